"""Traversals: a fluent, immutable builder that binds each step to the catalogue as it is added.

A traversal is a list of branches. A branch is one chain of labels, fixed when the plan is built, with a lazy DataFrame:
position k of its path has the columns ``p{k}__id`` and, once a property is asked for, ``p{k}__<property>``. Labels, edge
fan-out and missing properties are pruned before a DataFrame exists; everything else is left to Catalyst. A far vertex
is joined only when a property of it is used, if the graph declares its edges' ends to exist.
"""

from __future__ import annotations

import dataclasses
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.functions.predicates import P
from weftgraph.operators import services
from weftgraph.plans.catalog import PropertyGraph, columns_id
from weftgraph.plans.storage import cut

JOIN_VALUES = 1000  # within() and without() of more values than this become joins,
JOIN_BYTES = 16_000_000  # broadcast joins up to this size
DEAL_BYTES = 4_000_000  # joins of two sides beyond JOIN_BYTES have a partition for so many bytes of the edges, as planned


@dataclasses.dataclass(frozen=True)
class Pos:
    kind: str  # vertex, edge, value
    label: str | None
    table: object
    prefix: str
    hydrated: bool = True
    origin: str = ""

    @property
    def id(self) -> Column:
        return F.col(self.prefix + ("value" if self.kind == "value" else "id"))

    def names(self) -> list[str]:
        if self.kind == "vertex":
            return list(self.table.df.columns)
        return self.table.properties if self.kind == "edge" else []


@dataclasses.dataclass(frozen=True)
class Branch:
    df: DataFrame
    path: tuple[Pos, ...]
    names: dict[str, int]
    loops: int = 0

    @property
    def here(self) -> Pos:
        return self.path[-1]

    def to(self, df: DataFrame, pos: Pos) -> Branch:
        return dataclasses.replace(self, df=df, path=(*self.path, pos))

    def where(self, condition: Column) -> Branch:
        return dataclasses.replace(self, df=self.df.where(condition))


class Steps:
    """An anonymous traversal: steps recorded for later."""

    def __init__(self, steps=()):
        self.steps = tuple(steps)

    def __getattr__(self, name):
        if name.startswith("__"):
            raise AttributeError(name)
        return lambda *a, **k: Steps((*self.steps, (name, a, k)))

    def uses(self, *names) -> bool:
        return any(n in names or any(isinstance(x, Steps) and x.uses(*names) for x in (*a, *k.values())) for n, a, k in self.steps)


__ = Steps()
HOPS = {"out", "in_", "both"}
EDGE_HOPS = {"out_e", "in_e", "both_e"}
REDUCERS = {"count": F.count, "max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}
FILTERS = {"has", "has_not", "has_label", "has_id", "has_key", "and_", "or_", "not_", "loops", "where"}


class GraphSource:
    def __init__(self, graph: PropertyGraph):
        self.graph = graph

    def V(self, *ids) -> Traversal:
        """All vertices, or those of the given ids (of whatever label has such ids); a null id matches nothing."""
        branches = []
        for v in self.graph.vertices.values():
            df = v.df.select(v.id().alias("p0__id"), *(F.col(c).alias(f"p0__{c}") for c in v.df.columns if c != "id"))
            branches.append(Branch(df, (Pos("vertex", v.label, v, "p0__"),), {}))
        t = Traversal(self.graph, branches)
        return t.has_id(P.within(*ids)) if ids else t

    def E(self, *labels, ids=()) -> Traversal:
        """All edges, or those of the given labels. ``ids``: dicts of values of an edge's key columns (or, where it has none, of
        its ends and properties); a plain value is that of a single key column. Labels without these columns have none."""
        branches = []
        for e in self.graph.edges:
            if labels and e.label not in labels:
                continue
            b = Branch(_edge_frame(self.graph, e, "p0__", True), (Pos("edge", e.label, e, "p0__", origin="out"),), {})
            if ids:
                fields = b.df.schema["p0__id"].dataType.names
                wanted = [x if isinstance(x, dict) else {fields[0]: x} for x in ids if x is not None and (isinstance(x, dict) or len(fields) == 1)]
                wanted = [x for x in wanted if set(x) <= set(fields)]
                if not wanted:
                    continue
                one = [reduce(lambda p, q: p & q, (F.col(f"p0__id.{k}") == F.lit(v) for k, v in x.items())) for x in wanted]
                b = b.where(reduce(lambda p, q: p | q, one))
            branches.append(b)
        return Traversal(self.graph, branches)

    def call(self, service: str, **parameters) -> Traversal:
        """Starts with the rows of a service of kind "start"."""
        return Traversal(self.graph, []).follow(services.call(service, None, kind="start", graph=self.graph, **parameters))

    def inject(self, *values) -> Traversal:
        df = self.graph.spark.createDataFrame([(v,) for v in values], ["p0__value"])
        return Traversal(self.graph, [Branch(df, (Pos("value", None, None, "p0__"),), {})])

    def union(self, *starts: Traversal) -> Traversal:
        return Traversal(self.graph, [b for t in starts for b in t.branches])


def _planned(df: DataFrame) -> int:
    """Bytes of the rows as the optimizer reckons from the files' sizes, or of all that a join or union reads; 0 where unknown."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(str(x.stats().sizeInBytes())) for x in ([plan] if leaves.size() == 1 else [leaves.apply(k) for k in range(leaves.size())])]
    return sum(sizes) if all(x < 1 << 60 for x in sizes) else 0


def _dealt(frame: DataFrame, key: str, other: DataFrame) -> DataFrame:
    """Edges for a join with rows that are many too: in partitions whose number grows with them and which adaptive execution does
    not merge, as it goes by compressed bytes, of which ordered keys take very few."""
    size = _planned(frame)
    if size <= JOIN_BYTES or _planned(other) <= JOIN_BYTES:
        return frame
    return frame.repartition(max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // DEAL_BYTES), key)


def _edge_frame(graph, e, prefix, properties) -> DataFrame:
    src, dst = columns_id(e.src, graph.vertices[e.src_label].keys), columns_id(e.dst, graph.vertices[e.dst_label].keys)
    cols = [src.alias(prefix + "_src"), dst.alias(prefix + "_dst")]
    if properties:
        cols += [F.col(c).alias(prefix + c) for c in e.properties]
        cols.append((F.struct(*e.keys) if e.keys else F.struct(*e.src, *e.dst, *e.properties)).alias(prefix + "id"))
    return e.df.select(*cols)


class Traversal:
    """``branches``: a list, or a function that builds it when first asked for. ``merged``: a function that builds the same
    rows merged by their last element, with their number in ``_bulk``, for results that don't need the paths."""

    def __init__(self, graph: PropertyGraph, branches, scope=None, merged=None, ordered=(), stored=None):
        self.graph, self.scope, self._merged, self.ordered, self.stored = graph, scope, merged, tuple(ordered), dict(stored or {})
        self._branches = branches if callable(branches) else list(branches)

    @property
    def branches(self) -> list[Branch]:
        if callable(self._branches):
            self._branches = self._branches()
        return self._branches

    def _new(self, branches) -> Traversal:
        return Traversal(self.graph, branches, self.scope, ordered=self.ordered, stored=self.stored)

    def _each(self, f) -> Traversal:
        return self._new([x for b in self.branches for x in f(b)])

    def _run(self, steps: Steps, branches, scope=None) -> Traversal:
        t = Traversal(self.graph, branches, scope)
        for name, a, k in steps.steps:
            t = getattr(t, name)(*a, **k)
        return t

    # Properties

    def _hydrate(self, b: Branch, k: int) -> Branch:
        pos = b.path[k]
        if pos.hydrated:
            return b
        v = pos.table
        props = v.df.select(v.id().alias(pos.prefix + "_key"), *(F.col(c).alias(pos.prefix + c) for c in v.df.columns if c != "id"))
        df = b.df.join(props, F.col(pos.prefix + "id") == F.col(pos.prefix + "_key")).drop(pos.prefix + "_key")
        path = tuple(dataclasses.replace(p, hydrated=True) if p.prefix == pos.prefix else p for p in b.path)
        return dataclasses.replace(b, df=df, path=path)

    def _prop(self, b: Branch, k: int, name: str) -> tuple[Branch, Column | None]:
        """A property (or id, label, value) of a position; None where the label lacks it."""
        pos = b.path[k]
        if pos.kind == "value":
            kind = b.df.schema[pos.prefix + "value"].dataType if name != "value" else None
            if isinstance(kind, T.StructType) and name in kind.names:
                return b, pos.id[name]
            if isinstance(kind, T.MapType):
                return b, F.element_at(pos.id, F.lit(name))
            return b, pos.id if name in ("id", "value") else None
        if name == "label":
            return b, F.lit(pos.label)
        if name == "id":
            return b, pos.id
        if pos.kind == "vertex" and name in pos.table.keys:  # part of the id: no join
            return b, pos.id if len(pos.table.keys) == 1 else pos.id[name]
        if name in pos.names() or (pos.kind == "vertex" and pos.hydrated and pos.prefix + name in b.df.columns):
            b = self._hydrate(b, k)
            return b, F.col(pos.prefix + name)
        return (b, F.col(pos.prefix + name)) if pos.prefix + name in b.df.columns else (b, None)

    def _spec(self, b: Branch, spec: str) -> tuple[Branch, Column | None]:
        """``.name``: of the current position; ``x.name``: of the position named x; ``loops``; ``path``; an anonymous traversal:
        its count, max, min, sum or mean if it ends with one, else its least result."""
        if isinstance(spec, Steps):
            return self._child(b, spec)
        if spec == "loops":
            return b, F.lit(b.loops)
        if spec == "path":
            return b, self._path(b)
        at, _, name = spec.rpartition(".")
        if at and at not in b.names:
            return b, None
        return self._prop(b, b.names[at] if at else len(b.path) - 1, name)

    def _child(self, b: Branch, steps: Steps) -> tuple[Branch, Column]:
        """A column of what a child yields for each row: reduced by its last step, or the least."""
        how = steps.steps[-1][0] if steps.steps and steps.steps[-1][0] in REDUCERS else None
        child = Steps(steps.steps[:-1]) if how else steps
        keys = self._keys(b, child)
        seed = dataclasses.replace(b, df=b.df if len(keys) > 1 else b.df.dropDuplicates(keys))
        name = f"_c{len(b.df.columns)}"
        near = self._near(b, child) if how == "count" else None
        if near is not None:
            found = [df.withColumn("_v", F.lit(1)) for df in near]
        else:
            found = [x.df.select(*(F.col(k).alias("_s" + k) for k in keys), (F.lit(1) if how == "count" else x.here.id).alias("_v")) for x in self._run(child, [seed]).branches]
        if not found:
            return b, F.lit(0).cast("long") if how == "count" else F.lit(None)
        rows = reduce(DataFrame.unionByName, found)
        if len(keys) > 1:  # rows that repeat their keys would count twice
            times = b.df.groupBy(*(F.col(k).alias("_s" + k) for k in keys)).agg(F.count("*").alias("_times"))
            rows = rows.join(times, ["_s" + k for k in keys])
            value = F.count("*") / F.max("_times") if how == "count" else F.sum("_v") / F.max("_times") if how == "sum" else REDUCERS.get(how, F.min)("_v")
        else:
            value = REDUCERS.get(how, F.min)("_v")
        rows = rows.groupBy(*("_s" + k for k in keys)).agg((value.cast("long") if how == "count" else value).alias(name))
        on = reduce(lambda x, y: x & y, (F.col(k) == F.col("_s" + k) for k in keys))
        df = b.df.join(rows, on, "left").drop(*("_s" + k for k in keys))
        return dataclasses.replace(b, df=df), F.coalesce(name, F.lit(0)) if how == "count" else F.col(name)

    # Filters

    def has(self, key, value=None, *rest) -> Traversal:
        """has(key, P or value), has(label, key, P or value), has(key): the property is not null."""
        if rest:
            return self.has_label(key).has(value, *rest)
        if value is None:
            value = P(lambda c, o: c.isNotNull())
        p = P.of(value)

        def one(b):
            b, c = self._prop(b, len(b.path) - 1, key)
            if c is None:
                return [b] if p.absent else []
            if p.kind in ("within", "without") and len(p.values) > JOIN_VALUES:
                values = self.graph.spark.createDataFrame([(v,) for v in p.values], ["_value"])
                few = sum(len(v) if isinstance(v, (str, bytes)) else 8 for v in p.values) <= JOIN_BYTES
                how = "left_semi" if p.kind == "within" else "left_anti"
                return [dataclasses.replace(b, df=b.df.join(F.broadcast(values) if few else values, c == F.col("_value"), how))]
            if p.kind == "within" and not p.values:
                return []
            return [b.where(p(c, lambda name, b=b: F.col(b.here.prefix + name)))]

        return self._each(one)

    has_key = has

    def has_not(self, key) -> Traversal:
        return self.has(key, P(lambda c, o: c.isNull(), absent=True))

    def has_label(self, *labels) -> Traversal:
        """Names, or predicates over names."""
        return self._new([b for b in self.branches if any(x.plain(b.here.label) if isinstance(x, P) else x == b.here.label for x in labels)])

    def without_label(self, *labels) -> Traversal:
        return self._new([b for b in self.branches if b.here.label not in labels])

    def has_id(self, value) -> Traversal:
        p = P.of(value)

        def one(b):
            kind = dict(b.df.dtypes).get(b.here.prefix + "id", "")
            if p.values and (kind.startswith("struct") or (type(p.values[0]) is str) != (kind == "string")):
                return []  # ids of another kind belong to other labels
            return [b.where(p(b.here.id))]

        return self._each(one)

    def is_(self, value) -> Traversal:
        return self._each(lambda b: [b.where(P.of(value)(b.here.id))])

    def filter(self, condition) -> Traversal:
        """A function from a column getter to a boolean column."""

        def one(b):
            missing = False

            def get(name):
                nonlocal b, missing
                b, c = self._prop(b, len(b.path) - 1, name)
                missing |= c is None
                return F.lit(None) if c is None else c

            c = condition(get)
            return [] if missing else [b.where(c)]

        return self._each(one)

    def loops(self, value) -> Traversal:
        return self._each(lambda b: [b.where(P.of(value)(F.lit(b.loops)))])

    def _keys(self, b: Branch, steps: Steps) -> list[str]:
        """What a child's results depend on: the current element, and all of the path if the child looks back."""
        back = steps.uses("select", "where_ab", "simple_path", "cyclic_path", "match", "from_", "path")
        return list(dict.fromkeys(p.prefix + ("value" if p.kind == "value" else "id") for p in (b.path if back else b.path[-1:])))

    def _near(self, b: Branch, steps: Steps) -> list[DataFrame] | None:
        """For a child of one hop, the near ends of its edges under the key's name: one row for each of its results, without going by
        the rows at hand. None for any other child, or if edges may lead nowhere."""
        (name, labels, _), *more = steps.steps or (("", (), {}),)
        if more or b.here.kind != "vertex" or not (name in HOPS and self.graph.referential or name in EDGE_HOPS):
            return None
        ends = {"out": ("out",), "in": ("in",), "both": ("out", "in")}[name.removesuffix("_e").rstrip("_")]
        found = []
        for e in self.graph.edges:
            for end in ends:
                if (not labels or e.label in labels) and (e.src_label if end == "out" else e.dst_label) == b.here.label:
                    near = f"_s{b.here.prefix}id"
                    frame = _edge_frame(self.graph, e, "_near", False).select(F.col("_near_src" if end == "out" else "_near_dst").alias(near))
                    found.append(_dealt(frame, near, b.df))
        return found

    def _starts(self, b: Branch, steps: Steps) -> tuple[list[str], DataFrame | None]:
        """The distinct keys of the rows for which a child yields anything (of one hop, of all rows there could be)."""
        keys = self._keys(b, steps)
        if (near := self._near(b, steps)) is not None:
            return keys, reduce(DataFrame.unionByName, near).distinct() if near else None
        seed = dataclasses.replace(b, df=b.df if len(keys) > 1 else b.df.dropDuplicates(keys))
        found = [x.df.select(*(F.col(k).alias("_s" + k) for k in keys)) for x in self._run(steps, [seed]).branches]
        return keys, reduce(DataFrame.unionByName, found).distinct() if found else None

    def _exists(self, b: Branch, steps: Steps, want=True) -> list[Branch]:
        keys, found = self._starts(b, steps)
        if found is None:
            return [] if want else [b]
        on = reduce(lambda x, y: x & y, (F.col(k) == F.col("_s" + k) for k in keys))
        return [dataclasses.replace(b, df=b.df.join(found, on, "left_semi" if want else "left_anti"))]

    def _flag(self, b: Branch, steps: Steps) -> tuple[Branch, Column]:
        """A boolean column: whether the child yields anything for the row."""
        out = F.lit(True)
        if len(steps.steps) > 1 and any(n not in FILTERS for n, _, _ in steps.steps):
            return self._flag_join(b, steps)
        for name, a, k in steps.steps:
            if name in ("and_", "or_", "where", "not_") and all(isinstance(x, Steps) for x in a):
                flags = []
                for x in a:
                    b, f = self._flag(b, x)
                    flags.append(f)
                f = reduce((lambda x, y: x | y) if name == "or_" else (lambda x, y: x & y), flags)
                out &= ~f if name == "not_" else f
            elif name == "has_label":
                out &= F.lit(b.here.label in a)
            elif name == "loops":
                out &= P.of(a[0])(F.lit(b.loops))
            elif name == "has_id":
                out &= F.coalesce(P.of(a[0])(b.here.id), F.lit(False))
            elif name in ("has", "has_key", "has_not") and len(a) <= 2:
                b, c = self._prop(b, len(b.path) - 1, a[0])
                p = P(lambda c, o: c.isNull(), absent=True) if name == "has_not" else P.of(a[1]) if len(a) > 1 and a[1] is not None else P(lambda c, o: c.isNotNull())
                out &= F.lit(p.absent) if c is None else F.coalesce(p(c, lambda n, b=b: F.col(b.here.prefix + n)), F.lit(False))
            else:
                b, f = self._flag_join(b, Steps([(name, a, k)]))
                out &= f
        return b, out

    def _flag_join(self, b, steps):
        keys, found = self._starts(b, steps)
        if found is None:
            return b, F.lit(False)
        name = f"_f{len(b.df.columns)}"
        on = reduce(lambda x, y: x & y, (F.col(k) == F.col("_s" + k) for k in keys))
        df = b.df.join(found.withColumn(name, F.lit(True)), on, "left").drop(*("_s" + k for k in keys))
        return dataclasses.replace(b, df=df), F.coalesce(F.col(name), F.lit(False))

    def where(self, *children) -> Traversal:
        """Keeps a row once if the child yields anything: a semi join."""
        t = self
        for c in children:
            t = t.and_(c)
        return t

    def and_(self, *children) -> Traversal:
        def one(b):
            out = [b]
            for c in children:
                if all(n in FILTERS for n, _, _ in c.steps):
                    flagged = [self._flag(x, c) for x in out]
                    out = [x.where(f) for x, f in flagged]
                else:
                    out = [y for x in out for y in self._exists(x, c)]
            return out

        return self._each(one)

    def or_(self, *children) -> Traversal:
        def one(b):
            b, f = self._flag(b, Steps([("or_", children, {})]))
            return [b.where(f)]

        return self._each(one)

    def not_(self, child: Steps) -> Traversal:
        def one(b):
            if all(n in FILTERS for n, _, _ in child.steps):
                b, f = self._flag(b, child)
                return [b.where(~f)]
            return self._exists(b, child, want=False)

        return self._each(one)

    def where_ab(self, a: str, op: str, b: str, by="id") -> Traversal:
        """Compares two named positions, by one property or one for each (a pair); elements of different labels are never equal."""
        ops = {"eq": lambda x, y: x == y, "neq": lambda x, y: x != y, "lt": lambda x, y: x < y, "lte": lambda x, y: x <= y, "gt": lambda x, y: x > y, "gte": lambda x, y: x >= y}
        by_a, by_b = (by, by) if isinstance(by, str) else by

        def one(br):
            self._known(a, b)
            if by == "id" and br.path[br.names[a]].label != br.path[br.names[b]].label:
                return [br] if op == "neq" else []
            br, x = self._spec(br, f"{a}.{by_a}")
            br, y = self._spec(br, f"{b}.{by_b}")
            return [] if x is None or y is None else [br.where(ops[op](x, y))]

        return self._each(one)

    def where_as(self, name: str, key: str, value) -> Traversal:
        """Keeps rows whose named position has a property that meets any predicate (text, full text, arrays and others too)."""

        def one(b):
            self._known(name)
            b, c = self._spec(b, f"{name}.{key}")
            p, prefix = P.of(value), b.path[b.names[name]].prefix
            return ([b] if p.absent else []) if c is None else [b.where(p(c, lambda n: F.col(prefix + n)))]

        return self._each(one)

    def _known(self, *names: str) -> None:
        """Unknown names are an error; a name that only some branches have is none."""
        for name in names:
            if self.branches and all(name not in b.names for b in self.branches):
                raise KeyError(f"no position is named {name}")

    def simple_path(self) -> Traversal:
        """No vertex twice. Checked step by step, so only the last vertex needs comparing inside a repeat."""

        def one(b):
            vs, clash = [p for p in b.path if p.kind == "vertex"], []
            for i, p in enumerate(vs):
                clash += [p.id == q.id for q in vs[:i] if q.label == p.label and q.prefix != p.prefix]
            return [b.where(~reduce(lambda x, y: x | y, clash))] if clash else [b]

        return self._each(one)

    def cyclic_path(self) -> Traversal:
        def one(b):
            vs, clash = [p for p in b.path if p.kind == "vertex"], []
            for i, p in enumerate(vs):
                clash += [p.id == q.id for q in vs[:i] if q.label == p.label]
            return [b.where(reduce(lambda x, y: x | y, clash))] if clash else []

        return self._each(one)

    # Navigation

    def _hop(self, b: Branch, direction: str, labels, edge: bool) -> list[Branch]:
        out = []
        if b.here.kind != "vertex":
            return out
        for e in self.graph.edges:
            near, far = (e.src_label, e.dst_label) if direction == "out" else (e.dst_label, e.src_label)
            if (labels and e.label not in labels) or near != b.here.label:
                continue
            prefix = f"p{len(b.path)}__"
            a, z = ("_src", "_dst") if direction == "out" else ("_dst", "_src")
            frame = _edge_frame(self.graph, e, prefix, edge)
            df = b.df.join(_dealt(frame, prefix + a, b.df), b.here.id == F.col(prefix + a))
            if edge:
                out.append(b.to(df, Pos("edge", e.label, e, prefix, origin=direction)))
                continue
            df = df.withColumnRenamed(prefix + z, prefix + "id").drop(prefix + a)
            x = b.to(df, Pos("vertex", far, self.graph.vertices[far], prefix, hydrated=False))
            out.append(x if self.graph.referential else self._hydrate(x, len(x.path) - 1))
        return out

    def out(self, *labels):
        return self._each(lambda b: self._hop(b, "out", labels, False))

    def in_(self, *labels):
        return self._each(lambda b: self._hop(b, "in", labels, False))

    def both(self, *labels):
        return self._each(lambda b: self._hop(b, "out", labels, False) + self._hop(b, "in", labels, False))

    def out_e(self, *labels):
        return self._each(lambda b: self._hop(b, "out", labels, True))

    def in_e(self, *labels):
        return self._each(lambda b: self._hop(b, "in", labels, True))

    def both_e(self, *labels):
        return self._each(lambda b: self._hop(b, "out", labels, True) + self._hop(b, "in", labels, True))

    def _end(self, b: Branch, side: str) -> list[Branch]:
        e, prefix = b.here.table, f"p{len(b.path)}__"
        label = e.dst_label if side == "in" else e.src_label
        df = b.df.withColumn(prefix + "id", F.col(b.here.prefix + ("_dst" if side == "in" else "_src")))
        x = b.to(df, Pos("vertex", label, self.graph.vertices[label], prefix, hydrated=False))
        return [x if self.graph.referential else self._hydrate(x, len(x.path) - 1)]

    def in_v(self):
        return self._each(lambda b: self._end(b, "in"))

    def out_v(self):
        return self._each(lambda b: self._end(b, "out"))

    def both_v(self):
        return self._each(lambda b: self._end(b, "out") + self._end(b, "in"))

    def other_v(self):
        return self._each(lambda b: self._end(b, "in" if b.here.origin == "out" else "out"))

    def V(self, *ids) -> Traversal:
        """A scan in the middle: every vertex for every row. The graph must be small; a cross join is what it means."""
        start = GraphSource(self.graph).V(*ids)

        def one(b):
            out = []
            for s in start.branches:
                prefix = f"p{len(b.path)}__"
                df = s.df.select(*(F.col(c).alias(prefix + c[4:]) for c in s.df.columns))
                out.append(b.to(b.df.crossJoin(df), dataclasses.replace(s.here, prefix=prefix)))
            return out

        return self._each(one)

    # Binding and values

    def as_(self, name: str) -> Traversal:
        return self._each(lambda b: [dataclasses.replace(b, names=b.names | {name: len(b.path) - 1})])

    def select(self, *names: str, by=None) -> Traversal:
        """Goes back to a named position. Several names: a value with a field for each, ``by``: a property of each, or one for
        all; ids by default."""
        self._known(*names)
        if len(names) == 1 and by is None:
            return self._each(lambda b: [dataclasses.replace(b, path=(*b.path, b.path[b.names[names[0]]]))] if names[0] in b.names else [])
        each = dict.fromkeys(names, by or "id") if by is None or isinstance(by, str) else dict(zip(names, by, strict=True))
        return self.project(**{n: f"{n}.{k}" for n, k in each.items()})

    def project(self, **specs) -> Traversal:
        """A value with a field for each spec; missing properties are null."""

        def one(b):
            fields = []
            for name, spec in specs.items():
                b, c = spec_column(self, b, spec)
                fields.append((F.lit(None) if c is None else c).alias(name))
            return b, F.struct(*fields)

        return self._map(one)

    def values(self, *keys) -> Traversal:
        """A row per non-null property."""

        def one(b):
            out = []
            for key in keys or b.here.names():
                x, c = self._prop(b, len(b.path) - 1, key)
                if c is not None:
                    prefix = f"p{len(b.path)}__"
                    out.append(x.to(x.df.withColumn(prefix + "value", c).where(F.col(prefix + "value").isNotNull()), Pos("value", None, None, prefix, origin=key)))
            return out

        if self._merged is None:
            return self._each(one)
        return Traversal(self.graph, lambda: self._each(one).branches, merged=lambda: [x for b in self._merged() for x in one(b)])

    def id(self) -> Traversal:
        return self._map(lambda b: self._prop(b, len(b.path) - 1, "id"))

    def label(self) -> Traversal:
        return self._map(lambda b: (b, F.lit(b.here.label)))

    def constant(self, value) -> Traversal:
        return self._map(lambda b: (b, F.lit(value)))

    def map(self, f) -> Traversal:
        """A value computed by a function from a getter (spec -> column) to a column; rows whose label lacks a property go."""

        def one(b):
            missing = False

            def get(spec):
                nonlocal b, missing
                b, c = self._spec(b, spec if "." in spec else "." + spec)
                missing |= c is None
                return F.lit(None) if c is None else c

            c = f(get)
            return b, None if missing else c

        return self._map(one)

    def math(self, expression: str) -> Traversal:
        """A SQL expression over ``_``, the current value."""
        return self._map(lambda b: (b, F.expr(re.sub(r"\b_\b", f"`{b.here.prefix}value`", expression))))

    def _map(self, f) -> Traversal:
        def one(b):
            b, c = f(b)
            if c is None:
                return []
            prefix = f"p{len(b.path)}__"
            return [b.to(b.df.withColumn(prefix + "value", c), Pos("value", None, None, prefix))]

        return self._each(one)

    def fun(self, name: str, expression: str) -> Traversal:
        """Adds a property computed by a SQL expression over the element's properties."""

        def one(b):
            b = self._hydrate(b, len(b.path) - 1)
            plain = b.df.withColumns({c: F.col(b.here.prefix + c) for c in b.here.names()}).withColumn(b.here.prefix + name, F.expr(expression))
            return [dataclasses.replace(b, df=plain.drop(*b.here.names()))]

        return self._each(one)

    def sack(self, name: str, start, op) -> Traversal:
        """Sets (start given) or changes a value that rows carry: ``op`` is a function of (sack, getter)."""

        def one(b):
            box = {"b": b}

            def get(spec):
                box["b"], c = self._spec(box["b"], spec)
                return c

            old = F.lit(start) if start is not None else F.col(f"_sack_{name}")
            new = op(old, get)
            return [dataclasses.replace(box["b"], df=box["b"].df.withColumn(f"_sack_{name}", new))]

        return self._each(one)

    # Values made of whole results

    def follow(self, rows: DataFrame) -> Traversal:
        """Goes on with the rows of a result as values: a single column, or a value with a field for each column."""
        cols = rows.columns
        df = rows.select((F.col(cols[0]) if len(cols) == 1 else F.struct(*cols)).alias("p0__value"))
        return Traversal(self.graph, [Branch(df, (Pos("value", None, None, "p0__"),), {})], stored=self.stored)

    def store(self, name: str, step: str, *arguments, **named) -> Traversal:
        """Keeps the result of a step that ends a traversal under a name, for cap(), and goes on as if it weren't there."""
        out = self._new(self.branches)
        out.stored[name] = getattr(self, step)(*arguments, **named)
        return out

    def aggregate(self, name: str, spec=".id") -> Traversal:
        """Keeps the values of a spec under a name, for cap_list() and where_stored()."""
        return self.store(name, "table", value=spec)

    def cap(self, name: str) -> DataFrame:
        """What was kept under a name."""
        return self.stored[name]

    def cap_list(self, name: str) -> DataFrame:
        """value: the sorted list of the values kept under a name; bounded use only, as the list lies in one row."""
        return self.stored[name].agg(F.sort_array(F.collect_list("value")).alias("value"))

    def where_stored(self, name: str, spec=".id", inside=True) -> Traversal:
        """Rows whose spec is among the values kept under a name, or isn't."""

        def one(b):
            b, c = self._spec(b, spec)
            if c is None:
                return [] if inside else [b]
            values = self.stored[name].select(F.col("value").alias("_kept")).distinct()
            return [dataclasses.replace(b, df=b.df.join(values, c == F.col("_kept"), "left_semi" if inside else "left_anti"))]

        return self._each(one)

    def then(self, step: str, *arguments, **named) -> Traversal:
        """Goes on after a step that ends a traversal: then("group_count", ".label").has("count", P.gt(3))."""
        return self.follow(getattr(self, step)(*arguments, **named))

    def unfold(self) -> Traversal:
        """A row for each item of a list, or each entry (key, value) of a map."""

        def one(b):
            prefix = f"p{len(b.path)}__"
            kind = b.df.schema[b.here.prefix + "value"].dataType if b.here.kind == "value" else None
            if not isinstance(kind, (T.ArrayType, T.MapType)):
                return [b]
            items = F.map_entries(b.here.id) if isinstance(kind, T.MapType) else b.here.id
            return [b.to(b.df.withColumn(prefix + "value", F.explode(items)), Pos("value", None, None, prefix))]

        return self._each(one)

    def path_value(self) -> Traversal:
        """The path so far as a list of texts, row by row."""
        return self._map(lambda b: (b, F.split(self._path(b), ">")))

    def map_value(self, *keys) -> Traversal:
        """id, label and properties of the current element as a map of texts, row by row; nulls are left out."""

        def one(b):
            b = self._hydrate(b, len(b.path) - 1)
            names = [k for k in (keys or b.here.names()) if k in b.here.names()]
            entries = [F.struct(F.lit("id").alias("key"), b.here.id.cast("string").alias("value")), F.struct(F.lit("label").alias("key"), F.lit(b.here.label).alias("value"))]
            for k in names:
                b, c = self._prop(b, len(b.path) - 1, k)
                entries.append(F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")))
            return b, F.map_from_entries(F.filter(F.array(*entries), lambda x: x["value"].isNotNull()))

        return self._map(one)

    def identity(self) -> Traversal:
        return self

    def none(self) -> Traversal:
        return self._each(lambda b: [b.where(F.lit(False))])

    def flat_map(self, child: Steps) -> Traversal:
        return self._each(lambda b: self._run(child, [b]).branches)

    def side_effect(self, child: Steps) -> Traversal:
        """The child is planned, so that its mistakes show, and its results are not used."""
        self._run(child, self.branches)
        return self

    def call(self, service: str, **parameters) -> Traversal:
        """The results of a service for the current vertices: of kind "streaming", (id, value) rows for the distinct ids of
        each label; of kind "barrier", any rows for all elements (label, id) together, with which the traversal goes on."""
        if services.kind(service) == "barrier":
            return self.follow(services.call(service, self.table(label=".label", id=".id"), **parameters))

        def one(b):
            rows = services.call(service, b.df.select(b.here.id.alias("id")).distinct(), **parameters)
            value = next(c for c in rows.columns if c != "id")
            prefix = f"p{len(b.path)}__"
            df = b.df.join(rows.select(F.col("id").alias("_call"), F.col(value).alias(prefix + "value")), b.here.id == F.col("_call")).drop("_call")
            return [b.to(df, Pos("value", None, None, prefix))]

        return self._each(one)

    def drop(self) -> PropertyGraph:
        """The graph without the current elements: vertices with the edges at them, edges, or (after values()) properties."""
        graph = self.graph
        for b in self.branches:
            if b.here.kind == "vertex":
                graph = graph.drop_vertices(b.here.label, b.df.select(b.here.id.alias("id")))
            elif b.here.kind == "edge":
                graph = graph.drop_edge_rows(b.here.table, b.df.select(b.here.id.alias("id")))
            else:
                owner = b.path[-2] if len(b.path) > 1 else None
                if owner is None or owner.kind != "vertex" or not b.here.origin:
                    raise ValueError("drop() of a value that is no property")
                graph = graph.remove_property(owner.label, b.here.origin, b.df.select(owner.id.alias("id")))
        return graph

    # Branching

    def union(self, *children: Steps) -> Traversal:
        return self._each(lambda b: [x for c in children for x in self._run(c, [b]).branches])

    def optional(self, child: Steps) -> Traversal:
        return self._each(lambda b: self._run(child, [b]).branches + self._exists(b, child, want=False))

    def coalesce(self, *children: Steps) -> Traversal:
        """The first child that yields anything, row by row."""

        def one(b):
            out, rest = [], [b]
            for c in children:
                out += [x for r in rest for x in self._run(c, [r]).branches]
                rest = [x for r in rest for x in self._exists(r, c, want=False)]
            return out

        return self._each(one)

    def choose(self, test: Steps, then: Steps, other: Steps | None = None) -> Traversal:
        def one(b):
            b, f = self._flag(b, test)
            no = [b.where(~f)]
            return self._run(then, [b.where(f)]).branches + (self._run(other, no).branches if other else no)

        return self._each(one)

    def branch(self, key, options: dict, none: Steps | None = None, any_: Steps | None = None) -> Traversal:
        """Routes rows by the value of a property or of an anonymous traversal; ``none`` takes the unmatched, ``any_`` all."""

        def one(b):
            b, c = self._child(b, key) if isinstance(key, Steps) else self._prop(b, len(b.path) - 1, key)
            out = self._run(any_, [b]).branches if any_ else []
            if c is not None:
                for value, steps in options.items():
                    out += self._run(steps, [b.where(c == value)]).branches
            if none:
                rest = b if c is None else b.where(F.coalesce(~c.isin(list(options)), F.lit(True)))
                out += self._run(none, [rest]).branches
            return out

        return self._each(one)

    def local(self, child: Steps) -> Traversal:
        """The child for each row on its own: ranges and reductions inside count per row."""
        return self._each(lambda b: self._run(child, [b], scope=[p.prefix + ("value" if p.kind == "value" else "id") for p in b.path]).branches)

    def local_count(self, child: Steps) -> Traversal:
        """The number of the child's results for each row, 0 among them."""
        return self.local_reduce(child, "count")

    def local_reduce(self, child: Steps, how: str) -> Traversal:
        """count, max, min, sum or mean of the child's results for each row; a row without results goes, but for its count."""

        def one(b):
            b, c = self._child(b, Steps((*child.steps, (how, (), {}))))
            prefix = f"p{len(b.path)}__"
            df = b.df.withColumn(prefix + "value", c)
            return [b.to(df if how == "count" else df.where(F.col(prefix + "value").isNotNull()), Pos("value", None, None, prefix))]

        return self._each(one)

    def match(self, *patterns: Steps) -> Traversal:
        """Patterns ``__.as_(a)....as_(b)`` joined on shared names; the first one's start is the current position. Of those that can
        come next, the ones that filter by a property come first, so that fewer rows are multiplied by the others."""
        t, left, known = self, list(patterns), set()
        for n in range(len(patterns)):
            ready = [x for x in left if n and x.steps[0][1][0] in known and any(name in ("has", "has_id", "has_not", "is_") for name, _, _ in x.steps)]
            pattern = (ready or left)[0]
            left = [x for x in left if x is not pattern]
            (_, (first,), _), *middle, (_, (last,), _) = pattern.steps
            known |= {first, last}
            t = t.as_(first) if n == 0 and all(first not in b.names for b in t.branches) else t.select(first)
            t = t._run(Steps(middle), t.branches)
            if all(last in b.names for b in t.branches):
                t = t.as_("_match").where_ab("_match", "eq", last)
            else:
                t = t.as_(last)
        return t

    def dedup(self, *by: str) -> Traversal:
        """Distinct current elements (or values), each with the path and the names of one of its rows; with ``by``, one row for
        each combination of specs."""
        if by:
            return self._each(lambda b: [self._distinct(b, by)])
        out, seen = [], {}
        for b in self.branches:
            key = b.here.prefix + ("value" if b.here.kind == "value" else "id")
            df = b.df.dropDuplicates([key])
            earlier = seen.setdefault((b.here.kind, b.here.label), [])
            if earlier:  # another branch with elements of this label
                taken = reduce(DataFrame.unionByName, earlier)
                df = df.join(taken, F.col(key).eqNullSafe(F.col("_taken")), "left_anti")
            earlier.append(b.df.select(F.col(key).alias("_taken")).distinct())
            out.append(dataclasses.replace(b, df=df))
        return self._new(out)

    def _distinct(self, b, by):
        names = []
        for k, spec in enumerate(by):
            b, c = self._spec(b, spec)
            b = dataclasses.replace(b, df=b.df.withColumn(f"_d{k}", F.lit(None) if c is None else c))
            names.append(f"_d{k}")
        return dataclasses.replace(b, df=b.df.dropDuplicates(names).drop(*names))

    def order(self, *by, shuffle: int | None = None) -> Traversal:
        """The order of what follows: of limit(), and of the rows of table(). ``by``: specs (with "-" descending), functions from
        a getter to a column, or anonymous traversals (see _spec); ``shuffle``: a seed for a hash of the path instead."""
        by = by or (("." + "id",) if shuffle is None else (lambda get: F.xxhash64(F.lit(shuffle), get("path")),))
        return Traversal(self.graph, self.branches, self.scope, ordered=by, stored=self.stored)

    def _order(self, b: Branch, by) -> tuple[Branch, list[tuple[Column, bool]]]:
        """(column, descending) of each spec."""
        out = []
        for spec in by:
            down = isinstance(spec, str) and spec.startswith("-")
            b, c = spec_column(self, b, spec[1:] if down else spec)
            out.append((F.lit(None) if c is None else c, down))
        return b, out

    def limit(self, n: int, by=(), skip=0) -> Traversal:
        """Inside local(): for each row. Ordered by the specs (or those of order()) and then by ids, so results repeat. Over several
        labels, each gives up to skip + n rows, and the first of these together are kept."""
        by = by or self.ordered

        def sort(keys):
            return [c.desc_nulls_first() if down else c.asc_nulls_last() for c, down in keys]

        def one(b):
            b, keys = self._order(b, by)
            order = [*sort(keys), *(p.id for p in b.path[::-1])]
            if self.scope is None:
                return [dataclasses.replace(b, df=b.df.orderBy(*order).offset(skip).limit(n))]
            w = Window.partitionBy(*self.scope).orderBy(*order)
            df = b.df.withColumn("_rn", F.row_number().over(w)).where((F.col("_rn") > skip) & (F.col("_rn") <= skip + n)).drop("_rn")
            return [dataclasses.replace(b, df=df)]

        if len(self.branches) <= 1 or self.scope is not None:
            return self._each(one)
        first, ranks = [], []
        for k, b in enumerate(self.branches):
            b, keys = self._order(b, by)
            order = [*sort(keys), *(p.id for p in b.path[::-1])]
            top = b.df.orderBy(*order).limit(skip + n).withColumn("_rn", F.row_number().over(Window.orderBy(*order)))  # skip + n rows
            first.append(dataclasses.replace(b, df=top))
            ranks.append(top.select(F.lit(k).alias("_b"), "_rn", *(c.alias(f"_o{i}") for i, (c, _) in enumerate(keys))))
        names = [(F.col(f"_o{i}"), isinstance(x, str) and x.startswith("-")) for i, x in enumerate(by)]
        kept = reduce(DataFrame.unionByName, ranks).orderBy(*sort(names), "_b", "_rn").offset(skip).limit(n).select(F.col("_b").alias("_kb"), F.col("_rn").alias("_kr"))
        return self._new([dataclasses.replace(b, df=b.df.join(kept.where(F.col("_kb") == k), F.col("_rn") == F.col("_kr"), "left_semi").drop("_rn")) for k, b in enumerate(first)])

    # Repeat

    def repeat(self, body: Steps, times=None, until: Steps | None = None, emit=None, until_first=False, emit_first=False, most=100_000) -> Traversal:
        """do-while unless ``until_first``. ``emit``: True or a filter. Rows that dead-end without meeting ``until`` are
        dropped. With ``until``, each round's rows are written once, as ids with their flag, and an empty frontier ends the loop;
        rows still on their way after ``most`` rounds are an error. ``times`` rounds are run whatever their number.

        With ``times`` alone and a body of plain hops, count, max and min of what follows go by merged rows: neither the
        plan nor the frontier grows with the number of paths."""
        if times is None and until is None and emit is None:
            return self._new([])
        plain = until is None and emit is None and times and self.scope is None and body.steps
        if plain and all(name in HOPS for name, _, _ in body.steps) and all(b.here.kind == "vertex" for b in self.branches):
            return Traversal(self.graph, lambda: self._repeated(body, times).branches, merged=lambda: self._bulk(body, times))
        return self._repeated(body, times, until, emit, until_first, emit_first, most)

    def _narrow(self, b: Branch) -> Branch:
        """Without the properties that can be joined again by the vertices' ids."""
        gone, path = set(), []
        for pos in b.path:
            if pos.kind == "vertex":
                gone |= {pos.prefix + c for c in pos.table.df.columns if c != "id"}
                pos = dataclasses.replace(pos, hydrated=False)
            path.append(pos)
        return dataclasses.replace(b, df=b.df.drop(*gone), path=tuple(path))

    @staticmethod
    def _joined(branches: list[Branch]) -> list[Branch]:
        """Branches of the same chain of labels as one: a hop both ways doubles rows, not plans."""
        groups: dict = {}
        for b in branches:
            chain = tuple((p.kind, p.label, p.prefix, p.hydrated, p.origin, id(p.table) if p.kind == "edge" else 0) for p in b.path)
            groups.setdefault((chain, tuple(sorted(b.names.items())), tuple(sorted(b.df.columns))), []).append(b)
        return [g[0] if len(g) == 1 else dataclasses.replace(g[0], df=reduce(DataFrame.unionByName, (b.df for b in g))) for g in groups.values()]

    def _repeated(self, body, times, until=None, emit=None, until_first=False, emit_first=False, most=100_000) -> Traversal:
        out, now = [], [dataclasses.replace(b, loops=0) for b in self.branches]
        if times == 0:
            return self
        bounded = times is not None and until is None
        if not bounded:
            now = [self._narrow(b) for b in now]

        def split(branches, steps):
            """(rows that meet a child, the others), whose flag is written with them: the child runs once."""
            yes, no = [], []
            for b in branches:
                x, f = self._flag(b, steps)
                slim = self._narrow(x)
                keep = [c for c in slim.df.columns if not re.fullmatch(r"_[fc]\d+", c)]
                x, flagged = slim, cut(x.df.select(*keep, f.alias("_yes")), "repeat")
                x = dataclasses.replace(x, df=flagged)
                yes.append(dataclasses.replace(x, df=flagged.where("_yes").drop("_yes")))
                no.append(dataclasses.replace(x, df=flagged.where("not _yes").drop("_yes")))
            return yes, no

        def emitted(branches):
            if emit is True:
                return branches
            flagged = [self._flag(b, emit) for b in branches]
            return [b.where(f) for b, f in flagged]

        for depth in range(1, (most if times is None else times) + 1):
            if until is not None and until_first:
                done, now = split(now, until)
                out += done
            if emit is not None and emit_first:
                out += emitted(now)
            now = self._joined([dataclasses.replace(b, loops=depth) for b in self._run(body, now).branches])
            if not now or depth == times:
                out += now
                break
            if until is not None and not until_first:
                done, now = split(now, until)
                out += done
            elif not bounded:
                now = [dataclasses.replace(b, df=cut(self._narrow(b).df, "repeat"), path=self._narrow(b).path) for b in now]
            if emit is not None and not emit_first:
                out += emitted(now)
            if not bounded:
                now = [b for b in now if not b.df.isEmpty()]
                if not now:
                    break
            elif depth % 16 == 0:
                now = [dataclasses.replace(b, df=cut(b.df, "repeat")) for b in now]
        else:
            raise RuntimeError(f"rows left after {most} rounds of a repeat")
        return self._new(out)

    def repeat_counted(self, body: Steps, times: int) -> DataFrame:
        """label, id, n: where ``times`` rounds of the body end, and on how many paths. Rows are merged by element after each
        round, so that a frontier never outgrows the vertices."""
        parts = [b.df.select(F.lit(b.here.label).alias("label"), b.here.id.alias("id"), F.col("_bulk").alias("n")) for b in self._bulk(body, times)]
        return reduce(DataFrame.unionByName, parts)

    def _bulk(self, body: Steps, times: int) -> list[Branch]:
        """One branch per label: its elements (p0__id) and the number of paths to each (_bulk)."""

        def merge(branches, n):
            grown: dict[str, list[DataFrame]] = {}
            for b in branches:
                grown.setdefault(b.here.label, []).append(b.df.select(b.here.id.alias("p0__id"), n.alias("_bulk")))
            return [
                Branch(reduce(DataFrame.unionByName, dfs).groupBy("p0__id").agg(F.sum("_bulk").alias("_bulk")), (Pos("vertex", k, self.graph.vertices[k], "p0__", hydrated=False),), {})
                for k, dfs in grown.items()
            ]

        now = merge(self.branches, F.lit(1).cast("long"))
        for _ in range(times):
            now = merge(self._run(body, now).branches, F.col("_bulk"))
        return now

    # Results

    def table(self, order=(), limit=None, skip=0, tail=None, distinct=False, **columns) -> DataFrame:
        """A row per result: columns are specs. ``order``: output columns, "-" for descending; nulls last ascending."""
        parts, hidden = [], [] if order else [f"_order{k}" for k in range(len(self.ordered))]
        for b in self.branches:
            cols = []
            for name, spec in columns.items():
                b, c = spec_column(self, b, spec)
                cols.append((F.lit(None) if c is None else c).alias(name))
            if hidden:
                b, by = self._order(b, self.ordered)
                cols += [c.alias(n) for n, (c, _) in zip(hidden, by, strict=True)]
            parts.append(b.df.select(*cols))
        if not parts:
            return self.graph.spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
        out = reduce(DataFrame.unionByName, parts)
        if distinct:
            out = out.distinct()
        keys = [(k.lstrip("-"), k.startswith("-") != (tail is not None)) for k in order]
        keys += [(n, (isinstance(x, str) and x.startswith("-")) != (tail is not None)) for n, x in zip(hidden, self.ordered, strict=False)]
        if keys:
            out = out.orderBy(*(F.col(k).desc_nulls_first() if down else F.col(k).asc_nulls_last() for k, down in keys))
        out = out.drop(*hidden)
        if skip:
            out = out.offset(skip)
        return out.limit(tail if tail is not None else limit) if tail is not None or limit is not None else out

    def _path(self, b: Branch, by=None, sep=">"):
        parts, seen = [], None
        for k, pos in enumerate(b.path):
            if pos.prefix == seen:
                continue
            seen = pos.prefix
            if by:
                b, c = self._prop(b, k, by if isinstance(by, str) else by.get(pos.label, "id"))
                parts.append(F.coalesce(c.cast("string"), F.lit("")) if c is not None else F.lit(""))
            else:
                parts.append(F.concat(F.lit(f"{pos.label}:" if pos.label else ""), pos.id.cast("string")))
        return F.concat_ws(sep, *parts) if not by else (b, F.concat_ws(sep, *parts))

    def path(self, by=None, sep=">") -> DataFrame:
        """path, length: the path as text; ``by``: a property, or one for each label."""
        parts = []
        for b in self.branches:
            b, c = self._path(b, by, sep) if by else (b, self._path(b, None, sep))
            parts.append(b.df.select(c.alias("path"), F.lit(len({p.prefix for p in b.path})).alias("length")))
        return reduce(DataFrame.unionByName, parts)

    def tree(self, by=None) -> DataFrame:
        """depth, path, n: the distinct path prefixes with the number of paths through each."""
        parts = []
        for b in self.branches:
            for k in range(1, len(b.path) + 1):
                x = dataclasses.replace(b, path=b.path[:k])
                x, c = self._path(x, by) if by else (x, self._path(x))
                parts.append(x.df.select(F.lit(k).alias("depth"), c.alias("path")))
        return reduce(DataFrame.unionByName, parts).groupBy("depth", "path").agg(F.count("*").alias("n"))

    def element_map(self, *keys) -> DataFrame:
        """id, label, properties (map of text; nulls left out), and for edges the ids and labels of both ends."""
        parts = []
        for b in self.branches:
            b = self._hydrate(b, len(b.path) - 1)
            pos = b.here
            names = [k for k in (keys or pos.names()) if k in pos.names()]
            entries = F.array(*(F.struct(F.lit(k).alias("key"), F.col(pos.prefix + k).cast("string").alias("value")) for k in names)) if names else F.array().cast("array<struct<key:string,value:string>>")
            cols = [pos.id.cast("string").alias("id"), F.lit(pos.label).alias("label"), F.map_from_entries(F.filter(entries, lambda x: x["value"].isNotNull())).alias("properties")]
            edge = pos.kind == "edge"
            for name, side, label in (("out", "_src", "src_label"), ("in", "_dst", "dst_label")):
                cols.append((F.col(pos.prefix + side).cast("string") if edge else F.lit(None).cast("string")).alias(f"{name}_id"))
                cols.append((F.lit(getattr(pos.table, label)) if edge else F.lit(None).cast("string")).alias(f"{name}_label"))
            parts.append(b.df.select(*cols))
        return reduce(DataFrame.unionByName, parts)

    def value_map(self, *keys) -> DataFrame:
        """properties: a map from key to the list of its values."""
        return self.element_map(*keys).select(F.transform_values("properties", lambda k, v: F.array(v)).alias("properties"))

    def _values(self, spec: str) -> DataFrame:
        return self.table(value=spec)

    def count(self) -> DataFrame:
        if self._merged is not None and (merged := self._merged()):
            counts = reduce(DataFrame.unionByName, (b.df.select("_bulk") for b in merged))
            return counts.agg(F.coalesce(F.sum("_bulk"), F.lit(0)).cast("long").alias("count"))
        parts = [b.df.select(F.lit(1).alias("x")) for b in self.branches]
        if not parts:
            return self.graph.spark.range(1).select(F.lit(0).cast("long").alias("count"))
        return reduce(DataFrame.unionByName, parts).agg(F.count("*").alias("count"))

    def reduce(self, how: str, spec=".value") -> DataFrame:
        """max, min, sum or mean over all labels together; no row over nothing. max and min pass over NaN, sum keeps it."""
        merged = self._merged is not None and how in ("max", "min") and spec == ".value"
        values = (Traversal(self.graph, self._merged()) if merged else self).table(value=spec)
        v = F.col("value")
        if how in ("max", "min") and dict(values.dtypes)["value"] in ("double", "float"):
            v = F.when(~F.isnan(v), v)
        f = {"max": F.max, "min": F.min, "sum": F.sum, "mean": F.avg}[how]
        return values.agg(f(v).alias("value")).where("value is not null")

    def group(self, by, **aggregates) -> DataFrame:
        """One row per key: ``by`` a spec, or a dict of output names to specs; aggregates: name=(function, spec), with
        count for the number of rows and list for the sorted values."""
        by = dict(by) if isinstance(by, dict) else {"key": by}
        specs = {f"_a{k}": spec for k, (_, spec) in enumerate(aggregates.values()) if spec}
        rows = self.table(**by, **specs)
        fs = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "mean": F.avg, "list": lambda c: F.sort_array(F.collect_list(c)), "distinct": F.countDistinct}
        aggs = [(F.count("*") if spec is None else fs[f](F.col(f"_a{k}"))).alias(name) for k, (name, (f, spec)) in enumerate(aggregates.items())]
        return rows.groupBy(*by).agg(*aggs)

    def group_nested(self, outer, inner, **aggregate) -> DataFrame:
        """key, value: for each outer key a map from inner keys to one aggregate (name=(function, spec)). Inner keys with null
        are left out; their number for one outer key bounds the row."""
        ((name, _),) = aggregate.items()
        flat = self.group({"key": outer, "_inner": inner}, **aggregate).where("_inner is not null")
        entries = F.sort_array(F.collect_list(F.struct(F.col("_inner").alias("key"), F.col(name).alias("value"))))
        return flat.groupBy("key").agg(F.map_from_entries(entries).alias("value"))

    def group_count(self, by) -> DataFrame:
        return self.group(by, count=("count", None))

    def fold(self, spec=".value") -> DataFrame:
        """value: the sorted list of all; bounded use only, as the list lies in one row."""
        return self.table(value=spec).agg(F.sort_array(F.collect_list("value")).alias("value"))

    def has_next(self) -> DataFrame:
        """value: whether there is any result."""
        parts = [b.df.select(F.lit(1).alias("x")).limit(1) for b in self.branches]
        if not parts:
            return self.graph.spark.range(1).select(F.lit(False).alias("value"))
        return reduce(DataFrame.unionByName, parts).limit(1).agg((F.count("*") > 0).alias("value"))

    def sample(self, n: int, seed=0, **columns) -> DataFrame:
        """n rows chosen by a seeded hash of their columns."""
        out = self.table(**columns)
        text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in out.columns))
        return out.withColumn("_r", F.md5(text)).orderBy("_r", *columns).limit(n).drop("_r")

    def sack_sum(self, name: str, by: str, how="sum") -> DataFrame:
        """key, value: sacks merged by a spec: their sum, or count, max, min or mean."""
        parts = []
        for b in self.branches:
            b, c = self._spec(b, by)
            parts.append(b.df.select(c.alias("key"), F.col(f"_sack_{name}").alias("value")))
        return reduce(DataFrame.unionByName, parts).groupBy("key").agg(REDUCERS[how]("value").alias("value"))


def spec_column(t: Traversal, b: Branch, spec):
    if callable(spec):
        box = {"b": b}

        def get(s):
            box["b"], c = t._spec(box["b"], s)
            return F.lit(None) if c is None else c

        c = spec(get)
        return box["b"], c
    if isinstance(spec, str) and spec.startswith("sack:"):
        return b, F.col(f"_sack_{spec[5:]}")
    return t._spec(b, spec)
