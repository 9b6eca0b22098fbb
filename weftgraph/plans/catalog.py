"""The catalogue of a property graph: label tables over DataFrames. A graph is a snapshot; changes give a new one."""

from __future__ import annotations

import dataclasses
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclasses.dataclass(frozen=True)
class VertexTable:
    label: str
    df: DataFrame
    keys: tuple[str, ...]

    def id(self) -> Column:
        return F.col(self.keys[0]) if len(self.keys) == 1 else F.struct(*self.keys)


@dataclasses.dataclass(frozen=True)
class EdgeTable:
    label: str
    src_label: str
    dst_label: str
    df: DataFrame
    src: tuple[str, ...]
    dst: tuple[str, ...]
    keys: tuple[str, ...] = ()

    @property
    def properties(self) -> list[str]:
        return [c for c in self.df.columns if c not in (*self.src, *self.dst)]


def _tuple(x) -> tuple[str, ...]:
    return (x,) if isinstance(x, str) else tuple(x)


def columns_id(names: tuple[str, ...], keys: tuple[str, ...]) -> Column:
    """Foreign key columns as an id: alone, or as a struct with the names of the vertex's keys."""
    return F.col(names[0]) if len(names) == 1 else F.struct(*(F.col(n).alias(k) for n, k in zip(names, keys, strict=True)))


class PropertyGraph:
    """``referential``: edges' ends are known to exist, so a far vertex is joined only where one of its properties is used."""

    def __init__(self, spark: SparkSession, vertices=(), edges=(), referential=False, locked=False):
        self.spark, self.referential, self.locked = spark, referential, locked
        self.vertices: dict[str, VertexTable] = {v.label: v for v in vertices}
        self.edges: tuple[EdgeTable, ...] = tuple(edges)

    def _with(self, vertices=None, edges=None) -> PropertyGraph:
        return PropertyGraph(self.spark, (vertices if vertices is not None else self.vertices).values(), self.edges if edges is None else edges, self.referential, self.locked)

    def vertex(self, label: str, df: DataFrame, key="id") -> PropertyGraph:
        if self.locked and label not in self.vertices:
            raise ValueError(f"the topology is locked; no vertex label {label}")
        return self._with(vertices=self.vertices | {label: VertexTable(label, df, _tuple(key))})

    def edge(self, label: str, src_label: str, dst_label: str, df: DataFrame, src="src", dst="dst", key=()) -> PropertyGraph:
        if self.locked and not any(e.label == label for e in self.edges):
            raise ValueError(f"the topology is locked; no edge label {label}")
        for end in (src_label, dst_label):
            if end not in self.vertices:
                raise ValueError(f"no vertex label {end}")
        kept = tuple(e for e in self.edges if (e.label, e.src_label, e.dst_label) != (label, src_label, dst_label))
        return self._with(edges=(*kept, EdgeTable(label, src_label, dst_label, df, _tuple(src), _tuple(dst), _tuple(key))))

    def lock(self) -> PropertyGraph:
        out = self._with()
        out.locked = True
        return out

    def traversal(self):
        from weftgraph.plans.traversal import GraphSource

        return GraphSource(self)

    # Topology

    def topology_vertices(self) -> DataFrame:
        rows = [(v.label, ",".join(v.keys), len(v.df.columns)) for v in self.vertices.values()]
        return self.spark.createDataFrame(rows, "label string, keys string, n_properties int")

    def topology_edges(self) -> DataFrame:
        return self.spark.createDataFrame([(e.label, e.src_label, e.dst_label, len(e.properties)) for e in self.edges], "label string, out_label string, in_label string, n_properties int")

    def topology_properties(self) -> DataFrame:
        rows = [("vertex", v.label, f.name, f.dataType.simpleString()) for v in self.vertices.values() for f in v.df.schema]
        rows += [("edge", e.label, f.name, f.dataType.simpleString()) for e in self.edges for f in e.df.schema if f.name in e.properties]
        return self.spark.createDataFrame(sorted(set(rows)), "element string, label string, name string, type string")

    def topology(self) -> PropertyGraph:
        """The catalogue as a graph: vertex and edge labels with their properties."""
        labels = [(f"V:{v.label}", v.label, "vertex") for v in self.vertices.values()] + [(f"E:{x}", x, "edge") for x in sorted({e.label for e in self.edges})]
        props = self.topology_properties().withColumn("owner", F.concat(F.upper(F.substring("element", 1, 1)), F.lit(":"), "label")).withColumn("id", F.concat_ws(".", "owner", "name"))
        ends = [(f"V:{e.src_label}", f"E:{e.label}") for e in self.edges], [(f"E:{e.label}", f"V:{e.dst_label}") for e in self.edges]
        g = PropertyGraph(self.spark).vertex("schemaElement", self.spark.createDataFrame(labels, "id string, name string, kind string")).vertex("property", props.select("id", "name", "type"))
        g = g.edge("hasProperty", "schemaElement", "property", props.select(F.col("owner").alias("src"), F.col("id").alias("dst")))
        for name, rows in zip(("outOf", "into"), ends, strict=True):
            g = g.edge(name, "schemaElement", "schemaElement", self.spark.createDataFrame(sorted(set(rows)), "src string, dst string"))
        return g

    # Changes: each gives a new snapshot

    def add_vertices(self, label: str, rows: DataFrame, key="id") -> PropertyGraph:
        """Appends; unknown labels and columns come into being unless the topology is locked."""
        if label not in self.vertices:
            return self.vertex(label, rows, key)
        old = self.vertices[label]
        if self.locked and set(rows.columns) - set(old.df.columns):
            raise ValueError("the topology is locked")
        return self.vertex(label, old.df.unionByName(rows, allowMissingColumns=True), old.keys)

    def add_edges(self, label: str, src_label: str, dst_label: str, rows: DataFrame, src="src", dst="dst") -> PropertyGraph:
        """Appends; ``rows`` has the columns src, dst and properties."""
        found = [e for e in self.edges if (e.label, e.src_label, e.dst_label) == (label, src_label, dst_label)]
        if not found:
            return self.edge(label, src_label, dst_label, rows, src, dst)
        e = found[0]
        named = rows.withColumnsRenamed(dict(zip((*_tuple(src), *_tuple(dst)), (*e.src, *e.dst), strict=True)))
        return self.edge(label, src_label, dst_label, e.df.unionByName(named, allowMissingColumns=True), e.src, e.dst, e.keys)

    def bulk_add_edges(self, label: str, src_label: str, dst_label: str, pairs: DataFrame, src_prop: str, dst_prop: str, unique=False) -> PropertyGraph:
        """Edges from pairs of property values: ``pairs`` (out, in, other columns as properties). A value that several vertices
        have makes an edge for each; with ``unique`` it is an error, for which the two properties are grouped once."""
        a, b = self.vertices[src_label], self.vertices[dst_label]
        for v, prop in ((a, src_prop), (b, dst_prop)) if unique else ():
            if not self.duplicates(v.label, prop).isEmpty():
                raise ValueError(f"{v.label}.{prop} is not unique")
        rows = pairs.join(a.df.select(F.col(src_prop).alias("out"), a.id().alias("src")), "out").join(b.df.select(F.col(dst_prop).alias("in"), b.id().alias("dst")), "in").drop("out", "in")
        return self.add_edges(label, src_label, dst_label, rows)

    def set_property(self, label: str, name: str, value: Column, where: Column | None = None) -> PropertyGraph:
        """Sets a property (a null removes it) of the vertices that meet the condition."""
        v = self.vertices[label]
        old = F.col(name) if name in v.df.columns else F.lit(None)
        return self.vertex(label, v.df.withColumn(name, value if where is None else F.when(where, value).otherwise(old)), v.keys)

    def set_edge_property(self, label: str, name: str, value: Column, where: Column | None = None) -> PropertyGraph:
        """Sets a property (a null removes it) of the edges of a label, between whatever vertices, that meet the condition."""

        def one(e):
            if name in (*e.src, *e.dst, *e.keys):
                raise ValueError(f"{name} is no property")
            old = F.col(name) if name in e.df.columns else F.lit(None)
            return dataclasses.replace(e, df=e.df.withColumn(name, value if where is None else F.when(where, value).otherwise(old)))

        return self._with(edges=tuple(one(e) if e.label == label else e for e in self.edges))

    def remove_property(self, label: str, name: str, ids: DataFrame) -> PropertyGraph:
        """Sets a property to null for the vertices whose key is in ``ids`` (id)."""
        v = self.vertices[label]
        marked = ids.select(F.col("id").alias("_gone")).distinct().withColumn("_x", F.lit(True))
        df = v.df.join(marked, v.id() == F.col("_gone"), "left").withColumn(name, F.when(F.col("_x"), None).otherwise(F.col(name)))
        return self.vertex(label, df.select(*v.df.columns), v.keys)

    def merge_vertices(self, label: str, rows: DataFrame, on) -> PropertyGraph:
        """Updates the vertices that ``rows`` matches on the columns ``on`` and appends the rest. Of rows that repeat a key the
        greatest counts, by their other columns in order (nulls least)."""
        v, on = self.vertices[label], list(_tuple(on))
        new = [c for c in rows.columns if c not in on]
        if new:
            rows = rows.groupBy(*on).agg(F.max(F.struct(*new)).alias("_r")).select(*on, *(F.col(f"_r.{c}").alias(c) for c in new))
        else:
            rows = rows.distinct()
        side = rows.select(*(F.col(c).alias(f"_m_{c}") for c in rows.columns), F.lit(True).alias("_m"))
        match = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in on))
        joined = v.df.join(side, match, "left")
        keep = [F.when(F.col("_m"), F.col(f"_m_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in v.df.columns]
        extra = [F.col(f"_m_{c}").alias(c) for c in new if c not in v.df.columns]
        updated = joined.select(*keep, *extra)
        have = v.df.select(*(F.col(c).alias(f"_m_{c}") for c in on))
        missing = rows.join(have, match, "left_anti")
        return self.vertex(label, updated.unionByName(missing, allowMissingColumns=True), v.keys)

    def merge_edges(self, label: str, src_label: str, dst_label: str, rows: DataFrame) -> PropertyGraph:
        """Appends the edges (src, dst, properties) between ends that no edge of this label joins yet; of rows that repeat a
        pair of ends the greatest, by their properties in order (nulls least)."""
        found = [e for e in self.edges if (e.label, e.src_label, e.dst_label) == (label, src_label, dst_label)]
        props = [c for c in rows.columns if c not in ("src", "dst")]
        rows = rows.groupBy("src", "dst").agg(F.max(F.struct(*props)).alias("_r")).select("src", "dst", *(F.col(f"_r.{c}").alias(c) for c in props)) if props else rows.distinct()
        if found:
            e = found[0]
            have = e.df.select(columns_id(e.src, self.vertices[src_label].keys).alias("src"), columns_id(e.dst, self.vertices[dst_label].keys).alias("dst"))
            rows = rows.join(have, ["src", "dst"], "left_anti")
        return self.add_edges(label, src_label, dst_label, rows)

    def drop_vertices(self, label: str, ids: DataFrame) -> PropertyGraph:
        """Without the vertices whose key is in ``ids`` (id) and without the edges at them."""
        v = self.vertices[label]
        gone = ids.select(F.col("id").alias("_gone")).distinct()
        without = lambda df, c: df.join(gone, c == F.col("_gone"), "left_anti")
        g = self.vertex(label, without(v.df, v.id()), v.keys)
        edges = []
        for e in self.edges:
            df = e.df
            if e.src_label == label:
                df = without(df, columns_id(e.src, v.keys))
            if e.dst_label == label:
                df = without(df, columns_id(e.dst, v.keys))
            edges.append(dataclasses.replace(e, df=df))
        return g._with(edges=tuple(edges))

    def drop_edges(self, label: str, where: Column) -> PropertyGraph:
        return self._with(edges=tuple(dataclasses.replace(e, df=e.df.where(~F.coalesce(where, F.lit(False)))) if e.label == label else e for e in self.edges))

    def drop_edge_rows(self, table: EdgeTable, ids: DataFrame) -> PropertyGraph:
        """Without the edges of one table whose id (key columns, or ends and properties, as a struct) is in ``ids`` (id)."""
        names = table.keys or (*table.src, *table.dst, *table.properties)
        gone = ids.select(*(F.col(f"id.{n}").alias(f"_g_{n}") for n in names)).distinct()
        on = reduce(lambda a, b: a & b, (F.col(n).eqNullSafe(F.col(f"_g_{n}")) for n in names))
        same = lambda e: (e.label, e.src_label, e.dst_label) == (table.label, table.src_label, table.dst_label)
        return self._with(edges=tuple(dataclasses.replace(e, df=e.df.join(gone, on, "left_anti")) if same(e) else e for e in self.edges))

    def rename_label(self, old: str, new: str) -> PropertyGraph:
        vs = {(new if k == old else k): (dataclasses.replace(v, label=new) if k == old else v) for k, v in self.vertices.items()}
        swap = lambda x: new if x == old else x
        return self._with(vertices=vs, edges=tuple(dataclasses.replace(e, src_label=swap(e.src_label), dst_label=swap(e.dst_label)) for e in self.edges))

    # Checks

    def multiplicity(self, label: str, src_label: str, dst_label: str, lower=0, upper=-1, side="out") -> DataFrame:
        """id, n of the vertices whose number of edges on a side breaks the bounds (-1: none)."""
        e = next(e for e in self.edges if (e.label, e.src_label, e.dst_label) == (label, src_label, dst_label))
        v, cols = (self.vertices[src_label], e.src) if side == "out" else (self.vertices[dst_label], e.dst)
        n = e.df.groupBy(columns_id(cols, v.keys).alias("_end")).agg(F.count("*").alias("n"))
        out = v.df.select(v.id().alias("id")).join(n, F.col("id") == F.col("_end"), "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        return out.where((F.col("n") < lower) | (F.col("n") > upper if upper >= 0 else F.lit(False)))

    def duplicates(self, label: str, *columns: str) -> DataFrame:
        """Groups that break a unique index."""
        return self.vertices[label].df.groupBy(*columns).count().where("count > 1")

    def count_vertices(self) -> int:
        return self._rows(v.df for v in self.vertices.values())

    def count_edges(self) -> int:
        return self._rows(e.df for e in self.edges)

    @staticmethod
    def _rows(frames) -> int:
        """One job over all tables."""
        parts = [df.select(F.lit(1).alias("x")) for df in frames]
        return reduce(DataFrame.unionByName, parts).count() if parts else 0

    def sql(self, query: str) -> DataFrame:
        """A SQL query over the label tables: ``V_<label>``, and ``E_<from>_<label>_<to>`` with the ends as src and dst."""
        for v in self.vertices.values():
            v.df.createOrReplaceTempView(f"V_{v.label}")
        for e in self.edges:
            src, dst = columns_id(e.src, self.vertices[e.src_label].keys), columns_id(e.dst, self.vertices[e.dst_label].keys)
            e.df.select(src.alias("src"), dst.alias("dst"), *e.properties).createOrReplaceTempView(f"E_{e.src_label}_{e.label}_{e.dst_label}")
        return self.spark.sql(query)

    def sql_json(self, query: str) -> DataFrame:
        """As sql(), a JSON text for each row (value)."""
        rows = self.sql(query)
        return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
