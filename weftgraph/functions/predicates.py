"""Predicates: functions from a column (and the element's other columns) to a boolean column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions import vectors


class P:
    """A predicate. ``values`` is the list of a within/without, which the planner may turn into a join. ``plain``: the same
    test of a Python value, for what is known when a plan is built (labels)."""

    def __init__(self, test, kind="test", values=None, absent=False, plain=None):
        self.test, self.kind, self.values, self.absent, self._plain = test, kind, values, absent, plain

    def plain(self, value) -> bool:
        if self._plain is None:
            raise TypeError("this predicate can't be applied to labels")
        return self._plain(value)

    def __call__(self, col: Column, other=None) -> Column:
        return self.test(col, other)

    def __and__(self, p):
        return P(lambda c, o: self(c, o) & p(c, o), plain=lambda x: self.plain(x) and p.plain(x))

    def __or__(self, p):
        return P(lambda c, o: self(c, o) | p(c, o), plain=lambda x: self.plain(x) or p.plain(x))

    def __invert__(self):
        return P(lambda c, o: ~self(c, o), plain=lambda x: not self.plain(x))

    negate = __invert__

    @staticmethod
    def of(value) -> P:
        return value if isinstance(value, P) else P.eq(value)

    @staticmethod
    def eq(v):
        return P(lambda c, o: c.isNull() if v is None else c == v, absent=v is None, plain=lambda x: x == v)

    @staticmethod
    def neq(v):
        return P(lambda c, o: c.isNotNull() if v is None else c != v, plain=lambda x: x != v)

    @staticmethod
    def gt(v):
        return P(lambda c, o: c > v)

    @staticmethod
    def gte(v):
        return P(lambda c, o: c >= v)

    @staticmethod
    def lt(v):
        return P(lambda c, o: c < v)

    @staticmethod
    def lte(v):
        return P(lambda c, o: c <= v)

    @staticmethod
    def between(a, b):
        """a <= x < b."""
        return P(lambda c, o: (c >= a) & (c < b))

    @staticmethod
    def inside(a, b):
        return P(lambda c, o: (c > a) & (c < b))

    @staticmethod
    def outside(a, b):
        return P(lambda c, o: (c < a) | (c > b))

    @staticmethod
    def within(*values):
        vs = _flat(values)
        return P(lambda c, o: c.isin(vs) if vs else F.lit(False), "within", vs, plain=lambda x: x in vs)

    @staticmethod
    def without(*values):
        """One value: as neq, which drops nulls. Several: an anti join, which keeps them."""
        vs = _flat(values)
        if not vs:
            return P(lambda c, o: F.lit(True), plain=lambda x: True)
        if len(vs) == 1:
            return P.neq(vs[0])
        return P(lambda c, o: F.coalesce(~c.isin(vs), F.lit(True)), "without", vs, plain=lambda x: x not in vs)

    @staticmethod
    def ref(op: str, key: str):
        """Compares with another property of the same element."""
        ops = {"eq": "__eq__", "neq": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}
        return P(lambda c, o: getattr(c, ops[op])(o(key)))


def _flat(values) -> list:
    out = list(values[0]) if len(values) == 1 and isinstance(values[0], (list, tuple, set, frozenset)) else list(values)
    return [v for v in dict.fromkeys(out) if v is not None]


class Text:
    """Literal text predicates."""

    contains = staticmethod(lambda v: P(lambda c, o: c.contains(v)))
    ncontains = staticmethod(lambda v: P(lambda c, o: ~c.contains(v)))
    containsCIS = staticmethod(lambda v: P(lambda c, o: F.lower(c).contains(v.lower())))
    ncontainsCIS = staticmethod(lambda v: P(lambda c, o: ~F.lower(c).contains(v.lower())))
    startsWith = staticmethod(lambda v: P(lambda c, o: c.startswith(v)))
    nstartsWith = staticmethod(lambda v: P(lambda c, o: ~c.startswith(v)))
    endsWith = staticmethod(lambda v: P(lambda c, o: c.endswith(v)))
    nendsWith = staticmethod(lambda v: P(lambda c, o: ~c.endswith(v)))
    regex = staticmethod(lambda v: P(lambda c, o: c.rlike(v)))


class FullText:
    """Token search. Tokens are runs of letters, marks, digits and underscores, lower-cased; no stemming. ``columns``: further
    properties whose tokens count too (their order is that of the names)."""

    GAP = r"[^\p{L}\p{M}\p{N}_]+"

    @staticmethod
    def _tokens(c, o, columns):
        texts = [c, *(o(name) for name in columns)]
        return F.split(F.lower(F.concat_ws(" ", *texts) if len(texts) > 1 else c), FullText.GAP)

    @staticmethod
    def match(query: str, columns=()):
        """All tokens of the query are tokens of the text."""
        tokens = [t for t in re.split(r"[^\w]+", query.lower()) if t]
        return P(lambda c, o: F.size(F.array_except(F.array(*map(F.lit, tokens)), FullText._tokens(c, o, columns))) == 0 if tokens else F.lit(True))

    @staticmethod
    def query(query: str, columns=()):
        """A boolean query: ``&``, ``|``, ``!``, parentheses, ``a <-> b`` (b follows a), ``word:*`` (a prefix)."""
        parts = re.findall(r"<->|[&|!()]|\w+(?::\*)?", query.lower())

        def parse(at):
            def atom(at):
                if at >= len(parts) or parts[at] in ("&", "|", ")", "<->"):
                    raise ValueError(f"not a full-text query: {query}")
                if parts[at] == "!":
                    f, at = atom(at + 1)
                    return (lambda t, f=f: ~f(t)), at
                if parts[at] == "(":
                    f, at = either(at + 1)
                    if at >= len(parts) or parts[at] != ")":
                        raise ValueError(f"not a full-text query: {query}")
                    return f, at + 1
                run = [parts[at]]
                while at + 2 < len(parts) and parts[at + 1] == "<->":
                    run, at = [*run, parts[at + 2]], at + 2
                if len(run) > 1:
                    phrase = " " + " ".join(run) + " "
                    return (lambda t: F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" ")).contains(phrase)), at + 1
                if run[0].endswith(":*"):
                    return (lambda t, w=run[0][:-2]: F.exists(t, lambda x: x.startswith(w))), at + 1
                return (lambda t, w=run[0]: F.array_contains(t, w)), at + 1

            def chain(at, mark, part, join):
                f, at = part(at)
                while at < len(parts) and parts[at] == mark:
                    g, at = part(at + 1)
                    f = (lambda t, f=f, g=g: join(f(t), g(t)))
                return f, at

            both = lambda at: chain(at, "&", atom, lambda x, y: x & y)
            either = lambda at: chain(at, "|", both, lambda x, y: x | y)
            return either(at)

        test, end = parse(0)
        if end != len(parts):
            raise ValueError(f"not a full-text query: {query}")
        return P(lambda c, o: test(FullText._tokens(c, o, columns)))


class Arrays:
    @staticmethod
    def contains(values):
        if not values:
            return P(lambda c, o: c.isNotNull())
        return P(lambda c, o: F.size(F.array_except(F.array(*map(F.lit, values)), c)) == 0)

    @staticmethod
    def overlaps(values):
        return P(lambda c, o: F.arrays_overlap(c, F.array(*map(F.lit, values))) if values else F.lit(False))


def lquery_regex(query: str) -> str:
    """A label-path pattern (``*``, ``*{n}``, ``*{n,m}``, ``a|b``, ``label*``, ``!label``) as a regular expression over "path."."""
    out = []
    for part in query.split("."):
        if m := re.fullmatch(r"\*(?:\{(\d*)(,?)(\d*)\})?", part):
            low, comma, high = m.groups()
            times = "*" if low is None else f"{{{low or 0},{high}}}" if comma else f"{{{low}}}"
            out.append(rf"(?:[^.]+\.){times}")
            continue
        no, part = part.startswith("!"), part.lstrip("!")
        alternatives = "|".join(re.escape(p.rstrip("*@%")) + ("[^.]*" if "*" in p else "") for p in part.split("|"))
        out.append(rf"(?!(?:{alternatives})\.)[^.]+\." if no else rf"(?:{alternatives})\.")
    return "^" + "".join(out) + "$"


class Ltree:
    """Dotted label paths."""

    @staticmethod
    def ancestor(path: str):
        """The column is an ancestor of ``path``, or equal to it."""
        return P(lambda c, o: F.concat(F.lit(path + ".")).startswith(F.concat(c, F.lit("."))))

    @staticmethod
    def descendant(path: str):
        return P(lambda c, o: F.concat(c, F.lit(".")).startswith(path + "."))

    @staticmethod
    def lquery(query: str):
        return P(lambda c, o: F.concat(c, F.lit(".")).rlike(lquery_regex(query)))

    @staticmethod
    def ancestor_any(paths):
        return P(lambda c, o: F.exists(F.array(*map(F.lit, paths)), lambda x: F.concat(x, F.lit(".")).startswith(F.concat(c, F.lit(".")))))

    @staticmethod
    def descendant_any(paths):
        return P(lambda c, o: F.exists(F.array(*map(F.lit, paths)), lambda x: F.concat(c, F.lit(".")).startswith(F.concat(x, F.lit(".")))))


class Vector:
    @staticmethod
    def below(metric: str, vector, limit: float):
        """The metric to ``vector`` is below ``limit``."""
        return P(lambda c, o: vectors.METRICS[metric](c, vector) < limit)
