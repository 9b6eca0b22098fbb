"""Named services. "streaming": from rows (id) to rows (id, a value) for each label of a traversal; "barrier": from all
elements (label, id) to any rows; "start": from the graph to any rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions import vectors
from weftgraph.operators import algorithms

KINDS = ("streaming", "barrier", "start")
_services: dict[str, tuple[str, Callable[..., DataFrame]]] = {}


def register(name: str, service: Callable[..., DataFrame], kind="streaming") -> None:
    if kind not in KINDS:
        raise ValueError(f"no kind {kind}; there are {KINDS}")
    _services[name] = kind, service


def names() -> list[str]:
    return sorted(_services)


def kind(name: str) -> str:
    if name not in _services:
        raise KeyError(f"no service {name}; there are {names()}")
    return _services[name][0]


def call(name: str, rows: DataFrame | None, kind: str | None = None, **parameters) -> DataFrame:
    found, service = _services[name] if name in _services else (globals()["kind"](name), None)
    if kind is not None and kind != found:
        raise ValueError(f"{name} is a {found} service")
    return service(rows, **parameters) if found != "start" else service(**parameters)


def _nearest(graph, label: str, column: str, vector, k: int, metric="l2") -> DataFrame:
    """id, distance: the k vertices of a label nearest to a vector."""
    v = graph.vertices[label]
    return v.df.select(v.id().alias("id"), vectors.METRICS[metric](F.col(column), vector).alias("distance")).orderBy("distance", "id").limit(k)


register("degree", lambda rows, edges, direction="both": algorithms.degree(rows, edges, direction))
register("component", lambda rows, edges: algorithms.connected_components(rows, edges))
register("labels", lambda rows: rows.groupBy("label").agg(F.count("*").alias("n")), "barrier")
register("nearest", _nearest, "start")
