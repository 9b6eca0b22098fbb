"""Reading and writing graphs: Parquet, CSV and JSON label tables, and whole graphs as GraphSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.plans.catalog import PropertyGraph, columns_id


def read_table(spark: SparkSession, path: str, schema=None, form="parquet", **options) -> DataFrame:
    """A label table. CSV and JSON want a schema: inferring one reads the data twice."""
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(form).load(path)


def write_graph(graph: PropertyGraph, path: str, form="parquet", partition_by: dict[str, list[str]] | None = None) -> None:
    """Each label's table under ``path``/vertices and ``path``/edges. ``partition_by``: for a label, the properties whose values
    are folders, so that predicates on them skip files."""
    parts = partition_by or {}
    for v in graph.vertices.values():
        v.df.write.format(form).partitionBy(*parts.get(v.label, [])).save(f"{path}/vertices/{v.label}")
    for e in graph.edges:
        src, dst = columns_id(e.src, graph.vertices[e.src_label].keys), columns_id(e.dst, graph.vertices[e.dst_label].keys)
        e.df.select(src.alias("src"), dst.alias("dst"), *e.properties).write.format(form).partitionBy(*parts.get(e.label, [])).save(f"{path}/edges/{e.src_label}-{e.label}-{e.dst_label}")


def read_graph(spark: SparkSession, path: str, vertices: dict[str, str], edges: list[tuple[str, str, str]], form="parquet") -> PropertyGraph:
    """What write_graph() wrote: ``vertices`` (label: key) and ``edges`` (label, from, to)."""
    g = PropertyGraph(spark)
    for label, key in vertices.items():
        g = g.vertex(label, read_table(spark, f"{path}/vertices/{label}", form=form), key)
    for label, src, dst in edges:
        g = g.edge(label, src, dst, read_table(spark, f"{path}/edges/{src}-{label}-{dst}", form=form))
    return g


def write_graphson(graph: PropertyGraph, path: str) -> None:
    """A JSON line per element: {"kind", "label", "id", "properties"} and for edges the ends."""
    parts = []
    for v in graph.vertices.values():
        parts.append(v.df.select(F.to_json(F.struct(F.lit("vertex").alias("kind"), F.lit(v.label).alias("label"), v.id().alias("id"), F.struct(*v.df.columns).alias("properties"))).alias("value")))
    for e in graph.edges:
        src, dst = columns_id(e.src, graph.vertices[e.src_label].keys), columns_id(e.dst, graph.vertices[e.dst_label].keys)
        props = [F.struct(*e.properties).alias("properties")] if e.properties else []
        parts.append(
            e.df.select(F.to_json(F.struct(F.lit("edge").alias("kind"), F.lit(e.label).alias("label"), F.lit(e.src_label).alias("outLabel"), src.alias("outV"), F.lit(e.dst_label).alias("inLabel"), dst.alias("inV"), *props)).alias("value"))
        )
    for k, p in enumerate(parts):
        p.write.mode("overwrite" if k == 0 else "append").text(path)


def read_graphson(spark: SparkSession, path: str, vertices: dict[str, tuple[str, str]], edges: list[tuple[str, str, str, str]]) -> PropertyGraph:
    """``vertices``: label -> (schema of the properties, key); ``edges``: (label, from, to, schema of the properties)."""
    lines = spark.read.text(path)
    get = lambda name: F.get_json_object("value", f"$.{name}")
    g = PropertyGraph(spark)
    for label, (schema, key) in vertices.items():
        rows = lines.where((get("kind") == "vertex") & (get("label") == label))
        g = g.vertex(label, rows.select(F.from_json(get("properties"), schema).alias("p")).select("p.*"), key)
    for label, src, dst, schema in edges:
        rows = lines.where((get("kind") == "edge") & (get("label") == label) & (get("outLabel") == src) & (get("inLabel") == dst))
        ids = {f.name: f.dataType for v in (src, dst) for f in g.vertices[v].df.schema.fields if f.name in g.vertices[v].keys}
        kinds = [ids[g.vertices[v].keys[0]] for v in (src, dst)]
        rows = rows.select(get("outV").cast(kinds[0]).alias("src"), get("inV").cast(kinds[1]).alias("dst"), *([F.from_json(get("properties"), schema).alias("p")] if schema else []))
        g = g.edge(label, src, dst, rows.select("src", "dst", *(["p.*"] if schema else [])))
    return g
