"""The TPC-H-like tables as a property graph."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from weftgraph.plans.catalog import PropertyGraph

VERTICES = {
    "region": ("region", "r_regionkey"),
    "nation": ("nation", "n_nationkey"),
    "customer": ("customer", "c_custkey"),
    "supplier": ("supplier", "s_suppkey"),
    "part": ("part", "p_partkey"),
    "orders": ("orders", "o_orderkey"),
    "event": ("events", "event_id"),
    "document": ("documents", "doc_id"),
    "label": ("labels", "doc_id"),
    "embedding": ("embeddings", "vec_id"),
    "page": ("pages", "page_id"),
    "message": ("conversations", ("conv_id", "turn")),
}
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]


def load(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    g = PropertyGraph(spark, referential=True)
    for label, (name, key) in VERTICES.items():
        g = g.vertex(label, read(name), key)
    two = lambda name, a, b, *props: read(name).select(F.col(a).alias("src"), F.col(b).alias("dst"), *props)
    g = g.edge("inRegion", "nation", "region", two("nation", "n_nationkey", "n_regionkey"))
    g = g.edge("inNation", "customer", "nation", two("customer", "c_custkey", "c_nationkey"))
    g = g.edge("inNation", "supplier", "nation", two("supplier", "s_suppkey", "s_nationkey"))
    g = g.edge("placed", "customer", "orders", two("orders", "o_custkey", "o_orderkey"))
    line = read("lineitem")
    contains = line.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), *(c for c in line.columns if c not in ("l_orderkey", "l_partkey")))
    g = g.edge("contains", "orders", "part", contains)
    g = g.edge("suppliedBy", "orders", "supplier", two("lineitem", "l_orderkey", "l_suppkey", "l_partkey", "l_quantity"))
    g = g.edge("nextPart", "part", "part", next_part(line))
    talk = read("conversations")
    replies = talk.select(F.col("conv_id").alias("src_conv"), F.col("turn").alias("src_turn"), F.col("conv_id").alias("dst_conv"), (F.col("turn") + 1).alias("dst_turn"))
    replies = replies.join(talk.select(F.col("conv_id").alias("dst_conv"), F.col("turn").alias("dst_turn")), ["dst_conv", "dst_turn"]).select("src_conv", "src_turn", "dst_conv", "dst_turn")
    g = g.edge("replies", "message", "message", replies, ("src_conv", "src_turn"), ("dst_conv", "dst_turn"))
    return g.edge("labelled", "document", "label", read("labels").select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst")))


def next_part(line):
    """part -> the next part of the same order; cost is the quantity."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    return line.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.col("l_quantity").alias("cost")).where("dst is not null")
