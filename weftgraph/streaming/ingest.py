"""Streaming ingest: micro-batches of vertices or edges appended to a label's Parquet table, each batch once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(stream: DataFrame, path: str, checkpoint: str, key: list[str] | None = None, available_now=True, id_col: str | None = None):
    """Starts a query that appends a stream of rows to a label table. With ``key``, rows whose key repeats inside a batch are
    written once. Each batch has a folder of its own (``batch=<n>``), which a retried batch overwrites. With ``id_col``, rows
    get ids that no other row of the table has: the batch's number above 44 bits of place (2,048 partitions of 2^33 rows)."""

    def write(rows: DataFrame, n: int) -> None:
        rows = rows.dropDuplicates(key) if key else rows
        rows = rows.withColumn(id_col, F.lit(n << 44) + F.monotonically_increasing_id()) if id_col else rows
        rows.write.mode("overwrite").parquet(f"{path}/batch={n}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_degree(edges: DataFrame, time_col: str, late="10 minutes", window="5 minutes") -> DataFrame:
    """window start, src, n: edges per source and window of a stream (or table) of edges with an event time."""
    return edges.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("w"), "src").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "src", "n")
