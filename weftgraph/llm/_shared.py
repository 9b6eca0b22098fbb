"""What several operators of this subpackage need: words, packed arrays, and the core's storage and components."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import zstandard
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import algorithms
from weftgraph.plans.storage import cut, delete, forget, new_path, shared_dir  # noqa: F401

#: A word is a run of characters other than space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, rows: int = 500):
    """A batch in slices, so that only a few of its rows are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
    hand_back()


def hand_back() -> None:
    """Returns what this process has freed to the system: Arrow's pool and, with glibc, the heap keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def settle(spark: SparkSession) -> None:
    """Lets go of what finished queries left behind: Spark removes their shuffles and broadcasts, from disk too, once the
    driver's JVM has collected the plans, which it may not do for long; Arrow's pool keeps memory of results, and the C library
    what the JVM freed outside its heap."""
    hand_back()
    spark._jvm.System.gc()
    trim_jvm(spark)


def trim_jvm(spark: SparkSession) -> str | None:
    """Has the driver's JVM return memory that it freed outside its heap, which the C library keeps otherwise; what the JVM
    says of it, or None where it has no such command (older Java)."""
    jvm, array = spark._jvm, spark.sparkContext._gateway.new_array
    args = array(jvm.java.lang.Object, 4)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # The server's class is not exported, so it is called by the interface's method.
    call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        return call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JJavaError:
        return None


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    inner = F.btrim(text, F.lit(WHITE))
    return F.when(text.isNull() | (inner == ""), F.lit(0)).otherwise(F.size(F.split(inner, GAP))).cast("long")


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0, by byte planes, compressed."""
    parts = [np.array([len(arrays), *(x for a in arrays for x in (len(a), _width(a)))], np.int64).tobytes()]
    for a in arrays:
        parts.append(np.ascontiguousarray(np.asarray(a).astype(np.int64).view(np.uint8).reshape(-1, 8)[:, : _width(a)].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _width(a) -> int:
    return (int(a.max()).bit_length() + 7) // 8 if len(a) else 0


def unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    shape = raw[8 : 8 + 16 * n].view(np.int64).reshape(n, 2)
    at, out = 8 + 16 * n, []
    for size, width in shape.tolist():
        whole = np.zeros((size, 8), np.uint8)
        whole[:, :width] = raw[at : at + size * width].reshape(width, size).T
        out.append(whole.view(np.int64).reshape(size))
        at += size * width
    return out


def components(edges: DataFrame, one_task=2_000_000) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); component is the smallest reachable node. Up to ``one_task``
    distinct edges (16 bytes each) are solved in one task; more by the core's star rounds."""
    distinct = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    distinct = cut(distinct, "edges")
    if distinct.count() > one_task:
        return algorithms.components(distinct)

    def solve(key, group):
        a, b = (group.column(k).to_numpy() for k in ("a", "b"))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        return pa.table({"node": pa.array(nodes), "component": pa.array(nodes[roots(len(nodes), at[: len(a)], at[len(a) :])])})

    return distinct.groupBy(F.lit(0).alias("all")).applyInArrow(solve, "node long, component long")


def roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches by the links (i, j)."""
    at = np.arange(n)
    while True:
        low = np.minimum(at[i], at[j])
        new = at.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = np.minimum(new, new[new])
        if (new == at).all():
            return at
        at = new
