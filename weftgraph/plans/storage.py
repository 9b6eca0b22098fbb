"""Cutting the lineage of iterative plans in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dirs: dict[str, tempfile.TemporaryDirectory] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Only where it is unset, and then
    only in local mode, a temporary folder of this process stands in for it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        at = jvm.org.apache.hadoop.fs.Path(found)
        whole = at.getFileSystem(conf).makeQualified(at).toString().rstrip("/")
        return re.sub("^file:/(?!/)", "file:///", whole)
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    own = _own_dirs.setdefault(context.applicationId, tempfile.TemporaryDirectory(prefix="weftgraph-"))
    return f"file://{own.name}"


@atexit.register
def _clean() -> None:
    for own in _own_dirs.values():
        own.cleanup()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back: the plan above starts there, and a
    lost executor costs no earlier work."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def forget(df: DataFrame | None) -> None:
    """Deletes what cut() wrote; only for tables that nothing will read again."""
    if (path := getattr(df, "_weft_path", None)) is not None:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def let_go(spark: SparkSession) -> None:
    """Loops of many rounds: has the shuffle files of plans that nothing refers to deleted, which waits for a collection."""
    gc.collect()
    spark._jvm.System.gc()
