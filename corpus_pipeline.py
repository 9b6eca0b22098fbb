"""A corpus pipeline of four stages. Each takes (spark, docs, sf_dir) and its rows are written and read again as the next
stage's ``docs``. All stages but the last return the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontam, langid, minhash_dedup, mixing
from weftgraph.llm._shared import cut, table

BROADCAST_ROWS = 500_000


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` without the ids of ``gone`` (_gone): ids of bounded number are broadcast, others joined by a shuffle."""
    gone = cut(gone, "pipeline-gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that language identification rejects go: texts that are null or have no letter, and those in which no
    language is probable enough. The model learns from the labelled rows of the stage's own input. Rows are judged one by
    one, whatever their ids; an input without a labelled text has no model, so all of it goes; an empty table stays empty."""
    return langid.keep_known(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document of the smallest id stays.
    Documents without words or with a null id stay. Rows of one id are one document: they stay or go together."""
    found = minhash_dedup.near_duplicates(docs, percent=80)
    return _without(docs, found.where("not kept").select(F.col("doc_id").alias("_gone")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage, parameters changed or not, go. Rows are judged by id and text; null and empty
    texts and ids stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"), broadcast_rows=BROADCAST_ROWS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of each row that the mix takes words of: rows that repeat an id or have
    none are rows of their own, rows without words are never taken, null sources are one source."""
    rows, _ = mixing.mix(docs)
    return rows.where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix_sources", mix_sources)]

#: SQL can express neither the trained model of the first stage nor, therefore, run()'s rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
