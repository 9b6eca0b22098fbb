"""Mixing sources to target weights with a low-discrepancy schedule; DataFrame functions only.

1. Targets. Sources get ``budget`` times all words, shared by weight; a target stops at ``max_epochs`` times its
   source's words and the excess is shared again. The fixed point is a water level: target = min(cap, weight * level),
   and the level follows from running sums over the sources sorted by cap / weight.
2. Schedule. Slot n has the golden-ratio point frac(n / phi^2), kept on a grid of 2^32 so that any engine gets the same
   value. Points map through cumulative targets to sources; the k-th slot of a source takes the k-th block of the
   source's stream. Ranks come from counts per run of slots, prefix sums over runs, and row numbers inside a run. Blocks of
   a target that no slot took (a few of each source: points are spread evenly, not exactly) follow in slots at the end.
3. Streams. A source's documents, shuffled by a hash of their id, form a stream of words, repeated up to
   ``max_epochs`` times and cut into blocks of ``block_words`` words. Offsets come from sums per hash range, prefix
   sums over ranges, and running sums inside a range. Both ranges and runs number about the square root of what they
   divide, so no task sorts a whole source, however hot.
4. Slots and blocks meet in a hash join on (source, block). Slots whose block lies beyond the target drop out; the
   last block of a target is used up to the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm._shared import cut, settle, word_count

GRID, STEP = 4294967296, 1640531527  # 2^32; round(2^32 / phi^2), odd


def default_weights(rank: Column) -> Column:
    """5, 2, 1, repeating, by the source's rank from 0."""
    return F.element_at(F.array(F.lit(5), F.lit(2), F.lit(1)), (rank % 3 + 1).cast("int")).cast("double")


def source_targets(sized: DataFrame, weights=default_weights, budget=1.5, max_epochs=2) -> DataFrame:
    """source, rank, docs, source_size, target of each source of ``sized`` (source, size). Nulls are one source, last."""
    by = sized.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    ranked = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("w", weights(F.col("rank"))).withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(budget))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(rest)
    leveled = ranked.withColumn("level", level)
    first = F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "rank", "level")))
    leveled = leveled.withColumn("fixed", first.over(Window.partitionBy())["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("w") * F.col("fixed"), F.col("cap").cast("double")))
    return leveled.select("source", "rank", "docs", "source_size", target.alias("target"))


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """slot, rank, block: the k-th slot of each source takes its block k; every block of a target has one slot."""
    spark = targets.sparkSession
    quota = targets.withColumn("t", F.floor("target")).where("t > 0")
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    cum, total = F.sum("t").over(upto), F.sum("t").over(Window.partitionBy())
    scale = lambda x: x * F.lit(float(GRID)) / total
    quota = quota.select("rank", "t", scale(cum - F.col("t")).alias("lo"), scale(cum).alias("hi"), total.alias("total"))
    stat = quota.agg(F.max("total"), F.count("*")).first()
    n_sources = stat[1]
    slots = -(-(stat[0] or 0) // block_words) if n_sources else 0
    run = max(1, int(slots**0.5))
    # A source covers a few cells of a grid as fine as there are sources; slots find theirs by an equi-join on the cell.
    cell = GRID / max(1, n_sources)
    cells = quota.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / cell), F.floor(F.col("hi") / cell))))
    points = spark.range(slots).select(
        F.col("id").alias("slot"), F.floor(F.col("id") / run).alias("run"), ((F.col("id") % GRID) * F.lit(STEP) % F.lit(GRID)).cast("double").alias("p")
    )
    points = points.withColumn("cell", F.floor(F.col("p") / cell))
    mapped = points.join(cells, "cell").where("p >= lo and p < hi").select("slot", "run", "rank", "t")
    per_run = mapped.groupBy("rank", "run").agg(F.count("*").alias("n"))
    prior = Window.partitionBy("rank").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    per_run = per_run.select("rank", "run", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("rank", "run").orderBy("slot"))
    ranked = mapped.withColumn("k", inside).join(per_run, ["rank", "run"])
    out = ranked.select("slot", "rank", "t", (F.col("before") + F.col("k") - 1).alias("block"))
    out = out.where(F.col("block") * F.lit(block_words) < F.col("t")).select("slot", "rank", "block")
    taken = mapped.groupBy("rank").agg(F.count("*").alias("n"))
    last = F.floor((F.col("t") - 1) / F.lit(block_words))
    short = quota.select("rank", "t").join(taken, "rank", "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") <= last)
    rest = short.select("rank", F.explode(F.sequence(F.col("n"), last)).alias("block"))
    return out.unionByName(rest.select((F.lit(slots) + F.col("block") * F.lit(max(1, n_sources)) + F.col("rank")).alias("slot"), "rank", "block"))


def streams(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Every row of ``sized`` (key, source, size) with its place: range_, nth and start (words before it in its source)."""
    known = targets.select(F.col("source").alias("s"), "rank", "docs", "source_size", "target")
    rows = sized.join(F.broadcast(known) if targets.count() <= 100_000 else known, F.col("source").eqNullSafe(F.col("s")))
    h = F.md5(F.coalesce(F.col("key").cast("string"), F.lit("")))
    u = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("h", h).withColumn("range_", F.floor(u * F.ceil(F.sqrt("docs")) / F.lit(GRID)))
    sums = rows.groupBy("rank", "range_").agg(F.sum("size").alias("n"))
    prior = Window.partitionBy("rank").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("rank", "range_", F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before"))
    order = Window.partitionBy("rank", "range_").orderBy("h", "key", "size")
    rows = rows.withColumn("nth", F.row_number().over(order))
    rows = rows.withColumn("inner", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.join(sums, ["rank", "range_"])
    return rows.select("key", "source", "size", "rank", "range_", "nth", "source_size", "target", (F.col("before") + F.col("inner")).alias("start"))


def mix(docs: DataFrame, id_col="doc_id", text_col="text", source_col="source", weights=default_weights, budget=1.5, max_epochs=2, block_words=128):
    """(rows, pieces).

    ``rows``: one row per input row: id, source, size, source_size, target, taken, and row_key (rank, range_, nth), which names it.
    ``pieces``: the mix itself: slot, rank, block, row_key, epoch, word_from, word_to (of the document, end exclusive).

    Each source takes floor(target) words. Null text and texts without words have size 0 and take nothing. Null sources are one source. Rows that repeat an
    id are rows of their own. An empty table gives no rows. Only the three named columns are read.
    """
    settle(docs.sparkSession)
    sized = docs.select(F.col(id_col).alias("key"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sized = cut(sized, "mix-sizes")
    targets = cut(source_targets(sized, weights, budget, max_epochs), "mix-targets")
    placed = cut(streams(sized, targets), "mix-streams")
    settle(docs.sparkSession)
    b = F.lit(block_words)
    epochs = placed.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    epochs = epochs.withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size")).where(F.col("at") < F.floor("target"))
    epochs = epochs.withColumn("end", F.least(F.col("at") + F.col("size"), F.floor("target")))
    spans = epochs.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("end") - 1) / b))))
    joined = spans.join(schedule(targets, block_words).select("slot", "rank", "block"), ["rank", "block"])
    pieces = joined.select(
        "slot", "rank", "block", "key", "range_", "nth", "epoch",
        (F.greatest("at", F.col("block") * b) - F.col("at")).alias("word_from"),
        (F.least("end", (F.col("block") + 1) * b) - F.col("at")).alias("word_to"),
    )
    taken = pieces.groupBy("rank", "range_", "nth").agg(F.sum(F.col("word_to") - F.col("word_from")).alias("taken"))
    rows = placed.join(taken, ["rank", "range_", "nth"], "left").select(
        F.col("key").alias(id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "rank", "range_", "nth"
    )
    return rows, pieces


def query(spark, sf_dir):
    from weftgraph.llm._shared import table

    return mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
), by_source AS (
  SELECT source, count(*) AS docs, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1 AS rk FROM by_source
), weighed AS (
  SELECT *, [5, 2, 1][rk % 3 + 1]::DOUBLE AS w, source_size * 2 AS cap FROM ranked
), leveled AS (
  SELECT *, (sum(source_size) OVER ()::BIGINT * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
    / sum(w) OVER (ORDER BY cap / w, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl FROM weighed
), fixed AS (
  SELECT lvl FROM leveled WHERE lvl <= cap / w ORDER BY cap / w, rk LIMIT 1
), targets AS (
  SELECT source, rk, docs, source_size, least(cap::DOUBLE, coalesce(w * (SELECT lvl FROM fixed), cap::DOUBLE)) AS target FROM leveled
), quota AS (
  SELECT rk, floor(target)::BIGINT AS t FROM targets WHERE floor(target) > 0
), reach AS (SELECT rk, t AS words FROM quota
), placed AS (
  SELECT doc_id, size, source_size, target, words,
    sum(size) OVER (PARTITION BY targets.rk ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source LEFT JOIN reach ON reach.rk = targets.rk
)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(coalesce(words, 0), start + size) - start) + greatest(0, least(coalesce(words, 0), start + source_size + size) - start - source_size))::BIGINT AS taken
FROM placed
"""
