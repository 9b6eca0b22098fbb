"""Benchmark decontamination by templates; DataFrame functions only.

Numbers, names and units become typed placeholders, so that a question keeps its template when its parameters change. What a
name is depends on case, which copies may change, so texts are compared in two forms: all capitalised words are names, a run of
them one placeholder; no word is a name.

Windows of ``width`` template tokens of the benchmark, with at least ``literals`` literal ones, form an index; document
windows meet it in a hash join, form by form. Matches of an item that lie on one diagonal (document position minus item
position) belong to one occurrence, within which each parameter of the item must always have become the same value; windows
with a slot that breaks this don't count. A document is contaminated by an item if, in one form, at least half of the item's
windows are found, or if one occurrence has ``run`` windows (13 tokens with the defaults).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._shared import cut, settle, table

SLOT, STOP, POINT, JOIN = "\x01", "\x02", "\x03", "\x04"
#: Units of measure after a number.
UNITS = "mm|cm|m|km|in|inch|inches|ft|feet|foot|mile|miles|mi|g|mg|kg|lb|lbs|oz|ml|l|liter|liters|litre|litres|s|sec|second|seconds|min|minute|minutes|h|hr|hour|hours|day|days|week|weeks|month|months|year|years|percent|dollar|dollars|euro|euros|usd|eur|mph|kmh|hz|khz|mhz|w|kw|v|kb|mb|gb|tb"
#: (pattern, replacement) in order, on the text behind a sentence mark; a lower-casing goes before the last. Slots: a, a name;
#: s, one where a sentence starts; n, a number; u, a unit.
STEPS = (
    ("([0-9])[.,]([0-9])", rf"$1{POINT}$2"),  # decimals stay whole
    ("[.!?:;\n\r]+", f" {STOP} "),
    (rf"[^\p{{L}}\p{{M}}\p{{N}}{STOP}{POINT}]+", " "),
    (r" (\p{Lu}\p{Ll}[^ ]*)", rf" {SLOT}a$1{JOIN}"),
    (rf"{STOP} {SLOT}a([^ ]*){JOIN}", rf"{SLOT}s$1"),
    (rf"{JOIN} {SLOT}a", JOIN),  # a run of names
    (f"{STOP} ?|{JOIN}( |$)", "$1"),
    (r"([0-9])(\p{L})", "$1 $2"),
    (" ([0-9])", f" {SLOT}n$1"),
    (rf"({SLOT}n[0-9{POINT}]+) ({UNITS})( |$)", rf"$1 {SLOT}u$2$3"),
)
TEMPLATE = (rf"{SLOT}([anu])[^ ]*", rf"{SLOT}$1")
START = (rf"{SLOT}s([^ ]*) {SLOT}a", rf"{SLOT}a$1{JOIN}")  # a run of names from where a sentence starts
#: Of each form: whether START goes first, and plain replacements in marked tokens, in order.
FORMS = (
    (True, ((f"{SLOT}s", f"{SLOT}a"),)),
    (False, ((f"{SLOT}s", ""), (f"{SLOT}a", ""), (JOIN, " "))),
)


def marked(text: Column) -> Column:
    """The tokens of a text, by single spaces; slots start with SLOT and their type, and keep their value."""
    text = F.coalesce(text, F.lit(""))
    text = F.when(F.contains(text, F.lit(STOP)) | F.contains(text, F.lit(POINT)), F.translate(text, STOP + POINT, "  ")).otherwise(text)
    out = F.concat(F.lit(f" {STOP} "), text)
    for k, (pattern, to) in enumerate(STEPS):
        out = F.regexp_replace(F.lower(out) if k == len(STEPS) - 1 else out, pattern, to)
    return F.btrim(F.regexp_replace(out, " +", " "), F.lit(" "))


def forms(rows: DataFrame) -> DataFrame:
    """A row (form, m) for each form of the marked tokens m."""
    kept = [c for c in rows.columns if c != "m"]
    made = []
    for n, (start, steps) in enumerate(FORMS):
        out = F.regexp_replace("m", *START) if start else F.col("m")
        for old, new in steps:
            out = F.replace(out, F.lit(old), F.lit(new))
        made.append(F.struct(F.lit(n).alias("form"), out.alias("m")))
    return rows.select(*kept, F.explode_outer(F.array(*made)).alias("_f")).select(*kept, "_f.form", "_f.m")


def template(tokens: Column) -> Column:
    return F.regexp_replace(tokens, *TEMPLATE)


def _windows(rows: DataFrame, text: str, width: int) -> DataFrame:
    """All other columns, and pos, t0..: the windows of template tokens.

    The outer generator keeps the optimizer from testing the array before it is exploded: the test would repeat the
    array's whole expression, regular expressions included, for each of its parts."""
    keep = [c for c in rows.columns if c != text]
    rows = rows.select(*keep, F.split(F.col(text), " ").alias("_a"))
    n = F.greatest(F.size("_a") - (width - 1), F.lit(0))
    zipped = F.arrays_zip(*(F.slice("_a", k + 1, n).alias(f"t{k}") for k in range(width)))
    rows = rows.select(*keep, zipped.alias("_z")).select(*keep, F.posexplode_outer("_z").alias("pos", "_w"))
    return rows.where("pos is not null").select(*keep, "pos", *(F.col(f"_w.t{k}") for k in range(width)))


def _hash(width: int) -> Column:
    return F.xxhash64(*(F.col(f"t{k}") for k in range(width)))


def find(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text", width=5, literals=3, run=9, broadcast_rows=500_000) -> DataFrame:
    """_key, item_id, form, matched, windows of every pair of a contaminated row and a template that contaminates it.

    _key is a hash of id and text (see row_key): repeated rows share it. Items of equal templates are one, under their
    smallest id. The index is broadcast up to ``broadcast_rows`` rows and joined by a shuffle beyond.
    """
    settle(docs.sparkSession)
    item = ["item_id", "form"]
    items = forms(benchmark.select(F.col(item_col).alias("item_id"), marked(F.col(item_text)).alias("m"))).withColumn("t", template(F.col("m")))
    items = items.groupBy("form", "t").agg(F.min(F.struct("item_id", "m")).alias("s")).select("form", F.col("s.item_id").alias("item_id"), F.col("s.m").alias("m"), "t")
    literal = sum((F.when(F.col(f"t{k}").startswith(SLOT), 0).otherwise(1) for k in range(width)), F.lit(0))
    index = _windows(items.select(*item, "t"), "t", width).where(literal >= literals)
    index = cut(index.select(*item, "pos", _hash(width).alias("h")).groupBy(*item, "h").agg(F.min("pos").alias("ipos")), "decontam-index")
    sizes = index.groupBy(*item).agg(F.count("*").alias("windows"))
    small = index.count() <= broadcast_rows
    rows = forms(docs.select(row_key(id_col, text_col), marked(F.col(text_col)).alias("m")))
    spread = _windows(rows.select("_key", "form", template(F.col("m")).alias("t")), "t", width).select("_key", "form", "pos", _hash(width).alias("h"))
    hits = spread.join(F.broadcast(index) if small else index, ["form", "h"]).select("_key", *item, "ipos", (F.col("pos") - F.col("ipos")).alias("diag")).distinct()
    pair = ["_key", *item]

    def decide(found: DataFrame) -> DataFrame:
        each = found.groupBy(*pair, "diag").agg(F.collect_set("ipos").alias("at"))  # at most an item's windows
        # All together at most a position for each token of the text, which a task holds anyway.
        each = each.groupBy(*pair).agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("matched"), F.max(F.size("at")).alias("longest"))
        each = each.join(F.broadcast(sizes) if small else sizes, item)
        return each.where((2 * F.col("matched") >= F.col("windows")) | (F.col("longest") >= run)).select(*pair, "matched", "windows")

    hits = cut(hits, "decontam-hits")
    pairs = cut(decide(hits), "decontam-pairs")
    # Slots matter where an item of a found pair has any.
    slots = lambda rows, keys, at, value: rows.select(*keys, F.posexplode_outer(F.split("m", " ")).alias(at, value)).where(F.col(value).startswith(SLOT))
    item_slots = slots(items, item, "islot", "was").join(pairs.select(*item).distinct(), item, "left_semi")
    slotted = pairs.join(item_slots.select(*item).distinct(), item, "left_semi").select(*pair)
    keys = cut(slotted.select("_key").distinct(), "decontam-slotted")
    few = keys.count() <= broadcast_rows
    settle(docs.sparkSession)
    # Only the texts in question are marked again: the join is on the rows as they are, below the regular expressions.
    asked = docs.select(row_key(id_col, text_col), F.col(text_col).alias("_text")).join(F.broadcast(keys) if few else keys, "_key", "left_semi")
    doc_slots = slots(forms(asked.select("_key", marked(F.col("_text")).alias("m"))), ["_key", "form"], "dslot", "now").distinct()
    used = hits.join(slotted, pair, "left_semi").withColumn("islot", F.explode(F.sequence(F.col("ipos"), F.col("ipos") + (width - 1))))
    used = used.join(item_slots, [*item, "islot"]).select(*pair, "diag", "ipos", "islot", "was", (F.col("islot") + F.col("diag")).alias("dslot"))
    values = used.join(doc_slots, ["_key", "form", "dslot"])
    torn = values.groupBy(*pair, "diag", "was").agg(F.min("now").alias("least"), F.max("now").alias("most")).where("least <> most")
    bad = values.join(torn, [*pair, "diag", "was"], "left_semi").select(*pair, "diag", "ipos").distinct()
    checked = decide(hits.join(slotted, pair, "left_semi").join(bad, [*pair, "diag", "ipos"], "left_anti"))
    return pairs.join(slotted, pair, "left_anti").unionByName(checked)


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of id and text."""
    return F.struct(F.xxhash64(F.col(id_col), F.col(text_col)).alias("x"), F.xxhash64(F.lit(1), F.col(text_col), F.col(id_col)).alias("y")).alias("_key")


def judge(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """id, contaminated, item_id, matched, windows of every row; the item is that with the largest share of windows
    found, the smallest id and the first form among equals, null for clean rows.

    Null and empty texts and texts of fewer tokens than a window are clean; items without a window of enough literal
    tokens find nothing, and an empty benchmark finds nothing. Repeated rows are judged alike. Texts of any length are read
    whole; an empty table gives no rows.
    """
    found = find(docs, benchmark, id_col, text_col, **options)
    best = found.groupBy("_key").agg(F.min(F.struct((-F.col("matched") / F.col("windows")).alias("s"), "item_id", "form", "matched", "windows")).alias("b"))
    best = best.select(F.col("_key").alias("k"), F.col("b.item_id").alias("item_id"), F.col("b.matched").alias("matched"), F.col("b.windows").alias("windows"))
    rows = docs.select(F.col(id_col), row_key(id_col, text_col)).join(best, F.col("_key") == F.col("k"), "left")
    return rows.select(id_col, F.col("k").isNotNull().alias("contaminated"), "item_id", "matched", "windows")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", broadcast_rows=500_000, **options) -> DataFrame:
    """The rows of ``docs``, columns as they are, without the contaminated ones."""
    found = cut(find(docs, benchmark, id_col, text_col, broadcast_rows=broadcast_rows, **options).select(F.col("_key").alias("_found")).distinct(), "decontam-found")
    found = F.broadcast(found) if found.count() <= broadcast_rows else found
    return docs.join(found, row_key(id_col, text_col) == F.col("_found"), "left_anti")


def query(spark, sf_dir):
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _sql_replaced(text: str, steps, lower_last=False) -> str:
    for k, (pattern, to) in enumerate(steps):
        text = f"regexp_replace({f'lower({text})' if lower_last and k == len(steps) - 1 else text}, '{pattern}', '{to.replace('$', chr(92))}', 'g')"
    return text


def _sql_marked(text: str) -> str:
    out = _sql_replaced(f"' {STOP} ' || translate(coalesce({text}, ''), '{STOP + POINT}', '  ')", STEPS, True)
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'), ' ')"


def _sql_forms(rows: str, key: str) -> str:
    """key, form, m, t of rows with m."""
    made = []
    for n, (start, steps) in enumerate(FORMS):
        m = _sql_replaced("m", [START]) if start else "m"
        for old, new in steps:
            m = f"replace({m}, '{old}', '{new}')"
        made.append(f"SELECT {key}, {n} AS form, {m} AS m FROM {rows}")
    each = " UNION ALL ".join(made)
    return f"SELECT *, {_sql_replaced('m', [TEMPLATE])} AS t FROM ({each})"


SQL = f"""
WITH marked_items AS (SELECT item_id, {_sql_marked("text")} AS m FROM benchmark
), items AS (
  SELECT min(item_id) AS item_id, form, arg_min(m, item_id) AS m, t FROM ({_sql_forms("marked_items", "item_id")}) GROUP BY form, t
), toks AS (SELECT item_id, form, string_split(t, ' ') AS a, string_split(m, ' ') AS v FROM items
), win AS (SELECT item_id, form, i - 1 AS pos, a[i : i + 4] AS w FROM (SELECT item_id, form, a, unnest(range(1, greatest(1, len(a) - 3))) AS i FROM toks)
), idx AS (
  SELECT item_id, form, w, min(pos) AS ipos FROM win WHERE len(list_filter(w, lambda x: NOT starts_with(x, '{SLOT}'))) >= 3 GROUP BY item_id, form, w
), sizes AS (SELECT item_id, form, count(*) AS windows FROM idx GROUP BY item_id, form
), marked_docs AS (SELECT doc_id, {_sql_marked("text")} AS m FROM documents
), docs AS (
  SELECT doc_id, form, string_split(t, ' ') AS a, string_split(m, ' ') AS v FROM ({_sql_forms("marked_docs", "doc_id")})
), dwin AS (SELECT doc_id, form, i - 1 AS pos, a[i : i + 4] AS w FROM (SELECT doc_id, form, a, unnest(range(1, greatest(1, len(a) - 3))) AS i FROM docs)
), hits AS (SELECT DISTINCT doc_id, item_id, form, ipos, pos - ipos AS diag FROM dwin JOIN idx USING (form, w)
), slots AS (
  SELECT doc_id, item_id, form, diag, ipos, t.v[ipos + k] AS was, d.v[ipos + diag + k] AS now
  FROM hits JOIN toks t USING (item_id, form) JOIN docs d USING (doc_id, form), range(1, 6) r(k) WHERE starts_with(t.v[ipos + k], '{SLOT}')
), torn AS (SELECT doc_id, item_id, form, diag, was FROM slots GROUP BY ALL HAVING min(now) <> max(now)
), bad AS (SELECT DISTINCT doc_id, item_id, form, diag, ipos FROM slots JOIN torn USING (doc_id, item_id, form, diag, was)
), good AS (SELECT * FROM hits ANTI JOIN bad USING (doc_id, item_id, form, diag, ipos)
), each AS (SELECT doc_id, item_id, form, diag, count(*) AS n FROM good GROUP BY ALL
), pairs AS (
  SELECT doc_id, item_id, form, matched, windows FROM (SELECT doc_id, item_id, form, count(DISTINCT ipos) AS matched FROM good GROUP BY ALL)
  JOIN (SELECT doc_id, item_id, form, max(n) AS longest FROM each GROUP BY ALL) USING (doc_id, item_id, form) JOIN sizes USING (item_id, form) WHERE 2 * matched >= windows OR longest >= 9
), best AS (SELECT doc_id, item_id, matched, windows FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY -matched / windows, item_id, form) = 1)
SELECT d.doc_id, b.doc_id IS NOT NULL AS contaminated, item_id, matched, windows FROM documents d LEFT JOIN best b ON b.doc_id = d.doc_id
"""
