"""URL filter: a blocked Bloom filter over listed canonical URLs, an exact join behind it, and host and path rules.

The filter has blocks of four 64-bit words; a URL sets one bit in each word of its block. There is a block for every dozen
listed URLs: up to ``max_blocks`` (40 bytes each) they are broadcast, a larger filter is joined on the block number. Only
rows that pass the filter enter the exact hash join on the URL, which removes false positives; all others go past it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._shared import lower_ascii, table

#: (verdict, host, path) of the production query.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; empty for null or no ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """host, path without a last ``/`` or ``.html``, and the query without ``utm_`` parameters; no scheme, no fragment."""
    query = F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))
    query = F.regexp_replace(F.regexp_replace(query, r"(^|&)utm_[^&]*", ""), r"^&", "")
    path = F.regexp_replace(path_of(url), r"(/|\.html)$", "")
    return F.concat(host_of(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def rule_for(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls. A rule fits its host and the host's subdomains."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, what) if verdict is None else verdict.when(fits, what)
    return (rule, verdict) if rule is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _place(url: Column, blocks: int) -> list[Column]:
    h = F.xxhash64(url)
    bits = F.xxhash64(url, F.lit(1))
    words = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return [F.pmod(h, F.lit(blocks)).alias("block"), *(w.alias(f"w{i}") for i, w in enumerate(words))]


def bloom(listed: DataFrame, blocks: int) -> DataFrame:
    """block, b0..b3: the filter over ``listed`` (url), one row per block in use."""
    return listed.select(*_place(F.col("url"), blocks)).groupBy("block").agg(*(F.bit_or(f"w{i}").alias(f"b{i}") for i in range(4)))


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, id_col="page_id", url_col="url", max_blocks=1 << 18) -> DataFrame:
    """page_id, host, path, rule, verdict, listed of every row.

    The verdict is the longest fitting rule's; without one, block if the canonical URL is in ``listed`` (url: canonical
    URLs; nulls and repeats do no harm), else allow. Null URLs and URLs without ``://`` have empty host and path and
    are never listed. Repeated rows are judged each; a very long URL is matched whole; an empty table gives no rows and
    an empty list lists nothing. At most ``max_blocks`` x 40 bytes are broadcast.
    """
    known = listed.select("url").where("url is not null and url <> ''").distinct()
    blocks = 1 << max(0, known.count() // 12).bit_length()
    u = F.col(url_col)
    rows = pages.select(F.col(id_col), host_of(u).alias("host"), path_of(u).alias("path"), F.when(F.contains(u, F.lit("://")), canonical(u)).alias("_url"))
    bits = bloom(known, blocks)
    rows = rows.select("*", *_place(F.col("_url"), blocks)).join(F.broadcast(bits) if blocks <= max_blocks else bits, "block", "left")
    maybe = F.col("_url").isNotNull() & F.col("b0").isNotNull()
    for i in range(4):
        maybe &= F.col(f"b{i}").bitwiseAND(F.col(f"w{i}")) == F.col(f"w{i}")
    rows = rows.select(id_col, "host", "path", "_url", F.coalesce(maybe, F.lit(False)).alias("_maybe"))
    hits = rows.where("_maybe").join(known.select(F.col("url").alias("_url"), F.lit(True).alias("_hit")), "_url", "left")
    rows = hits.select(id_col, "host", "path", F.coalesce("_hit", F.lit(False)).alias("listed")).unionByName(rows.where("not _maybe").select(id_col, "host", "path", F.lit(False).alias("listed")))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    return rows.select(id_col, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")


def reported(pages: DataFrame) -> DataFrame:
    """The list of the production query: canonical URLs under the hosts that the tables use for spam."""
    u = F.col("url")
    return pages.where(host_of(u).rlike(r"(^|\.)(spam-farm|casino-win|free-bets|cheap-pills|ads-track)\.")).select(canonical(u).alias("url"))


def query(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return judge(pages, reported(pages))


SQL = r"""
WITH p AS (
  SELECT page_id, url,
    coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path,
    regexp_replace(regexp_replace(coalesce(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), ''), '(^|&)utm_[^&]*', '', 'g'), '^&', '') AS query FROM pages
), c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN host || regexp_replace(path, '(/|\.html)$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical FROM p
), l AS (
  SELECT DISTINCT canonical AS hit FROM c WHERE regexp_matches(host, '(^|\.)(spam-farm|casino-win|free-bets|cheap-pills|ads-track)\.')
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM c LEFT JOIN l ON canonical = hit
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN hit IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  hit IS NOT NULL AS listed
FROM r
"""
