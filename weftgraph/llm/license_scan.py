"""Licence scan: sparse TF-IDF cosine of headers and licence files to templates, then inheritance from the nearest ancestor
directory.

Header candidates are the lines of a text and, as notices are wrapped, windows of two to six consecutive lines of wrapped
text (up to 120 characters each); they are compared with notices. Licence files (by name) are compared whole, with notices and
with full licence texts. A line or window whose cosine to a notice reaches the threshold must hold one of the notice's heavier
terms (the lighter ones together weigh too little), so lines without any such term near them are left out before anything
is exploded. Terms are exploded and shuffled once, by candidate; norms and products are summed from there. Files without a
licence of their own inherit that of the licence file in the nearest directory above them, found by an equi-join of each
file's ancestor paths with the directories of licence files. DataFrame functions only.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._shared import cut, table

#: (licence, notice): the notices that files carry, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "Released into the public domain under CC0 1.0"),
    ("Proprietary", "All rights reserved"),
)
MIT_TEXT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies
or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING
BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission."""
BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)
HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR
BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
PERFORMANCE OF THIS SOFTWARE."""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either
express or implied. See the License for the specific language governing permissions and limitations under the License."""
#: (licence, text): whole texts, for licence files only. Longer licences are known by their notices.
TEXTS = (
    ("MIT", MIT_TEXT),
    ("BSD-2-Clause", f"{BSD_HEAD} {BSD_TAIL}"),
    ("BSD-3-Clause", f"{BSD_HEAD} {BSD_THIRD} {BSD_TAIL}"),
    ("ISC", ISC_TEXT),
    ("Apache-2.0", APACHE_NOTICE),
)
#: Words that any text may hold, the most common first, and bare numbers: the search for anchors does without these first.
COMMON = "the of and to a in is it by are as or with that this for be any all you can under from use work only out into free form without subject general v version 0 1 2 3 4".split()
TERM, LICENCE_FILE = "[a-z0-9]+", r"(?i)(^|/)(licen[cs]e|copying|notice)(\.[a-z]+)?$"
LINES, WRAPPED = 6, 120  # of a window; characters of a wrapped line


def fit(templates=TEMPLATES, texts=TEXTS, threshold=0.75):
    """(weights, idf, unseen, anchors): unit template vectors (notices first) as (template, term, weight), IDF over the
    templates, and the terms of which any candidate near enough to a notice holds one."""
    bags = [Counter(re.findall(TERM, text.lower())) for _, text in (*templates, *texts)]
    df = Counter(t for bag in bags for t in bag)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in sorted(df.items())}
    weights, anchors = [], set()
    for k, bag in enumerate(bags):
        raw = {t: n * idf[t] for t, n in sorted(bag.items())}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        unit = {t: w / norm for t, w in raw.items()}
        weights += [(k, t, w) for t, w in unit.items()]
        light, rank = 0.0, {t: k for k, t in enumerate(COMMON)}
        for t, w in sorted(unit.items(), key=lambda x: (rank.get(x[0], len(rank)), x[1], x[0])) if k < len(templates) else ():
            if light + w * w < threshold * threshold - 1e-9:
                light += w * w
            else:
                anchors.add(t)
    return weights, idf, math.log(1 + len(bags)) + 1, sorted(anchors)


def _literal(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def lines_of(text: Column, held: str) -> Column:
    """(l, h, w): lines, whether they hold an anchor, and whether they are short enough to be wrapped text."""
    return F.transform(F.split(text, "[\r\n]+"), lambda x: F.struct(x.alias("l"), x.rlike(held).alias("h"), (F.length(x) <= WRAPPED).alias("w")))


def candidates(lines: Column) -> Column:
    """(file, text) of the lines that hold an anchor, and of the windows of wrapped lines around them. ``lines``: a column that
    holds lines_of(), not the expression, which would be evaluated for each window."""
    one = F.transform(F.filter(lines, lambda x: x["h"]), lambda x: F.struct(F.lit(False).alias("file"), x["l"].alias("text")))
    starts = F.filter(F.transform(lines, lambda x, i: i), lambda i: F.exists(F.slice(lines, i + 1, LINES), lambda x: x["h"]) & F.element_at(lines, i + 1)["w"])

    def windows(i):
        return F.transform(F.sequence(F.lit(2), F.least(F.lit(LINES), F.size(lines) - i)), lambda k: F.slice(lines, i + 1, k))

    several = F.flatten(F.transform(F.filter(starts, lambda i: F.size(lines) - i >= 2), windows))
    several = F.filter(several, lambda w: F.forall(w, lambda x: x["w"]) & F.exists(w, lambda x: x["h"]))
    return F.concat(one, F.transform(several, lambda w: F.struct(F.lit(False).alias("file"), F.array_join(F.transform(w, lambda x: x["l"]), " ").alias("text"))))


def notices(files: DataFrame, templates=TEMPLATES, texts=TEXTS, threshold=0.75) -> DataFrame:
    """_key, template, score: for each text (columns _key, path, text) its best template, if a candidate reaches the
    threshold. Of equal scores the first template wins."""
    spark = files.sparkSession
    weights, idf, unseen, anchors = fit(templates, texts, threshold)
    held = r"(?i)(^|[^a-z0-9])(" + "|".join(anchors) + ")([^a-z0-9]|$)"
    is_file = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    files = files.where(F.col("text").rlike(held) | is_file).where("text is not null")
    whole = F.when(is_file, F.array(F.struct(F.lit(True).alias("file"), F.col("text"))))
    files = files.select("_key", whole.alias("_whole"), lines_of(F.col("text"), held).alias("_lines"))
    # A generator between keeps the optimizer from putting the expression in the column's place.
    files = files.select("_key", "_whole", F.explode_outer(F.array("_lines")).alias("_lines"))
    units = files.select("_key", F.concat(candidates(F.col("_lines")), F.coalesce("_whole", F.array().cast("array<struct<file:boolean,text:string>>"))).alias("u"))
    units = units.select("_key", F.posexplode_outer("u").alias("unit", "u")).select("_key", "unit", "u.file", F.lower("u.text").alias("l"))
    terms = units.select("_key", "unit", "file", F.explode(F.regexp_extract_all("l", F.lit(TERM), 0)).alias("term"))
    # By candidate from here on: counts, sums and norms need no other shuffle.
    terms = terms.repartition(F.col("_key"), F.col("unit")).groupBy("_key", "unit", "file", "term").agg(F.count("*").alias("tf"))
    by_term: dict = {}
    for k, t, w in weights:
        by_term.setdefault(t, []).append((k, w))
    # The templates are a parameter of the code, so their few hundred terms may be broadcast.
    known = _literal(spark, [(t, idf[t], x) for t, x in by_term.items()], "term string, idf double, at array<struct<template:int,w:double>>")
    terms = terms.join(F.broadcast(known), "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    usable = F.filter(F.coalesce("at", F.array().cast("array<struct<template:int,w:double>>")), lambda x: F.col("file") | (x["template"] < len(templates)))
    parts = F.concat(F.array(F.struct(F.lit(-1).alias("template"), (F.col("w") * F.col("w")).alias("x"))), F.transform(usable, lambda x: F.struct(x["template"].alias("template"), (x["w"] * F.col("w")).alias("x"))))
    sums = terms.select("_key", "unit", F.explode(parts).alias("p")).groupBy("_key", "unit", "p.template").agg(F.sum("p.x").alias("x"))
    cosine = F.struct(F.when(F.col("template") >= 0, -F.col("x")).alias("s"), "template")
    best = sums.groupBy("_key", "unit").agg(F.max(F.when(F.col("template") < 0, F.sqrt("x"))).alias("norm"), F.min(F.when(F.col("template") >= 0, cosine)).alias("b"))
    best = best.select("_key", F.round(-F.col("b.s") / F.col("norm"), 6).alias("score"), F.col("b.template").alias("template")).where(F.col("score") >= threshold)
    best = best.groupBy("_key").agg(F.min(F.struct((-F.col("score")).alias("s"), "template")).alias("b"))
    return best.select("_key", F.col("b.template").alias("template"), (-F.col("b.s")).alias("score"))


def ancestors(path: Column) -> Column:
    """Directories above a path, the root ("") first."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))


def scan(files: DataFrame, id_col="doc_id", path_col="path", text_col="text", templates=TEMPLATES, texts=TEXTS, threshold=0.75, broadcast_rows=200_000) -> DataFrame:
    """id, path, license, score, origin (own, inherited or null), inherited_from of every row.

    Null and empty texts have no licence of their own; null paths inherit nothing and hand nothing on. Several licence
    files in a directory hand on the smallest licence name. A licence file without a known notice is passed over. Rows
    that repeat an id, path and text share their result. Texts of any length are scanned whole; an empty table gives no rows.
    """
    rows = files.select(F.col(id_col).alias("_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    rows = rows.withColumn("_key", F.struct(F.xxhash64("_id", "path", "text"), F.xxhash64(F.lit(1), "text", "path", "_id")))  # 128 bits
    names = F.array(*(F.lit(n) for n, _ in (*templates, *texts)))
    found = notices(rows.select("_key", "path", "text"), templates, texts, threshold).withColumn("license", F.element_at(names, F.col("template") + 1)).drop("template")
    found = cut(found, "license-notices")
    owned = rows.drop("text").join(F.broadcast(found) if found.count() <= broadcast_rows else found, "_key", "left")
    owned = cut(owned, "license-owned")
    folder = F.regexp_replace("path", "(^|/)[^/]*$", "")
    given = owned.where(F.col("license").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy(folder.alias("folder")).agg(F.min("license").alias("given"))
    given = cut(given, "license-folders")
    above = owned.where(F.col("license").isNull() & F.col("path").isNotNull()).select("_key", F.posexplode(ancestors(F.col("path"))).alias("depth", "folder"))
    near = above.join(F.broadcast(given) if given.count() <= broadcast_rows else given, "folder")
    near = near.groupBy("_key").agg(F.max(F.struct("depth", "folder", "given")).alias("n")).select(F.col("_key").alias("k"), "n.folder", "n.given")
    out = owned.join(near, F.col("_key") == F.col("k"), "left")
    origin = F.when(F.col("license").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited")
    return out.select(F.col("_id").alias(id_col), "path", F.coalesce("license", "given").alias("license"), "score", origin.alias("origin"), F.col("folder").alias("inherited_from"))


def repository(docs: DataFrame) -> DataFrame:
    """``documents`` laid out as source trees: a source's documents lie in folders of a hundred, ten of which share a
    parent; every hundredth document is its folder's licence file."""
    up = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    last = F.when(F.col("doc_id") % 1000 == 0, F.concat(up(1000), F.lit("/LICENSE"))).when(F.col("doc_id") % 100 == 0, F.concat(up(1000), F.lit("/"), up(100), F.lit("/LICENSE")))
    last = last.otherwise(F.concat(up(1000), F.lit("/"), up(100), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), last).alias("path"), "text")


def query(spark, sf_dir):
    return scan(repository(table(spark, sf_dir, "documents")))


def _sql() -> str:
    """Every line, every window of wrapped lines and every licence file against every template: no anchors."""
    weights, idf, unseen, _ = fit()
    values = lambda rows: ", ".join(f"({', '.join(repr(x) if not isinstance(x, float) else f'{x!r}::DOUBLE' for x in r)})" for r in rows)
    return f"""
WITH files AS (
  SELECT doc_id, text, coalesce(source, 'none') || '/' || CASE WHEN doc_id % 1000 = 0 THEN (doc_id // 1000) || '/LICENSE' WHEN doc_id % 100 = 0 THEN (doc_id // 1000) || '/' || (doc_id // 100) || '/LICENSE'
    ELSE (doc_id // 1000) || '/' || (doc_id // 100) || '/' || doc_id || '.txt' END AS path FROM documents
), idf(term, idf) AS (VALUES {values(idf.items())}
), tw(template, term, w) AS (VALUES {values(weights)}
), names(template, name) AS (VALUES {values((k, n) for k, (n, _) in enumerate((*TEMPLATES, *TEXTS)))}
), ls AS (SELECT doc_id, regexp_split_to_array(text, '[\r\n]+') AS ls FROM files WHERE text IS NOT NULL
), units AS (
  SELECT doc_id, i AS a, k AS b, false AS file, array_to_string(ls[i : i + k - 1], ' ') AS l FROM ls, range(1, len(ls) + 1) r(i), range(1, {LINES} + 1) n(k)
  WHERE i + k - 1 <= len(ls) AND (k = 1 OR len(list_filter(ls[i : i + k - 1], lambda x: length(x) > {WRAPPED})) = 0)
  UNION ALL SELECT doc_id, 0, 0, true, text FROM files WHERE ends_with(path, '/LICENSE') AND text IS NOT NULL
), terms AS (
  SELECT doc_id, a, b, file, term, count(*) AS tf FROM (SELECT doc_id, a, b, file, unnest(regexp_extract_all(lower(l), '{TERM}')) AS term FROM units) GROUP BY ALL
), weighed AS (SELECT doc_id, a, b, file, term, tf * coalesce(idf, {unseen!r}::DOUBLE) AS w FROM terms LEFT JOIN idf USING (term)
), norms AS (SELECT doc_id, a, b, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL
), scored AS (
  SELECT doc_id, template, round(sum(weighed.w * tw.w) / any_value(norm), 6) AS score FROM weighed JOIN tw USING (term) JOIN norms USING (doc_id, a, b) WHERE file OR template < {len(TEMPLATES)} GROUP BY doc_id, a, b, template
), best AS (
  SELECT doc_id, name AS license, score FROM scored JOIN names USING (template) WHERE score >= 0.75 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) = 1
), owned AS (SELECT doc_id, path, license, score FROM files LEFT JOIN best USING (doc_id)
), folders AS (
  SELECT regexp_replace(path, '(^|/)[^/]*$', '') AS folder, min(license) AS given FROM owned WHERE license IS NOT NULL AND ends_with(path, '/LICENSE') GROUP BY ALL
), above AS (
  SELECT doc_id, d AS depth, array_to_string(string_split(path, '/')[1:d], '/') AS folder FROM owned, range(0, 5) r(d) WHERE license IS NULL AND d < len(string_split(path, '/'))
), near AS (SELECT doc_id, folder, given FROM above JOIN folders USING (folder) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth DESC) = 1)
SELECT doc_id, path, coalesce(license, given) AS license, score,
  CASE WHEN license IS NOT NULL THEN 'own' WHEN given IS NOT NULL THEN 'inherited' END AS origin, folder AS inherited_from
FROM owned LEFT JOIN near USING (doc_id)
"""


SQL = _sql()
