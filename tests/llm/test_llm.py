import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import same
from weftgraph.llm import decontam, embed_dedup, langid, license_scan, lm_score, minhash_dedup, mixing, queries, token_counts, url_filter, warc
from weftgraph.llm import _shared as shared

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size string, _key string, kept string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 0.5, "x", "k", "z") for r in rows], DOCS)


def words(rng, n, pool):
    return " ".join(rng.choice(pool) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rng, pool = random.Random(1), [f"w{k}" for k in range(300)]
    long = words(rng, 60_000, pool)
    same_ = words(rng, 80, pool)
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t", None, None), (4, long, "en", "a"), (5, same_, "en", "b"), (5, same_, "en", "b"), (6, same_ + " more", "de", "b")]
    rows += [(7, same_.upper(), "de", None), (None, same_, "en", "c"), (8, "one two", "en", "c"), (9, "ONE\ttwo", "en", "c"), (10, "été œuvre 日本", "fr", "é")]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(260)] + [(0, k) for k in range(1000, 1100)]
    at = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(at[a], at[b])
            changed |= at[a] != low or at[b] != low
            at[a] = at[b] = low
    got = {r[0]: r[1] for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: at[x] for e in edges for x in e if e[0] != e[1]}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_settle_returns_native_memory(spark):
    """What the driver's JVM allocated outside its heap and freed goes back to the system."""
    jvm = spark._jvm
    status = f"/proc/{jvm.java.lang.ProcessHandle.current().pid()}/status"

    def anon():
        with open(status) as f:
            return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) / 1024

    if shared.trim_jvm(spark) is None:
        pytest.skip("older Java")
    made = [jvm.java.util.zip.Deflater() for _ in range(600)]
    for k, x in enumerate(made):
        if k % 20:  # the others keep the freed ones from lying at the end
            x.end()
    for _ in range(2):
        jvm.System.gc()
    before = anon()
    shared.settle(spark)
    assert before - anon() > 40
    for x in made[::20]:
        x.end()


# WARC


def test_warc_round_trip(spark):
    big = "x" * 3_000_000
    rows = [(1, "http://a/\r\nb", "p" * 200, "e"), (2, None, "p" * 200, "e"), (3, "u", None, "e"), (4, "u", "", "e"), (5, "u", "short", "e"), (6, "u", "short", "e"), (7, "u", big, "e"), (7, "u", big, "e"), (None, "u", "p" * 200, "e")]
    rows += [(100 + k, f"http://h/{k}", f"<p>{k} {'text ' * k}</p>", "e") for k in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").coalesce(1)
    archives = warc.write_pages(pages, archive_bytes=4000)
    assert archives.count() > 1
    got = warc.read_written(archives).collect()
    assert Counter((r.page_id, r.payload_bytes) for r in got) == Counter((r[0], len((r[2] or "").encode())) for r in rows)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[2].record_type, by[2].refers_to, by[None].refers_to) == ("response", "revisit", 1, 1)
    assert by[6].record_type == "response" and by[7].record_type == "response" and by[3].payload == b""
    assert by[150].payload.decode() == f"<p>50 {'text ' * 50}</p>" and by[2].payload is None
    folder = archives.first().archive.rpartition("/")[0]
    assert warc.read_files(spark, folder).count() == len(rows)
    assert warc.read_written(warc.write_pages(pages.where("false"))).count() == 0


def test_warc_dictionary_is_used_and_checked():
    import io
    import struct

    import zstandard

    records = [warc.format_record(k, "http://h/", f"<html>{k}</html>".encode() * 9, __import__("hashlib").sha256(f"<html>{k}</html>".encode() * 9).hexdigest(), "response", None) for k in range(300)]
    d = warc.train_dictionary(records)
    encoder = zstandard.ZstdCompressor(dict_data=d)
    body = b"".join(encoder.compress(r) for r in records)
    assert len(list(warc.read_archive(io.BytesIO(warc.archive_head(d) + body)))) == 300
    packed = zstandard.compress(d.as_bytes())
    assert len(list(warc.read_archive(io.BytesIO(struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + body)))) == 300
    for bad in (body, warc.archive_head(d)[:50], warc.archive_head(d) + body[:-3], b"junk" * 9):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(bad)))
    plain = records[0]
    for bad in (plain.replace(b"WARC/1.1", b"WARC/9"), plain.replace(b"Content-Length: ", b"Content-Length: 1", 1), plain[:-1], plain.replace(b"WARC-Date", b"X-Date"), plain.replace(b"<html>0", b"<html>1", 1)):
        with pytest.raises(warc.WarcError):
            warc.parse_record(bad)


# Mixing


def fill(sizes, weights, budget):
    """Share, stop at twice the size, share the excess again, until none is above."""
    target, left, free = dict.fromkeys(sizes, 0.0), budget * sum(sizes.values()), {k for k in sizes if sizes[k]}
    while left > 1e-9 and free:
        total, rest = sum(weights[k] for k in free), 0.0
        for k in free:
            target[k] += left * weights[k] / total
        for k in list(free):
            if target[k] >= 2 * sizes[k]:
                rest += target[k] - 2 * sizes[k]
                target[k] = 2.0 * sizes[k]
                free.discard(k)
        left = rest
    return target


def test_mix(spark):
    rng = random.Random(5)
    rows = [(k, words(rng, rng.choice([0, 1, 30, 500]), ["a", "b"]), "en", rng.choice(["s1", "s1", "s1", "s2", "s3", None, "S", "é"])) for k in range(400)] + [(7, "x y", "en", "s1"), (1000, None, "en", "t"), (None, "x", "en", "s1")]
    out, pieces = mixing.mix(docs(spark, rows), block_words=16)
    got = out.collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    names = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None]
    want = fill(dict(sizes), {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}, 1.5)
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    taken = Counter()
    for r in got:
        taken[names[r["rank"]]] += r.taken
        assert math.isclose(r.target, want[names[r["rank"]]], rel_tol=1e-9, abs_tol=1e-9)
    for k in names:
        assert abs(taken[k] - math.floor(want[k] + 1e-6)) <= 1  # every block of a target has its slot, small sources too
    assert sum(r.word_to - r.word_from for r in pieces.collect()) == sum(taken.values())
    slots = [r.slot for r in pieces.select("slot", "rank", "block").distinct().collect()]
    assert len(set(slots)) == len(slots)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_mix_odd(odd, none):
    assert mixing.mix(odd)[0].count() == odd.count() and mixing.mix(none)[0].count() == 0 and mixing.mix(odd.where("doc_id = 1"))[0].first().taken == 0


# Language identification


def test_langid(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.query(spark, sf_dir).join(table.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == table.count()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_langid_odd(spark, sf_dir, odd, none):
    model = langid.fit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    by = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert all(by[k].lang_pred == "und" and by[k].rejected and by[k].score == 0 for k in (1, 2, 3)) and by[4].lang_pred != "und"
    assert langid.fit(none) is None and langid.identify(odd, None).where("lang_pred = 'und'").count() == odd.count()
    assert langid.identify(none, model).count() == 0
    assert langid.fit(odd) is not None


def test_langid_rejects_unlearned_languages(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.fit(table)
    other = ["Το κείμενο αυτό είναι γραμμένο στα ελληνικά και κανείς δεν το έμαθε", "Это предложение написано на русском языке и его никто не учил", "これは誰も学ばなかった日本語の文章です", "هذه جملة عربية لم يتعلمها أحد هنا"]
    got = langid.identify(docs(spark, [(k, t, None, "a") for k, t in enumerate(other)]), model).collect()
    assert all(r.rejected and r.lang_pred in model.languages for r in got)
    known = langid.identify(table.where("length(text) > 200 and lang is not null"), model).collect()
    assert np.mean([r.rejected for r in known]) <= 0.01
    kept = langid.keep_known(table, model)
    assert kept.columns == table.columns and kept.count() == langid.identify(table, model).where("not rejected").count()


def test_langid_predicts_as_the_averaged_embedding(spark, sf_dir):
    """Texts judged together, alone or in segments have the softmax of the mean score of their n-grams."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    model = langid.fit(table)
    texts = [r.text for r in table.collect()] + ["a", "ab ", "été", "x" * 700_000, "Ein langer Satz. " * 60_000]
    got = {r.doc_id: r for r in langid.identify(docs(spark, [(k, t, None, "a") for k, t in enumerate(texts)]), model).collect()}
    bits = int(model.scores.shape[0]).bit_length() - 1
    for k, t in enumerate(texts):
        if t is None or not langid.LETTER.search(t):
            continue
        n = langid.bucket_counts(t, bits)
        logits = (n @ model.scores.astype(float) / n.sum() + model.bias) / model.temperature
        p = np.exp(logits - logits.max())
        p = (p / p.sum())[: len(model.languages)]
        assert got[k].lang_pred == model.languages[int(p.argmax())] and abs(got[k].score - p.max()) < 1e-3, t[:40]


def test_langid_segments_count_every_gram_once(monkeypatch):
    text = "Ein Satz, und noch einer. " * 50
    whole = langid.bucket_counts(text, 12)
    monkeypatch.setattr(langid, "SEGMENT", 64)
    assert (langid.bucket_counts(text, 12) == whole).all()


# Decontamination


def test_templates(spark):
    item = "If Anna Smith buys 12 apples and eats 5 apples then how many of the 12 apples are left in the basket of the kitchen"
    changed = item.replace("12", "40").replace("Anna Smith", "Bob").replace(" 5 ", " 7 ")
    torn = item.replace("12", "40", 1).replace("Anna", "Bob")
    clean = "Totally different words that say nothing of the kind at all in any way today"
    short = "Tom has 3 apples. Anna has 5 apples. Ben has 7 apples. How many apples do they have?"
    german = "Der Lehrer kauft am Montag mit seiner Tochter frisches Brot und den Käse für das Fest der Schule"
    start = "Weng Li earns $12 an hour for babysitting. Yesterday, she just did 50 minutes of babysitting. How much did she earn?"
    rows = [(1, "Intro words here. " + item + ". Bye."), (2, f"So: {changed}"), (3, torn), (4, clean), (5, None), (6, ""), (7, item.upper()), (8, " ".join(str(k) for k in range(500))), (1, "clean text"), (9, item.lower())]
    rows += [(10, short.replace("Tom", "Uma").replace("Anna", "Vic").replace("Ben", "Wes").replace("3", "8")), (11, german.lower()), (12, german.upper()), (13, start.replace("Weng Li", "Tina").replace("12", "18")), (14, "\x01a \x02 \x03 \x04 " + clean)]
    rows += [(15, f"{clean} {item} " + "noise " * 60_000)]
    bench = spark.createDataFrame([(1, item, "z"), (2, None, "z"), (3, "1 2 3 4 5 6 7 8 9", "z"), (4, "", "z"), (5, short, "z"), (6, german, "z"), (7, start, "z")], "item_id long, text string, windows string")
    d = spark.createDataFrame([(*r, "q", 1) for r in rows], "doc_id long, text string, item_id string, matched int")
    found = decontam.judge(d, bench).collect()
    got = sorted((r.doc_id, r.contaminated, r.item_id) for r in found if r.doc_id != 3)
    want = {1: 1, 2: 1, 7: 1, 9: 1, 10: 5, 11: 6, 12: 6, 13: 7, 15: 1}
    assert got == sorted([(k, k in want, want.get(k)) for k, _ in rows if k not in (1, 3)] + [(1, True, 1), (1, False, None)])
    by = {r.doc_id: r for r in found}
    # Doc 3 turned 12 into 40 once and kept it once. With "If Anna Smith" as one slot the item has 23 tokens, hence 19 windows, of
    # which the 3 around the first number and the 5 around the second don't count.
    assert (by[3].contaminated, by[3].matched, by[3].windows) == (True, 11, 19) and by[9].matched == by[9].windows == 21
    kept = decontam.keep_clean(d, bench)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {1, 4, 5, 6, 8, 14}
    assert decontam.judge(d, bench.where("false")).where("contaminated").count() == 0
    assert decontam.judge(d.where("false"), bench).count() == 0
    far = decontam.judge(d, bench, broadcast_rows=0)
    assert sorted(map(tuple, far.collect()), key=repr) == sorted(map(tuple, found), key=repr)


# Licences


def test_licenses(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, "a/LICENSE", f"text\n{mit}\n"), (2, "a/b/c/x.py", "code"), (3, "a/b/LICENSE.txt", apache), (4, "a/y.py", f"# {apache}"), (5, "z/q.py", "nothing"), (6, None, "x"), (7, "a/n.py", None), (8, "a/b/copying", "no notice"), (8, "a/b/copying", "no notice"), (9, None, mit)]
    d = spark.createDataFrame([(*r, "e") for r in rows], "doc_id long, path string, text string, license string")
    got = {r.doc_id: (r.license, r.origin, r.inherited_from) for r in license_scan.scan(d).collect()}
    assert got == {1: ("MIT", "own", None), 2: ("Apache-2.0", "inherited", "a/b"), 3: ("Apache-2.0", "own", None), 4: ("Apache-2.0", "own", None), 5: (None, None, None), 6: (None, None, None), 7: ("MIT", "inherited", "a"), 8: ("Apache-2.0", "inherited", "a/b"), 9: ("MIT", "own", None)}
    assert license_scan.scan(d).count() == len(rows) + 2 * 0 and license_scan.scan(d.where("false")).count() == 0


def test_wrapped_headers_and_whole_files(spark):
    gpl = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
    bsd = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
    mit = """// Permission is hereby granted, free of charge, to any person obtaining a copy
// of this software and associated documentation files (the "Software"), to deal
// in the Software without restriction, including without limitation the rights"""
    apache = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License."""
    wrap = lambda t, n: "\n".join(" ".join(t.split()[k : k + n]) for k in range(0, len(t.split()), n))
    code = "\nint main() { return 0; }\n" * 20
    rows = [(k, f"src/{k}.c", code + t + code) for k, t in enumerate((gpl, bsd, mit, apache, "This program may be redistributed under other terms, see the manual."))]
    rows += [(10, "a/LICENSE", "Copyright 2020 Somebody\n\n" + wrap(license_scan.MIT_TEXT, 11)), (11, "b/COPYING.txt", wrap(license_scan.TEXTS[2][1], 13)), (12, "c/LICENSE", wrap(license_scan.TEXTS[1][1], 9)), (13, "d/licence", wrap(license_scan.ISC_TEXT, 12))]
    rows += [(20, "e/LICENSE", " \n\n"), (21, "f/LICENSE", None), (22, "g/x.c", "word " * 60_000), (23, "a/LICENSE", "MIT " * 60_000)]
    got = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert [got[k] for k in range(5)] == ["GPL-3.0", "BSD-3-Clause", "MIT", "Apache-2.0", None]
    assert [got[k] for k in (10, 11, 12, 13)] == ["MIT", "BSD-3-Clause", "BSD-2-Clause", "ISC"] and [got[k] for k in (20, 21, 22)] == [None, None, None]


def test_anchors_lose_no_line():
    weights, idf, unseen, anchors = license_scan.fit(threshold=0.75)
    for k in range(len(license_scan.TEMPLATES)):  # notices; whole texts need no anchor
        light = sum(w * w for t, term, w in weights if t == k and term not in anchors)
        assert light < 0.75**2


# Embeddings


def test_embeddings(spark):
    x = [(k, [math.cos(k * 0.05), math.sin(k * 0.05), 0.0], 1) for k in range(60)]
    x += [(100, None, 1), (101, [0.0] * 3, 1), (102, [1.0, float("nan"), 0.0], 1), (103, [1.0, 0.0, 0.0], None), (104, [1.0, None, 0.0], 1), (105, [1.0, 0.0], 1), (106, [], 1), (107, [float("inf"), 0.0, 0.0], 1), (0, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0, 0.0], 1), (200, [3.0, 0.0, 0.0], 2)]
    df = spark.createDataFrame([(*r, "e") for r in x], "vec_id long, embedding array<float>, label int, rep string")
    for tile, axes in ((4, 1), (5, 2), (2048, 3)):
        got = embed_dedup.near_duplicates(df, tile=tile, axes=axes).collect()
        e = np.array([r[1] for r in x[:60]] + [[1, 0, 0]], np.float32).astype(float)
        e /= np.linalg.norm(e, axis=1, keepdims=True)
        n = (e @ e.T >= 0.93).sum(1) - 1
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None and r.vec_id < 60) == sorted((k, int(c), 0) for k, c in zip([*range(60), 0], n, strict=True))
        assert all(r.n_links == 0 and r.component_id == r.vec_id and r.kept for r in got if r.vec_id is None or r.vec_id >= 100)
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


# Token counts


def test_tokens():
    pieces = set(token_counts.read_vocabulary())
    longest, rng = max(map(len, pieces)), random.Random(2)

    def greedy(word):
        s, n, i = [*word[:-1], word[-1] + 256], 0, 0
        while i < len(s):
            i = next(j for j in range(min(len(s), i + longest), i, -1) if tuple(s[i:j]) in pieces)
            n += 1
        return n

    a = token_counts.Automaton(pieces)
    for _ in range(3000):
        w = "".join(rng.choice("abcdeinrstßéо日") for _ in range(rng.randrange(1, 25))).encode()
        assert a.count(w) == greedy(w)
    small = token_counts.Automaton([(97,), (97, 98), (97, 98, 99, 100 + 256), (98,), (99,)])
    assert small.count(b"abce") == 1 and small.count(b"abcd") == 1 and small.count(b"") == 0 and small.count(b"ab") == 1


def test_token_counts_as_a_plain_loop(spark, sf_dir):
    import regex

    pieces = set(token_counts.read_vocabulary())
    longest = max(map(len, pieces))

    def greedy(word):
        s, n, i = [*word[:-1], word[-1] + 256], 0, 0
        while i < len(s):
            i = next((j for j in range(min(len(s), i + longest), i, -1) if tuple(s[i:j]) in pieces), 0)
            if not i:
                return 1
            n += 1
        return n

    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    got = token_counts.query(spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        found = regex.findall(token_counts.PATTERN, texts[r.doc_id].lower())
        assert (r.n_bytes, r.n_words, r.n_tokens) == (len(texts[r.doc_id].encode()), len(found), sum(greedy(w.encode()) for w in found))


def test_tokens_odd(odd, none):
    got = {r.doc_id: r for r in token_counts.count_tokens(odd).collect()}
    assert (got[1].n_tokens, got[2].n_tokens, got[1].n_bytes) == (0, 0, 0) and got[4].n_words > 60_000 and token_counts.count_tokens(none).count() == 0


# MinHash


def brute(rows, percent):
    def shingles(t):
        w = bytes(t or "", "utf-8").lower().split()
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    sets = {k: shingles(t) for k, t in rows}
    at = {k: k for k in sets}

    def root(k):
        while at[k] != k:
            k = at[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                at[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


@pytest.mark.parametrize("percent,tile", [(85, 256), (80, 8)])
def test_minhash(spark, percent, tile):
    rng, pool = random.Random(percent), [f"w{k}" for k in range(400)]
    passage, base, rows = words(rng, 60, pool), words(rng, 150, pool), []
    for k in range(60):  # near copies of one text that are not all near each other, and of each other
        w = base.split()
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = rng.choice(pool)
        rows.append(" ".join(w[: 150 - k % 3]))
    rows += [words(rng, rng.randrange(5, 80), pool) + " " + passage for _ in range(60)] + [words(rng, 3, pool[:3]) for _ in range(12)] + [words(rng, 8, pool[:2]) for _ in range(12)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for most in (0, 100, 1 << 18):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(d, percent=percent, tile=tile, broadcast_ids=0 if tile == 8 else 1000, most_frequent=most, bucket_entries=700, short_list=256 if most else 4).collect()}
        assert got == brute(rows, percent)


def test_minhash_odd(odd, none):
    got = minhash_dedup.near_duplicates(odd).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == odd.count() and all(by[k].n_shingles == 0 and by[k].kept for k in (1, 2, 3)) and [by[k].component_id for k in (5, 6, 7, 8, 9)] == [5, 5, 5, 8, 8] and by[None].component_id is None and by[None].kept
    assert minhash_dedup.near_duplicates(none).count() == 0


# URLs


def test_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.com/en/7?x#y", "http://example.com/en/8", "https://x.org/es/1#f", "http://bad.net/p/?utm_source=a&b=1", "http://BAD.net/p?b=1", "http://bad.net/p?b=2", "://", "http://notexample.com/en/7", "http://a?b#c"]
    pages = spark.createDataFrame([(k, u, "e") for k, u in enumerate(urls)], "page_id long, url string, host string")
    listed = spark.createDataFrame([("bad.net/p?b=1",), (None,), ("bad.net/p?b=1",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).collect()}
    assert got[0] == got[1] == got[2] == got[9] == ("", "", None, "allow") and got[3] == ("a.example.com", "/en/7", "example.com/en/7", "allow") and got[4][3] == "block" and got[5] == ("x.org", "/es/1", "org/es/", "block")
    assert [got[k][3] for k in (6, 7, 8)] == ["block", "block", "allow"] and got[10][2] == "com/en/" and got[11][:2] == ("a", "")
    many = spark.range(5000).selectExpr("concat('h.net/', id) url")
    tight = url_filter.judge(spark.range(10000).selectExpr("id page_id", "concat('http://h.net/', id) url"), many, rules=(), max_blocks=2)
    assert tight.where("listed").count() == 5000
    assert url_filter.judge(pages, listed.where("false")).where("listed").count() == 0 and url_filter.judge(pages.where("false"), listed).count() == 0


def test_minhash_similar_sets_share_a_retained_value():
    """Every pair at the threshold does, at every size and whatever values count as frequent."""
    rng = np.random.default_rng(9)
    for percent in (80, 85):
        for n in range(1, 41):
            for m in range(n, n * 100 // percent + 1):
                least = -(-percent * (n + m) // (100 + percent))
                for shared_ in range(least, n + 1):
                    for k in range(20):
                        v = rng.integers(0, 2**63, n + m - shared_, dtype=np.uint64)
                        a, b = np.sort(v[:n]), np.sort(v[n - shared_ :])
                        order = minhash_dedup.Order(rng.permutation(v)[: k % 3 * len(v) // 2])
                        assert np.intersect1d(order.retained(a, percent), order.retained(b, percent)).size, (percent, n, m, shared_)


# Language model


def test_lm(spark, sf_dir):
    got = lm_score.query(spark, sf_dir).collect()
    table = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    count, tokens = Counter(), lambda t: [*(t or "").encode().lower().split(), b""]
    for k, t in table.items():
        if zlib.crc32(str(k).encode()) % 10:
            count.update(tokens(t))
    n, v = sum(count.values()), len(count)
    assert len(got) == len(table)
    for r in got:
        t = tokens(table[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r.base_score, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def _tables_exactly(n, a, d):
    """Mean number of tables of n customers whose new tables weigh a and whose others weigh their size less d."""

    def parts(n, most):
        if not n:
            yield []
        for k in range(min(n, most), 0, -1):
            for rest in parts(n - k, k):
                yield [k, *rest]

    total = mean = 0.0
    for p in parts(n, n):
        ways = math.factorial(n) / math.prod(math.factorial(k) for k in p) / math.prod(math.factorial(k) for k in Counter(p).values())
        w = ways * a ** len(p) * math.prod(math.gamma(k - d) / math.gamma(1 - d) for k in p)
        total, mean = total + w, mean + w * len(p)
    return mean / total


def test_gibbs_seating():
    rng, m = np.random.default_rng(0), 20_000
    for n, a, d in ((2, 0.7, 0.4), (3, 0.2, 0.8), (6, 1.5, 0.3)):
        t, sizes = lm_score.gibbs(np.full(m, n), np.full(m, a), d, rng, passes=4)
        t, sizes = lm_score.gibbs(np.full(m, n), np.full(m, a), d, rng, t, sizes, passes=4)
        assert abs(t.mean() - _tables_exactly(n, a, d)) < 0.03 and len(sizes) == t.sum() and (np.add.reduceat(sizes, np.cumsum(t) - t) == n).all()
    c = np.array([1, 5000, 3, 40])
    t, sizes = lm_score.seated(c, np.full(4, 1.0), 0.5, rng)
    assert (t >= 1).all() and (t <= c).all() and len(sizes) == t.sum() - t[1] and sizes.sum() == 44
    for x in ([0, 5, 300, 70000], [], [2**62 + 5, 1]):
        assert lm_score.unpack(lm_score.pack(np.array(x, np.int64), np.array([1])))[0].tolist() == x


def _plain_model(texts, d, a, d0, a0, rounds, rng):
    """Mean predictive probabilities by one-at-a-time Gibbs over all customers in turn, totals always up to date."""
    seqs = [["", *t.split(), ""] for t in texts]
    moves = [(u, w) for s in seqs for u, w in zip(s, s[1:], strict=False)]
    words_ = sorted({w for _, w in moves})
    base, rest, parent, seat_of, parent_of = 1 / (len(words_) + 1), {}, {w: [] for w in words_}, [], {}
    size = Counter(u for u, _ in moves)

    def prob_parent(w):
        n, t = sum(map(sum, parent.values())), sum(map(len, parent.values()))
        return (sum(parent[w]) - d0 * len(parent[w]) + (a0 + d0 * t) * base) / (a0 + n)

    def choose(tables, d_, new):
        weights = [x - d_ if x else 0 for x in tables] + [new]
        return rng.choices(range(len(weights)), weights)[0]

    def sit(tables, k):
        if k == len(tables):
            tables.append(0)
        tables[k] += 1
        return k

    def open_(u):
        return sum(1 for (v, _), tables in rest.items() if v == u for x in tables if x)

    def arrive(u, w):
        tables = rest.setdefault((u, w), [])
        k = choose(tables, d, (a + d * open_(u)) * prob_parent(w))
        new = k == len(tables) or not tables[k]
        sit(tables, k)
        if new:
            at = parent[w]
            total = sum(1 for x in parent.values() for y in x if y)
            at_k = choose(at, d0, (a0 + d0 * total) * base)
            if at_k == len(at):
                at.append(0)
            at[at_k] += 1
        return k

    def leave(u, w, k):
        tables = rest[u, w]
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            at = parent[w]
            j = rng.choices(range(len(at)), at)[0]
            at[j] -= 1
            if not at[j]:
                at.pop(j)

    for u, w in moves:
        arrive(u, w)
    mean = {}
    for r in range(rounds):
        for u, w in moves:
            tables = rest[u, w]
            leave(u, w, rng.choices(range(len(tables)), tables)[0])
            arrive(u, w)
        if r >= rounds // 4:
            for u in size:
                for w in words_:
                    tables = rest.get((u, w), [])
                    p = (sum(tables) - d * len(tables) + (a + d * open_(u)) * prob_parent(w)) / (a + size[u])
                    mean[u, w] = mean.get((u, w), 0) + p / (rounds - rounds // 4)
    return mean


def test_lm_as_plain_gibbs(spark):
    """Mean probabilities are those of a plain sampler that moves one customer at a time through the whole hierarchy."""
    from pyspark.sql import functions as F

    rng = random.Random(5)
    pool = "a a a a b b b c c d e f".split()
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 14))) for _ in range(14)]
    want = _plain_model(texts, 0.6, 1.0, 0.4, 2.0, 400, rng)
    ask = sorted({(u, w) for u, w in want if u and w})
    rows = [(k, t) for k, t in enumerate(texts)] + [(1000 + k, f"{u} {w}") for k, (u, w) in enumerate(ask)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: 10**r.score for r in lm_score.score_whole(d, F.col("doc_id") >= 1000, burn=20, keep=120, fixed=(0.6, 1.0, 0.4, 2.0)).collect()}
    off = [abs(math.log(got[1000 + k] / (want["", u] * want[u, w] * want[w, ""]))) for k, (u, w) in enumerate(ask)]
    assert np.mean(off) < 0.08 and max(off) < 0.4


def test_lm_whole_contexts(spark):
    """Rare preceding words are contexts of their own, whatever the lexicon and the number of chunks and buckets."""
    from pyspark.sql import functions as F

    rng = random.Random(7)
    pairs = [(f"a{k}", f"b{k}") for k in range(200)]
    rows = [(k, " ".join(" ".join(rng.choice(pairs)) for _ in range(40))) for k in range(100)] + [(100, "a5 b5 " * 20), (101, "a5 b6 " * 20), (102, "zz a5 new"), (None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    held = F.coalesce(F.col("doc_id") >= 100, F.lit(False))
    for lexicon, bounds in (([], {}), (["a5", "b5", "b6"], {"chunk_tokens": 500, "bucket_tokens": 1000}), (None, {"chunk_tokens": 300, "bucket_tokens": 700})):
        lexicon = lexicon if lexicon is None else [w.encode() for w in lexicon]
        got = {r.doc_id: r for r in lm_score.score_whole(d, held, words=lexicon, **bounds).collect()}
        assert len(got) == 104 and got[100].score > got[101].score + 20 and got[None].n_tokens == 1 and got[102].n_known == 2
        assert got[100].held_out and got[100].train_tokens == 100 * 81 + 1
    assert lm_score.score_whole(d.where("false"), held).count() == 0 and lm_score.score_whole(d, F.lit(True)).count() == 104


def test_lm_seats_every_pair(spark):
    """The lexicon only shortens codes: pairs of two words outside it are reseated too, in whatever buckets their words are."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    pool = [f"w{k}" for k in range(25)]
    rows = [(k, words(rng, 40, pool)) for k in range(60)] + [(1000 + k, f"{rng.choice(pool)} {rng.choice(pool)}") for k in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = lambda **kw: {r.doc_id: r.score for r in lm_score.score_whole(d, F.col("doc_id") >= 1000, burn=4, keep=6, fixed=(0.3, 40.0, 0.4, 2.0), **kw).collect() if r.doc_id >= 1000}
    want, noise = model(seed=1), model(seed=2)
    got = model(words=[], chunk_tokens=200, bucket_tokens=300)
    off = lambda x: np.mean([abs(x[k] - want[k]) for k in want])
    assert off(got) < 1.3 * off(noise) and abs(sum(got.values()) - sum(want.values())) < 0.02 * len(want)


def test_lm_odd(odd, none):
    got = lm_score.score_whole(odd, lm_score.fold(odd["doc_id"])).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (1, 2, 3)} == {1} and all(r.score < 0 for r in got)
    assert sorted((r.n_tokens, r.base_score) for r in got if r.doc_id == 5)[0] == sorted((r.n_tokens, r.base_score) for r in got if r.doc_id == 5)[1]
    assert lm_score.score_whole(none, lm_score.fold(none["doc_id"])).count() == 0


# Pipeline


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names, rows = d.columns, d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, sf_dir)
        assert rows.columns == names, name
    assert 0 < rows.count() <= d.count()
    out = corpus_pipeline.run(spark, sf_dir)
    assert 0 < out.count() <= rows.count() and out.where("taken > 2 * size").count() == 0


def test_pipeline_odd(spark, sf_dir, odd, none):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id for r in df.collect()), key=repr)
    known = stages["language_id"](spark, odd, sf_dir)
    assert set(ids(known)) <= {4, 5, 6, 7, None, 8, 9, 10} and known.columns == odd.columns
    # 5 (twice), 6 and 7 are copies; 8 and 9 too; a null id and texts without words stay.
    assert ids(stages["near_dedup"](spark, odd, sf_dir)) == sorted([1, 2, 3, 4, 5, 5, 8, 10, None], key=repr)
    bench_free = stages["decontaminate"](spark, odd, sf_dir)
    assert ids(bench_free) == ids(odd)
    mixed = stages["mix_sources"](spark, odd, sf_dir).collect()
    assert {r.doc_id for r in mixed} <= {4, 5, 6, 7, None, 8, 9, 10} and all(0 < r.taken <= 2 * r.size for r in mixed)
    assert sum(r.taken for r in mixed if r.source == "a") > 0 and {r.source for r in mixed} == {"a", "b", "c", None, "é"}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, sf_dir).count() == 0, name
