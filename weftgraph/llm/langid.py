"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text's features are its byte n-grams (UTF-8, lowered, runs of white space and digits as one space), hashed into
buckets. The model averages the embeddings of all n-grams of a text and applies a linear softmax; both are trained
together by stochastic gradient descent in numpy on a bounded, hash-chosen sample of each language, and of made-up texts of
letters that languages elsewhere use, which are a class of their own that is never predicted: texts like them are none of the
learned languages. Texts that training has not seen calibrate a temperature and the rejection threshold.

Prediction needs the product of embeddings and output weights only, a table of buckets x languages, so a text costs a
hash and a lookup per n-gram, in segments of bounded size however long the text.
"""

from __future__ import annotations

import dataclasses

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._shared import settle, slices, table

ORDERS = (1, 2, 3, 4)
LETTER, PLAIN = regex.compile(r"\p{L}"), regex.compile(r"[\s\d]+")
SEGMENT = 1 << 19


@dataclasses.dataclass(frozen=True)
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x (languages and the class of other texts)
    bias: np.ndarray
    temperature: float
    threshold: float  # texts whose best probability is lower are rejected


def clean(text: str) -> bytes:
    return b" " + PLAIN.sub(" ", text.lower()).strip().encode("utf-8", "replace") + b" "


def grams(data: np.ndarray, order: int, bits: int) -> np.ndarray:
    """Buckets of the n-grams that start at each byte but the last order - 1."""
    h = np.full(len(data) - order + 1, order * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
    for i in range(order):
        h = (h ^ data[i : len(data) - order + 1 + i]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
    return (h * np.uint32(0x85EBCA77)) >> np.uint32(32 - bits)


def bucket_counts(text: str, bits: int) -> np.ndarray:
    data, out = np.frombuffer(clean(text), np.uint8).astype(np.uint32), np.zeros(1 << bits, np.int64)
    for s in range(0, len(data), SEGMENT):
        for order in ORDERS:
            part = data[s : s + SEGMENT + order - 1]
            if len(part) >= order:
                out += np.bincount(grams(part, order, bits), minlength=1 << bits)
    return out


def made_up(words: list[str], rng) -> str:
    """Words of the same lengths, of letters of some range of code points that is not Latin."""
    start = int(rng.integers(0x370, 0xD000))
    return " ".join("".join(map(chr, rng.integers(start, start + 96, min(len(w), 30)))) for w in words[:200])


def _features(bits: int, pieces: tuple[int, ...]):
    """For each sampled text: the whole of it, windows of its words of a few lengths, and for one in four a made-up text, whose
    language is null."""

    def run(batches):
        for batch in (x for b in batches for x in slices(b, 100)):
            rows = []
            for key, text, lang in zip(*(batch.column(k).to_pylist() for k in ("_id", "_text", "_lang")), strict=True):
                words = text.split()
                rng = np.random.default_rng(len(text))
                parts = [text] + [" ".join(words[(s := int(rng.integers(len(words) - n + 1))) : s + n]) for n in pieces if len(words) > n]
                made = [(made_up(words, rng), None)] if words and rng.random() < 0.25 else []
                for k, (part, of) in enumerate([*((p, lang) for p in parts), *made]):
                    counts = bucket_counts(part, bits)
                    used = np.nonzero(counts)[0]
                    rows.append((key, k, of, used.astype(np.uint16 if bits <= 16 else np.uint32).tobytes(), (counts[used] / counts.sum()).astype(np.float32).tobytes()))
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            types = (pa.int64(), pa.int32(), pa.string(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], names=["key", "part", "lang", "used", "share"])

    return run


def _softmax(x):
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Sparse:
    """Rows of (buckets, shares)."""

    def __init__(self, rows):
        self.rows = rows

    def batch(self, which):
        parts = [self.rows[k] for k in which]
        start = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])])[:-1]
        return np.concatenate([p[0] for p in parts]).astype(np.int64), np.concatenate([p[1] for p in parts]), start


def train(rows, labels: np.ndarray, languages: list[str], bits: int, texts: np.ndarray | None = None, dim=16, epochs=20, rate=2.0, size=32, reject=0.0005, most_threshold=0.4, seed=7) -> Model:
    """Stochastic gradient descent on 4 of 5 texts; temperature and threshold on the fifth. ``texts``: the text that each
    row is of or a window of, so that no text is in both parts. A label beyond the languages is the class of other texts."""
    rng = np.random.default_rng(seed)
    table_, n_lang = Sparse(rows), len(languages) + 1
    emb = (rng.standard_normal((1 << bits, dim)) / dim).astype(np.float32)
    out, bias = np.zeros((dim, n_lang), np.float32), np.zeros(n_lang, np.float32)
    texts = np.arange(len(rows)) if texts is None else np.unique(texts, return_inverse=True)[1]
    n_texts, order = int(texts.max()) + 1, rng.permutation(len(rows))
    place = rng.permutation(n_texts)[texts[order]]
    kept = order[place < n_texts // 5] if n_texts >= 10 else order
    learn = order[place >= n_texts // 5] if n_texts >= 10 else order
    weight = 1 / np.maximum(1, np.bincount(labels[learn], minlength=n_lang))
    weight = (weight / weight[labels[learn]].mean()).astype(np.float32)

    def hidden(which):
        used, share, start = table_.batch(which)
        return used, share, start, np.add.reduceat(emb[used] * share[:, None], start, axis=0)

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for s in range(0, len(learn), size):
            which = learn[s : s + size]
            used, share, start, h = hidden(which)
            grad = _softmax(h @ out + bias)
            grad[np.arange(len(which)), labels[which]] -= 1
            grad *= weight[labels[which]][:, None] / len(which)
            back = grad @ out.T
            out -= step * (h.T @ grad)
            bias -= step * grad.sum(axis=0)
            # Embeddings see tiny shares; a larger step for them balances the two layers.
            np.add.at(emb, used, -step * 64 * share[:, None] * np.repeat(back, np.diff(np.append(start, len(used))), axis=0))
        learn = rng.permutation(learn)
    logits = np.concatenate([hidden(kept[s : s + size])[3] @ out + bias for s in range(0, len(kept), size)])
    best, loss = 1.0, np.inf
    for t in np.geomspace(0.02, 5, 60):
        now = -np.log(np.maximum(_softmax(logits / t)[np.arange(len(kept)), labels[kept]], 1e-12)).mean()
        best, loss = (t, now) if now < loss - 1e-9 else (best, loss)
    own = labels[kept] < len(languages)
    sure = _softmax(logits / best)[own, :-1].max(axis=1) if own.any() else np.ones(1)
    return Model(languages, emb @ out, bias, float(best), float(min(most_threshold, np.quantile(sure, reject))))


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", per_language=250, bits=15, pieces=(4, 12, 40), most_languages=200) -> Model | None:
    """Trains on about ``per_language`` rows of each of the ``most_languages`` most frequent languages of ``docs``, chosen by a
    hash of the id: this bounds what the driver gathers to ``per_language`` x languages x (2 + pieces) sparse rows. Rows with
    null text or language, or without a letter, aren't learned from; rows that repeat an id and text are chosen together;
    ties of languages go by name. None where no row can be learned from."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.col(lang_col).cast("string").alias("_lang"))
    rows = rows.where("_text is not null and _lang is not null").where(F.col("_text").rlike(r"\p{L}"))
    found = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(most_languages).collect()
    counts = {r[0]: r[1] for r in found}
    if not counts:
        return None
    languages = sorted(counts)
    shares = docs.sparkSession.createDataFrame([(x, per_language / counts[x]) for x in languages], "_lang string, _share double")
    rows = rows.join(F.broadcast(shares), "_lang").select("_id", "_text", "_lang", "_share")
    u = F.pmod(F.xxhash64(F.lit("langid"), F.col("_id").cast("string"), F.octet_length("_text")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(u < F.col("_share")).select(F.xxhash64(F.col("_id").cast("string"), "_text").alias("_id"), "_text", "_lang")
    found = sample.mapInArrow(_features(bits, pieces), "key long, part int, lang string, used binary, share binary").toArrow()
    if not found.num_rows:  # hash-chosen samples of tiny tables can be empty: then all rows are few enough
        found = rows.select(F.xxhash64(F.col("_id").cast("string"), "_text").alias("_id"), "_text", "_lang").where(F.col("_lang").isin([x for x in languages if counts[x] <= per_language])).mapInArrow(_features(bits, pieces), "key long, part int, lang string, used binary, share binary").toArrow()
    found = found.sort_by([("key", "ascending"), ("part", "ascending"), ("lang", "ascending")])
    given = found.column("lang").to_pylist()
    kind = np.uint16 if bits <= 16 else np.uint32
    data = [(np.frombuffer(u.as_py(), kind), np.frombuffer(s.as_py(), np.float32)) for u, s in zip(found.column("used"), found.column("share"), strict=True)]
    seen = sorted({x for x in given if x is not None})
    place = {x: k for k, x in enumerate(seen)}
    labels = np.array([place.get(x, len(seen)) for x in given])
    keys = found.column("key").to_numpy()
    del found, sample
    model = train(data, labels, seen, bits, keys)
    del data
    settle(docs.sparkSession)
    return model


def _predict(shipped, bits, text_at=1, keep_rows=False):
    def run(batches):
        languages, scores, bias, temperature, threshold = shipped.value
        columns = [np.ascontiguousarray(c) for c in scores.T]

        def sums(data):
            """Summed scores and number of n-grams of the texts whose bytes start at ``starts``."""
            out, n = np.zeros(len(columns)), 0
            for s in range(0, len(data), SEGMENT):
                for order in ORDERS:
                    part = data[s : s + SEGMENT + order - 1]
                    if len(part) >= order:
                        g = grams(part.astype(np.uint32), order, bits)
                        n += len(g)
                        out += [c[g].sum(dtype=np.float64) for c in columns]
            return out, n

        def many(texts):
            """The same for several short texts at once; n-grams don't cross texts."""
            lengths = np.array([len(t) for t in texts])
            data, ends = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint32), np.cumsum(lengths)
            starts = ends - lengths
            total, n = np.zeros((len(texts), len(columns))), np.zeros(len(texts), np.int64)
            owner_end = np.repeat(ends, lengths)
            for order in ORDERS:
                if len(data) < order:
                    continue
                g = grams(data, order, bits)
                inside = (np.arange(len(g)) + order <= owner_end[: len(g)]).astype(np.float32)
                at = np.minimum(starts, len(g) - 1)
                for c, column in enumerate(columns):
                    total[:, c] += np.add.reduceat(column[g] * inside, at)
                n += np.maximum(0, lengths - order + 1)
            return total, n

        def judge(texts):
            """(place of the best language or -1, its probability, whether rejected) of each text."""
            picked, found = np.zeros(len(texts), np.int64) - 1, np.zeros(len(texts))
            group, held = [], 0

            def settle(which, total, n):
                p = _softmax((total / np.maximum(1, n)[:, None] + bias) / temperature)[:, : len(languages)]
                picked[which], found[which] = p.argmax(axis=1), p.max(axis=1)

            for k, text in enumerate(texts):
                if text is None or not LETTER.search(text):
                    continue
                data = clean(text)
                if len(data) > SEGMENT // 4:
                    total, n = sums(np.frombuffer(data, np.uint8))
                    settle([k], total[None, :], np.array([n]))
                    continue
                group.append((k, data))
                held += len(data)
                if held > SEGMENT // 4:
                    settle([x for x, _ in group], *many([t for _, t in group]))
                    group, held = [], 0
            if group:
                settle([x for x, _ in group], *many([t for _, t in group]))
            return picked, found, (picked < 0) | (found < threshold)

        for batch in (x for b in batches for x in slices(b)):
            picked, found, rejected = judge(batch.column(text_at).to_pylist())
            if keep_rows:
                yield batch.filter(pa.array(~rejected))
                continue
            names = np.array([*languages, "und"], object)[picked]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.clip(found, 0, 1)), pa.array(rejected)], names=[batch.schema.names[0], "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, model: Model | None, id_col="doc_id", text_col="text") -> DataFrame:
    """id, lang_pred, score, rejected of every row's whole text.

    Null texts and texts without a letter are ``und`` with score 0, and rejected; so is everything where there is no
    model. Texts whose calibrated probability is below the model's threshold keep their best language but are
    rejected. Repeated rows are predicted alike. Only the two named columns are read; nothing is shuffled. An empty table
    gives no rows; very long texts are read whole, in segments.
    """
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    if model is None:
        return rows.select(id_col, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected"))
    shipped = docs.sparkSession.sparkContext.broadcast(dataclasses.astuple(model))
    bits = int(model.scores.shape[0]).bit_length() - 1
    return rows.mapInArrow(_predict(shipped, bits), f"`{id_col}` {rows.schema[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model | None, text_col="text") -> DataFrame:
    """The rows of ``docs``, columns as they are, that identify() does not reject, in one pass without joins or keys."""
    if model is None:
        return docs.where(F.lit(False))
    shipped = docs.sparkSession.sparkContext.broadcast(dataclasses.astuple(model))
    bits = int(model.scores.shape[0]).bit_length() - 1
    return docs.mapInArrow(_predict(shipped, bits, docs.columns.index(text_col), True), docs.schema)


def fold(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")), F.lit(0)) % 3


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(F.col("doc_id")) != 1))
    out = identify(docs, model)
    return out.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "lang_pred", "score", "rejected")
