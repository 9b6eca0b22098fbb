"""Near-duplicate documents by bottom-k sketches of word shingles.

One hash function orders all shingles, but for a broadcast list of frequent ones (seen twice or more in a sample of the
rows, at most ``most`` of them), which come after all others, the rarer first. No result depends on the list: it only
shortens the inverted lists. A document retains the first values of its set in that order, as many as it can lack of a
similar set, and one more: two similar sets have a retained value in common, always.

1. Lists. Retained values go, packed, to buckets by value, which make lists of the distinct sets that retain it; lists of one
   are dropped, lists with equal members are one list with a weight.
2. Heads. The member of a list that is in most lists is its head; a set's overlap with a head is the weight of the lists that
   they share. Each set is compared with the head of its largest overlap, if sizes and overlap allow a link: links, not
   pairs, of a large group of copies.
3. The rest. A list whose members are all in one component by then can add nothing. The others generate the overlaps of sets
   of similar size in different components; a pair whose overlap is too small for the sizes can't be similar (values that
   are not retained bound what else is shared). Members of longer lists are tied without counting. What is left is clustered
   and compared tile by tile, but for pairs inside the cluster's largest component; cells of similar set sizes keep apart
   what can't be similar. Large clusters make more tasks of the same size; nothing is capped.

A comparison estimates the similarity from the bottom-k sketch of the union, and pairs that could reach the threshold are
counted on their full sets. Tasks return the components that they saw. Equal sets are compared once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._shared import components, cut, pack, roots, settle, slices, table, unpack

ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """Hashes of words met so far; emptied when it holds ``most`` words."""

    def __init__(self, most=1 << 15):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


def shingle_set(text: bytes | None, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the shingles of a text (UTF-8): A-Z lowered, words between white space.
    Fewer words than ``size`` are one shingle; no words, none."""
    words = text.lower().split() if text else ()  # bytes: ASCII case and white space only
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    m = min(n, size)
    h = np.full(n - m + 1, m, np.uint64)
    for i in range(m):
        h += w[i : n - m + 1 + i] * ODD[i % 8] + np.uint64(i // 8)
    return np.unique(mix64(h) >> np.uint64(1))


def step_of(n: int, percent: int) -> int:
    """Sizes in steps of the factor that similar sets differ by at most."""
    return math.floor(math.log(n) / (math.log(100 / percent) * (1 + 1e-9)))


def _shingles(size):
    def run(batches):
        hashes = WordHashes()
        for batch in (x for b in batches for x in slices(b, 100)):
            found = [shingle_set(t.as_py(), hashes, size) for t in batch.column("_text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).astype(np.int64))], names=["v"])

    return run


def frequent(rows: DataFrame, size: int, share=0.03, least=2000, most=1 << 18) -> np.ndarray:
    """Shingles that occur in two or more of a sample of the rows (_text), the rarer first; at most ``most``."""
    n = rows.count()
    part = rows if n <= least else rows.sample(max(share, least / n), seed=3)
    counts = part.select("_text").mapInArrow(_shingles(size), "v long").groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    found = counts.orderBy(F.desc("c"), "v").limit(most).select("v").toArrow()
    return found.column("v").to_numpy()[::-1].astype(np.uint64)


class Order:
    """The order of shingles: by hash, but ``late`` ones after all others, as they are given."""

    def __init__(self, late: np.ndarray):
        self.rank = np.argsort(late, kind="stable")
        self.late = late[self.rank]

    def retained(self, s: np.ndarray, percent: int) -> np.ndarray:
        """The first values of a sorted set, all but those that a similar set must share, and one more."""
        keep = len(s) + percent * -len(s) // 100 + 1
        if not len(self.late):
            return s[:keep]
        at = np.minimum(np.searchsorted(self.late, s), len(self.late) - 1)
        late = self.late[at] == s
        early = s[~late][:keep]
        if len(early) == keep:
            return early
        rest = s[late][np.argsort(self.rank[at[late]], kind="stable")]
        return np.concatenate([early, rest[: keep - len(early)]])


def _sketches(size, percent, shipped):
    def run(batches):
        hashes, order = WordHashes(), Order(shipped.value)
        for batch in (x for b in batches for x in slices(b)):
            n, key, kept = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), hashes, size)
                n.append(len(s))
                key.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                kept.append(order.retained(s, percent).view(np.int64) if len(s) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(key, pa.string()), pa.array(kept, pa.list_(pa.int64()))], names=["_id", "n_shingles", "_set", "_kept"])

    return run


def _sets(size):
    def run(batches):
        hashes = WordHashes()
        for batch in (x for b in batches for x in slices(b)):
            sets = pa.array([shingle_set(t.as_py(), hashes, size).tobytes() for t in batch.column("_text")], pa.binary())
            keep = [k for k in batch.schema.names if k != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), sets], names=[*keep, "_values"])

    return run


def _ask(buckets: int):
    """bucket, blob: the retained values of (_node, _kept) rows, sorted, and the nodes that retain them. A bucket needs 36 bits of
    a value: values that coincide there only make candidates more."""

    def run(batches):
        for batch in (x for b in batches for x in slices(b, 5000)):
            node, first = np.unique(batch.column("_node").to_numpy(), return_index=True)
            kept = batch.column("_kept").take(pa.array(first))
            value = kept.flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(node, np.diff(kept.offsets.to_numpy()))
            bucket, value = value % buckets, value // buckets & (1 << 36) - 1
            order = np.lexsort((value, bucket))
            value, owner, bucket = value[order], owner[order], bucket[order]
            used = np.unique(bucket)
            cuts = np.searchsorted(bucket, [used, used + 1])
            blobs = [pack(np.diff(value[a:b], prepend=0), owner[a:b]) for a, b in zip(*cuts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    return run


def _lists(key, group):
    """list, node, weight: the members of lists of two or more; ``list`` is a hash of its members, which names equal lists alike."""
    parts = [unpack(b.as_py()) for b in group.column("blob")]
    value, node = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((node, value))
    value, node = value[order], node[order]
    if len(value):
        new = np.append(True, (value[1:] != value[:-1]) | (node[1:] != node[:-1]))
        value, node = value[new], node[new]
    start = np.nonzero(np.append(True, value[1:] != value[:-1]))[0] if len(value) else np.empty(0, np.int64)
    size = np.diff(np.append(start, len(value)))
    several = np.repeat(size > 1, size)
    node, size = node[several], size[size > 1]
    if not len(node):
        return pa.table({"list": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "weight": pa.array([], pa.int64())})
    name = mix64(np.add.reduceat(mix64(node.astype(np.uint64)), np.cumsum(size) - size) + size.astype(np.uint64)).view(np.int64)
    rows = pa.table({"list": pa.array(np.repeat(name, size)), "node": pa.array(node)})
    return rows.group_by(["list", "node"]).aggregate([([], "count_all")]).rename_columns(["list", "node", "weight"])


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, most=8192) -> np.ndarray:
    """Sizes of the intersections of the sets ``left`` with the sets ``right``, by incidence matrices over shared values."""
    which = np.unique(np.concatenate([left, right]))
    at = np.full(len(sets), -1)
    at[which] = np.arange(len(which))
    values = np.concatenate([sets[k] for k in which])
    owner = np.repeat(np.arange(len(which)), [len(sets[k]) for k in which])
    _, value, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[value] > 1
    column = (np.cumsum(count > 1) - 1)[value[shared]]
    owner = owner[shared]
    out = np.zeros((len(left), len(right)), np.int64)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = int(column[-1]) + 1 if len(column) else 0
    for c in range(0, width, most):
        a, b = np.searchsorted(column, [c, c + most])
        grid = np.zeros((len(which), min(most, width - c)), np.float32)
        grid[owner[a:b], column[a:b] - c] = 1
        out += (grid[at[left]] @ grid[at[right]].T).astype(np.int64)
    return out


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, k: int):
    """Index pairs (into left, into right) with 100 * intersection >= percent * union."""
    sketches = [s[:k] for s in sets]
    last = np.array([s[k - 1] if len(s) >= k else np.uint64(2**64 - 1) for s in sets], np.uint64)
    inter = overlaps(sketches, left, right)
    # Of the union's bottom-k sketch: values up to the smaller of the two sketches' ends.
    in_left = np.stack([np.searchsorted(sketches[i], last[right], "right") for i in left])
    in_right = np.stack([np.searchsorted(sketches[j], last[left], "right") for j in right], axis=1)
    union = in_left + in_right - inter
    t = percent / 100
    maybe = inter >= (t - 5 * math.sqrt(t * (1 - t) / k)) * union
    size = np.array([len(s) for s in sets])
    maybe &= 100 * np.minimum(size[left][:, None], size[right][None, :]) >= percent * np.maximum(size[left][:, None], size[right][None, :])
    return maybe, size


def blocks(sizes: list[int], most=1 << 19) -> np.ndarray:
    """Numbers of blocks of consecutive sets, none with more than about ``most`` values."""
    return (np.cumsum(sizes) - 1) // most


def links(sets, left, right, same: bool, percent: int, k=128):
    maybe, size = similar(sets, left, right, percent, k)
    if same:
        maybe &= np.triu(np.ones(maybe.shape, bool), 1)
    i, j = np.nonzero(maybe)
    if not len(i):
        return left[i], right[j]
    if len(i) <= 512:
        inter = np.array([len(np.intersect1d(sets[left[a]], sets[right[b]], assume_unique=True)) for a, b in zip(i, j, strict=True)])
    else:
        inter = np.zeros(len(i), np.int64)
        of_i, of_j = (block[np.searchsorted(u, k)] for u, block, k in ((u, blocks([len(sets[side[x]]) for x in u]), k) for u, side, k in ((np.unique(i), left, i), (np.unique(j), right, j))))
        for code in np.unique(of_i * (1 << 20) + of_j):
            at = np.nonzero((of_i == code >> 20) & (of_j == code & ((1 << 20) - 1)))[0]
            ui, uj = np.unique(i[at]), np.unique(j[at])
            inter[at] = overlaps(sets, left[ui], right[uj])[np.searchsorted(ui, i[at]), np.searchsorted(uj, j[at])]
    a, b = left[i], right[j]
    ok = 100 * inter >= percent * (size[a] + size[b] - inter)
    return a[ok], b[ok]


def _overlaps(percent):
    """a, b, overlap: for each ``list`` of a group, the pairs of different components and similar sizes, with its weight."""

    def run(key, group):
        rows = group.sort_by([("list", "ascending"), ("rep", "ascending")])
        name, rep, n, c, weight = (rows.column(k).to_numpy() for k in ("list", "rep", "n", "c", "weight"))
        starts = np.append(np.nonzero(np.append(True, name[1:] != name[:-1]))[0], len(name))
        out = [(np.empty(0, np.int64),) * 3]
        for s, e in zip(starts, starts[1:], strict=False):
            i, j = np.triu_indices(e - s, 1)
            low, high = np.minimum(n[s + i], n[s + j]), np.maximum(n[s + i], n[s + j])
            ok = (c[s + i] != c[s + j]) & (100 * low >= percent * high)
            out.append((rep[s + i[ok]], rep[s + j[ok]], np.full(int(ok.sum()), weight[s])))
        a, b, w = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"a": pa.array(a), "b": pa.array(b), "overlap": pa.array(w)}).group_by(["a", "b"]).aggregate([("overlap", "sum")]).rename_columns(["a", "b", "overlap"])

    return run


def _compare(percent):
    """Compares, for each ``sub`` of a group, its home rows with each other (where ``same``) and with its other rows (side 1)."""

    def run(key, group):
        rows = group.sort_by([("sub", "ascending"), ("rep", "ascending")])
        sub, rep, side, same = (rows.column(k).to_numpy() for k in ("sub", "rep", "side", "same"))
        values, out = rows.column("_values"), [(np.empty(0, np.int64),) * 2]
        starts = np.append(np.nonzero(np.append(True, sub[1:] != sub[:-1]))[0], len(sub))
        for s, e in zip(starts, starts[1:], strict=False):
            sets = [np.frombuffer(v.as_py(), np.uint64) for v in values[int(s) : int(e)]]
            home, other = np.nonzero(side[s:e] == 0)[0], np.nonzero(side[s:e] == 1)[0]
            found = [links(sets, home, home, True, percent)] if same[s] and len(home) > 1 else []
            if len(home) and len(other):
                found.append(links(sets, home, other, False, percent))
            for i, j in found:
                low = roots(e - s, i, j)
                moved = np.nonzero(low != np.arange(e - s))[0]
                out.append((rep[s:e][moved], rep[s:e][low[moved]]))
        a, b = (np.concatenate(z) for z in zip(*out, strict=True))
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return run


def _tile_tasks(rows: DataFrame, tile: int) -> DataFrame:
    """Deals ``rows`` (cluster, cell, rep, minor) out: sub, task, side, same, rep. Any two rows of a cluster in the same or in
    adjacent cells, of which one is minor, meet in one sub. A cluster of up to ``tile`` rows is one sub; in larger ones, tiles of
    minor rows meet tiles of all."""
    total = rows.groupBy("cluster").agg(F.count("*").alias("total"))
    rows = rows.join(total, "cluster")
    small = rows.where(F.col("total") <= tile).select(F.col("cluster").alias("sub"), F.lit(0).alias("large"), F.when(F.col("minor"), 0).otherwise(1).alias("side"), F.lit(True).alias("same"), "rep")
    at = ["cluster", "cell", "minor"]
    large = rows.where(F.col("total") > tile).select(*at, "rep")
    counts = large.groupBy(*at).agg(F.ceil(F.count("*") / tile).cast("int").alias("_t"))
    large = large.join(counts, at).withColumn("i", F.pmod(F.xxhash64("rep"), F.col("_t")).cast("int")).drop("_t")
    tiles = counts.select(*at, F.explode(F.sequence(F.lit(0), F.col("_t") - 1)).alias("i"))
    near = tiles.select("cluster", F.explode(F.array(F.col("cell") - 1, "cell", F.col("cell") + 1)).alias("cell"), F.struct("cell", "minor", "i").alias("y"))
    x = F.struct("cell", "minor", "i")
    pairs = tiles.where("minor").select("cluster", "cell", x.alias("x")).join(near, ["cluster", "cell"]).where("not y.minor or struct(y.cell, y.i) >= struct(x.cell, x.i)")
    pairs = cut(pairs.select("cluster", "x", "y", F.xxhash64("cluster", "x", "y").alias("sub")), "minhash-tiles")
    sides = [
        large.withColumn(k, x).join(pairs.where("x = y" if k == "x" and n else "x <> y"), ["cluster", k]).select("sub", F.lit(1).alias("large"), F.lit(side).alias("side"), F.lit(bool(n)).alias("same"), "rep")
        for k, side, n in (("x", 0, 1), ("x", 0, 0), ("y", 1, 0))
    ]
    out = small
    for one in sides:
        out = out.unionByName(one)
    return out


def _found(dealt: DataFrame, rows: DataFrame, shingle: int, percent: int, broadcast_ids: int, per_task=500) -> DataFrame:
    """The links' components of ``dealt`` (sub, large, side, same, rep): a, b. Small subs share a task. Sets are made again from
    the texts (``rows``: _id, _text) where they are wanted."""
    dealt = cut(dealt, "minhash-dealt")
    small, n = dealt.agg(F.count_if(F.col("large") == 0), F.count("*")).first()
    dealt = dealt.withColumn("task", F.when(F.col("large") == 0, F.pmod(F.xxhash64("sub"), F.lit(max(1, small // per_task)))).otherwise(F.col("sub")))
    texts = rows.join(F.broadcast(dealt) if n <= broadcast_ids else dealt, F.col("_id") == F.col("rep"))
    sets = texts.select("large", "task", "sub", "side", "same", "rep", "_text").mapInArrow(_sets(shingle), "large int, task long, sub long, side int, same boolean, rep long, _values binary")
    return sets.groupBy("large", "task").applyInArrow(_compare(percent), "a long, b long")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", shingle=5, percent=85, tile=512, bucket_entries=1 << 19, broadcast_ids=500_000, most_frequent=1 << 18, short_list=256) -> DataFrame:
    """id, n_shingles, component_id, kept of every row.

    Null texts and texts without words have an empty set and link with nothing, as do rows with null id. Rows that
    repeat an id share its component. Ties don't arise: a component is named by its smallest id. Texts are used whole;
    only the two named columns are read. An empty table gives no rows. Candidate ids are broadcast up to
    ``broadcast_ids`` and joined by a shuffle beyond; ``most_frequent`` bounds the broadcast list of frequent shingles.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    settle(docs.sparkSession)
    late = docs.sparkSession.sparkContext.broadcast(frequent(rows, shingle, most=most_frequent))
    sketched = cut(rows.mapInArrow(_sketches(shingle, percent, late), "_id long, n_shingles long, _set string, _kept array<bigint>"), "minhash-sketches")
    ok = F.col("_id").isNotNull() & (F.col("n_shingles") > 0)
    node = F.shiftrightunsigned(F.xxhash64("_set"), 16)  # names of sets; sets that share one only make candidates more
    classes = cut(sketched.where(ok).groupBy("_set").agg(F.min("_id").alias("rep"), F.max("n_shingles").alias("n")).withColumn("node", node), "minhash-classes")
    entries = sketched.where(ok).agg(F.coalesce(F.sum(F.size("_kept")), F.lit(0))).first()[0]
    asked = sketched.where(ok).select(node.alias("_node"), "_kept").mapInArrow(_ask(max(1, -(-entries // bucket_entries))), "bucket int, blob binary")
    lists = asked.groupBy("bucket").applyInArrow(_lists, "list long, node long, weight long").groupBy("list", "node").agg(F.sum("weight").alias("weight"))
    lists = cut(lists.join(classes.select("node", "rep", "n"), "node").groupBy("list", "rep").agg(F.max("weight").alias("weight"), F.max("n").alias("n")), "minhash-lists")
    members = cut(lists.groupBy("rep").agg(F.sum("weight").alias("degree"), F.max("n").alias("n")), "minhash-members")

    size = members.select("rep", "n")

    def possible(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, overlap) that could be similar, by their sizes and by what values that aren't retained could add."""
        pairs = pairs.join(size.withColumnsRenamed({"rep": "a", "n": "n_a"}), "a").join(size.withColumnsRenamed({"rep": "b", "n": "n_b"}), "b")
        share = lambda n: F.ceil(F.col(n) * percent / 100)
        least = F.ceil((F.col("n_a") + F.col("n_b")) * percent / F.lit(100.0 + percent) - 1e-6) - F.greatest(share("n_a"), share("n_b")) + 1
        return pairs.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (F.col("overlap") >= least))

    # Each set against the head that it shares most with.
    heads = lists.join(members.select("rep", "degree"), "rep").groupBy("list").agg(F.max(F.struct("degree", "rep"))["rep"].alias("head"))
    ties = lists.join(heads, "list").where("rep <> head").groupBy(F.col("rep").alias("a"), F.col("head").alias("b")).agg(F.sum("weight").alias("overlap"))
    star = cut(possible(ties).groupBy(F.col("a").alias("rep")).agg(F.max(F.struct("overlap", "b"))["b"].alias("head")), "minhash-star")
    hot = star.groupBy("head").agg(F.ceil(F.count("*") / tile).cast("int").alias("parts"))
    sub = F.xxhash64("head", "part").alias("sub")
    others = star.join(hot, "head").withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).select(sub, F.lit(1).alias("side"), "rep")
    homes = hot.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(sub, F.lit(0).alias("side"), F.col("head").alias("rep"))
    dealt = others.unionByName(homes).select("sub", F.lit(0).alias("large"), "side", F.lit(False).alias("same"), "rep")
    first = cut(components(_found(dealt, rows, shingle, percent, broadcast_ids)), "minhash-first")
    settle(docs.sparkSession)
    # Lists of several components.
    known = lists.join(first, F.col("rep") == F.col("node"), "left").select("list", "rep", "n", "weight", F.coalesce("component", "rep").alias("c"))
    mixed = known.groupBy("list").agg(F.min("c").alias("least"), F.max("c").alias("most"), F.min("rep").alias("b"), F.count("*").alias("members")).where("least < most")
    open_ = cut(known.join(mixed.select("list", "b", "members"), "list"), "minhash-open")
    short = open_.where(F.col("members") <= short_list)
    task = F.pmod(F.xxhash64("list"), F.lit(max(1, short.count() // 20_000))).alias("task")
    pairs = short.select(task, "list", "rep", "n", "c", "weight").groupBy("task").applyInArrow(_overlaps(percent), "a long, b long, overlap long").groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    ties = possible(pairs).select("a", "b").unionByName(open_.where((F.col("members") > short_list) & (F.col("rep") != F.col("b"))).select(F.col("rep").alias("a"), "b"))
    clusters = components(ties)
    placed = open_.select("rep", "n", "c").distinct().join(clusters, F.col("rep") == F.col("node")).select(F.col("component").alias("cluster"), "rep", "n", "c")
    placed = cut(placed, "minhash-placed")
    major = placed.groupBy("cluster", "c").agg(F.count("*").alias("k")).groupBy("cluster").agg(F.max(F.struct("k", "c"))["c"].alias("major"))
    cell = F.floor(F.log(F.col("n").cast("double")) / (math.log(100 / percent) * (1 + 1e-9))).cast("int").alias("cell")
    placed = placed.join(major, "cluster").select("cluster", cell, "rep", (F.col("c") != F.col("major")).alias("minor"))
    second = _found(_tile_tasks(placed, tile), rows, shingle, percent, broadcast_ids)
    groups = components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(second))
    named = classes.drop("node").join(groups, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("_set").alias("s"), F.coalesce("component", "rep").alias("component_id"))
    linked = sketched.where(ok).join(named, F.col("_set") == F.col("s")).select("_id", "n_shingles", "component_id")
    alone = sketched.where(~ok).select("_id", "n_shingles", F.col("_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), inter AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, d.doc_id = coalesce(c, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN comp ON comp.a = d.doc_id
"""
