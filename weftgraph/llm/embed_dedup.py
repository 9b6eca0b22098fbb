"""Near-duplicate embeddings: a subspace pigeonhole join under a squared-distance budget.

For unit vectors, cosine >= t is squared distance <= 2 - 2t. A fixed rotation spreads the distance, the rotated
vector is split into blocks, and each block gets a share of the budget in proportion to its dimensions. A pair within
the budget is within the share of at least one block, so joining each block by range and checking the union of
candidates exactly loses nothing.

A block's range join runs on cells over its first coordinates, as wide as the block's radius: a vector is at home in one
cell and visits those of the forward neighbours (half of all; the other half visit it) that its ball reaches. Each further
coordinate (``axes``) compares fewer pairs but sends a vector to more cells. Large cells are split
into tiles of bounded size and each task compares two tiles, so that a hot cell becomes many equal tasks. A pair is handled
in its first block only (tasks hold whole vectors and can tell), hence pairs are neither emitted nor shuffled: a task
returns link counts and the components that it saw.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm._shared import components, cut, roots, slices, table

SLACK = 1e-9


def rotation(dim: int) -> np.ndarray:
    """An orthogonal matrix that depends on the dimension only."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_bounds(dim: int, blocks: int) -> list[tuple[int, int]]:
    cuts = np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)
    return [(int(a), int(b)) for a, b in zip(cuts, cuts[1:], strict=False)]


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotate(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Row by row, so that a vector's coordinates don't depend on what else is in the batch."""
    return np.stack([(x * row).sum(axis=1) for row in matrix], axis=1)


def budgets(dim: int, blocks: int, threshold: float) -> list[tuple[int, int, float]]:
    whole = (2 - 2 * threshold) * (1 + SLACK) + SLACK
    return [(a, b, whole * (b - a) / dim) for a, b in block_bounds(dim, blocks)]


def tile_links(left, right, same: bool, block: int, shares, threshold: float, matrix):
    """Index pairs (i, j) that link and whose first block within its share is ``block``."""
    xl, xr = unit(left), unit(right)
    rl, rr = rotate(xl, matrix), rotate(xr, matrix)
    a, b, share = shares[block]
    u, v = rl[:, a:b], rr[:, a:b]
    d = (u * u).sum(1)[:, None] + (v * v).sum(1)[None, :] - 2 * (u @ v.T)
    near = d <= share + 1e-6
    if same:
        near &= np.triu(np.ones(near.shape, bool), 1)
    i, j = np.nonzero(near)
    keep_i, keep_j = [], []
    for s in range(0, len(i), 65536):
        p, q = i[s : s + 65536], j[s : s + 65536]
        cos = (xl[p] * xr[q]).sum(1)
        ok = cos >= threshold
        p, q = p[ok], q[ok]
        square = (rl[p] - rr[q]) ** 2
        ok = square[:, a:b].sum(1) <= share
        for e, f, earlier in shares[:block]:
            ok &= square[:, e:f].sum(1) > earlier
        keep_i.append(p[ok])
        keep_j.append(q[ok])
    return (np.concatenate(keep_i), np.concatenate(keep_j)) if keep_i else (i, j)


def cells_of(x: np.ndarray, width: float):
    """(rows, cells, visit) of vectors ``x`` (coordinates only): the home of each, and the forward neighbours in its reach."""
    home = np.floor(x / width).astype(np.int64)
    low, high = x - home * width, (home + 1) * width - x
    rows, cells, visit = [np.arange(len(x))], [home], [np.zeros(len(x), np.int32)]
    for step in itertools.product((-1, 0, 1), repeat=x.shape[1]):
        if step <= (0,) * len(step):
            continue
        gap = sum(((high if k > 0 else low)[:, i] ** 2 for i, k in enumerate(step) if k), np.zeros(len(x)))
        near = np.nonzero(gap <= width * width)[0]
        rows.append(near)
        cells.append(home[near] + np.array(step))
        visit.append(np.ones(len(near), np.int32))
    return np.concatenate(rows), np.concatenate(cells), np.concatenate(visit)


def _cells(shares_of, axes):
    def run(batches):
        for batch in (x for b in batches for x in slices(b, 2000)):
            vectors = batch.column("_vec")
            lengths = np.array([len(v) for v in vectors])
            out = {k: [] for k in ("row", "dim", "block", "cell", "visit")}
            for dim in np.unique(lengths).tolist():
                matrix, shares = shares_of(dim)
                part = np.nonzero(lengths == dim)[0]
                x = rotate(unit(np.array([vectors[int(r)].as_py() for r in part], dtype=float)), matrix)
                for k, (a, b, share) in enumerate(shares):
                    rows, cells, visit = cells_of(x[:, a : min(a + axes, b)], np.sqrt(share) * (1 + SLACK))
                    out["row"].append(part[rows])
                    out["dim"].append(np.full(len(rows), dim))
                    out["block"].append(np.full(len(rows), k))
                    out["cell"] += [",".join(map(str, c)) for c in cells.tolist()]
                    out["visit"].append(visit)
            if not out["row"]:
                continue
            row = pa.array(np.concatenate(out["row"]))
            cols = [batch.column("rep").take(row), batch.column("_label").take(row), *(pa.array(np.concatenate(out[k]).astype(np.int32)) for k in ("dim", "block")), pa.array(out["cell"]), pa.array(np.concatenate(out["visit"])), vectors.take(row), batch.column("n").take(row)]
            yield pa.RecordBatch.from_arrays(cols, names=["rep", "_label", "dim", "block", "cell", "visit", "_vec", "n"])

    return run


def deal(rows: DataFrame, keys: list[str], tile: int) -> DataFrame:
    """Deals home and visiting rows of a cell (``keys``) out to tasks (keys, i, j, v): home tiles i <= j of a cell meet in a
    task with v = -1, a home tile i and a visitors' tile v in one with j = -1, and all of a cell that is one tile of each
    in one with i = j = v = 0. ``role``: 0 home as i, 1 home as j, 2 visitor."""
    tiles = lambda c: F.ceil(F.sum(c) / tile).cast("int")
    counts = rows.groupBy(*keys).agg(tiles(1 - F.col("visit")).alias("_h"), tiles(F.col("visit")).alias("_v"))
    counts = counts.where("_h > 0")
    rows = rows.join(counts, keys)
    own = F.pmod(F.xxhash64("rep"), F.when(F.col("visit") == 0, F.col("_h")).otherwise(F.col("_v"))).cast("int")
    rows = rows.withColumn("_own", own)

    def each(n: Column, task) -> Column:
        return F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), task)

    def to(i: Column, j: Column, v: Column, role) -> Column:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), v.cast("int").alias("v"), F.lit(role).cast("int").alias("role"))

    zero, none, mine = F.lit(0), F.lit(-1), F.col("_own")
    one = F.array(to(zero, zero, zero, F.when(F.col("visit") == 0, 0).otherwise(2)))
    home = F.concat(
        each(F.col("_h"), lambda k: to(F.least(mine, k), F.greatest(mine, k), none, F.when(mine <= k, 0).otherwise(1))),
        each(F.col("_v"), lambda k: to(mine, none, k, 0)),
    )
    visitor = each(F.col("_h"), lambda k: to(k, none, mine, 2))
    tasks = F.when((F.col("_h") == 1) & (F.col("_v") <= 1), one).when(F.col("visit") == 0, home).otherwise(visitor)
    dealt = rows.withColumn("_g", F.explode(tasks)).drop("_h", "_v", "_own", "visit")
    return dealt.select("*", "_g.i", "_g.j", "_g.v", "_g.role").drop("_g")


def _compare(shares_of, threshold):
    def run(key, group):
        dim, block, tile_i, tile_j, tile_v = (k.as_py() for k in (key[1], key[2], *key[4:]))
        matrix, shares = shares_of(dim)
        order = group.sort_by("rep")
        role = order.column("role").to_numpy()
        vec = order.column("_vec").combine_chunks()
        x = vec.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(role), dim)
        rep, n = order.column("rep").to_numpy(), order.column("n").to_numpy()
        sides = [np.nonzero(role == k)[0] for k in range(3)]
        meet = [(0, 0)] if tile_i == tile_j else [(0, 1)] if tile_v < 0 else []
        meet += [(0, 2)] if tile_v >= 0 else []
        found = []
        for p, q in meet:
            if len(sides[p]) and len(sides[q]):
                i, j = tile_links(x[sides[p]], x[sides[q]], p == q, block, shares, threshold, matrix)
                found.append((sides[p][i], sides[q][j]))
        i, j = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))
        links = np.bincount(i, weights=n[j], minlength=len(rep)) + np.bincount(j, weights=n[i], minlength=len(rep))
        hit = np.nonzero(links)[0]
        low = roots(len(rep), i, j)
        return pa.table({"a": pa.array(rep[hit]), "b": pa.array(rep[low[hit]]), "links": pa.array(links[hit].astype(np.int64))})

    return run


def near_duplicates(vectors: DataFrame, id_col="vec_id", vec_col="embedding", label_col="label", threshold=0.93, blocks=8, axes=1, tile=2048) -> DataFrame:
    """id, n_links, component_id, kept of every row, comparing rows of equal non-null labels and equal dimension.

    Vectors that are null, empty, zero or hold null or non-finite components, rows with null label and rows with null
    id link with nothing; their component is their id. Equal vectors are compared once, with their number, and count as
    links of each other; rows that repeat an id count as vectors of their own. Only the three named columns are read. An
    empty table gives no rows.
    """
    v = vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), F.col(vec_col).alias("_vec"))
    ok = F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("_vec").isNotNull()
    whole = F.coalesce(F.forall("_vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    ok &= whole & F.coalesce(F.exists("_vec", lambda x: x != 0), F.lit(False))
    reps = v.where(ok).groupBy("_label", "_vec").agg(F.min("_id").cast("long").alias("rep"), F.count("*").alias("n"))
    reps = cut(reps, "embed-reps")
    known: dict = {}

    def shares_of(dim):
        if dim not in known:
            known[dim] = rotation(dim), budgets(dim, blocks, threshold)
        return known[dim]

    label, vec = reps.schema["_label"].dataType.simpleString(), reps.schema["_vec"].dataType.simpleString()
    home = reps.mapInArrow(_cells(shares_of, axes), f"rep long, _label {label}, dim int, block int, cell string, visit int, _vec {vec}, n long")
    dealt = deal(home, ["_label", "dim", "block", "cell"], tile)
    found = dealt.groupBy("_label", "dim", "block", "cell", "i", "j", "v").applyInArrow(_compare(shares_of, threshold), "a long, b long, links long")
    found = cut(found, "embed-links")
    groups = components(found.select("a", "b"))
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    known_reps = reps.join(links, F.col("a") == F.col("rep"), "left").join(groups, F.col("node") == F.col("rep"), "left")
    known_reps = known_reps.select(
        F.col("_label").alias("l"), F.col("_vec").alias("v"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id")
    )
    linked = v.where(ok).join(known_reps, (F.col("_label") == F.col("l")) & (F.col("_vec") == F.col("v"))).select("_id", "n_links", "component_id")
    alone = v.where(~ok).select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").cast("long").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a), cnt AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(c, vec_id)::BIGINT AS component_id, vec_id = coalesce(c, vec_id) AS kept
FROM embeddings LEFT JOIN cnt ON cnt.a = vec_id LEFT JOIN comp ON comp.a = vec_id
"""
