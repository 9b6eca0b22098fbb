"""Graph algorithms as DataFrame loops: components, degree, shortest paths, driving distance, k shortest paths.

Edge frames have src, dst, cost and optionally reverse_cost and id; a negative cost means that the edge is absent in
that direction. Only counts reach the driver; frontiers are written, so that a lost executor costs one round.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from weftgraph.plans.storage import cut, forget, let_go


def arcs(edges: DataFrame, directed=True) -> DataFrame:
    """u, v, cost, edge: every direction in which an edge can be walked."""
    edge = F.col("id") if "id" in edges.columns else F.struct("src", "dst", "cost")
    out = edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("cost").cast("double").alias("cost"), edge.alias("edge"))
    back = [out.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost", "edge")] if not directed else []
    if "reverse_cost" in edges.columns:
        r = edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), F.col("reverse_cost").cast("double").alias("cost"), edge.alias("edge"))
        back += [r] + ([r.select(F.col("v").alias("u"), F.col("u").alias("v"), "cost", "edge")] if not directed else [])
    for b in back:
        out = out.unionByName(b)
    return out.where("cost >= 0")


def degree(vertices: DataFrame, edges: DataFrame, direction="both") -> DataFrame:
    """id, degree of every vertex (column id); a self-loop counts on both sides."""
    ends = {"out": [F.col("src")], "in": [F.col("dst")], "both": [F.col("src"), F.col("dst")]}[direction]
    n = edges.select(F.explode(F.array(*ends)).alias("_e")).groupBy("_e").agg(F.count("*").alias("n"))
    return vertices.select("id").join(n, F.col("id") == F.col("_e"), "left").select("id", F.coalesce("n", F.lit(0)).alias("degree"))


def components(edges: DataFrame) -> DataFrame:
    """node, component of every node of ``edges`` (a, b); component is the smallest reachable node.

    Alternating large-star and small-star rounds (Kiveris et al., 2014): each round replaces the edges by edges to
    smaller nodes, at most as many as before. Only counts and a checksum reach the driver. Minima are combined
    before the shuffle and written, so that the join to them has a shuffle of its own on both sides, whose hot nodes
    adaptive execution can split.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = cut(e, "cc"), None
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("sum(cast(xxhash64(v) as decimal(38,0)))")).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, cut(moved.unionByName(small.withColumnRenamed("m", "v")).distinct(), "cc")
        forget(last)
        forget(least)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component of every vertex: the smallest id that it reaches, direction aside."""
    found = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    return vertices.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def _counted(df: DataFrame, name: str, flag: str) -> tuple[DataFrame, int]:
    """cut(), and the number of rows with a flag, which is counted as they are written."""
    seen = Observation()
    return cut(df.observe(seen, F.count_if(flag).alias("n")), name), seen.get["n"]


FEW = 200_000  # rows of a frontier that are broadcast; more are dealt to the arcs, which lie by their first node


def _tree(edges: DataFrame, starts: DataFrame, directed=True, limit=None, most=100_000) -> tuple[DataFrame, DataFrame]:
    """(start, node, agg_cost, depth, pred: a shortest-path tree for each start; the arcs u, v, cost, edge). Each round writes one
    table, the best known paths with a flag on those that improved; the arcs are dealt out once, whatever the number of rounds."""
    spark = edges.sparkSession
    bare = directed and not {"id", "reverse_cost"} & set(edges.columns) and dict(edges.dtypes)["cost"] == "double"
    a = arcs(edges, directed).groupBy("u", "v")
    if bare:  # an arc is its edge: nothing but costs to compare
        a = cut(a.agg(F.min("cost").alias("cost")), "arcs").select("u", "v", "cost", F.struct(F.col("u").alias("src"), F.col("v").alias("dst"), "cost").alias("edge"))
    else:
        a = cut(a.agg(F.min(F.struct("cost", "edge")).alias("m")).select("u", "v", "m.cost", "m.edge"), "arcs")
    light, dealt, row = a.select("u", "v", "cost"), None, ["agg_cost", "depth", "pred"]
    best = starts.select(F.col("id").alias("start"), F.col("id").alias("node")).distinct()
    best = cut(best.select("start", "node", F.lit(0.0).alias("agg_cost"), F.lit(0).alias("depth"), F.lit(None).cast(dict(a.dtypes)["u"]).alias("pred"), F.lit(True).alias("new")), "best")
    n = best.count()
    try:
        for done in range(most):
            if not n:
                return best.drop("new"), a
            front = best.where("new").select("start", F.col("node").alias("u"), F.col("agg_cost").alias("a"), F.col("depth").alias("d"))
            if n > FEW and dealt is None:
                dealt = light.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "u").sortWithinPartitions("u").persist(StorageLevel.DISK_ONLY)
            step = light.join(F.broadcast(front), "u") if n <= FEW else front.join(dealt, "u")
            step = step.select("start", F.col("v").alias("node"), (F.col("a") + F.col("cost")).alias("agg_cost"), (F.col("d") + 1).alias("depth"), F.col("u").alias("pred"))
            step = step if limit is None else step.where(F.col("agg_cost") <= limit)
            both = best.select("start", "node", F.struct(*row).alias("m"), F.struct(*row).alias("old")).unionByName(step.select("start", "node", F.struct(*row).alias("m")), allowMissingColumns=True)
            both = both.groupBy("start", "node").agg(F.min("m").alias("m"), F.min("old").alias("old"))
            last, (best, n) = best, _counted(both.select("start", "node", "m.*", F.expr("old is null or m < old").alias("new")), "best", "new")
            forget(last)
            if done % 8 == 7:
                let_go(spark)
    finally:
        if dealt is not None:
            dealt.unpersist()
    raise RuntimeError(f"no fixed point in {most} rounds")


def shortest(edges: DataFrame, starts: DataFrame, directed=True, limit=None, most=100_000, edge=True) -> DataFrame:
    """start, node, agg_cost, depth, pred, edge, cost: a shortest-path tree for each start (column id), by relaxing the
    arcs out of the nodes that improved in the round before. ``limit`` bounds the aggregate cost. Of equal costs the
    fewest edges win, then the smallest predecessor. The loop ends with the first round in which nothing improves, after as
    many rounds as the longest of these paths has edges; more than ``most`` are an error. Without ``edge`` the last two
    columns, those of the arc into the node, are left out."""
    best, a = _tree(edges, starts, directed, limit, most)
    if not edge:
        return best
    into = a.select(F.col("u").alias("pred"), F.col("v").alias("node"), "edge", "cost")
    return best.join(into, ["pred", "node"], "left").select("start", "node", "agg_cost", "depth", "pred", "edge", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def _walk_back(tree: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """The rows (start, end, node, ...) of each path from its end to its start, by the tree's predecessors: each round doubles
    the part of every path that is known, by the rows so many steps up the tree."""
    at = [c for c in columns if c not in ("start", "end")]
    above = tree.select("start", F.col("node").alias("pred"), F.struct(*at).alias("up"))
    hop = cut(tree.where("pred is not null").select("start", "node", "pred").join(above, ["start", "pred"]).select("start", "node", "up"), "hop")
    out = [cut(rows.select(*columns), "walk")]
    while True:
        more = cut(reduce(DataFrame.unionByName, out).where("node <> start").join(hop, ["start", "node"]).select("start", "end", "up.*").select(*columns), "walk")
        if more.isEmpty():
            return reduce(DataFrame.unionByName, out)
        out.append(more)
        further = hop.select("start", F.col("node").alias("_n"), F.col("up").alias("_up"))
        far = hop.alias("h").join(further.alias("f"), F.expr("h.start = f.start and h.up.node = f._n"))
        last, hop = hop, cut(far.select(F.col("h.start").alias("start"), F.col("h.node").alias("node"), F.col("f._up").alias("up")), "hop")
        forget(last)


def dijkstra(edges: DataFrame, starts: DataFrame, ends: DataFrame, directed=True) -> DataFrame:
    """start, end, seq, node, edge, traversal_cost, traversal_agg_cost: the shortest path of each pair, node by node.
    ``edge`` and ``traversal_cost`` lead into the node."""
    tree = cut(shortest(edges, starts, directed), "tree")
    rows = tree.join(ends.select(F.col("id").alias("node")).distinct(), "node").where("start <> node").withColumn("end", F.col("node"))
    out = _walk_back(tree, rows, ["start", "end", "depth", "node", "edge", "cost", "agg_cost"])
    return out.select("start", "end", F.col("depth").alias("seq"), "node", "edge", F.col("cost").alias("traversal_cost"), F.col("agg_cost").alias("traversal_agg_cost"))


def driving_distance(edges: DataFrame, starts: DataFrame, distance: float, directed=True) -> DataFrame:
    """start, node, traversal_agg_cost, traversal_depth, pred, leaf: the nodes within a distance, and whether a path ends there."""
    tree = shortest(edges, starts, directed, limit=distance, edge=False)
    inner = tree.where("pred is not null").select(F.col("start").alias("_s"), F.col("pred").alias("_p")).distinct()
    out = tree.join(inner, (F.col("start") == F.col("_s")) & (F.col("node") == F.col("_p")), "left")
    return out.select("start", "node", F.col("agg_cost").alias("traversal_agg_cost"), F.col("depth").alias("traversal_depth"), "pred", F.col("_p").isNull().alias("leaf"))


def driving_paths(edges: DataFrame, starts: DataFrame, distance: float, directed=True) -> DataFrame:
    """start, end, path (array of nodes), traversal_agg_cost: a path to each leaf of the tree within a distance."""
    found = cut(driving_distance(edges, starts, distance, directed), "driving")
    tree = found.select("start", "node", "pred", F.col("traversal_depth").alias("depth"))
    rows = _walk_back(tree, found.where("leaf").select("start", F.col("node").alias("end"), "node", "pred", F.col("traversal_depth").alias("depth")), ["start", "end", "node", "depth"])
    paths = rows.groupBy("start", "end").agg(F.array_sort(F.collect_list(F.struct("depth", "node"))).alias("p"))  # one path's nodes
    ends = found.where("leaf").select("start", F.col("node").alias("end"), "traversal_agg_cost")
    return paths.join(ends, ["start", "end"]).select("start", "end", F.col("p.node").alias("path"), "traversal_agg_cost")


def ksp_pairs(edges: DataFrame, pairs: DataFrame, k: int, directed=True, most=100_000) -> DataFrame:
    """start, end, rank, path (array of nodes), traversal_agg_cost: the k shortest loopless paths of each pair (start, end).

    Best first, for all pairs together: a path is kept with its cost and the exact distance from its last node to the end. Until a
    pair has k complete paths, a round grows by an edge those of its paths of which the sum is least (twice as many every eight rounds),
    and the others wait; from then on all that can still beat the k-th best, while the rest are dropped. Of equal costs fewer
    edges win, then the smaller path. Paths left after ``most`` rounds are an error."""
    a = cut(arcs(edges, directed).groupBy("u", "v").agg(F.min("cost").alias("cost")), "arcs")
    pairs = cut(pairs.select("start", "end").where("start <> end").distinct(), "pairs")
    turned = a.select(F.col("v").alias("src"), F.col("u").alias("dst"), "cost")
    rest = shortest(turned, pairs.select(F.col("end").alias("id")), edge=False).select(F.col("start").alias("end"), F.col("node").alias("v"), F.col("agg_cost").alias("rest"))
    paths = pairs.join(rest.withColumnRenamed("v", "start"), ["start", "end"]).select("start", "end", F.array("start").alias("path"), F.lit(0.0).alias("c"), F.col("rest").alias("whole"))
    paths, n = _counted(paths.withColumns({"bound": F.lit(None).cast("double"), "now": F.lit(True)}), "paths", "now")
    done = F.element_at("path", -1) == F.col("end")
    pair, kinds = Window.partitionBy("start", "end"), Window.partitionBy("start", "end", done)
    for rounds in range(most + 1):
        if not n:
            return paths.where(done).withColumn("rank", F.row_number().over(pair.orderBy("c", F.size("path"), "path"))).select("start", "end", "rank", "path", F.col("c").alias("traversal_agg_cost"))
        if rounds == most:
            break
        front = paths.where("now").select("start", "end", "path", "c", "bound", F.element_at("path", -1).alias("u"))
        grown = a.join(F.broadcast(front) if n <= FEW else front, "u").where(~F.array_contains("path", F.col("v")))
        grown = grown.select("start", "end", "v", F.concat("path", F.array("v")).alias("path"), (F.col("c") + F.col("cost")).alias("c"), "bound")
        grown = rest.join(F.broadcast(grown) if n <= FEW // 64 else grown, ["end", "v"]).select("start", "end", "path", "c", (F.col("c") + F.col("rest")).alias("whole"), "bound")
        can = F.expr("bound is null or whole <= bound * (1 + 1e-9)")  # sums of the same costs differ by rounding
        every = paths.where("not now").select(*grown.columns).unionByName(grown.where(can))
        every = every.withColumn("rank", F.row_number().over(kinds.orderBy("c", F.size("path"), "path")))
        every = every.withColumn("bound", F.max(F.when(done & (F.col("rank") == k), F.col("c"))).over(pair)).where(F.when(done, F.col("rank") <= k).otherwise(can)).drop("rank")
        turn = F.row_number().over(kinds.orderBy("whole", F.size("path").desc(), "path")) <= (16 + 4 * k) << min(rounds // 8, 40)
        last, (paths, n) = paths, _counted(every.withColumn("now", ~done & (F.col("bound").isNotNull() | turn)), "paths", "now")
        forget(last)
        if rounds % 8 == 7:
            let_go(edges.sparkSession)
    raise RuntimeError(f"paths left after {most} rounds")


def ksp(edges: DataFrame, start, end, k: int, directed=True, most=100_000) -> DataFrame:
    """rank, path, traversal_agg_cost: ksp_pairs() of one pair."""
    kind = dict(edges.dtypes)["src"]
    pair = edges.sparkSession.createDataFrame([(start, end)], f"start {kind}, end {kind}")
    return ksp_pairs(edges, pair, k, directed, most).select("rank", "path", "traversal_agg_cost")
