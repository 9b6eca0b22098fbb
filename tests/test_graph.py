"""Traversals on small graphs with known answers, against plain Python, and what the driver's tables can't show."""

import random

import pytest
from pyspark.sql import functions as F
from weftgraph.functions.predicates import Ltree, P, Text, lquery_regex
from weftgraph.operators import algorithms, services
from weftgraph.plans.catalog import PropertyGraph
from weftgraph.plans.traversal import __
from weftgraph.sources import io
from weftgraph.streaming import ingest


def friends(spark, edges):
    names = sorted({x for e in edges for x in e})
    g = PropertyGraph(spark).vertex("Friend", spark.createDataFrame([(n, n) for n in names], "id string, name string"))
    return g.edge("of", "Friend", "Friend", spark.createDataFrame(edges, "src string, dst string"))


def names(df, column="path"):
    return sorted(r[column] for r in df.collect())


@pytest.fixture(scope="module")
def modern(spark):
    g = PropertyGraph(spark)
    g = g.vertex("person", spark.createDataFrame([(1, "marko", 29), (2, "vadas", 27), (4, "josh", 32), (6, "peter", 35)], "id long, name string, age int"))
    g = g.vertex("software", spark.createDataFrame([(3, "lop", "java"), (5, "ripple", "java")], "id long, name string, lang string"))
    g = g.edge("knows", "person", "person", spark.createDataFrame([(1, 2, 0.5), (1, 4, 1.0)], "src long, dst long, weight double"))
    return g.edge("created", "person", "software", spark.createDataFrame([(1, 3, 0.4), (4, 5, 1.0), (4, 3, 0.4), (6, 3, 0.2)], "src long, dst long, weight double"))


def test_modern(modern):
    V = lambda *x: modern.traversal().V().has_label(*x) if x else modern.traversal().V()
    assert V().values("age").reduce("max").first().value == 35 and V().count().first()["count"] == 6
    assert V().repeat(__.both(), times=5).values("age").reduce("min").first().value == 27
    twice = V().repeat(__.both(), times=2)
    assert twice.count().first()["count"] == len(twice.path().collect()) == sum(len(x) for x in two_steps().values())
    assert twice.values("age").reduce("max").first().value == 35 and twice.values("age").count().first()["count"] == twice.values("age").table(v=".value").count()
    assert names(V("person").out("created").table(name=".name"), "name") == ["lop", "lop", "lop", "ripple"]
    assert names(V().has("name", "marko").out().table(name=".name"), "name") == ["josh", "lop", "vadas"]
    assert {r.id: r.n for r in V().repeat_counted(__.both(), 2).collect()} == {k: sum(1 for _ in v) for k, v in two_steps().items()}
    assert names(V("person").not_(__.out("created")).table(name=".name"), "name") == ["vadas"]
    assert V("person").has("missing", 1).count().first()["count"] == 0 and V("person").has_not("missing").count().first()["count"] == 4
    assert V("person").has("name", P.within()).count().first()["count"] == 0 and V("person").has("name", P.without()).count().first()["count"] == 4
    assert names(V("person").out_e("created").has("weight", P.gte(0.4)).other_v().table(name=".name"), "name") == ["lop", "lop", "ripple"]


def two_steps():
    e = [(1, 2), (1, 4), (1, 3), (4, 5), (4, 3), (6, 3)]
    near = {}
    for a, b in e:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    out = {}
    for a in near:
        for b in near[a]:
            for c in near[b]:
                out.setdefault(c, []).append(a)
    return out


def test_recursion(spark):
    t = friends(spark, [("a", "b"), ("a", "c"), ("c", "d"), ("c", "e"), ("e", "f")]).traversal().V().has("name", "a")
    hop = __.out("of").simple_path()
    assert names(t.repeat(hop, until=__.not_(hop)).path(by="name")) == ["a>b", "a>c>d", "a>c>e>f"]
    t = friends(spark, [("a", "b"), ("a", "c"), ("a", "d"), ("d", "e"), ("d", "f"), ("d", "g"), ("e", "h"), ("e", "i")]).traversal().V().has("name", "a")
    assert names(t.repeat(hop, until=__.has("name", "e")).path(by="name")) == ["a>d>e"]
    assert names(t.repeat(hop, until=__.loops(P.lt(3))).path(by="name")) == ["a>b", "a>c", "a>d"]
    assert names(t.repeat(hop, until=__.and_(__.loops(P.lt(3)), __.has("name", P.within("c", "d")))).path(by="name")) == ["a>c", "a>d"]
    assert names(t.repeat(hop, times=1, emit=True, emit_first=True).path(by="name")) == ["a", "a>b", "a>c", "a>d"]
    assert names(t.repeat(hop, times=1, emit=True).path(by="name")) == ["a>b", "a>c", "a>d"]
    assert names(t.repeat(hop, times=0).path(by="name")) == ["a"] and t.repeat(hop).count().first()["count"] == 0
    ring = friends(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")]).traversal().V().has("name", "a")
    assert names(ring.repeat(hop, until=__.not_(hop)).path(by="name")) == ["a>b>c"]
    assert ring.both("of").count().first()["count"] == 4


def test_branches(spark):
    g = PropertyGraph(spark)
    for label, ids in (("A", ["a1", "a2"]), ("B", ["b1", "b2"]), ("C", ["c1", "c2", "c3"])):
        g = g.vertex(label, spark.createDataFrame([(x, x) for x in ids], "id string, name string"))
    g = g.edge("ab", "A", "B", spark.createDataFrame([("a1", "b1"), ("a1", "b2")], "src string, dst string"))
    g = g.edge("bc", "B", "C", spark.createDataFrame([("b1", c) for c in ("c1", "c2", "c3")], "src string, dst string"))
    V = g.traversal().V()
    want = ["a1>b1>c1", "a1>b1>c2", "a1>b1>c3", "a1>b2", "a2"]
    assert names(V.has_label("A").optional(__.out().optional(__.out())).path(by="name")) == want
    assert names(V.has_label("A").choose(__.out(), __.out()).path(by="name")) == ["a1>b1", "a1>b2", "a2"]
    assert V.repeat(__.out(), until=__.has_label("C")).count().first()["count"] == 6
    assert V.repeat(__.out(), until=__.has_label("C"), until_first=True).count().first()["count"] == 9
    assert V.repeat(__.out(), times=2, emit=True, emit_first=True).has_label("A").count().first()["count"] == 2
    assert names(V.has_label("A").local(__.out().limit(1, by=("-.name",))).table(name=".name"), "name") == ["b2"]
    assert {(r.depth, r.path): r.n for r in V.has_label("A").out().out().tree("name").collect()}[(2, "a1>b1")] == 3


def test_random_graphs_against_python(spark):
    rng = random.Random(8)
    edges = list({(rng.randrange(12), rng.randrange(12)) for _ in range(25)})
    near = {}
    for a, b in edges:
        near.setdefault(a, []).append(b)
    g = PropertyGraph(spark, referential=True).vertex("N", spark.range(12)).edge("e", "N", "N", spark.createDataFrame(edges, "src long, dst long"))
    paths = [[k] for k in range(12)]
    for _ in range(3):
        paths = [[*p, x] for p in paths for x in near.get(p[-1], []) if x not in p]
    got = g.traversal().V().repeat(__.out("e").simple_path(), times=3).path(by="id")
    assert names(got) == sorted(">".join(map(str, p)) for p in paths)
    comp = {k: k for k in range(12)}
    for _ in range(12):
        for a, b in edges:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert {r.id: r.component for r in algorithms.connected_components(spark.range(12), g.edges[0].df).collect()} == comp


def test_predicates(spark):
    df = spark.createDataFrame([("one",), ("one.two",), ("one.two.one",), ("one.two.two",), ("one.three",), ("one.three.one",), ("one.three.two",), ("one.twofold",)], "p string")
    n = lambda p: df.where(p(F.col("p"))).count()
    assert (n(Ltree.descendant("one.two")), n(Ltree.descendant("one.three")), n(Ltree.descendant_any(["one.two", "one.three"])), n(Ltree.ancestor("one.two.one"))) == (3, 3, 6, 3)
    assert n(Ltree.lquery("one.*{1}")) == 3 and n(Ltree.lquery("*.two|three")) == 4 and n(Ltree.lquery("one.two*")) == 2 and n(Ltree.lquery("one.!two")) == 2 and lquery_regex("a") == r"^(?:a)\.$"
    nulls = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    rows = lambda p: nulls.where(p(F.col("x"))).count()
    assert (rows(P.neq(1)), rows(P.without(1, 9)), rows(P.without(1)), rows(P.eq(None)), rows(~P.within(1))) == (1, 2, 1, 1, 1)
    assert df.where(Text.contains("%")(F.col("p"))).count() == 0


def test_routes(spark):
    wiki = [(1, 2, 7), (1, 3, 9), (1, 6, 14), (2, 3, 10), (2, 4, 15), (3, 6, 2), (3, 4, 11), (4, 5, 6), (5, 6, 9)]
    e = spark.createDataFrame([(a, b, float(c), -1.0) for a, b, c in wiki], "src long, dst long, cost double, reverse_cost double")
    one = lambda x: spark.createDataFrame([(x,)], "id long")
    rows = sorted(algorithms.dijkstra(e, one(1), one(5), directed=False).collect(), key=lambda r: r.seq)
    assert [r.node for r in rows] == [1, 3, 6, 5] and rows[-1].traversal_agg_cost == 20.0
    assert algorithms.dijkstra(e, one(5), one(1)).count() == 0
    near = algorithms.driving_distance(e, one(1), 11.0, directed=False).collect()
    assert {r.node: (r.traversal_agg_cost, r.leaf) for r in near} == {1: (0.0, False), 2: (7.0, True), 3: (9.0, False), 6: (11.0, True)}
    found = algorithms.ksp(e, 1, 5, 3, directed=False).orderBy("rank").collect()
    assert [(r.path, r.traversal_agg_cost) for r in found] == [([1, 3, 6, 5], 20.0), ([1, 6, 5], 23.0), ([1, 3, 4, 5], 26.0)]
    assert services.call("degree", spark.range(1, 8), edges=e).where("id = 7").first().degree == 0
    with pytest.raises(KeyError):
        services.call("nothing", e)


def test_whole_part_graph(spark, sf_dir):
    """Components and paths of all parts, not of one brand's, against plain Python."""
    import heapq

    from weftgraph.plans import catalogue

    g = catalogue._graph(spark, sf_dir)
    rows = next(e for e in g.edges if e.label == "nextPart").df.select("src", "dst", F.col("cost").cast("double").alias("cost")).collect()
    parts = [r.p_partkey for r in g.vertices["part"].df.collect()]
    near, comp = {}, {k: k for k in parts}
    for r in rows:
        near.setdefault(r.src, {})[r.dst] = min(r.cost, near.get(r.src, {}).get(r.dst, r.cost))
    changed = True
    while changed:
        changed = False
        for r in rows:
            low = min(comp[r.src], comp[r.dst])
            changed |= comp[r.src] != low or comp[r.dst] != low
            comp[r.src] = comp[r.dst] = low
    start = min(near)
    far, heap = {}, [(0.0, start)]
    while heap:
        c, u = heapq.heappop(heap)
        if u not in far:
            far[u] = c
            for v, more in near.get(u, {}).items():
                heapq.heappush(heap, (c + more, v))
    run = catalogue.queries()
    assert {r.id: r.component for r in run["components"](spark, sf_dir).collect()} == comp
    assert {r.node: r.traversal_agg_cost for r in run["driving_distance"](spark, sf_dir).collect()} == {k: c for k, c in far.items() if c <= catalogue.DISTANCE}
    assert {r.end: r.cost for r in run["dijkstra"](spark, sf_dir).collect()} == {k: c for k, c in far.items() if k != start}
    leaves = run["driving_paths"](spark, sf_dir).collect()
    assert leaves and all(r.traversal_agg_cost == far[r.node] and r.nodes >= 2 for r in leaves)
    found = run["ksp"](spark, sf_dir).collect()
    assert {r.end for r in found} and all(r.traversal_agg_cost == far[r.end] for r in found if r.rank == 1)
    assert all(r.path[0] == start and r.path[-1] == r.end and len(set(r.path)) == len(r.path) and sum(near[a][b] for a, b in zip(r.path, r.path[1:])) == r.traversal_agg_cost for r in found)


def test_paths_of_several_pairs(spark):
    """ksp_pairs and driving_paths against all loopless paths of a small random graph."""
    import random

    rng, cost = random.Random(8), {}
    for _ in range(26):
        u, v = rng.randrange(9), rng.randrange(9)
        if u != v:
            cost[u, v] = float(rng.randrange(1, 6))

    def walks(path, c):
        yield path, c
        for (u, v), more in cost.items():
            if u == path[-1] and v not in path:
                yield from walks([*path, v], c + more)

    every = [(p, c) for s in range(9) for p, c in walks([s], 0.0)]
    e = spark.createDataFrame([(u, v, c) for (u, v), c in cost.items()], "src long, dst long, cost double")
    pairs = [(0, 5), (0, 7), (3, 1), (8, 2), (4, 4)]
    got = {}
    for r in algorithms.ksp_pairs(e, spark.createDataFrame(pairs, "start long, end long"), 3).collect():
        got.setdefault((r.start, r.end), {})[r.rank] = (r.traversal_agg_cost, len(r.path), list(r.path))
    for s, t in pairs:
        want = sorted((c, len(p), p) for p, c in every if p[0] == s and p[-1] == t and s != t)[:3]
        assert [got.get((s, t), {})[k] for k in sorted(got.get((s, t), {}))] == want
    best = {}
    for p, c in every:
        key = (p[0], p[-1])
        best[key] = min(best.get(key, (c, len(p))), (c, len(p)))
    for r in algorithms.driving_paths(e, spark.createDataFrame([(0,), (3,)], "id long"), 7.0).collect():
        assert (r.traversal_agg_cost, len(r.path)) == best[r.start, r.end] and r.path[0] == r.start and r.path[-1] == r.end
        assert sum(cost[a, b] for a, b in zip(r.path, r.path[1:])) == r.traversal_agg_cost <= 7.0


def test_names_outlive_dedup(modern):
    t = modern.traversal().V().has_label("person").as_("p").out("created").dedup()
    assert names(t.table(name=".name"), "name") == ["lop", "ripple"] and t.select("p").count().first()["count"] == 2
    with pytest.raises(KeyError):
        t.select("q")
    both = modern.traversal().V().has_label("person").union(__.out("created"), __.out("knows").out("created")).dedup()
    assert names(both.table(name=".name"), "name") == ["lop", "ripple"]


def test_steps_on_results(modern, spark):
    t = modern.traversal().V()
    people = t.has_label("person")
    assert names(people.limit(9).table(name=".name"), "name") == ["josh", "marko", "peter", "vadas"]
    assert names(t.order(".name").limit(3).table(name=".name"), "name") == ["josh", "lop", "marko"]
    assert [r.name for r in t.order("-.name").table(name=".name").collect()] == ["vadas", "ripple", "peter", "marko", "lop", "josh"]
    assert len({tuple(r.name for r in t.order(shuffle=k).table(name=".name").collect()) for k in range(6)}) > 1
    assert [r.name for r in people.order(__.out("created").count(), ".name").table(name=".name").collect()] == ["vadas", "marko", "peter", "josh"]
    assert names(people.then("group_count", ".age").has("count", P.gte(1)).table(key=".key"), "key") == [27, 29, 32, 35]
    assert {r.name: r.w for r in people.as_("p").local_reduce(__.out_e("created").values("weight"), "max").table(name="p.name", w=".value").collect()} == {"marko": 0.4, "josh": 1.0, "peter": 0.2}
    assert people.has("name", "josh").out("created").path_value().table(value=".value").first()[0][0].startswith("person:")
    assert not t.has("name", "nobody").has_next().first()[0] and t.has_next().first()[0]
    assert names(t.has_label(P.without("person", "x")).table(name=".name"), "name") == ["lop", "ripple"]
    with pytest.raises(TypeError):
        t.has_label(P.gt("a"))
    left = people.has("name", "marko").drop()
    assert left.count_vertices() == 5 and left.count_edges() == 3
    assert modern.traversal().E("knows").drop().count_edges() == 4
    assert people.has("name", "marko").values("age").drop().traversal().V().has_label("person").has("age").count().first()["count"] == 3
    services.register("twice", lambda rows, times=2: rows.select("id", (rows["id"] * times).alias("v")))
    assert names(people.call("twice", times=3).table(value=".value"), "value") == [3, 6, 12, 18]
    with pytest.raises(ValueError):
        modern.traversal().call("twice")
    assert names(people.values("age").math("abs(_) + bit_count(_)").table(value=".value"), "value") == [31, 33, 33, 38]
    merged = modern.merge_vertices("person", spark.createDataFrame([(1, "a"), (1, "b"), (9, "c"), (9, "d")], "id long, name string"), "id")
    assert names(merged.traversal().V().has_label("person").table(name=".name"), "name") == ["b", "d", "josh", "peter", "vadas"]
    edges = modern.merge_edges("knows", "person", "person", spark.createDataFrame([(1, 2), (2, 1), (2, 1)], "src long, dst long"))
    assert edges.count_edges() == 7


def test_repeat_both_ways_is_one_plan(modern):
    t = modern.traversal().V().has_label("person").has("name", "marko").repeat(__.both("knows"), times=4)
    assert len(t.branches) == 1 and names(t.table(name=".name"), "name") == sorted(["marko"] * 4)
    t = modern.traversal().V().has("name", "marko").repeat(__.both(), times=2)
    assert len(t.branches) < 8 and t.count().first()["count"] == 7  # neighbours of vadas, josh and lop


def test_fulltext(spark):
    from weftgraph.functions.predicates import FullText
    from weftgraph.plans.catalog import PropertyGraph

    rows = [(1, "Un été à Paris", "fr"), (2, "日本 語 text", "ja"), (3, "the quick brown fox", "en"), (4, "the brown quick_one", "en"), (5, None, "en")]
    t = PropertyGraph(spark).vertex("d", spark.createDataFrame(rows, "id long, text string, lang string")).traversal().V()
    found = lambda p: names(t.has("text", p).table(id=".id"), "id")
    assert found(FullText.match("ÉTÉ paris")) == [1] and found(FullText.match("日本")) == [2] and found(FullText.match("the en", columns=("lang",))) == [3, 4]
    assert found(FullText.query("the & (fox | quick_one)")) == [3, 4] and found(FullText.query("the & !fox")) == [4] and found(FullText.query("quick <-> brown")) == [3]
    assert found(FullText.query("qui:* | été")) == [1, 3, 4]
    for wrong in ("", "a &", "(a", "a b"):
        with pytest.raises(ValueError):
            FullText.query(wrong)


def test_loops_end_whole_or_raise(spark):
    """No row is dropped at a number of rounds: loops run until none is left, exactly ``times``, or raise."""
    t = friends(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e")]).traversal().V().has("name", "a")
    hop = __.out("of").simple_path()
    with pytest.raises(RuntimeError):
        t.repeat(hop, until=__.not_(hop), most=2)
    assert names(t.repeat(hop, until=__.not_(hop), most=4).path(by="name")) == ["a>b>c>d>e"]
    assert names(t.repeat(hop, times=3, most=2).path(by="name")) == ["a>b>c>d"]
    e = spark.createDataFrame([(k, k + 1, 1.0) for k in range(4)], "src long, dst long, cost double")
    with pytest.raises(RuntimeError):
        algorithms.ksp(e, 0, 4, 1, most=2)
    assert algorithms.ksp(e, 0, 4, 2, most=4).first().path == [0, 1, 2, 3, 4]


def test_files(spark, modern, tmp_path):
    io.write_graph(modern, str(tmp_path / "g"))
    back = io.read_graph(spark, str(tmp_path / "g"), {"person": "id", "software": "id"}, [("knows", "person", "person"), ("created", "person", "software")])
    assert back.count_vertices() == 6 and back.count_edges() == 6
    io.write_graphson(modern, str(tmp_path / "j"))
    back = io.read_graphson(spark, str(tmp_path / "j"), {"person": ("id long, name string, age int", "id"), "software": ("id long, name string, lang string", "id")}, [("created", "person", "software", "weight double")])
    assert names(back.traversal().V().has_label("person").out("created").table(name=".name"), "name") == ["lop", "lop", "lop", "ripple"]


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "id long, name string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, name string").parquet(str(tmp_path / "in"))
    ingest.append(stream, str(tmp_path / "out"), str(tmp_path / "cp"), key=["id"]).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_changes(modern, spark):
    g = modern.drop_vertices("person", spark.createDataFrame([(4,)], "id long"))
    assert g.count_vertices() == 5 and g.count_edges() == 3 and modern.count_edges() == 6
    with pytest.raises(ValueError):
        modern.lock().vertex("x", spark.range(1))
    with pytest.raises(ValueError):
        modern.edge("e", "nobody", "person", spark.range(1))
    assert modern.rename_label("person", "human").traversal().V().has_label("human").out("knows").count().first()["count"] == 2
    assert modern.topology_properties().where("element = 'edge'").count() == 2


def test_ksp_grows_the_best_paths_first(spark, monkeypatch):
    """Between full layers the number of paths is a power of the layer's size; few of them are written."""
    rng_cost = lambda d, u, v: float(1 + (u * 7 + v * 5 + d * 3) % 11)
    e = [(10 * d + u, 10 * d + 10 + v, rng_cost(d, u, v)) for d in range(6) for u in range(8 if d else 1) for v in range(8 if d < 5 else 1)]
    best = {0: [(0.0, [0])]}
    for u, v, c in e:  # in the order of layers
        best[v] = sorted([*best.get(v, []), *((x + c, [*p, v]) for x, p in best[u])])
    written, cut = [], algorithms.cut

    def counted(df, name="cut"):
        out = cut(df, name)
        if name in ("grown", "paths"):
            written.append(out.count())
        return out

    monkeypatch.setattr(algorithms, "cut", counted)
    found = algorithms.ksp(spark.createDataFrame(e, "src long, dst long, cost double"), 0, 60, 3).orderBy("rank").collect()
    assert [(r.traversal_agg_cost, list(r.path)) for r in found] == best[60][:3]
    assert max(written) < 3000 < len(best[60])


def test_one_hop_children_go_by_edges(spark, tmp_path, monkeypatch):
    """optional, choose and counts of one hop need no join of the rows with their edges before the one with its result; large sides are
    dealt to a number of partitions of their own."""
    from weftgraph.plans import traversal

    e = [(1, 11), (1, 12), (2, 11), (None, 12)]
    spark.createDataFrame(e, "src long, dst long").write.parquet(str(tmp_path / "e"))
    spark.range(1, 5).write.parquet(str(tmp_path / "a"))
    g = PropertyGraph(spark, referential=True).vertex("A", spark.read.parquet(str(tmp_path / "a"))).vertex("B", spark.range(11, 13))
    V = g.edge("ab", "A", "B", spark.read.parquet(str(tmp_path / "e"))).traversal().V().has_label("A")
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    for many in (False, True):
        if many:
            monkeypatch.setattr(traversal, "JOIN_BYTES", 0)
        some = V.optional(__.out()).table(label=".label", id=".id")
        assert sorted(map(tuple, some.collect())) == [("A", 3), ("A", 4), ("B", 11), ("B", 11), ("B", 12)] and joins(some) == 2
        assert ("RepartitionByExpression" in some._jdf.queryExecution().optimizedPlan().toString()) == many
        two = V.choose(__.out(), __.out(), __.constant(0)).table(value=lambda c: F.coalesce(c(".id"), c(".value")))
        assert sorted(r.value for r in two.collect()) == [0, 0, 11, 11, 12] and joins(two) == 3
        by = V.branch(__.out().count(), {1: __.out()}, none=__.constant(0)).table(value=lambda c: F.coalesce(c(".id"), c(".value")))
        assert sorted(r.value for r in by.collect()) == [0, 0, 0, 11]


def test_match_filters_first(spark):
    """A pattern that filters is joined before one that multiplies the rows, whatever their order."""
    g = PropertyGraph(spark).vertex("A", spark.range(2)).vertex("B", spark.range(2)).vertex("C", spark.createDataFrame([(0, "x"), (1, "y")], "id long, name string"))
    g = g.edge("ab", "A", "B", spark.createDataFrame([(0, 0), (1, 0), (1, 1)], "src long, dst long")).edge("bc", "B", "C", spark.createDataFrame([(0, 0), (1, 1)], "src long, dst long"))
    t = g.traversal().V().has_label("B").match(__.as_("b").in_("ab").as_("a"), __.as_("b").in_("ab").as_("d"), __.as_("b").out("bc").has("name", "x").as_("c"))
    assert [p.label for p in t.branches[0].path if p.label != "B"] == ["A", "C", "A"]
    assert sorted(map(tuple, t.table(a="a.id", d="d.id", c="c.id").collect())) == [(0, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0)]
