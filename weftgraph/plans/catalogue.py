"""The registered graph queries, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import vectors
from weftgraph.functions.predicates import Arrays, FullText, Ltree, P, Text, Vector
from weftgraph.operators import algorithms, services
from weftgraph.plans import storage
from weftgraph.plans.catalog import PropertyGraph
from weftgraph.plans.driver_graph import load
from weftgraph.plans.traversal import __
from weftgraph.sources import io
from weftgraph.streaming import ingest

_queries: dict[str, Callable[[PropertyGraph], DataFrame]] = {}
_sql: dict[str, str] = {}


def q(name: str, run: Callable[[PropertyGraph], DataFrame], sql: str | None = None) -> None:
    _queries[name] = run
    if sql:
        _sql[name] = sql


_last: dict[tuple, PropertyGraph] = {}


def _graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """The graph over a folder, kept for the last session and folder: its frames are lazy plans, but reading their schemas
    takes a second."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _last:
        _last.clear()
        _last[key] = load(spark, sf_dir)
    return _last[key]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(_graph(spark, sf_dir))) for name, f in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_sql)


def V(g: PropertyGraph, *labels: str):
    return g.traversal().V().has_label(*labels)


CUST = "SELECT c_custkey AS id FROM customer WHERE "
NEXT = "SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS dst, l_quantity AS cost FROM lineitem"
NEXT = f"np AS (SELECT * FROM ({NEXT}) WHERE dst IS NOT NULL)"
TALK = "rep AS (SELECT a.conv_id AS c, a.turn AS s, b.turn AS d FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"

# Scans
q("scan_label", lambda g: V(g, "customer").table(id=".id", name=".c_name"), "SELECT c_custkey AS id, c_name AS name FROM customer")
q(
    "scan_multi_label",
    lambda g: V(g, "customer", "supplier").table(label=".label", id=".id", nation=lambda c: F.coalesce(c(".c_nationkey"), c(".s_nationkey"))),
    "SELECT 'customer' AS label, c_custkey AS id, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey FROM supplier",
)
q(
    "scan_ids",
    lambda g: g.traversal().V(1, 5, 7, None).has_label("nation", "orders").table(label=".label", id=lambda c: c(".id").cast("long")),
    "SELECT 'nation' AS label, n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey IN (1, 5, 7) UNION ALL SELECT 'orders', o_orderkey FROM "
    "orders WHERE o_orderkey IN (1, 5, 7)",
)
q(
    "scan_edges",
    lambda g: g.traversal().E("placed").table(src=lambda c: F.col("p0___src"), dst=lambda c: F.col("p0___dst")),
    "SELECT o_custkey AS src, o_orderkey AS dst FROM orders",
)
q(
    "count_vertices",
    lambda g: g.traversal().V().count(),
    "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + "
    "(SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM events) + (SELECT count(*) FROM documents) + (SELECT "
    "count(*) FROM labels) + (SELECT count(*) FROM embeddings) + (SELECT count(*) FROM pages) + (SELECT count(*) FROM conversations) AS count",
)
q("inject", lambda g: g.traversal().inject(1, 2, 3).math("_ * 2").table(value=lambda c: c(".value").cast("long")), "SELECT unnest([2, 4, 6])::BIGINT AS value")
q(
    "mid_traversal_v",
    lambda g: V(g, "region").as_("r").V().has_label("nation").table(r="r.r_name", n=".n_name"),
    "SELECT r_name AS r, n_name AS n FROM region, nation",
)
SEGMENTS = "SELECT c_mktsegment AS segment, count(*) AS n FROM {} GROUP BY c_mktsegment"
q("query_passthrough", lambda g: g.sql(SEGMENTS.format("V_customer")), SEGMENTS.format("customer"))
q(
    "query_json",
    lambda g: g.sql_json(SEGMENTS.format("V_customer")),
    f"SELECT '{{\"segment\":\"' || segment || '\",\"n\":' || n || '}}' AS value FROM ({SEGMENTS.format('customer')})",
)
q(
    "scan_edge_ids",
    lambda g: g.traversal().E("contains", ids=[{"src": 1, "l_linenumber": 1}, {"src": 3, "l_linenumber": 2}]).out_v().table(id=".id"),
    "SELECT l_orderkey AS id FROM lineitem WHERE (l_orderkey = 1 AND l_linenumber = 1) OR (l_orderkey = 3 AND l_linenumber = 2)",
)
q(
    "has_label_p",
    lambda g: g.traversal().V().has_label(P.within("nation", "region")).has_label(P.neq("region")).table(id=".id", label=".label"),
    "SELECT n_nationkey AS id, 'nation' AS label FROM nation",
)


def _round_trip(g, form):
    """Nations and regions written and read again."""
    small = PropertyGraph(g.spark).vertex("nation", g.vertices["nation"].df, "n_nationkey").vertex("region", g.vertices["region"].df, "r_regionkey")
    small = small.edge("inRegion", "nation", "region", next(e.df for e in g.edges if e.label == "inRegion"))
    path = storage.new_path(g.spark, form)
    schemas = {v.label: v.df.schema.simpleString()[7:-1].replace(":", " ") for v in small.vertices.values()}
    if form == "graphson":
        io.write_graphson(small, path)
        back = io.read_graphson(g.spark, path, {k: (x, small.vertices[k].keys[0]) for k, x in schemas.items()}, [("inRegion", "nation", "region", "")])
    else:
        for v in small.vertices.values():
            v.df.write.option("header", True).csv(f"{path}/{v.label}")
        back = PropertyGraph(g.spark)
        for k, x in schemas.items():
            back = back.vertex(k, io.read_table(g.spark, f"{path}/{k}", x, "csv", header=True), small.vertices[k].keys[0])
        back = back.edge("inRegion", "nation", "region", back.vertices["nation"].df.selectExpr("n_nationkey src", "n_regionkey dst"))
    return back.traversal().V().has_label("nation").as_("n").out("inRegion").table(nation="n.n_name", region=".r_name")


def _partitioned(g):
    """Orders written in folders by status, and read with a predicate on it."""
    path = storage.new_path(g.spark, "layout")
    io.write_graph(PropertyGraph(g.spark).vertex("orders", g.vertices["orders"].df, "o_orderkey"), path, partition_by={"orders": ["o_orderstatus"]})
    back = io.read_graph(g.spark, path, {"orders": "o_orderkey"}, [])
    return V(back, "orders").has("o_orderstatus", "F").table(id=".id", price=".o_totalprice")


def _streamed(g):
    """Regions ingested as a stream, with ids of their own."""
    path = storage.new_path(g.spark, "stream")
    g.vertices["region"].df.write.parquet(f"{path}/in")
    stream = g.spark.readStream.schema(g.vertices["region"].df.schema).parquet(f"{path}/in")
    ingest.append(stream, f"{path}/out", f"{path}/state", id_col="id").awaitTermination()
    return V(PropertyGraph(g.spark).vertex("region", g.spark.read.parquet(f"{path}/out")), "region").table(id=".id", name=".r_name").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.max("name").alias("last"))


q("partitioned_layout", _partitioned, "SELECT o_orderkey AS id, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F'")
q("stream_ids", _streamed, "SELECT count(*) AS n, count(*) AS ids, max(r_name) AS last FROM region")
q(
    "windowed_degree",
    lambda g: ingest.windowed_degree(g.vertices["event"].df.select("ts", F.col("user_id").alias("src")), "ts", window="1 hour").select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "src", "n"),
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, user_id AS src, count(*) AS n FROM events GROUP BY ALL",
)
for form in ("graphson", "csv"):
    q(
        f"{form}_round_trip",
        lambda g, form=form: _round_trip(g, form),
        "SELECT n_name AS nation, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    )

# Predicates
for name, p, sql in (
    ("eq", P.eq("BUILDING"), "= 'BUILDING'"),
    ("neq", P.neq("BUILDING"), "<> 'BUILDING'"),
):
    q(f"has_{name}", lambda g, p=p: V(g, "customer").has("c_mktsegment", p).table(id=".id"), f"{CUST} c_mktsegment {sql}")
for name, p, sql in (
    ("gt", P.gt(5000.0), "c_acctbal > 5000"),
    ("gte", P.gte(5000.0), "c_acctbal >= 5000"),
    ("lt", P.lt(0.0), "c_acctbal < 0"),
    ("lte", P.lte(0.0), "c_acctbal <= 0"),
    ("between", P.between(0.0, 1000.0), "c_acctbal >= 0 AND c_acctbal < 1000"),
    ("inside", P.inside(0.0, 1000.0), "c_acctbal > 0 AND c_acctbal < 1000"),
    ("outside", P.outside(0.0, 9000.0), "(c_acctbal < 0 OR c_acctbal > 9000)"),
    ("p_or", P.lt(0.0) | P.gt(9000.0) | P.between(100.0, 200.0), "(c_acctbal < 0 OR c_acctbal > 9000 OR c_acctbal >= 100 AND c_acctbal < 200)"),
    ("p_not", ~P.inside(0.0, 9000.0), "NOT (c_acctbal > 0 AND c_acctbal < 9000)"),
):
    q(f"has_{name}", lambda g, p=p: V(g, "customer").has("c_acctbal", p).table(id=".id"), CUST + sql)
q(
    "within_small",
    lambda g: V(g, "customer").has("c_mktsegment", P.within("BUILDING", "MACHINERY")).table(id=".id"),
    CUST + "c_mktsegment IN ('BUILDING', 'MACHINERY')",
)
q(
    "within_large",
    lambda g: V(g, "orders").has("o_orderkey", P.within(list(range(0, 12000, 3)))).table(id=".id"),
    "SELECT o_orderkey AS id FROM orders WHERE o_orderkey < 12000 AND o_orderkey % 3 = 0",
)
q(
    "without_large",
    lambda g: V(g, "orders").has("o_orderkey", P.without(list(range(0, 12000, 3)))).table(id=".id"),
    "SELECT o_orderkey AS id FROM orders WHERE NOT (o_orderkey < 12000 AND o_orderkey % 3 = 0)",
)
q(
    "without_keeps_null",
    lambda g: V(g, "label").fun("q", "CASE WHEN quality = 0 THEN NULL ELSE toxic END").has("q", P.without(1, 2)).table(id=".id"),
    "SELECT doc_id AS id FROM labels WHERE quality = 0 OR quality IS NULL OR toxic NOT IN (1, 2) OR toxic IS NULL",
)
q(
    "has_key",
    lambda g: V(g, "customer", "supplier").has("s_acctbal").table(label=".label", id=".id"),
    "SELECT 'supplier' AS label, s_suppkey AS id FROM supplier WHERE s_acctbal IS NOT NULL",
)
q(
    "has_not_key",
    lambda g: V(g, "customer", "supplier").has_not("s_acctbal").table(label=".label", id=".id"),
    "SELECT 'customer' AS label, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier WHERE s_acctbal IS NULL",
)
q(
    "property_ref",
    lambda g: V(g, "part").has("p_retailprice", P.ref("gt", "p_size")).has("p_size", P.ref("lt", "p_partkey")).table(id=".id"),
    "SELECT p_partkey AS id FROM part WHERE p_retailprice > p_size AND p_size < p_partkey",
)
q("has_id", lambda g: V(g, "orders").has_id(P.within(1, 2, 3)).table(id=".id"), "SELECT o_orderkey AS id FROM orders WHERE o_orderkey IN (1, 2, 3)")
for name, p, sql in (
    ("contains", Text.contains("an"), "contains(text, 'an')"),
    ("ncontains", Text.ncontains("an"), "NOT contains(text, 'an')"),
    ("contains_cis", Text.containsCIS("THE"), "contains(lower(text), 'the')"),
    ("ncontains_cis", Text.ncontainsCIS("THE"), "NOT contains(lower(text), 'the')"),
    ("starts_with", Text.startsWith("The"), "starts_with(text, 'The')"),
    ("nstarts_with", Text.nstartsWith("The"), "NOT starts_with(text, 'The')"),
    ("ends_with", Text.endsWith("."), "ends_with(text, '.')"),
    ("nends_with", Text.nendsWith("."), "NOT ends_with(text, '.')"),
    ("percent_is_literal", Text.contains("%_"), "contains(text, '%_')"),
):
    q(f"text_{name}", lambda g, p=p: V(g, "document").has("text", p).table(id=".id"), f"SELECT doc_id AS id FROM documents WHERE {sql}")
TOKENS = r"regexp_split_to_array(lower({}), '[^\p{{L}}\p{{M}}\p{{N}}_]+')"
q(
    "fulltext",
    lambda g: V(g, "message").has("text", FullText.match("the that")).table(conv=".conv_id", turn=".turn"),
    f"SELECT conv_id AS conv, turn FROM conversations WHERE list_has_all({TOKENS.format('text')}, ['the', 'that'])",
)
q(
    "fulltext_unicode",
    lambda g: V(g, "document").has("text", FullText.query("für | année | años | größe | même")).table(id=".id"),
    f"SELECT doc_id AS id FROM documents WHERE list_has_any({TOKENS.format('text')}, ['für', 'année', 'años', 'größe', 'même'])",
)
q(
    "fulltext_query",
    lambda g: V(g, "message").has("text", FullText.query("the & (that | wh:*) & !of")).table(conv=".conv_id", turn=".turn"),
    f"SELECT conv_id AS conv, turn FROM (SELECT *, {TOKENS.format('text')} AS t FROM conversations) WHERE list_contains(t, 'the') AND "
    "(list_contains(t, 'that') OR len(list_filter(t, lambda x: starts_with(x, 'wh'))) > 0) AND NOT list_contains(t, 'of')",
)
q(
    "fulltext_phrase",
    lambda g: V(g, "document").has("text", FullText.query("of <-> the")).table(id=".id"),
    f"SELECT doc_id AS id FROM documents WHERE contains(' ' || array_to_string({TOKENS.format('text')}, ' ') || ' ', ' of the ')",
)
q(
    "fulltext_columns",
    lambda g: V(g, "message").has("text", FullText.match("user the", columns=("role",))).table(conv=".conv_id", turn=".turn"),
    f"SELECT conv_id AS conv, turn FROM conversations WHERE list_has_all({TOKENS.format("concat_ws(' ', text, role)")}, ['user', 'the'])",
)
q(
    "where_as",
    lambda g: V(g, "message").as_("a").out("replies").where_as("a", "text", FullText.match("the")).table(conv=".conv_id", turn=".turn"),
    "SELECT b.conv_id AS conv, b.turn AS turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE "
    f"list_contains({TOKENS.format('a.text')}, 'the')",
)
q(
    "date_predicate",
    lambda g: V(g, "orders").has("o_orderdate", P.between(datetime.date(1995, 1, 1), datetime.date(1996, 1, 1))).table(id=".id"),
    "SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01'",
)
q(
    "inet",
    lambda g: V(g, "page").fun("ip", "concat('10.0.', page_id % 256, '.', page_id % 7)").has("ip", P.within("10.0.5.5", "10.0.9.2", "10.0.1.1")).table(id=".id", ip=".ip"),
    "SELECT page_id AS id, '10.0.' || page_id % 256 || '.' || page_id % 7 AS ip FROM pages WHERE ('10.0.' || page_id % 256 || '.' || page_id % 7) "
    "IN ('10.0.5.5', '10.0.9.2', '10.0.1.1')",
)
q("has_id_neq", lambda g: V(g, "nation").has_id(P.neq(3)).table(id=".id"), "SELECT n_nationkey AS id FROM nation WHERE n_nationkey <> 3")
q(
    "has_id_without",
    lambda g: V(g, "nation").has_id(P.without(1, 2, 3)).table(id=".id"),
    "SELECT n_nationkey AS id FROM nation WHERE n_nationkey NOT IN (1, 2, 3)",
)
q(
    "is_step",
    lambda g: V(g, "customer").values("c_acctbal").is_(P.gt(9000.0)).table(value=".value"),
    "SELECT c_acctbal AS value FROM customer WHERE c_acctbal > 9000",
)
ARR = "list_value(p_size, p_size + 1, p_size * 2)"
q(
    "array_contains",
    lambda g: V(g, "part").fun("a", "array(p_size, p_size + 1, p_size * 2)").has("a", Arrays.contains([10, 11])).table(id=".id"),
    f"SELECT p_partkey AS id FROM part WHERE list_has_all({ARR}, [10, 11])",
)
q(
    "array_overlaps",
    lambda g: V(g, "part").fun("a", "array(p_size, p_size + 1, p_size * 2)").has("a", Arrays.overlaps([10, 20])).table(id=".id"),
    f"SELECT p_partkey AS id FROM part WHERE list_has_any({ARR}, [10, 20])",
)
PATH_FUN, PATH_SQL = "concat('r', n_regionkey, '.n', n_nationkey)", "concat('r', n_regionkey, '.n', n_nationkey)"
for name, p, sql in (
    ("descendant", Ltree.descendant("r1"), "starts_with(p || '.', 'r1.')"),
    ("ancestor", Ltree.ancestor("r1.n1.x"), "starts_with('r1.n1.x.', p || '.')"),
    ("descendant_any", Ltree.descendant_any(["r0", "r2.n12"]), "(starts_with(p || '.', 'r0.') OR starts_with(p || '.', 'r2.n12.'))"),
    ("ancestor_any", Ltree.ancestor_any(["r0.n0.a", "r1.n2"]), "(starts_with('r0.n0.a.', p || '.') OR starts_with('r1.n2.', p || '.'))"),
    ("lquery", Ltree.lquery("*{1}.n1*"), "regexp_matches(p, '^[^.]+[.]n1[^.]*$')"),
):
    q(
        f"ltree_{name}" if name != "lquery" else name,
        lambda g, p=p: V(g, "nation").fun("p", PATH_FUN).has("p", p).table(id=".id", p=".p"),
        f"SELECT n_nationkey AS id, p FROM (SELECT *, {PATH_SQL} AS p FROM nation) WHERE {sql}",
    )
q(
    "and_or_nested",
    lambda g: V(g, "customer").or_(__.and_(__.has("c_mktsegment", "BUILDING"), __.has("c_acctbal", P.gt(0.0))), __.has("c_nationkey", P.lt(3)), __.has("missing", 1)).table(id=".id"),
    CUST + "(c_mktsegment = 'BUILDING' AND c_acctbal > 0) OR c_nationkey < 3",
)
q(
    "lambda_filter",
    lambda g: V(g, "part").filter(lambda c: F.length(c("p_name")) % 2 == 0).table(id=".id"),
    "SELECT p_partkey AS id FROM part WHERE length(p_name) % 2 = 0",
)

# Projections
q("values_keys", lambda g: V(g, "nation").values("n_name", "missing").table(value=".value"), "SELECT n_name AS value FROM nation")
q(
    "element_map",
    lambda g: V(g, "region").element_map().select("id", "label", F.col("properties")["r_name"].alias("r_name")),
    "SELECT r_regionkey::VARCHAR AS id, 'region' AS label, r_name FROM region",
)
q(
    "element_map_edge",
    lambda g: g.traversal().E("inRegion").element_map().select("label", "out_id", "out_label", "in_id", "in_label"),
    "SELECT 'inRegion' AS label, n_nationkey::VARCHAR AS out_id, 'nation' AS out_label, n_regionkey::VARCHAR AS in_id, 'region' AS in_label FROM "
    "nation",
)
q("value_map", lambda g: V(g, "region").value_map("r_name").select(F.col("properties")["r_name"].alias("names")), "SELECT [r_name] AS names FROM region")
q("id_label", lambda g: V(g, "nation").out("inRegion").table(id=".id", label=".label"), "SELECT n_regionkey AS id, 'region' AS label FROM nation")
q(
    "as_select",
    lambda g: V(g, "customer").as_("c").out("placed").as_("o").select("c").table(name=".c_name", price="o.o_totalprice"),
    "SELECT c_name AS name, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey",
)
q(
    "project_math",
    lambda g: V(g, "orders").map(lambda c: F.round(c("o_totalprice") * 2, 2)).math("round(_ + 1, 2)").table(value=".value"),
    "SELECT round(round(o_totalprice * 2, 2) + 1, 2) AS value FROM orders",
)
q("constant", lambda g: V(g, "region").constant("x").table(value=".value"), "SELECT 'x' AS value FROM region")
q(
    "string_steps",
    lambda g: V(g, "nation").map(lambda c: F.concat(F.upper(F.substring(c("n_name"), 1, 3)), F.lit("-"), F.length(c("n_name")))).table(value=".value"),
    "SELECT upper(substr(n_name, 1, 3)) || '-' || length(n_name) AS value FROM nation",
)
q(
    "path_by",
    lambda g: V(g, "customer").has("c_acctbal", P.lt(0.0)).out("inNation").out("inRegion").path(by={"customer": "c_name", "nation": "n_name", "region": "r_name"}),
    "SELECT c_name || '>' || n_name || '>' || r_name AS path, 3 AS length FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON "
    "n_regionkey = r_regionkey WHERE c_acctbal < 0",
)
q("path_ids", lambda g: V(g, "nation").out("inRegion").path(), "SELECT 'nation:' || n_nationkey || '>region:' || n_regionkey AS path, 2 AS length FROM nation")
q(
    "tree",
    lambda g: V(g, "nation").out("inRegion").in_("inRegion").tree(),
    "WITH t AS (SELECT 'nation:' || a.n_nationkey AS x, '>region:' || a.n_regionkey AS y, '>nation:' || b.n_nationkey AS z FROM nation a JOIN "
    "nation b USING (n_regionkey)) SELECT 1 AS depth, x AS path, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT 2, x || y, count(*) FROM t "
    "GROUP BY ALL UNION ALL SELECT 3, x || y || z, count(*) FROM t GROUP BY ALL",
)
q(
    "simple_path",
    lambda g: V(g, "nation").out("inRegion").in_("inRegion").simple_path().table(a=lambda c: F.col("p0__id"), b=".id"),
    "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey <> b.n_nationkey",
)
q(
    "cyclic_path",
    lambda g: V(g, "nation").out("inRegion").in_("inRegion").cyclic_path().table(a=lambda c: F.col("p0__id"), b=".id"),
    "SELECT n_nationkey AS a, n_nationkey AS b FROM nation",
)
q(
    "fun_expr",
    lambda g: V(g, "customer").fun("scaled", "round(c_acctbal * 10, 1)").table(id=".id", scaled=".scaled"),
    "SELECT c_custkey AS id, round(c_acctbal * 10, 1) AS scaled FROM customer",
)
q("fold_unfold", lambda g: V(g, "nation").then("fold", ".n_name").unfold().table(value=".value"), "SELECT n_name AS value FROM nation")
q(
    "path_value",
    lambda g: V(g, "nation").out("inRegion").path_value().unfold().table(value=".value"),
    "SELECT 'nation:' || n_nationkey AS value FROM nation UNION ALL SELECT 'region:' || n_regionkey FROM nation",
)
q(
    "map_value",
    lambda g: V(g, "region").map_value("r_name").table(id=".id", label=".label", name=".r_name"),
    "SELECT r_regionkey::VARCHAR AS id, 'region' AS label, r_name AS name FROM region",
)
q(
    "select_by",
    lambda g: V(g, "customer").as_("c").out("placed").as_("o").select("c", "o", by=("c_name", "o_totalprice")).table(c=".c", o=".o"),
    "SELECT c_name AS c, o_totalprice AS o FROM customer JOIN orders ON o_custkey = c_custkey",
)
q(
    "project_step",
    lambda g: V(g, "orders").project(status=".o_orderstatus", lines=__.out("contains").count()).table(status=".status", lines=".lines"),
    "SELECT any_value(o_orderstatus) AS status, count(l_orderkey) AS lines FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY "
    "o_orderkey",
)
q(
    "math_functions",
    lambda g: V(g, "part").values("p_size").math("bit_count(_) + _").table(value=lambda c: c(".value").cast("long")),
    "SELECT (bit_count(p_size) + p_size)::BIGINT AS value FROM part",
)
q(
    "then_group",
    lambda g: V(g, "customer").then("group_count", ".c_nationkey").has("count", P.gt(5)).table(key=".key", count=".count"),
    "SELECT c_nationkey AS key, count(*) AS count FROM customer GROUP BY 1 HAVING count(*) > 5",
)
q(
    "has_next",
    lambda g: V(g, "customer").out("placed").has("o_totalprice", P.gt(1000.0)).has_next(),
    "SELECT count(*) > 0 AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000",
)
q(
    "plain_steps",
    lambda g: V(g, "customer").flat_map(__.out("placed")).side_effect(__.out("contains")).identity().count(),
    "SELECT count(*) AS count FROM orders",
)
q("none_step", lambda g: V(g, "customer").union(__.none(), __.out("inNation")).group_count(".label"), "SELECT 'nation' AS key, count(*) AS count FROM customer")

# Navigation
q(
    "out",
    lambda g: V(g, "customer").has("c_mktsegment", "BUILDING").out("placed").table(id=".id", price=".o_totalprice"),
    "SELECT o_orderkey AS id, o_totalprice AS price FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
)
q(
    "in",
    lambda g: V(g, "region").has("r_name", "ASIA").in_("inRegion").in_("inNation").table(label=".label", id=".id"),
    "SELECT 'customer' AS label, c_custkey AS id FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
    "WHERE r_name = 'ASIA' UNION ALL SELECT 'supplier', s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON "
    "n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
)
q(
    "both",
    lambda g: V(g, "part").both("nextPart").table(a=lambda c: F.col("p0__id"), b=".id"),
    f"WITH {NEXT} SELECT src AS a, dst AS b FROM np UNION ALL SELECT dst, src FROM np",
)
q(
    "out_multi_label",
    lambda g: V(g, "orders").out("contains", "suppliedBy").group_count(".label"),
    "SELECT 'part' AS key, count(*) AS count FROM lineitem UNION ALL SELECT 'supplier', count(*) FROM lineitem",
)
q(
    "outE_inV",
    lambda g: V(g, "orders").has("o_orderstatus", "F").out_e("contains").has("l_quantity", P.gt(40.0)).as_("e").in_v().table(part=".p_name", quantity="e.l_quantity"),
    "SELECT p_name AS part, l_quantity AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE "
    "o_orderstatus = 'F' AND l_quantity > 40",
)
q(
    "inE_outV",
    lambda g: V(g, "part").has("p_size", P.lt(5)).in_e("contains").out_v().table(id=".id"),
    "SELECT l_orderkey AS id FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 5",
)
q(
    "bothE_otherV",
    lambda g: V(g, "part").both_e("nextPart").other_v().table(a=lambda c: F.col("p0__id"), b=".id"),
    f"WITH {NEXT} SELECT src AS a, dst AS b FROM np UNION ALL SELECT dst, src FROM np",
)
q(
    "edge_both_v",
    lambda g: g.traversal().E("inRegion").both_v().table(label=".label", id=".id"),
    "SELECT 'nation' AS label, n_nationkey AS id FROM nation UNION ALL SELECT 'region', n_regionkey FROM nation",
)
q(
    "composite_key_join",
    lambda g: V(g, "message").has("role", "user").as_("a").out("replies").table(conv=".conv_id", asked="a.turn", turn=".turn", role=".role"),
    "SELECT b.conv_id AS conv, a.turn AS asked, b.turn AS turn, b.role AS role FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id "
    "AND b.turn = a.turn + 1 WHERE a.role = 'user'",
)
q(
    "match_pattern",
    lambda g: V(g, "supplier").match(__.as_("s").out("inNation").as_("n"), __.as_("n").in_("inNation").has_label("customer").as_("c"), __.as_("n").out("inRegion").has("r_name", "EUROPE").as_("r")).table(s="s.s_name", c="c.c_name"),
    "SELECT s_name AS s, c_name AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey JOIN region "
    "ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'",
)
q(
    "match_cycle",
    lambda g: V(g, "customer").match(__.as_("c").out("inNation").as_("n"), __.as_("c").out("placed").out("suppliedBy").as_("s"), __.as_("s").out("inNation").as_("n")).dedup("c.id", "s.id").table(c="c.id", s="s.id"),
    "SELECT DISTINCT c_custkey AS c, s_suppkey AS s FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey "
    "JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey = c_nationkey",
)
q(
    "where_ab",
    lambda g: V(g, "nation").as_("a").out("inRegion").in_("inRegion").as_("b").where_ab("a", "neq", "b").table(a="a.n_name", b="b.n_name"),
    "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey <> b.n_nationkey",
)
q(
    "where_ab_by",
    lambda g: V(g, "message").as_("a").out("replies").as_("b").where_ab("a", "lt", "b", by="role").table(conv=".conv_id", turn=".turn"),
    "SELECT b.conv_id AS conv, b.turn AS turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE "
    "a.role < b.role",
)

# Branching, semi and anti joins
NOLINE = "NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)"
q(
    "optional",
    lambda g: V(g, "orders").has("o_orderstatus", "O").optional(__.out("contains")).table(label=".label", id=".id"),
    "SELECT 'part' AS label, l_partkey AS id FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' UNION ALL SELECT "
    f"'orders', o_orderkey FROM orders WHERE o_orderstatus = 'O' AND {NOLINE}",
)
q(
    "optional_nested",
    lambda g: V(g, "customer").has("c_acctbal", P.lt(-900.0)).optional(__.out("placed").optional(__.out("contains"))).path(),
    "WITH c AS (SELECT * FROM customer WHERE c_acctbal < -900) SELECT 'customer:' || c_custkey || '>orders:' || o_orderkey || '>part:' || "
    "l_partkey AS path, 3 AS length FROM c JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT "
    f"'customer:' || c_custkey || '>orders:' || o_orderkey, 2 FROM c JOIN orders ON o_custkey = c_custkey WHERE {NOLINE} UNION ALL SELECT "
    "'customer:' || c_custkey, 1 FROM c WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
)
q(
    "choose_pred",
    lambda g: V(g, "customer").choose(__.has("c_acctbal", P.gt(0.0)), __.out("inNation"), __.out("placed")).group_count(".label"),
    "SELECT 'nation' AS key, count(*) AS count FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'orders', count(*) FROM customer JOIN orders ON "
    "o_custkey = c_custkey WHERE NOT c_acctbal > 0",
)
q(
    "choose_has_next",
    lambda g: V(g, "orders").choose(__.out("contains"), __.out("suppliedBy"), __.in_("placed")).group_count(".label"),
    f"SELECT 'supplier' AS key, count(*) AS count FROM lineitem UNION ALL SELECT 'customer', count(*) FROM orders WHERE {NOLINE} HAVING count(*) > 0",
)
q(
    "choose_option",
    lambda g: V(g, "orders").branch("o_orderstatus", {"F": __.out("contains"), "O": __.in_("placed")}, none=__.constant("other")).group(lambda c: F.coalesce(c(".label"), F.lit("value")), n=("count", None)),
    "SELECT 'part' AS key, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' UNION ALL SELECT "
    "'customer', count(*) FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'value', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', "
    "'O') HAVING count(*) > 0",
)
q(
    "choose_traversal",
    lambda g: V(g, "orders").branch(__.out("contains").count(), {1: __.in_("placed"), 2: __.out("contains")}, none=__.out("suppliedBy")).group_count(".label"),
    "WITH n AS (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) SELECT 'customer' "
    "AS key, count(*) AS count FROM n WHERE n = 1 HAVING count(*) > 0 UNION ALL SELECT 'part', sum(n)::BIGINT FROM n WHERE n = 2 HAVING count(*) > "
    "0 UNION ALL SELECT 'supplier', sum(n)::BIGINT FROM n WHERE n > 2 HAVING count(*) > 0",
)
q(
    "coalesce",
    lambda g: V(g, "orders").coalesce(__.out("contains").has("p_size", P.gt(45)), __.out("suppliedBy")).group_count(".label"),
    "WITH b AS (SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45) SELECT 'part' AS key, count(*) AS "
    "count FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size > 45 UNION ALL SELECT 'supplier', count(*) FROM lineitem ANTI JOIN b "
    "USING (l_orderkey)",
)
q(
    "union",
    lambda g: V(g, "customer").union(__.out("inNation"), __.out("placed"), __.has("c_acctbal", P.lt(0.0))).group_count(".label"),
    "SELECT 'nation' AS key, count(*) AS count FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', count(*) "
    "FROM customer WHERE c_acctbal < 0",
)
q(
    "union_start",
    lambda g: g.traversal().union(V(g, "region"), V(g, "nation")).table(label=".label", id=".id"),
    "SELECT 'region' AS label, r_regionkey AS id FROM region UNION ALL SELECT 'nation', n_nationkey FROM nation",
)
q(
    "local_limit",
    lambda g: V(g, "customer").as_("c").local(__.out("placed").limit(2, by=("-.o_totalprice", ".id"))).table(c="c.id", o=".id"),
    "SELECT o_custkey AS c, o_orderkey AS o FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) "
    "<= 2",
)
q(
    "local_count",
    lambda g: V(g, "orders").as_("o").local_count(__.out("contains")).table(o="o.id", n=".value"),
    "SELECT o_orderkey AS o, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey",
)
q(
    "local_max",
    lambda g: V(g, "customer").as_("c").local_reduce(__.out("placed").values("o_totalprice"), "max").table(c="c.id", value=".value"),
    "SELECT o_custkey AS c, max(o_totalprice) AS value FROM orders GROUP BY 1",
)
q(
    "local_sum",
    lambda g: V(g, "orders").as_("o").local_reduce(__.out_e("contains").values("l_quantity"), "sum").table(o="o.id", value=".value"),
    "SELECT l_orderkey AS o, sum(l_quantity) AS value FROM lineitem GROUP BY 1",
)
q(
    "where_semi",
    lambda g: V(g, "customer").where(__.out("placed").has("o_totalprice", P.gt(400000.0))).table(id=".id"),
    CUST + "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
)
q("not_anti", lambda g: V(g, "orders").not_(__.out("contains")).table(id=".id"), f"SELECT o_orderkey AS id FROM orders WHERE {NOLINE}")
q(
    "and_semi",
    lambda g: V(g, "customer").and_(__.out("placed").has("o_orderstatus", "F"), __.out("placed").has("o_orderstatus", "P")).table(id=".id"),
    CUST
    + ("EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AND EXISTS (SELECT 1 FROM orders WHERE o_custkey = "
       "c_custkey AND o_orderstatus = 'P')"),
)
q(
    "or_semi",
    lambda g: V(g, "customer").or_(__.out("placed").has("o_totalprice", P.gt(450000.0)), __.has("c_acctbal", P.lt(-500.0))).table(id=".id"),
    CUST + "EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000) OR c_acctbal < -500",
)

# Aggregation
q("count", lambda g: V(g, "customer").out("placed").out("contains").count(), "SELECT count(*) AS count FROM lineitem")
q("count_empty", lambda g: V(g, "customer").has("c_acctbal", P.gt(1e12)).count(), "SELECT 0::BIGINT AS count")
for how, sql in (("sum", "round(sum(o_totalprice), 2)"), ("min", "min(o_totalprice)"), ("max", "max(o_totalprice)"), ("mean", "round(avg(o_totalprice), 4)")):
    q(
        how,
        lambda g, how=how: V(g, "orders").values("o_totalprice").reduce(how).select(F.round("value", {"sum": 2, "mean": 4}.get(how, 9)).alias("value")),
        f"SELECT round({sql}, 9) AS value FROM orders",
    )
q(
    "mean_multi_label",
    lambda g: V(g, "customer", "supplier").values("c_acctbal", "s_acctbal").reduce("mean").select(F.round("value", 6).alias("value")),
    "SELECT round(avg(x), 6) AS value FROM (SELECT c_acctbal AS x FROM customer UNION ALL SELECT s_acctbal FROM supplier)",
)
q("max_empty", lambda g: V(g, "customer").has("c_acctbal", P.gt(1e12)).values("c_acctbal").reduce("max"), "SELECT c_acctbal AS value FROM customer WHERE false")
q(
    "max_skips_nan",
    lambda g: V(g, "supplier").map(lambda c: F.when(c("s_suppkey") % 2 == 0, F.lit(float("nan"))).otherwise(c("s_acctbal"))).reduce("max"),
    "SELECT max(s_acctbal) AS value FROM supplier WHERE s_suppkey % 2 <> 0",
)
q(
    "group_count",
    lambda g: V(g, "customer").has("c_mktsegment", "BUILDING").out("placed").group_count(".o_orderstatus"),
    "SELECT o_orderstatus AS key, count(*) AS count FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1",
)
for how, sql in (("sum", "round(sum(o_totalprice), 2)"), ("max", "max(o_totalprice)"), ("min", "min(o_totalprice)"), ("mean", "round(avg(o_totalprice), 4)")):
    q(
        f"group_{how}",
        lambda g, how=how: V(g, "orders").group(".o_orderpriority", value=(how, ".o_totalprice")).select("key", F.round("value", {"sum": 2, "mean": 4}.get(how, 9)).alias("value")),
        f"SELECT o_orderpriority AS key, round({sql}, 9) AS value FROM orders GROUP BY 1",
    )
q(
    "group_multi_key",
    lambda g: V(g, "orders").group({"status": ".o_orderstatus", "priority": ".o_orderpriority"}, n=("count", None)),
    "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n FROM orders GROUP BY ALL",
)
q(
    "group_by_label",
    lambda g: V(g, "customer", "supplier", "nation").group_count(".label"),
    "SELECT 'customer' AS key, count(*) AS count FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'nation', "
    "count(*) FROM nation",
)
q(
    "group_with_join",
    lambda g: V(g, "customer").as_("c").out("inNation").out("inRegion").group(".r_name", richest=("max", "c.c_acctbal"), n=("count", None)),
    "SELECT r_name AS key, max(c_acctbal) AS richest, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON "
    "n_regionkey = r_regionkey GROUP BY 1",
)
q(
    "group_nested",
    lambda g: V(g, "orders").then("group_nested", ".o_orderstatus", ".o_orderpriority", n=("count", None)).map(lambda c: F.map_entries(c(".value")["value"])).unfold().then("table", status=lambda c: F.col("p0__value")["key"], inner=lambda c: c(".value")["key"], n=lambda c: c(".value")["value"]).table(status=".status", inner=".inner", n=".n"),
    "SELECT o_orderstatus AS status, o_orderpriority AS inner, count(*) AS n FROM orders GROUP BY ALL",
)
q(
    "group_by_traversal",
    lambda g: V(g, "customer").group(__.out("placed").count(), n=("count", None)),
    "SELECT k AS key, count(*) AS n FROM (SELECT count(o_orderkey) AS k FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY "
    "c_custkey) GROUP BY 1",
)
q("group_count_element", lambda g: V(g, "orders").out("suppliedBy").group_count(".id"), "SELECT l_suppkey AS key, count(*) AS count FROM lineitem GROUP BY 1")
q("dedup", lambda g: V(g, "orders").out("contains").dedup().table(id=".id"), "SELECT DISTINCT l_partkey AS id FROM lineitem")
q(
    "dedup_select",
    lambda g: V(g, "region").as_("r").in_("inRegion").as_("n").in_("inNation").has_label("supplier").select("n").dedup().select("r").group_count(".r_name"),
    "SELECT r_name AS key, count(DISTINCT n_nationkey) AS count FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey "
    "= n_nationkey GROUP BY 1",
)
q("dedup_by", lambda g: V(g, "customer").dedup(".c_mktsegment").table(segment=".c_mktsegment"), "SELECT DISTINCT c_mktsegment AS segment FROM customer")
q(
    "aggregate_store",
    lambda g: V(g, "nation").aggregate("all", ".n_regionkey").has("n_name", P.gt("M")).cap_list("all"),
    "SELECT list_sort(list(n_regionkey)) AS value FROM nation",
)
q(
    "where_stored",
    lambda g: V(g, "supplier").out("inNation").aggregate("s").in_("inNation").has_label("customer").as_("c").out("inNation").where_stored("s").select("c").table(id=".id"),
    "SELECT c_custkey AS id FROM supplier s JOIN customer ON s_nationkey = c_nationkey",
)
q(
    "group_side_effect",
    lambda g: V(g, "customer").store("n", "group_count", ".c_mktsegment").out("placed").cap("n"),
    "SELECT c_mktsegment AS key, count(*) AS count FROM customer GROUP BY 1",
)
q("aggregate_cap", lambda g: V(g, "region").fold(".r_name"), "SELECT list_sort(list(r_name)) AS value FROM region")
q(
    "sack",
    lambda g: V(g, "customer").has("c_acctbal", P.lt(0.0)).sack("m", 1.0, lambda s, c: s).out("placed").sack("m", None, lambda s, c: s * c(".o_totalprice")).sack_sum("m", ".o_orderstatus").select("key", F.round("value", 2).alias("value")),
    "SELECT o_orderstatus AS key, round(sum(o_totalprice), 2) AS value FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_acctbal < 0 "
    "GROUP BY 1",
)
q(
    "sack_max",
    lambda g: V(g, "customer").sack("m", 0.0, lambda s, c: s).out("placed").sack("m", None, lambda s, c: s + c(".o_totalprice")).sack_sum("m", ".o_orderstatus", "max"),
    "SELECT o_orderstatus AS key, max(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
)
q(
    "sample_seeded",
    lambda g: V(g, "customer").sample(10, seed=7, id=".id"),
    "SELECT c_custkey AS id FROM customer ORDER BY md5('7|' || c_custkey), c_custkey LIMIT 10",
)
q(
    "bulk_repeat",
    lambda g: V(g, "part").repeat_counted(__.out("nextPart"), 3).groupBy("label").agg(F.sum("n").alias("paths")),
    f"WITH {NEXT}, a AS (SELECT dst AS v, count(*) AS n FROM np GROUP BY 1), b AS (SELECT dst AS v, sum(n) AS n FROM a JOIN np ON src = v GROUP BY "
    "1) SELECT 'part' AS label, sum(n)::BIGINT AS paths FROM b JOIN np ON src = v",
)

# Order and range
q(
    "order_multi",
    lambda g: V(g, "customer").table(order=("segment", "-balance", "id"), limit=50, segment=".c_mktsegment", balance=".c_acctbal", id=".id"),
    "SELECT c_mktsegment AS segment, c_acctbal AS balance, c_custkey AS id FROM customer ORDER BY 1, 2 DESC, 3 LIMIT 50",
)
q(
    "order_limit",
    lambda g: V(g, "orders").table(order=("-price", "id"), limit=10, id=".id", price=".o_totalprice"),
    "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY 2 DESC, 1 LIMIT 10",
)
q(
    "range",
    lambda g: V(g, "orders").table(order=("price", "id"), skip=5, limit=10, id=".id", price=".o_totalprice"),
    "SELECT o_orderkey AS id, o_totalprice AS price FROM orders ORDER BY 2, 1 LIMIT 10 OFFSET 5",
)
q("skip", lambda g: V(g, "nation").table(order=("name",), skip=20, name=".n_name"), "SELECT n_name AS name FROM nation ORDER BY 1 OFFSET 20")
q("tail", lambda g: V(g, "nation").table(order=("name",), tail=3, name=".n_name"), "SELECT n_name AS name FROM nation ORDER BY 1 DESC LIMIT 3")
q(
    "order_multi_label",
    lambda g: V(g, "customer", "supplier").table(order=("balance", "id", "label"), limit=20, label=".label", id=".id", balance=lambda c: F.coalesce(c(".c_acctbal"), c(".s_acctbal"))),
    "SELECT * FROM (SELECT 'customer' AS label, c_custkey AS id, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_suppkey, "
    "s_acctbal FROM supplier) ORDER BY balance, id, label LIMIT 20",
)
q(
    "order_by_path",
    lambda g: V(g, "nation").as_("n").out("inRegion").table(order=("nation",), limit=7, region=".r_name", nation="n.n_name"),
    "SELECT r_name AS region, n_name AS nation FROM nation JOIN region ON n_regionkey = r_regionkey ORDER BY 2 LIMIT 7",
)
q(
    "mid_limit",
    lambda g: V(g, "orders").limit(20, by=("-.o_totalprice",)).out("contains").group_count(".label"),
    "SELECT 'part' AS key, count(*) AS count FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) JOIN lineitem ON "
    "l_orderkey = o_orderkey",
)

BALANCE = lambda c: F.coalesce(c(".c_acctbal"), c(".s_acctbal"))
RICH = "SELECT 'customer' AS label, c_custkey AS id, c_nationkey AS n, c_acctbal AS b, 0 AS k FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_nationkey, s_acctbal, 1 FROM supplier"
q(
    "limit_multi_label",
    lambda g: V(g, "customer", "supplier").limit(25, by=(BALANCE,), skip=5).as_("x").out("inNation").table(label=lambda c: c("x.label"), id="x.id", nation=".n_name"),
    f"SELECT label, id, n_name AS nation FROM (SELECT * FROM ({RICH}) ORDER BY b, k, id LIMIT 25 OFFSET 5) JOIN nation ON n_nationkey = n",
)
q(
    "order_step",
    lambda g: V(g, "orders").order("-.o_totalprice", ".id").limit(10).out("contains").group_count(".id"),
    "SELECT l_partkey AS key, count(*) AS count FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) JOIN lineitem ON "
    "l_orderkey = o_orderkey GROUP BY 1",
)
q(
    "order_by_traversal",
    lambda g: V(g, "customer").order(__.out("placed").count(), "-.id").table(limit=10, id=".id"),
    "SELECT c_custkey AS id FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 ORDER BY count(o_orderkey), 1 DESC LIMIT 10",
)
q(
    "order_after_optional",
    lambda g: V(g, "orders").has("o_orderstatus", "O").optional(__.out("contains")).order("-.id", ".label").table(limit=20, id=".id", label=".label"),
    "SELECT id, label FROM (SELECT l_partkey AS id, 'part' AS label FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' "
    "UNION ALL SELECT o_orderkey, 'orders' FROM orders WHERE o_orderstatus = 'O' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = "
    "o_orderkey)) ORDER BY id DESC, label LIMIT 20",
)
q(
    "order_after_repeat",
    lambda g: V(g, "message").has("turn", 0).repeat(__.out("replies"), times=2, emit=True).order("-.conv_id", ".turn").limit(15).table(conv=".conv_id", turn=".turn"),
    "SELECT conv_id AS conv, turn FROM conversations WHERE turn IN (1, 2) ORDER BY 1 DESC, 2 LIMIT 15",
)

# Repeat
REC = "WITH RECURSIVE " + TALK
q(
    "repeat_times",
    lambda g: V(g, "message").has("turn", 0).repeat(__.out("replies"), times=2).table(conv=".conv_id", turn=".turn"),
    "SELECT conv_id AS conv, turn FROM conversations WHERE turn = 2",
)
q(
    "repeat_emit",
    lambda g: V(g, "message").has("turn", 0).repeat(__.out("replies"), times=2, emit=True).table(conv=".conv_id", turn=".turn", loops="loops"),
    "SELECT conv_id AS conv, turn, turn::INT AS loops FROM conversations WHERE turn IN (1, 2)",
)
q(
    "repeat_emit_first",
    lambda g: V(g, "message").has("turn", 0).repeat(__.out("replies"), times=2, emit=True, emit_first=True).table(conv=".conv_id", turn=".turn"),
    "SELECT conv_id AS conv, turn FROM conversations WHERE turn IN (0, 1, 2)",
)
q(
    "repeat_until_has",
    lambda g: V(g, "message").has("turn", 0).repeat(__.out("replies").simple_path(), until=__.has("turn", P.gte(3))).table(conv=".conv_id", turn=".turn"),
    "SELECT conv_id AS conv, turn FROM conversations WHERE turn = 3",
)
q(
    "repeat_until_leaf",
    lambda g: V(g, "message").has("turn", 0).repeat(__.out("replies").simple_path(), until=__.not_(__.out("replies").simple_path())).table(conv=".conv_id", turn=".turn"),
    "SELECT conv_id AS conv, max(turn) AS turn FROM conversations GROUP BY 1 HAVING max(turn) > 0",
)
q(
    "repeat_until_loops",
    lambda g: V(g, "message").has("turn", 0).repeat(__.out("replies").simple_path(), until=__.loops(P.gte(2))).table(conv=".conv_id", turn=".turn"),
    "SELECT conv_id AS conv, turn FROM conversations WHERE turn = 2",
)
q(
    "repeat_or",
    lambda g: V(g, "message").has("turn", 0).repeat(__.out("replies").simple_path(), until=__.or_(__.not_(__.out("replies").simple_path()), __.has("turn", 2))).table(conv=".conv_id", turn=".turn"),
    "SELECT conv_id AS conv, least(max(turn), 2) AS turn FROM conversations GROUP BY 1 HAVING max(turn) > 0",
)
q(
    "repeat_and",
    lambda g: V(g, "message").has("turn", 0).repeat(__.out("replies").simple_path(), until=__.and_(__.loops(P.lt(3)), __.has("role", "user"))).table(conv=".conv_id", turn=".turn"),
    "SELECT conv_id AS conv, min(turn) AS turn FROM conversations c WHERE turn > 0 AND turn < 3 AND role = 'user' GROUP BY 1",
)
q(
    "repeat_until_first",
    lambda g: V(g, "nation").repeat(__.out("inRegion"), until=__.has_label("region"), until_first=True).table(id=".id", label=".label"),
    "SELECT n_regionkey AS id, 'region' AS label FROM nation",
)
q(
    "repeat_edges",
    lambda g: V(g, "message").has("turn", 0).repeat(__.out_e("replies").in_v().simple_path(), times=2).path(by={"message": "turn"}).select("length"),
    "SELECT 5 AS length FROM conversations WHERE turn = 2",
)
q(
    "repeat_in",
    lambda g: V(g, "message").not_(__.out("replies")).repeat(__.in_("replies").simple_path(), until=__.not_(__.in_("replies").simple_path())).table(conv=".conv_id", turn=".turn"),
    "SELECT conv_id AS conv, 0::BIGINT AS turn FROM conversations GROUP BY 1 HAVING max(turn) > 0",
)
q(
    "repeat_both",
    lambda g: V(g, "message").has("turn", 1).repeat(__.both("replies").simple_path(), times=2).table(conv=".conv_id", turn=".turn"),
    "SELECT conv_id AS conv, turn FROM conversations c WHERE turn = 3",
)
q(
    "repeat_branching",
    lambda g: V(g, "part").has("p_partkey", P.lt(4)).repeat(__.out("nextPart").simple_path(), times=2).table(a=lambda c: F.col("p0__id"), b=lambda c: F.col("p1__id"), c=".id"),
    f"WITH {NEXT} SELECT x.src AS a, x.dst AS b, y.dst AS c FROM np x JOIN np y ON x.dst = y.src WHERE x.src < 4 AND x.src <> x.dst AND y.dst NOT "
    "IN (x.src, x.dst)",
)
q(
    "repeat_cycle",
    lambda g: V(g, "part").has("p_partkey", P.lt(3)).repeat(__.out("nextPart").simple_path(), until=__.or_(__.has("p_size", P.gt(10)), __.loops(P.gte(3)))).table(a=lambda c: F.col("p0__id"), id=".id", loops="loops"),
    f"WITH RECURSIVE {NEXT}, r(a, v, path, n, done) AS (SELECT p_partkey, p_partkey, [p_partkey], 0, false FROM part WHERE p_partkey < 3 UNION ALL "
    "SELECT a, dst, list_append(path, dst), n + 1, p_size > 10 OR n + 1 >= 3 FROM r JOIN np ON src = v JOIN part ON p_partkey = dst WHERE NOT done "
    "AND NOT list_contains(path, dst)) SELECT a, v AS id, n AS loops FROM r WHERE done",
)
q(
    "repeat_edges_cost",
    lambda g: V(g, "part").has("p_partkey", P.lt(4)).repeat(__.out_e("nextPart").in_v().simple_path(), times=2).table(first=lambda c: F.col("p1__cost"), second=lambda c: F.col("p3__cost"), id=".id"),
    f"WITH {NEXT} SELECT x.cost AS first, y.cost AS second, y.dst AS id FROM np x JOIN np y ON x.dst = y.src WHERE x.src < 4 AND x.src <> x.dst AND "
    "y.dst NOT IN (x.src, x.dst)",
)
q("repeat_nothing", lambda g: V(g, "nation").repeat(__.out("inRegion")).count(), "SELECT 0::BIGINT AS count")

# Vectors
VEC = "[" + ", ".join(str(((k * 37) % 19 - 9) / 10) for k in range(64)) + "]"
VECTOR = [((k * 37) % 19 - 9) / 10 for k in range(64)]
VSQL = f"{VEC}::DOUBLE[]"
for name, sql in (
    ("l2", f"list_distance(embedding::DOUBLE[], {VSQL})"),
    ("l1", f"list_sum([abs(x[1] - x[2]) for x in list_zip(embedding::DOUBLE[], {VSQL})])"),
    ("inner", f"list_inner_product(embedding::DOUBLE[], {VSQL})"),
    ("cosine", f"list_cosine_similarity(embedding::DOUBLE[], {VSQL})"),
):
    q(
        name,
        lambda g, name=name: V(g, "embedding").table(id=".id", d=lambda c: F.round(vectors.METRICS[name](c(".embedding"), VECTOR), 6)),
        f"SELECT vec_id AS id, round({sql}, 6) AS d FROM embeddings",
    )
BITS = "list_zip([x > 0 for x in embedding], [x > 0 for x in " + VEC + "])"
q(
    "hamming",
    lambda g: V(g, "embedding").fun("bits", "transform(embedding, x -> x > 0)").table(id=".id", d=lambda c: vectors.hamming(c(".bits"), [x > 0 for x in VECTOR])),
    f"SELECT vec_id AS id, list_sum([(x[1] <> x[2])::INT for x in {BITS}])::INT AS d FROM embeddings",
)
q(
    "jaccard",
    lambda g: V(g, "embedding").fun("bits", "transform(embedding, x -> x > 0)").table(id=".id", d=lambda c: F.round(vectors.jaccard(c(".bits"), [x > 0 for x in VECTOR]), 6)),
    f"SELECT vec_id AS id, round(1 - list_sum([(x[1] AND x[2])::INT for x in {BITS}]) / list_sum([(x[1] OR x[2])::INT for x in {BITS}]), 6) AS d "
    "FROM embeddings",
)
q(
    "knn",
    lambda g: V(g, "embedding").table(order=("d", "id"), limit=10, id=".id", d=lambda c: F.round(vectors.l2(c(".embedding"), VECTOR), 6)),
    f"SELECT vec_id AS id, round(list_distance(embedding::DOUBLE[], {VSQL}), 6) AS d FROM embeddings ORDER BY 2, 1 LIMIT 10",
)
for name, sql in (
    ("l1", f"list_sum([abs(x[1] - x[2]) for x in list_zip(embedding::DOUBLE[], {VSQL})])"),
    ("inner", f"list_inner_product(embedding::DOUBLE[], {VSQL})"),
    ("cosine", f"list_cosine_similarity(embedding::DOUBLE[], {VSQL})"),
    ("hamming", f"list_sum([(x[1] <> x[2])::INT for x in {BITS}])"),
    ("jaccard", f"1 - list_sum([(x[1] AND x[2])::INT for x in {BITS}]) / list_sum([(x[1] OR x[2])::INT for x in {BITS}])"),
):
    target = [x > 0 for x in VECTOR] if name in ("hamming", "jaccard") else VECTOR
    prop = "bits" if name in ("hamming", "jaccard") else "embedding"
    metric = lambda c, name=name, prop=prop, target=target: F.round(vectors.METRICS[name](c(f".{prop}"), target).cast("double"), 6)
    q(
        f"knn_{name}",
        lambda g, metric=metric: V(g, "embedding").fun("bits", "transform(embedding, x -> x > 0)").order(metric, ".id").table(limit=10, id=".id", d=metric),
        f"SELECT vec_id AS id, round(({sql})::DOUBLE, 6) AS d FROM embeddings ORDER BY 2, 1 LIMIT 10",
    )
q(
    "vec_filter_l2",
    lambda g: V(g, "embedding").has("embedding", Vector.below("l2", VECTOR, 4.0)).table(id=".id"),
    f"SELECT vec_id AS id FROM embeddings WHERE list_distance(embedding::DOUBLE[], {VSQL}) < 4.0",
)
q(
    "call_start",
    lambda g: g.traversal().call("nearest", label="embedding", column="embedding", vector=VECTOR, k=5).table(id=".id"),
    f"SELECT vec_id AS id FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {VSQL}), vec_id LIMIT 5",
)
q(
    "vec_filter",
    lambda g: V(g, "embedding").has("embedding", Vector.below("cosine", VECTOR, -0.1)).table(id=".id"),
    f"SELECT vec_id AS id FROM embeddings WHERE list_cosine_similarity(embedding::DOUBLE[], {VSQL}) < -0.1",
)
q(
    "geo_distance",
    lambda g: V(g, "nation").map(lambda c: F.round(vectors.sphere_distance(c("n_nationkey") * 7.0, c("n_regionkey") * 11.0, F.lit(10.0), F.lit(20.0)), 3)).table(value=".value"),
    "SELECT round(2 * 6370986.0 * asin(sqrt(pow(sin(radians(20.0 - n_regionkey * 11.0) / 2), 2) + cos(radians(n_regionkey * 11.0)) * "
    "cos(radians(20.0)) * pow(sin(radians(10.0 - n_nationkey * 7.0) / 2), 2))), 3) AS value FROM nation",
)


# Algorithms
def _edges(g, label):
    return next(e for e in g.edges if e.label == label).df


def _parts(g):
    return g.vertices["part"].df.select(F.col("p_partkey").alias("id"))


def _cheapest(g):
    """Of parallel nextPart edges the cheapest."""
    return _edges(g, "nextPart").groupBy("src", "dst").agg(F.min("cost").alias("cost"))


CHEAP = f"{NEXT}, e AS (SELECT src, dst, min(cost) AS cost FROM np GROUP BY ALL), first AS (SELECT min(src) AS s FROM e)"
#: Least labels after rounds of spreading to all neighbours: enough for components of up to so many edges across.
SPREAD = f"WITH RECURSIVE {NEXT}, b AS (SELECT src AS u, dst AS v FROM np UNION SELECT dst, src FROM np UNION SELECT p_partkey, p_partkey FROM part), r(i, v, c) AS (SELECT 0, p_partkey, p_partkey FROM part UNION ALL SELECT i + 1, b.v, min(c) FROM r JOIN b ON b.u = r.v WHERE i < 24 GROUP BY i, b.v)"
#: Least (cost, edges) of each node after rounds of relaxation, as one number; costs are whole numbers.
RELAX = f"WITH RECURSIVE {CHEAP}, d(i, n, c) AS (SELECT 0, s, 0.0::DOUBLE FROM first UNION ALL SELECT i + 1, n, min(c) FROM (SELECT i, e.dst AS n, d.c + e.cost * 100000 + 1 AS c FROM d JOIN e ON e.src = d.n WHERE d.i < {{rounds}}) WHERE c < {{limit}} GROUP BY i, n), best AS (SELECT n, min(c) AS c FROM d GROUP BY n)"
q(
    "degree",
    lambda g: algorithms.degree(_parts(g), _edges(g, "nextPart")),
    f"WITH {NEXT}, d AS (SELECT src AS x FROM np UNION ALL SELECT dst FROM np) SELECT p_partkey AS id, count(x) AS degree FROM part LEFT JOIN d ON "
    "x = p_partkey GROUP BY 1",
)
q(
    "degree_service",
    lambda g: V(g, "part").as_("p").call("degree", edges=_edges(g, "nextPart"), direction="out").table(id="p.id", degree=".value"),
    f"WITH {NEXT} SELECT p_partkey AS id, count(src) AS degree FROM part LEFT JOIN np ON src = p_partkey GROUP BY 1",
)
q(
    "call_barrier",
    lambda g: V(g, "customer", "supplier").call("labels").table(label=".label", n=".n"),
    "SELECT 'customer' AS label, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier",
)
q("components", lambda g: algorithms.connected_components(_parts(g), _edges(g, "nextPart")), SPREAD + " SELECT v AS id, min(c) AS component FROM r GROUP BY 1")


def _starts(edges):
    return edges.agg(F.min("src").alias("id"))


def _roads(g):
    """_cheapest(), written once for the queries that read it several times."""
    return storage.cut(_cheapest(g), "roads")


def _dijkstra(g):
    e = _roads(g)
    found = algorithms.dijkstra(e, _starts(e), e.select(F.col("dst").alias("id")))
    return found.groupBy("start", "end").agg(F.max("traversal_agg_cost").alias("cost"), F.count("*").alias("nodes"))


DISTANCE = 30.0
q(
    "driving_distance",
    lambda g: algorithms.driving_distance(e := _roads(g), _starts(e), DISTANCE).select("node", "traversal_agg_cost", "traversal_depth"),
    RELAX.format(rounds=31, limit="3100000")
    + " SELECT n AS node, floor(c / 100000) AS traversal_agg_cost, (c % 100000)::INT AS traversal_depth FROM best WHERE c < 3100000",
)
q(
    "driving_paths",
    lambda g: algorithms.driving_paths(e := _roads(g), _starts(e), DISTANCE).select(F.col("end").alias("node"), F.size("path").alias("nodes"), "traversal_agg_cost"),
)
q(
    "dijkstra",
    _dijkstra,
    RELAX.format(rounds=40, limit="1e18")
    + " SELECT s AS start, n AS end, floor(c / 100000) AS cost, (c % 100000 + 1)::BIGINT AS nodes FROM best, first WHERE n <> s",
)


def _ksp(g):
    """Two shortest paths from the smallest source to the nodes that are farthest from it, up to five."""
    e = _roads(g)
    tree = algorithms.shortest(e, _starts(e), edge=False)
    far = tree.where("depth > 0").orderBy(F.desc("agg_cost"), "node").limit(5)
    return algorithms.ksp_pairs(e, far.select("start", F.col("node").alias("end")), 2)


q("ksp", _ksp)

# Changes and the catalogue
q(
    "drop",
    lambda g: g.drop_vertices("orders", g.vertices["orders"].df.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))).traversal().V().has_label("customer").out("placed").out("contains").count(),
    "SELECT count(*) AS count FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'",
)
q(
    "drop_edges",
    lambda g: g.drop_edges("contains", F.col("l_quantity") > 25).traversal().V().has_label("orders").out("contains").count(),
    "SELECT count(*) AS count FROM lineitem WHERE l_quantity <= 25",
)
DROPPED = "SELECT count(*) AS count FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'F'"
q("drop_step", lambda g: V(V(g, "orders").has("o_orderstatus", "F").drop(), "customer").out("placed").out("contains").count(), DROPPED)
q(
    "drop_step_edges",
    lambda g: V(g.traversal().E("contains").has("l_quantity", P.gt(25.0)).drop(), "orders").out("contains").count(),
    "SELECT count(*) AS count FROM lineitem WHERE l_quantity <= 25",
)
q(
    "drop_step_property",
    lambda g: V(V(g, "customer").has("c_acctbal", P.lt(0.0)).values("c_acctbal").drop(), "customer").has_not("c_acctbal").table(id=".id"),
    "SELECT c_custkey AS id FROM customer WHERE c_acctbal < 0 OR c_acctbal IS NULL",
)
q(
    "set_edge_property",
    lambda g: g.set_edge_property("contains", "l_quantity", F.lit(0.0), F.col("l_quantity") > 25).traversal().E("contains").values("l_quantity").reduce("sum"),
    "SELECT sum(CASE WHEN l_quantity > 25 THEN 0 ELSE l_quantity END)::DOUBLE AS value FROM lineitem",
)
q(
    "add_v",
    lambda g: V(g.add_vertices("region", g.spark.createDataFrame([(99, "NOWHERE", "x")], "r_regionkey int, r_name string, note string")), "region").table(id=".id", name=".r_name", note=".note"),
    "SELECT r_regionkey AS id, r_name AS name, NULL::VARCHAR AS note FROM region UNION ALL SELECT 99, 'NOWHERE', 'x'",
)
q(
    "add_e",
    lambda g: V(g.add_edges("inRegion", "nation", "region", g.spark.createDataFrame([(0, 1)], "src int, dst int")), "nation").out("inRegion").group_count(".id"),
    "SELECT r AS key, count(*) AS count FROM (SELECT n_regionkey AS r FROM nation UNION ALL SELECT 1) GROUP BY 1",
)
q(
    "set_property",
    lambda g: V(g.set_property("customer", "c_acctbal", F.lit(0.0), F.col("c_acctbal") < 0), "customer").values("c_acctbal").reduce("min"),
    "SELECT min(greatest(c_acctbal, 0.0)) AS value FROM customer",
)
q(
    "merge_v",
    lambda g: V(g.merge_vertices("region", g.spark.createDataFrame([(1, "NEW"), (77, "MORE")], "r_regionkey int, r_name string"), "r_regionkey"), "region").table(id=".id", name=".r_name"),
    "SELECT r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN 'NEW' ELSE r_name END AS name FROM region UNION ALL SELECT 77, 'MORE'",
)
q(
    "merge_v_repeated",
    lambda g: V(g.merge_vertices("region", g.spark.createDataFrame([(1, "A"), (1, "B"), (77, "C"), (77, "D")], "r_regionkey int, r_name string"), "r_regionkey"), "region").table(id=".id", name=".r_name"),
    "SELECT r_regionkey AS id, CASE WHEN r_regionkey = 1 THEN 'B' ELSE r_name END AS name FROM region UNION ALL SELECT 77, 'D'",
)
q(
    "merge_e",
    lambda g: V(g.merge_edges("inRegion", "nation", "region", g.spark.createDataFrame([(0, 0), (0, 4)], "src int, dst int")), "nation").out("inRegion").count(),
    "SELECT (SELECT count(*) FROM nation) + (SELECT count(*) FROM (VALUES (0, 0), (0, 4)) v(s, d) WHERE NOT EXISTS (SELECT 1 FROM nation WHERE "
    "n_nationkey = s AND n_regionkey = d)) AS count",
)
q(
    "bulk_add_edges",
    lambda g: V(g.bulk_add_edges("near", "nation", "region", g.vertices["nation"].df.join(g.vertices["region"].df, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("out"), F.col("r_name").alias("in")), "n_name", "r_name"), "nation").out("near").group_count(".id"),
    "SELECT n_regionkey AS key, count(*) AS count FROM nation GROUP BY 1",
)
q(
    "multiplicity_check",
    lambda g: g.multiplicity("placed", "customer", "orders", lower=5, upper=12),
    "SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1 HAVING count(o_orderkey) < "
    "5 OR count(o_orderkey) > 12",
)
q(
    "unique_check",
    lambda g: g.duplicates("customer", "c_mktsegment").select(F.col("c_mktsegment").alias("segment"), F.col("count").alias("n")),
    "SELECT c_mktsegment AS segment, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1",
)
q(
    "topology_vertices",
    lambda g: g.topology_vertices().select("label", "n_properties"),
    "SELECT * FROM (VALUES ('region', 2), ('nation', 3), ('customer', 5), ('supplier', 4), ('part', 6), ('orders', 6), ('event', 6), ('document', "
    "5), ('label', 3), ('embedding', 3), ('page', 3), ('message', 4)) v(label, n_properties)",
)
q(
    "topology_traversal",
    lambda g: g.topology().traversal().V().has_label("schemaElement").has("name", "customer").out("outOf").table(edge=".name"),
    "SELECT unnest(['inNation', 'placed']) AS edge",
)
