"""Queries over the driver's tables, each beside the SQL that must give the same rows: records, coverage, usage, evaluation, windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versed.operators import coverage, evidence, graph, records, search
from versed.plans.registry import query
from versed.sources.tables import table
from versed.streaming import windows

LONG = "long"

# --- citations: orders cite parts through lineitem ---


@query("""SELECT cited AS p_partkey, o_orderkey, o_orderdate, n <= 25 AS complete FROM (SELECT *, count(*) OVER () AS n FROM (
SELECT DISTINCT l.l_partkey AS cited, o.o_orderkey, o.o_orderdate FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE l.l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 7) AND o.o_orderdate >= DATE '1994-01-01' AND o.o_orderdate <= DATE '1996-12-31'))
ORDER BY o_orderdate, o_orderkey, cited LIMIT 25""")
def cited_by_topn_complete(spark, sf):
    edges = table(spark, sf, "lineitem").join(table(spark, sf, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    found = graph.citing(edges, table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.lit(True), "l_orderkey", "l_partkey", "o_orderkey")
    found = graph.dated(found, "o_orderdate", "1994-01-01", "1996-12-31")
    rows = records.with_completeness(found, 25, F.col("o_orderdate"), F.col("o_orderkey"), F.col("cited"))
    return rows.select(F.col("cited").alias("p_partkey"), "o_orderkey", "o_orderdate", "complete")


VALUES = "l_partkey, l_suppkey, l_quantity, l_shipdate"
LINES_SQL = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS status FROM lineitem"""
ORDER_SQL = "l_partkey, l_suppkey, l_quantity, l_shipdate"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", F.when(F.col("l_returnflag") == "R", F.col("l_linestatus")).alias("status"))


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM ({LINES_SQL}) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY (status IS NOT NULL)::INT DESC, {ORDER_SQL}) = 1")
def dedupe_richest(spark, sf):
    order = [F.desc(records.filled(F.col("status"))), *(F.col(c.strip()) for c in ORDER_SQL.split(","))]
    return records.pick(_lines(spark, sf), ["l_orderkey", "l_linenumber"], *order).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM ({LINES_SQL}) QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {ORDER_SQL}) = 1")
def dedupe_first_seen(spark, sf):
    return records.pick(_lines(spark, sf), ["l_orderkey", "l_linenumber"], *(F.col(c.strip()) for c in ORDER_SQL.split(","))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) = 1")
def dedupe_last_wins(spark, sf):
    return records.pick(_lines(spark, sf), ["l_orderkey", "l_linenumber"], *(F.desc(c) for c in ("l_shipdate", "l_partkey", "l_suppkey", "l_quantity"))).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query("SELECT l_orderkey AS o_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS modes, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY 1")
def card_collapse(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), "|").alias("modes"), F.count_distinct("l_partkey").alias("n_parts"))
    return rows


@query("SELECT l_suppkey, min(l_partkey) AS preferred FROM lineitem WHERE length(l_partkey::VARCHAR) = (SELECT min(length(x.l_partkey::VARCHAR)) FROM lineitem x WHERE x.l_suppkey = lineitem.l_suppkey) GROUP BY 1")
def preferred_identifier(spark, sf):
    pairs = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_partkey").cast("string").alias("ident")).distinct()
    return graph.preferred(pairs, "l_suppkey", "ident").select("l_suppkey", F.col("ident").cast(LONG).alias("preferred"))


# --- coverage: suppliers are sources of nations' requests ---


def _capabilities(spark, sf):
    s = table(spark, sf, "supplier")
    klass = F.when(F.col("s_suppkey") % 3 == 0, "any").otherwise(F.concat(F.lit("c"), (F.col("s_nationkey") % 5).cast("string")))
    return s.select(
        F.col("s_suppkey").alias("source_id"), F.when(F.col("s_suppkey") % 2 == 0, "read").otherwise("search").alias("operation"), klass.alias("document_class"),
        (F.col("s_suppkey") % 4 != 0).alias("verified"), F.when(F.col("s_acctbal") > 5000, 2).when(F.col("s_acctbal") > 0, 1).otherwise(0).alias("verified_rank"), (F.col("s_suppkey") % 3).cast("int").alias("declared_rank"),
    )


CAPABILITIES_SQL = """SELECT s_suppkey AS source_id, CASE WHEN s_suppkey % 2 = 0 THEN 'read' ELSE 'search' END AS operation, CASE WHEN s_suppkey % 3 = 0 THEN 'any' ELSE 'c' || (s_nationkey % 5) END AS document_class,
s_suppkey % 4 <> 0 AS verified, CASE WHEN s_acctbal > 5000 THEN 2 WHEN s_acctbal > 0 THEN 1 ELSE 0 END AS verified_rank, s_suppkey % 3 AS declared_rank, s_suppkey % 5 <> 0 AS wired FROM supplier"""


@query(f"""WITH c AS ({CAPABILITIES_SQL}), q AS (SELECT n_nationkey AS request, CASE WHEN n_nationkey % 2 = 0 THEN 'read' ELSE 'search' END AS operation, CASE WHEN n_nationkey % 7 = 0 THEN 'any' ELSE 'c' || (n_nationkey % 6) END AS k FROM nation),
m AS (SELECT q.request, c.* FROM q JOIN c ON c.operation = q.operation AND (q.k = 'any' OR c.document_class = 'any' OR c.document_class = q.k)),
g AS (SELECT request, source_id FROM m WHERE verified AND wired QUALIFY row_number() OVER (PARTITION BY request ORDER BY verified_rank DESC, declared_rank DESC, source_id) = 1)
SELECT q.request AS n_nationkey, g.source_id, CASE WHEN g.source_id IS NOT NULL THEN '' WHEN (SELECT count(*) FROM m WHERE m.request = q.request) = 0 THEN 'no_capability' WHEN (SELECT bool_or(verified) FROM m WHERE m.request = q.request) THEN 'not_wired' ELSE 'not_verified' END AS reason
FROM q LEFT JOIN g ON g.request = q.request""")
def route_best_source(spark, sf):
    n = F.col("n_nationkey")
    asked = table(spark, sf, "nation").select(n.alias("request"), F.when(n % 2 == 0, "read").otherwise("search").alias("operation"), F.when(n % 7 == 0, "any").otherwise(F.concat(F.lit("c"), (n % 6).cast("string"))).alias("document_class"))
    capabilities = _capabilities(spark, sf)
    sources = capabilities.select("source_id", (F.col("source_id") % 5 != 0).alias("wired"))
    return coverage.route(asked, capabilities, sources).withColumnRenamed("request", "n_nationkey")


@query("SELECT s_nationkey AS source_id, s_name AS layer FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name) = 1")
def verified_layer(spark, sf):
    return coverage.verified_layer(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("source_id"), F.col("s_name").alias("layer"), "s_acctbal"), "s_acctbal")


@query("""SELECT r_name, count(n_nationkey) AS n_nations, string_agg(n_name, '|' ORDER BY n_name) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY r_name""")
def coverage_nested(spark, sf):
    sources = table(spark, sf, "region").select(F.col("r_regionkey").alias("source_id"), "r_name")
    capabilities = table(spark, sf, "nation").select(F.col("n_regionkey").alias("source_id"), F.col("n_name").alias("operation"), F.lit("").alias("document_class"), F.lit(1).alias("layer"))
    out = coverage.described(sources, capabilities)
    return out.select("r_name", F.greatest(F.lit(0), F.size("capabilities")).cast(LONG).alias("n_nations"), F.array_join(F.transform("capabilities", lambda c: c["operation"]), "|").alias("nations"))


@query("""SELECT DISTINCT a.p_name AS query, n.n_name AS alias FROM (SELECT DISTINCT p_brand || ' NATION_' || (p_size % 10) AS p_name FROM part) a JOIN nation n ON contains(a.p_name, n.n_name) OR contains(n.n_name, a.p_name)""")
def alias_containment_join(spark, sf):
    queries = table(spark, sf, "part").select(F.concat(F.col("p_brand"), F.lit(" NATION_"), (F.col("p_size") % 10).cast("string")).alias("query")).distinct()
    return records.containment(queries, "query", table(spark, sf, "nation").select(F.col("n_name").alias("alias")), "alias")


@query("""SELECT r AS requested, CASE WHEN d.doc_id IS NULL THEN 'not_found' ELSE 'ok' END AS status, d.doc_id, d.source FROM (SELECT unnest(range(0, 2000, 37)) AS r) q LEFT JOIN documents d ON d.doc_id = q.r""")
def batch_lookup_status(spark, sf):
    asked = spark.range(0, 2000, 37).withColumnRenamed("id", "doc_id")
    return records.lookup(asked, table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select("requested", "status", "doc_id", "source")


# --- usage and evaluation ---


def _usage(rows, *keys):
    value = F.col("value")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.count_if(value < 10).alias("errors"), F.round(F.avg(value), 2).alias("avg_value"))


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (value < 10) AS errors, round(avg(value), 2) AS avg_value FROM events GROUP BY event_type")
def tool_metrics(spark, sf):
    return _usage(table(spark, sf, "events"), "event_type")


@query("SELECT event_type, count(*) AS calls, count(*) FILTER (value < 10) AS errors, round(avg(value), 2) AS avg_value FROM events GROUP BY ROLLUP (event_type)")
def metrics_rollup(spark, sf):
    rows = table(spark, sf, "events")
    return rows.rollup("event_type").agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("value") < 10).alias("errors"), F.round(F.avg("value"), 2).alias("avg_value"))


@query("""WITH q AS (SELECT conv_id, turn, row_number() OVER w AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING)::BIGINT AS chars FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role))
SELECT conv_id, turn, n, chars, n <= 5 AND chars <= 1500 AS allowed FROM q""")
def session_quota(spark, sf):
    rows = table(spark, sf, "conversations").withColumn("o", F.struct("turn", "role"))
    out = records.quota(rows, "conv_id", "o", F.length("text").cast(LONG), 5, 1500)
    return out.select("conv_id", "turn", F.col("n").cast(LONG).alias("n"), "chars", "allowed")


@query("SELECT conv_id, role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id, role")
def agent_usage(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id", "role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text").cast(LONG)).alias("chars"))


RECALL_SQL = """WITH q AS (SELECT vec_id AS q, label AS ql, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
r AS (SELECT q, ql, label, row_number() OVER (PARTITION BY q ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.e), 9) DESC, vec_id) AS rank FROM q JOIN embeddings v ON v.vec_id <> q.q),
m AS (SELECT q, min(rank) FILTER (label = ql) AS first FROM r WHERE rank <= 5 GROUP BY q)
SELECT 5::BIGINT AS k, round(avg((first IS NOT NULL)::INT), 4) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 4) AS mrr FROM m"""


@query(RECALL_SQL)
def recall_mrr(spark, sf):
    """A stated query set (ids divisible by 100) against all vectors: blocks of queries, each in one pass over the vectors."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    best = search.nearest(vectors.where("vec_id % 100 = 0"), vectors, "vec_id", "embedding", 5)
    rows = best.join(vectors.select("vec_id", "label"), "vec_id").join(vectors.select(F.col("vec_id").alias("query"), F.col("label").alias("ql")), "query")
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id")))  # of five
    first = rows.groupBy("query").agg(F.min(F.when(F.col("label") == F.col("ql"), F.col("rank"))).alias("first"))
    return first.agg(F.lit(5).cast(LONG).alias("k"), F.round(F.avg(F.col("first").isNotNull().cast("int")), 4).alias("recall"), F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 4).alias("mrr")).select("k", "recall", "mrr")


@query("""WITH e AS (SELECT user_id, event_id, ts, event_type = 'error' AS f, sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
a AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS attempt FROM e WHERE f)
SELECT user_id, event_id, attempt, [60, 300, 1800, 7200, 86400][least(attempt, 5)]::BIGINT AS delay_s FROM a""")
def backoff_ladder(spark, sf):
    out = records.ladder(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return out.select("user_id", "event_id", F.col("attempt").cast(LONG).alias("attempt"), F.col("delay_s").cast(LONG).alias("delay_s"))


@query("""SELECT conv_id, role, count(DISTINCT evidence) AS n_entries, CASE count(DISTINCT evidence) WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS status FROM (SELECT conv_id, role, sha256(text) AS evidence FROM conversations) GROUP BY conv_id, role""")
def evidence_lookup(spark, sf):
    rows = table(spark, sf, "conversations")
    entries = rows.select(F.col("conv_id").alias("session"), F.col("role").alias("document"), F.lit("").alias("path"), F.sha2("text", 256).alias("evidence_id"), F.array().cast("array<string>").alias("aliases")).distinct()
    asked = rows.select(F.col("conv_id").alias("session"), F.col("role").alias("document"), F.lit("").alias("path")).distinct()
    n = entries.groupBy("session", "document").agg(F.count(F.lit(1)).alias("n_entries"))
    return evidence.find(asked, entries).join(n, ["session", "document"]).select(F.col("session").alias("conv_id"), F.col("document").alias("role"), "n_entries", "status")


# --- built-ins over the star schema ---


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def grouping_sets(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rows.groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))


@query("(SELECT l_partkey AS k FROM lineitem INTERSECT SELECT p_partkey FROM part WHERE p_size < 20) EXCEPT SELECT l_suppkey FROM lineitem")
def intersect_except(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.select(F.col("l_partkey").alias("k")).intersect(table(spark, sf, "part").where("p_size < 20").select("p_partkey")).subtract(lines.select("l_suppkey"))


@query("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def semi_anti(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return table(spark, sf, "customer").select("c_custkey").join(orders.where("o_totalprice > 200000"), "c_custkey", "left_semi").join(orders.where("o_orderstatus = 'P'"), "c_custkey", "left_anti")


@query("""SELECT o_orderkey, rank() OVER w AS rk, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, round(o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), 2) AS diff
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate::DATE)""")
def ranking_functions(spark, sf):
    by_day, by_price = W.partitionBy("o_custkey").orderBy(F.col("o_orderdate").cast("date")), W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select("o_orderkey", F.rank().over(by_day).cast(LONG).alias("rk"), F.dense_rank().over(by_day).cast(LONG).alias("dr"), F.row_number().over(by_price).cast(LONG).alias("rn"), F.round(price - F.lag(price).over(by_price), 2).alias("diff"))


@query()
def approx_distinct(spark, sf):
    return table(spark, sf, "lineitem").agg(F.approx_count_distinct("l_partkey", 0.02).alias("n"))


# --- windows over events ---


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS w_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS w_end, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_usage(spark, sf):
    return windows.windowed(table(spark, sf, "events"), "ts", "event_type", "1 hour")


@query("""SELECT w AS w_start, w + INTERVAL 1 HOUR AS w_end, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) GROUP BY ALL""")
def sliding_usage(spark, sf):
    return windows.windowed(table(spark, sf, "events"), "ts", "event_type", "1 hour", "30 minutes")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS s_start, max(ts) + INTERVAL 30 MINUTE AS s_end, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    return windows.sessions(table(spark, sf, "events"), "ts", "user_id", "30 minutes")
