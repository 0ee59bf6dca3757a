"""Queries over the driver's tables, each beside the SQL that must give the same rows: resolution, units, invariants, verdicts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versed.functions import ids
from versed.functions import text as T
from versed.functions.python import chunks, flat
from versed.operators import corpus, evidence, graph, records, resolve, search
from versed.plans.registry import query
from versed.sources.tables import table

LONG = "long"


@query("""WITH a AS (SELECT lower(n_name) AS alias, n_nationkey::VARCHAR AS law_id FROM nation), q AS (SELECT DISTINCT 'NATION_' || (p_size % 30) AS q FROM part),
m AS (SELECT q.q, a.law_id, CASE WHEN a.alias = lower(q.q) THEN 1 ELSE 2 END AS stage, a.alias FROM q JOIN a ON a.alias = lower(q.q) OR contains(a.alias, lower(q.q)) OR contains(lower(q.q), a.alias))
SELECT q, law_id, CASE stage WHEN 1 THEN 'alias' ELSE 'containment' END AS matched_by FROM m QUALIFY row_number() OVER (PARTITION BY q ORDER BY stage, alias, law_id) = 1""")
def alias_resolution(spark, sf):
    aliases = table(spark, sf, "nation").select(F.lower("n_name").alias("alias"), F.col("n_nationkey").cast("string").alias("law_id"))
    queries = table(spark, sf, "part").select(F.concat(F.lit("NATION_"), (F.col("p_size") % 30).cast("string")).alias("q")).distinct()
    return resolve.by_alias(queries, "q", aliases)


@query("""WITH s AS (SELECT p_brand, p_partkey, p_name, CASE WHEN lower(p_name) = 'red bolt' THEN 3 WHEN contains(lower(p_name), 'red bolt') THEN 2 WHEN contains('red bolt', lower(p_name)) THEN 1 END AS title_score FROM part)
SELECT p_brand, p_partkey, title_score::BIGINT AS title_score FROM s WHERE title_score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY title_score DESC, p_partkey) = 1""")
def title_match(spark, sf):
    rows = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", F.lit("Red bolt").alias("wanted"))
    return resolve.best_title(rows, "p_brand", "wanted", "p_name", "p_partkey").select("p_brand", "p_partkey", F.col("title_score").cast(LONG).alias("title_score"))


@query("""WITH c AS (SELECT o_custkey AS request, o_orderkey AS hit, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 2 END AS stage FROM orders)
SELECT request, hit, stage::BIGINT AS stage FROM c QUALIFY row_number() OVER (PARTITION BY request ORDER BY stage, hit) = 1""")
def resolution_cascade(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("request"), F.col("o_orderkey").alias("hit"), "o_orderstatus", "o_orderpriority")
    first, urgent = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    stages = [rows.where(first), rows.where(~first & urgent), rows.where(~first & ~urgent)]
    return resolve.cascade([s.select("request", "hit") for s in stages], "request", F.col("hit")).select("request", "hit", F.col("stage").cast(LONG).alias("stage"))


@query()
def chunk_documents(spark, sf):
    """Fragments of about 1500 characters of all documents."""
    return flat(table(spark, sf, "documents"), ["doc_id"], ["text"], "frag string, ordinal long, body string", chunks).select("doc_id", "frag", "ordinal", F.length("body").cast(LONG).alias("n_chars"))


@query("""SELECT doc_id, substr('Фрагмент frag-0001. ' || trim(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND NOT regexp_matches(trim(x), '^(?:[Сс]таття|[0-9]+|[-–.)]+)$'))[1]), 1, 300) AS heading FROM documents""")
def unit_headings(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.heading(F.col("text"), F.lit("frag-0001")).alias("heading"))


@query("SELECT doc_id, substr(text, 501, 500) AS page_text, length(text) > 1000 AS has_more FROM documents WHERE length(text) > 500")
def paged_text(spark, sf):
    rows = table(spark, sf, "documents").where(F.length("text") > 500)
    return rows.select("doc_id", T.page(F.col("text"), 2, 500).alias("page_text"), (F.length("text") > 1000).alias("has_more"))


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents), k AS (SELECT doc_id, text, ls, list_filter(ls, lambda x: NOT contains(lower(x), 'license') AND NOT contains(lower(x), 'token')) AS kept FROM l)
SELECT doc_id, substr(sha256(CASE WHEN len(kept) = len(ls) THEN text ELSE array_to_string(kept, chr(10)) || chr(10) || '[removed: ' || (len(ls) - len(kept)) || ']' END), 1, 16) AS fingerprint FROM k""")
def sanitised_fingerprint(spark, sf):
    clean = T.sanitised(F.col("text"), ("license", "token"))
    return table(spark, sf, "documents").select("doc_id", F.substring(ids.content_hash(clean), 1, 16).alias("fingerprint"))


@query("""SELECT doc_id, source, lang FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 ELSE 2 END, lang, doc_id) = 1""")
def language_choice(spark, sf):
    rank = F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 1).otherwise(2)
    return records.pick(table(spark, sf, "documents").select("doc_id", "source", "lang"), ["source"], rank, F.col("lang"), F.col("doc_id"))


@query("""SELECT vec_id, 'full_text' AS content, label % 3 <> 0 AND label % 2 = 0 AS confirmable, label % 3 <> 0 AND label % 2 = 0 AND vec_id % 5 <> 0 AS quotable FROM embeddings""")
def provenance_flags(spark, sf):
    content, publication = F.when(F.col("label") % 3 != 0, "full_text").otherwise("metadata"), F.when(F.col("label") % 2 == 0, "official").otherwise("summary")
    no = F.lit(False)
    return table(spark, sf, "embeddings").select("vec_id", F.lit("full_text").alias("content"), evidence.confirmable(content, publication).alias("confirmable"), evidence.quotable(content, publication, F.col("vec_id") % 5 != 0, no, no).alias("quotable"))


@query("""WITH a AS (SELECT l_partkey AS k, l_suppkey AS s, min(l_shipdate) AS f FROM lineitem GROUP BY 1, 2), v AS (SELECT k, lead(f) OVER (PARTITION BY k ORDER BY f, s) AS upto FROM a),
o AS (SELECT o_custkey, o_orderdate AS f, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS n FROM (SELECT DISTINCT o_custkey, o_orderdate FROM orders))
SELECT 'one current version' AS rule, (SELECT count(*) FROM (SELECT k FROM v GROUP BY k HAVING count(*) FILTER (upto IS NULL) <> 1)) AS n UNION ALL SELECT 'intervals run forward', (SELECT count(*) FROM o WHERE n IS NOT NULL AND n - INTERVAL 1 DAY < f)
UNION ALL SELECT 'unit ids are unique', (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1))
UNION ALL SELECT 'one order a day', (SELECT count(*) FROM (SELECT 1 FROM orders GROUP BY o_custkey, o_orderdate HAVING count(*) > 1))""")
def invariants(spark, sf):
    """How often each rule of the data model is broken."""
    from versed.operators import temporal

    lines = table(spark, sf, "lineitem")
    first = lines.select("l_partkey", F.sha2(F.col("l_suppkey").cast("string"), 256).alias("h"), "l_shipdate").groupBy("l_partkey", "h").agg(F.min("l_shipdate").alias("at"))
    versions = corpus.versions(first, "l_partkey", "h", "at")
    current = versions.groupBy("l_partkey").agg(F.count_if(F.col("status") == "current").alias("n")).where("n <> 1")
    spans = temporal.intervals(table(spark, sf, "orders"), "o_custkey", "o_orderdate").where("valid_to < valid_from")
    twice = lines.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")
    often = table(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").count().where("count > 1")
    rules = (("one current version", current), ("intervals run forward", spans), ("unit ids are unique", twice), ("one order a day", often))
    out = None
    for name, broken in rules:
        row = broken.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("rule"), "n")
        out = row if out is None else out.union(row)
    return out


@query("""WITH r AS (SELECT doc_id, max(e.label) AS label FROM labels l LEFT JOIN embeddings e ON e.vec_id = l.doc_id GROUP BY doc_id)
SELECT l.doc_id, CASE WHEN r.label IS NULL THEN 'not_published' WHEN l.quality = 0 THEN 'refusal' WHEN r.label % 2 = l.toxic THEN 'hit' ELSE 'absent' END AS verdict FROM labels l JOIN r ON r.doc_id = l.doc_id""")
def relevance_verdicts(spark, sf):
    """Judged cases: refused where that is right, else hit, absent, or nothing published."""
    hits = table(spark, sf, "embeddings").groupBy(F.col("vec_id").alias("doc_id")).agg(F.max("label").alias("label"))
    rows = table(spark, sf, "labels").join(hits, "doc_id", "left")
    verdict = F.when(F.col("label").isNull(), "not_published").when(F.col("quality") == 0, "refusal").when(F.col("label") % 2 == F.col("toxic"), "hit").otherwise("absent")
    return rows.select("doc_id", verdict.alias("verdict"))


@query("""SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), '|') AS o_orderstatus, array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS o_orderpriority, CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN min(o_orderstatus) END AS single FROM orders GROUP BY o_custkey""")
def multi_valued_card(spark, sf):
    out = graph.collapsed(table(spark, sf, "orders"), "o_custkey", ["o_orderstatus", "o_orderpriority"])
    return out.withColumn("single", records.single(records.values(F.col("o_orderstatus"))))


@query("""WITH d AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), o AS (SELECT l_partkey, count(*) AS n, min(l_orderkey) AS first FROM d GROUP BY l_partkey)
SELECT l_partkey, n AS n_citing, first AS first_citing FROM o ORDER BY n DESC, l_partkey LIMIT 50""")
def most_cited(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct().groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n_citing"), F.min("l_orderkey").alias("first_citing"))
    return search.top(rows, 50, F.desc("n_citing"), F.col("l_partkey"))


@query("""SELECT event_id, ts, user_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def change_feed_first(spark, sf):
    k = F.from_json("props", "k long")["k"]
    rows = table(spark, sf, "events").withColumn("k", k).withColumn("n", F.row_number().over(W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")))
    return rows.where("n = 1").select("event_id", "ts", "user_id", "event_type", "k")


@query("SELECT doc_id, coalesce(trim(list_filter(string_split(text, chr(10)), lambda x: length(trim(regexp_replace(x, '\\s+', ' ', 'g'))) BETWEEN 5 AND 500)[1]), '') AS title FROM documents")
def real_titles(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.real_title(F.col("text")).alias("title"))
