"""Queries answered by a stored index of all documents, each beside the SQL that must give the same rows."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from versed.operators import cards, index
from versed.plans.catalog import TOKENS
from versed.plans.registry import query
from versed.plans.session import workspace
from versed.sources.tables import table

LONG = "long"


def stored_index(spark, sf):
    """The folder of the index of `documents` (body, and the first line as heading), brought up to date with the table."""
    path = f"{workspace(spark)}/index-{hashlib.md5(sf.encode()).hexdigest()}"
    docs = table(spark, sf, "documents").withColumn("first_line", F.substring_index("text", "\n", 1))
    index.build(docs, "doc_id", path, body="text", heading="first_line")
    return path


def _one(spark, text):
    return spark.range(1).select(F.lit("q").alias("request"), F.lit(text).alias("asked"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents)
SELECT doc_id, count(*) AS hits FROM t WHERE term = 'the' OR starts_with(term, 'thing') GROUP BY doc_id HAVING bool_or(term = 'the') AND bool_or(starts_with(term, 'thing')) ORDER BY hits DESC, doc_id LIMIT 20""")
def across_corpus(spark, sf):
    """The twenty documents with most hits of two words, from the stored index, which is made where there is none."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    rows = cards.across(docs, "doc_id", f"{workspace(spark)}/across-{hashlib.md5(sf.encode()).hexdigest()}", _one(spark, " ".join(TOKENS[:2])), "request", "asked", 20, body="text")
    return rows.select(F.col("key").alias("doc_id"), "hits")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents),
f AS (SELECT doc_id, count(*) AS hits FROM t WHERE term = 'the' OR starts_with(term, 'thing') GROUP BY doc_id HAVING bool_or(term = 'the') AND bool_or(starts_with(term, 'thing')))
SELECT d.doc_id, d.source, f.hits::BIGINT AS hits FROM documents d JOIN f ON f.doc_id = d.doc_id""")
def hits_from_postings(spark, sf):
    path = stored_index(spark, sf)
    hits = index.counted(index.found(_one(spark, " ".join(TOKENS[:2])), "request", "asked", path).where("field = 'body'"))
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return docs.join(hits, F.col("doc_id") == F.col("key")).select("doc_id", "source", F.col("hits").cast(LONG).alias("hits"))


COVERS_SQL = """ranked AS (SELECT *, row_number() OVER w AS k, max(CASE WHEN a THEN p END) OVER w AS la, max(CASE WHEN b THEN p END) OVER w AS lb FROM hit WINDOW w AS (PARTITION BY request, doc_id ORDER BY p ROWS UNBOUNDED PRECEDING)),
started AS (SELECT r.*, least(la, lb) AS s FROM ranked r WHERE la IS NOT NULL AND lb IS NOT NULL),
fresh AS (SELECT *, s > coalesce(lag(s) OVER (PARTITION BY request, doc_id ORDER BY p), -1) AS new FROM started),
cover AS (SELECT f.request, f.doc_id, 0.1::DOUBLE / (1 + (f.p - f.s) - (f.k - g.k)) AS w FROM fresh f JOIN ranked g ON g.request = f.request AND g.doc_id = f.doc_id AND g.p = f.s WHERE f.new)"""


@query(f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
t AS (SELECT doc_id, len(ws) AS size, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS p FROM d),
hit AS (SELECT 'q' AS request, doc_id, size, p, term = 'the' AS a, starts_with(term, 'thing') AS b FROM t WHERE term = 'the' OR starts_with(term, 'thing')), {COVERS_SQL}
SELECT doc_id, round(sum(w) / (1 + ln(any_value(len(ws)))), 6) AS rank FROM cover JOIN d USING (doc_id) GROUP BY doc_id""")
def cover_density_all(spark, sf):
    """All documents that hold both words, ranked by cover density; equal ranks are in no order."""
    found = index.found(_one(spark, " ".join(TOKENS[:2])), "request", "asked", stored_index(spark, sf))
    return index.cover_density(found).select(F.col("key").alias("doc_id"), F.round("rank", 6).alias("rank"))


@query(f"""WITH q AS (SELECT item_id AS request, ts[2] AS x, ts[3] AS y FROM (SELECT item_id, regexp_extract_all(lower(text), '[A-Za-z]+') AS ts FROM benchmark) WHERE ts[2] <> ts[3]),
s AS (SELECT request, CASE WHEN length(x) >= 5 THEN x[1:greatest(5, length(x) - 3)] ELSE x END AS x, length(x) >= 5 AS px, CASE WHEN length(y) >= 5 THEN y[1:greatest(5, length(y) - 3)] ELSE y END AS y, length(y) >= 5 AS py FROM q),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
t AS (SELECT doc_id, unnest(ws) AS term, unnest(range(1, len(ws) + 1)) AS p FROM d),
words AS (SELECT DISTINCT term FROM t),
met AS (SELECT request, term, CASE WHEN px THEN starts_with(term, x) ELSE term = x END AS a, CASE WHEN py THEN starts_with(term, y) ELSE term = y END AS b FROM s JOIN words ON CASE WHEN px THEN starts_with(term, x) ELSE term = x END OR CASE WHEN py THEN starts_with(term, y) ELSE term = y END),
hit AS (SELECT request, doc_id, p, a, b FROM t JOIN met USING (term)), {COVERS_SQL},
every AS (SELECT request, doc_id, sum(w) AS w FROM cover GROUP BY ALL),
either AS (SELECT request, doc_id, 0.1::DOUBLE * count(*) AS w FROM hit WHERE request NOT IN (SELECT request FROM every) GROUP BY ALL)
SELECT request, doc_id, round(w / (1 + ln(len(ws))), 6) AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM either) JOIN d USING (doc_id) QUALIFY row_number() OVER (PARTITION BY request ORDER BY rank DESC, doc_id) <= 10""")
def cover_density_requests(spark, sf):
    """For each benchmark item as a request of its second and third word: the ten best documents by all words, or by any where no document has all; ties by id."""
    from pyspark.sql import Window as W

    items = table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit("[A-Za-z]+"), F.lit(0)).alias("ts")).where("get(ts, 1) <> get(ts, 2)")
    requests = items.select("item_id", F.concat_ws(" ", F.get("ts", 1), F.get("ts", 2)).alias("asked"))
    ranked = index.cover_density_or(requests, "item_id", "asked", stored_index(spark, sf)).withColumn("rank", F.round("rank", 6))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("rank"), F.col("key")))
    return ranked.withColumn("place", place).where("place <= 10").select(F.col("query").alias("request"), F.col("key").alias("doc_id"), "rank")


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws, regexp_extract_all(lower(string_split(text, chr(10))[1]), '[\\p{L}\\p{N}]+') AS hs FROM documents),
c AS (SELECT doc_id, (len(ws) + len(hs))::DOUBLE AS n, len(list_filter(ws, lambda w: w = 'the')) + 5.0::DOUBLE * len(list_filter(hs, lambda w: w = 'the')) AS a,
 len(list_filter(ws, lambda w: starts_with(w, 'thing'))) + 5.0::DOUBLE * len(list_filter(hs, lambda w: starts_with(w, 'thing'))) AS b FROM d),
s AS (SELECT count(*)::DOUBLE AS units, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, round(greatest(1e-6, ln((units - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + greatest(1e-6, ln((units - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 6) AS score
FROM c, s WHERE a > 0 AND b > 0""")
def bm25_indexed(spark, sf):
    """BM25 over the first line, weighted 5, and the body, from the stored index."""
    path = stored_index(spark, sf)
    found = index.found(_one(spark, " ".join(TOKENS[:2])), "request", "asked", path)
    return index.bm25(found, spark, path).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


@query("""SELECT item_id, CASE WHEN len(list_filter(regexp_extract_all(lower(text), '[A-Za-zА-Яа-яІіЇїЄєҐґ0-9-]+'), lambda w: replace(w, '-', '') <> '')) > 0 THEN 'ok' ELSE 'unusable_query' END AS status FROM benchmark
UNION ALL SELECT -1, 'unusable_query'""")
def index_statuses(spark, sf):
    """Whether the index can answer each benchmark item, and a request of service words alone."""
    items = table(spark, sf, "benchmark").select("item_id", "text")
    bare = spark.range(1).select(F.lit(-1).cast(LONG).alias("item_id"), F.lit("та або - що").alias("text"))
    return index.statuses(items.union(bare), "item_id", "text", stored_index(spark, sf)).select("item_id", "status")


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term, unnest(range(1, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) + 1)) AS p FROM documents)
SELECT term, doc_id, count(*) AS tf, min(p) AS first, max(p) AS last, sum(p)::BIGINT AS sum_of_places FROM t GROUP BY term, doc_id""")
def positional_postings(spark, sf):
    """The postings of all bodies as they are stored, with their places in short."""
    rows = index.current(spark, stored_index(spark, sf)).where("field = 'body'")
    whole = F.aggregate("positions", F.lit(0).cast(LONG), lambda a, p: a + p)
    return rows.select("term", F.col("key").alias("doc_id"), F.col("tf").cast(LONG).alias("tf"), F.array_min("positions").cast(LONG).alias("first"), F.array_max("positions").cast(LONG).alias("last"), whole.alias("sum_of_places"))
