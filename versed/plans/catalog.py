"""Queries over the driver's tables, each beside the SQL that must give the same rows: corpus, search, time, gates, quotes, identifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from versed.functions import ids
from versed.functions import text as T
from versed.operators import corpus, patterns, search, temporal
from versed.plans.registry import query
from versed.sources.tables import table

TOKENS = ["the", "thingly", "tion"]
LONG = "long"

# --- corpus ---


@query("""SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(DISTINCT text) FROM documents) AS n_distinct,
(SELECT count(DISTINCT vec_id) FROM embeddings) AS n_embedded, (SELECT count(DISTINCT doc_id) FROM labels) AS n_labelled,
(SELECT count(*) FROM documents d WHERE trim(d.text) <> '' AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)) AS n_pending""")
def corpus_stats(spark, sf):
    docs, emb, labels = (table(spark, sf, t) for t in ("documents", "embeddings", "labels"))
    pending = corpus.missing(docs.where(F.trim("text") != ""), emb, "doc_id", "vec_id")
    zero = F.lit(0).cast(LONG)
    parts = [
        docs.agg(F.count(F.lit(1)).alias("n_docs"), F.count_distinct(F.sha2("text", 256)).alias("n_distinct")),
        emb.agg(F.count_distinct("vec_id").alias("n_embedded")), labels.agg(F.count_distinct("doc_id").alias("n_labelled")), pending.agg(F.count(F.lit(1)).alias("n_pending")),
    ]
    names = [c for p in parts for c in p.columns]
    rows = [p.select(*(F.col(c) if c in p.columns else zero.alias(c) for c in names)) for p in parts]  # five one-row frames
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.agg(*(F.sum(c).alias(c) for c in names))


@query("SELECT doc_id, lang FROM documents d WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)")
def docs_missing_embedding(spark, sf):
    docs = table(spark, sf, "documents").where(F.trim("text") != "").select("doc_id", "lang")
    return corpus.missing(docs, table(spark, sf, "embeddings"), "doc_id", "vec_id")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def docs_without_label(spark, sf):
    return corpus.missing(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").withColumnRenamed("doc_id", "labelled"), "doc_id", "labelled")


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc_id, count(*) AS n_copies FROM documents GROUP BY 1")
def version_dedupe_by_hash(spark, sf):
    return corpus.first_versions(table(spark, sf, "documents"), "doc_id", "text")


@query("SELECT doc_id, length(text) AS n_chars FROM documents WHERE length(text) > 12000")
def oversized_documents(spark, sf):
    return table(spark, sf, "documents").where(F.length("text") > corpus.OVERSIZE).select("doc_id", F.length("text").cast(LONG).alias("n_chars"))


@query("""SELECT doc_id || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS unit, k AS chunk_no, length(CASE WHEN length(text) > 12000 THEN substr(text, (k - 1) * 3000 + 1, 3000) ELSE text END) AS n_chars
FROM (SELECT doc_id::VARCHAR AS doc_id, text, unnest(range(1, CASE WHEN length(text) > 12000 THEN ceil(length(text) / 3000.0)::BIGINT ELSE 1 END + 1)) AS k FROM documents)""")
def oversize_split(spark, sf):
    units = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("unit"), "text")
    return corpus.split_oversize(units, "unit", "text").select("unit", F.col("chunk_no").cast(LONG).alias("chunk_no"), F.length("text").cast(LONG).alias("n_chars"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (1, 5, 8, 13, 21, 34, 55, 89, 144)")
def point_lookup_in(spark, sf):
    return table(spark, sf, "documents").where(F.col("doc_id").isin(1, 5, 8, 13, 21, 34, 55, 89, 144)).select("doc_id", "source")


@query("""SELECT doc_id, source, source IN ('src3', 'src7') AS is_priority FROM documents d WHERE NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)
ORDER BY is_priority DESC, source, doc_id LIMIT 50""")
def priority_backfill_topk(spark, sf):
    rows = corpus.missing(table(spark, sf, "documents").select("doc_id", "source"), table(spark, sf, "embeddings"), "doc_id", "vec_id")
    rows = rows.withColumn("is_priority", F.col("source").isin("src3", "src7"))
    return search.top(rows, 50, F.desc("is_priority"), F.col("source"), F.col("doc_id"))


@query("""WITH r AS (SELECT source, doc_id, n_chars, coalesce(sum(n_chars + 1) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before,
row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
o AS (SELECT *, max((n > 1 AND used_before + n_chars > 40000)::INT) OVER (PARTITION BY source ORDER BY doc_id) AS over FROM r)
SELECT source, doc_id, n_chars, used_before FROM o WHERE over = 0""")
def char_budget_prefix(spark, sf):
    rows = corpus.within_budget(table(spark, sf, "documents").select("source", "doc_id", "n_chars"), "source", "doc_id", F.col("n_chars"), 40_000)
    return rows.select("source", "doc_id", "n_chars", "used_before")


@query("SELECT source, count(*) AS n_docs, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents GROUP BY source")
def bytes_by_source(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("text").cast(LONG)).alias("n_bytes"))


@query("""WITH p AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents),
q AS (SELECT lang, n, '[' || doc_id || ']' || text AS chunk FROM p WHERE n <= 6),
u AS (SELECT lang, n, chunk, 6000 - coalesce(sum(length(chunk)) OVER (PARTITION BY lang ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM q)
SELECT lang, string_agg(substr(chunk, 1, rest::BIGINT), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n) AS joined FROM u WHERE rest > 0 GROUP BY lang""")
def joined_units(spark, sf):
    chunk = F.concat(F.lit("["), F.col("doc_id").cast("string"), F.lit("]"), F.col("text"))
    return corpus.joined_within(table(spark, sf, "documents").select("lang", "doc_id", "text"), "lang", "doc_id", chunk, 6000, 6)


@query("""WITH a AS (SELECT l_partkey AS k, sha256(l_suppkey::VARCHAR) AS h, min(l_shipdate) AS f FROM lineitem GROUP BY 1, 2)
SELECT k AS l_partkey, h AS content_hash, f AS effective_from, lead(f) OVER w AS effective_to, CASE WHEN lead(f) OVER w IS NULL THEN 'current' ELSE 'superseded' END AS status
FROM a WINDOW w AS (PARTITION BY k ORDER BY f, h)""")
def version_chain(spark, sf):
    first = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.min("l_shipdate").alias("at"))  # aggregated before the windows
    first = first.repartition("l_partkey").withColumn("content_hash", F.sha2(F.col("l_suppkey").cast("string"), 256))  # hashed behind the last shuffle
    return corpus.chained(first, "l_partkey", "content_hash", "at")


@query("""WITH n AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders GROUP BY 1)
SELECT coalesce(n.c_custkey, c.c_custkey) AS c_custkey, c.c_name, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c FULL JOIN n ON n.c_custkey = c.c_custkey""")
def upsert_merge(spark, sf):
    old = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal")).withColumn("c_name", F.lit(None).cast("string"))
    return corpus.merge(old, new.select("c_custkey", "c_name", "c_acctbal"), ["c_custkey"], keep_if_null=("c_name",))


# --- lexical search ---

WORDS_SQL = "regexp_extract_all(lower(text), '[A-Za-zА-Яа-яІіЇїЄєҐґ0-9-]+')"
SIZE_SQL = "greatest(1, len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')))"
HITS_SQL = f"""SELECT doc_id, lang, source, text, {SIZE_SQL} AS size, len(list_filter(ws, lambda w: w = 'the')) AS h0, len(list_filter(ws, lambda w: starts_with(w, 'thing'))) AS h1, len(list_filter(ws, lambda w: w = 'tion')) AS h2
FROM (SELECT *, {WORDS_SQL} AS ws FROM documents)"""


@query(f"""WITH h AS ({HITS_SQL}) SELECT doc_id, round(h0 * 1000.0::DOUBLE / size + h1 * 1000.0::DOUBLE / size, 6) AS score FROM h WHERE h0 > 0 AND h1 > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def density_topk(spark, sf):
    rows = search.by_density(table(spark, sf, "documents"), "doc_id", "text", TOKENS[:2]).withColumn("score", F.round("score", 6))
    return search.top(rows, 20, F.desc("score"), F.col("doc_id"))


@query(f"""WITH h AS ({HITS_SQL}) SELECT doc_id, 'the' AS token, h0::BIGINT AS hits FROM h WHERE h0 > 0 UNION ALL SELECT doc_id, 'thingly', h1 FROM h WHERE h1 > 0 UNION ALL SELECT doc_id, 'tion', h2 FROM h WHERE h2 > 0""")
def token_hits(spark, sf):
    return search.token_hits(table(spark, sf, "documents"), "doc_id", "text", TOKENS)


@query(f"WITH h AS ({HITS_SQL}) SELECT doc_id, 3::BIGINT AS n_terms FROM h WHERE h0 > 0 AND h1 > 0 AND h2 > 0")
def prefix_and_search(spark, sf):
    return search.terms_search(table(spark, sf, "documents"), "doc_id", "text", TOKENS, every=True)


@query(f"WITH h AS ({HITS_SQL}) SELECT doc_id, ((h0 > 0)::INT + (h1 > 0)::INT)::BIGINT AS n_terms FROM h WHERE h0 > 0 OR h1 > 0")
def or_fallback_search(spark, sf):
    return search.and_or_search(table(spark, sf, "documents"), "doc_id", "text", [*TOKENS[:2], "zzzz"])


@query(f"""WITH w AS (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM w GROUP BY term ORDER BY df DESC, term LIMIT 200""")
def postings_df(spark, sf):
    return search.top(search.document_frequencies(table(spark, sf, "documents"), "doc_id", "text"), 200, F.desc("df"), F.col("term"))


POSTINGS_SQL = """WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents)
SELECT term, doc_id, 'body' AS field, count(*) AS tf FROM t GROUP BY term, doc_id"""


@query(POSTINGS_SQL)
def inverted_index(spark, sf):
    return search.postings(table(spark, sf, "documents"), "doc_id", body="text")


@query(POSTINGS_SQL)
def inverted_index_all(spark, sf):
    """The same, by its earlier name."""
    return inverted_index(spark, sf)


@query(POSTINGS_SQL + """ UNION ALL SELECT term, doc_id, 'heading' AS field, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(string_split(text, chr(10))[1]), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY term, doc_id""")
def inverted_index_fields(spark, sf):
    """The postings of two fields: the body, and the first line as a heading."""
    return search.postings(table(spark, sf, "documents").withColumn("heading", F.get(F.split("text", "\n"), 0)), "doc_id", body="text", heading="heading")


@query("""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS ws FROM documents),
c AS (SELECT doc_id, len(ws)::DOUBLE AS n, len(list_filter(ws, lambda w: w = 'the'))::DOUBLE AS a, len(list_filter(ws, lambda w: starts_with(w, 'thing')))::DOUBLE AS b FROM d),
s AS (SELECT count(*)::DOUBLE AS units, avg(n) AS mean, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id, round(greatest(1e-6, ln((units - da + 0.5) / (da + 0.5))) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * n / mean)) + greatest(1e-6, ln((units - db + 0.5) / (db + 0.5))) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * n / mean)), 4) AS score
FROM c, s WHERE a > 0 AND b > 0 ORDER BY score DESC, doc_id LIMIT 20""")
def bm25_topk(spark, sf):
    rows = search.bm25(table(spark, sf, "documents"), "doc_id", "text", TOKENS[:2]).withColumn("score", F.round("score", 4))
    return search.top(rows, 20, F.desc("score"), F.col("doc_id"))


@query("""WITH s AS (SELECT p_partkey, p_name, CASE WHEN p_partkey::VARCHAR = 'blue bolt' THEN 10000.0 WHEN contains(p_partkey::VARCHAR, 'blue bolt') THEN 5000.0
WHEN contains(lower(p_name), 'blue bolt') THEN 2000.0 + 9.0::DOUBLE / greatest(length(p_name), 1)
ELSE (contains(lower(p_name), 'blue') OR contains(p_partkey::VARCHAR, 'blue'))::INT + (contains(lower(p_name), 'bolt') OR contains(p_partkey::VARCHAR, 'bolt'))::INT END::DOUBLE AS score FROM part)
SELECT p_partkey, p_name, round(score, 6) AS score FROM s WHERE score > 0""")
def catalogue_rank(spark, sf):
    score = search.catalogue_score(F.col("p_partkey"), F.col("p_name"), "blue bolt")
    return table(spark, sf, "part").select("p_partkey", "p_name", F.round(score, 6).alias("score")).where("score > 0")


@query("""SELECT p_partkey, contains(p_partkey::VARCHAR, 'blue bolt') OR contains(lower(p_name), 'blue bolt') OR (contains(lower(p_name), 'blue') AND contains(lower(p_name), 'bolt')) AS is_confident FROM part""")
def confident_match(spark, sf):
    return table(spark, sf, "part").select("p_partkey", search.confident(F.col("p_partkey"), F.col("p_name"), "blue bolt").alias("is_confident"))


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents), e AS (SELECT doc_id, lines, unnest(range(0, len(lines))) AS i FROM l),
h AS (SELECT doc_id, lines, i, regexp_extract_all(lower(lines[i + 1]), '[A-Za-zА-Яа-яІіЇїЄєҐґ0-9-]+') AS ws, greatest(1, len(list_filter(regexp_split_to_array(lower(lines[i + 1]), '\\s+'), lambda w: w <> ''))) AS size FROM e),
c AS (SELECT *, len(list_filter(ws, lambda w: w = 'the')) AS a, len(list_filter(ws, lambda w: starts_with(w, 'thing'))) AS b FROM h)
SELECT doc_id, (i + 1)::BIGINT AS line_no, round(a * 1000.0::DOUBLE / size + b * 1000.0::DOUBLE / size, 6) AS score, array_to_string(lines[greatest(0, i - 3) + 1 : least(len(lines), i + 8)], chr(10)) AS window_text FROM c WHERE a > 0 AND b > 0""")
def line_context_window(spark, sf):
    return search.line_windows(table(spark, sf, "documents"), "doc_id", "text", TOKENS[:2]).withColumn("score", F.round("score", 6))


@query(f"""WITH h AS ({HITS_SQL}), k AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'article' WHEN lang = 'de' THEN 'line' ELSE 'alias_only' END AS kind, round(h0 * 1000.0::DOUBLE / size, 6) AS score FROM h WHERE h0 > 0)
SELECT doc_id, kind, score, row_number() OVER (ORDER BY (kind <> 'alias_only') DESC, score DESC, CASE kind WHEN 'article' THEN 2 WHEN 'line' THEN 1 ELSE 0 END DESC, doc_id) AS pos FROM k QUALIFY pos <= 100""")
def kind_tiebreak_order(spark, sf):
    from pyspark.sql import Window as W

    kind = F.when(F.col("lang") == "en", "article").when(F.col("lang") == "de", "line").otherwise("alias_only")
    rows = table(spark, sf, "documents").select("doc_id", kind.alias("kind"), F.round(T.density(F.col("text"), ["the"]), 6).alias("score"))
    order = [(F.col("kind") != "alias_only").desc(), F.desc("score"), F.when(F.col("kind") == "article", 2).when(F.col("kind") == "line", 1).otherwise(0).desc(), F.col("doc_id")]
    best = search.top(rows, 100, F.expr("score > 0").desc(), *order).where("score > 0")  # a filter before would score each text twice
    return best.withColumn("pos", F.row_number().over(W.orderBy(*order)).cast(LONG))  # numbers 100 rows


# --- vectors and fusion ---


def _query_vector(spark, sf):
    return [float(x) for x in table(spark, sf, "embeddings").where("vec_id = 7").first()["embedding"]]


def _cosine(spark, sf):
    vector = F.split(F.lit(" ".join(map(repr, _query_vector(spark, sf)))), " ").cast("array<double>")
    return table(spark, sf, "embeddings").select("vec_id", "label", F.round(search.cosine(F.col("embedding"), vector), 6).alias("score"))


COSINE_SQL = "SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 7)), 6) AS score FROM embeddings"


@query(f"SELECT vec_id, score FROM ({COSINE_SQL}) ORDER BY score DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf):
    return search.top(_cosine(spark, sf).select("vec_id", "score"), 10, F.desc("score"), F.col("vec_id"))


@query(f"SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM ({COSINE_SQL}) QUALIFY rn <= 3")
def vector_per_label_topk(spark, sf):
    from pyspark.sql import Window as W

    rn = F.row_number().over(W.partitionBy("label").orderBy(F.desc("score"), "vec_id")).cast(LONG)
    return _cosine(spark, sf).withColumn("rn", rn).where("rn <= 3").select("label", "vec_id", "score", "rn")


FUSED_SQL = f"""WITH h AS ({HITS_SQL}), f AS (SELECT doc_id, round(h0 * 1000.0::DOUBLE / size + h1 * 1000.0::DOUBLE / size, 6) AS score FROM h WHERE h0 > 0 AND h1 > 0),
c AS ({COSINE_SQL}),
r AS ((SELECT doc_id, 'fts' AS channel, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 40) UNION ALL (SELECT vec_id, 'vector', row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM c QUALIFY rank <= 40))
SELECT doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS rrf_score, array_to_string(list_sort(list(DISTINCT channel)), ',') AS matched_by FROM r GROUP BY doc_id ORDER BY rrf_score DESC, doc_id LIMIT 20"""


def _fused(spark, sf):
    lexical = search.by_density(table(spark, sf, "documents"), "doc_id", "text", TOKENS[:2]).withColumn("score", F.round("score", 6))
    vector = _cosine(spark, sf).select(F.col("vec_id").alias("doc_id"), "score")
    return search.fused([search.ranked(lexical, "doc_id", "fts", 40), search.ranked(vector, "doc_id", "vector", 40)], "doc_id", 20)


@query(FUSED_SQL)
def rrf_fusion(spark, sf):
    return _fused(spark, sf)


@query(f"SELECT matched_by, count(*) AS n FROM ({FUSED_SQL}) GROUP BY matched_by")
def rrf_matched_by(spark, sf):
    return _fused(spark, sf).groupBy("matched_by").agg(F.count(F.lit(1)).alias("n"))


# --- time ---


@query("""WITH d AS (SELECT DISTINCT o_custkey AS c, o_orderdate::DATE AS valid_from FROM orders)
SELECT c, valid_from, (lead(valid_from) OVER w - INTERVAL 1 DAY)::DATE AS valid_to, lead(valid_from) OVER w IS NULL AS is_current FROM d WINDOW w AS (PARTITION BY c ORDER BY valid_from)""")
def scd2_intervals(spark, sf):
    return temporal.intervals(table(spark, sf, "orders").withColumnRenamed("o_custkey", "c"), "c", "o_orderdate").select("c", "valid_from", "valid_to", "is_current")


@query("""WITH d AS (SELECT DISTINCT o_custkey AS c, o_orderdate::DATE AS d FROM orders), i AS (SELECT c, d, lead(d) OVER (PARTITION BY c ORDER BY d) AS nx, max(d) OVER (PARTITION BY c) AS last FROM d),
q AS (SELECT c_custkey, a AS as_of FROM customer, (SELECT unnest([DATE '1990-01-01', DATE '1994-03-15', DATE '1996-06-30', DATE '1999-12-31']) AS a)),
m AS (SELECT c, max(d) AS last FROM d GROUP BY c)
SELECT q.c_custkey, q.as_of, CASE WHEN m.c IS NULL THEN 'not_found' WHEN i.c IS NULL OR q.as_of > m.last THEN 'revision_unknown' ELSE 'ok' END AS status,
CASE WHEN q.as_of <= m.last THEN i.d END AS valid_from, CASE WHEN q.as_of <= m.last THEN (i.nx - INTERVAL 1 DAY)::DATE END AS valid_to, CASE WHEN q.as_of <= m.last AND i.nx IS NULL AND i.c IS NOT NULL THEN m.last END AS known_through
FROM q LEFT JOIN m ON m.c = q.c_custkey LEFT JOIN i ON i.c = q.c_custkey AND i.d <= q.as_of AND (i.nx IS NULL OR q.as_of < i.nx)""")
def asof_revision(spark, sf):
    days = F.array(*(F.lit(d).cast("date") for d in ("1990-01-01", "1994-03-15", "1996-06-30", "1999-12-31")))
    asked = table(spark, sf, "customer").select("c_custkey", F.explode(days).alias("as_of"))
    return temporal.as_of(asked, table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderdate")


@query("SELECT o_custkey AS c, max(o_orderdate::DATE) FILTER (o_orderdate::DATE <= DATE '1996-06-30') AS valid_from FROM orders GROUP BY 1")
def current_revision(spark, sf):
    return temporal.current(table(spark, sf, "orders").withColumnRenamed("o_custkey", "c"), "c", "o_orderdate", F.lit("1996-06-30").cast("date"))


NOW = "2024-03-01 00:00:00"


@query(f"""WITH m AS (SELECT user_id, max(ts) AS ts, max(event_id) % 3 * 15 AS ttl FROM events GROUP BY user_id), a AS (SELECT user_id, ttl, floor(date_diff('second', ts, TIMESTAMP '{NOW}') / 86400.0)::BIGINT AS age_days FROM m)
SELECT user_id, age_days, age_days < CASE WHEN ttl = 0 THEN 30 ELSE ttl END AS fresh FROM a""")
def freshness_flags(spark, sf):
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.max("ts").alias("ts"), (F.max("event_id") % 3 * 15).alias("ttl"))
    rows = rows.withColumn("age_days", ids.age_days(F.lit(NOW), F.col("ts")).cast(LONG))
    return rows.select("user_id", "age_days", temporal.fresh(F.col("age_days"), F.col("ttl")).alias("fresh"))


@query("""WITH h AS (SELECT doc_id, source, sha256(text) AS h FROM documents), l AS (SELECT doc_id, h, lag(h) OVER (PARTITION BY source ORDER BY doc_id) AS prev_hash FROM h)
SELECT doc_id, prev_hash, CASE WHEN prev_hash IS NULL THEN 'unknown' WHEN prev_hash = h THEN 'same' ELSE 'changed' END AS state FROM l""")
def text_change_state(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", ids.content_hash(F.col("text")).alias("h"))
    return temporal.change_state(rows, ["source"], "doc_id", "h").select("doc_id", "prev_hash", "state")


@query(f"""WITH u AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS seen, max(event_id) FILTER (event_type = 'error') AS err, max(event_id) FILTER (event_type = 'view') AS ok FROM events GROUP BY user_id),
s AS (SELECT user_id, seen IS NOT NULL AS has, coalesce(date_diff('second', seen, TIMESTAMP '{NOW}') < 86400 * 40, false) AS fresh, ok IS NOT NULL AND (err IS NULL OR ok > err) AS up FROM u)
SELECT user_id, CASE WHEN has AND fresh THEN 'cache' WHEN up THEN 'source' WHEN has THEN 'stale_cache' ELSE 'none' END AS served_from, has AND NOT fresh AND NOT up AS stale FROM s""")
def stale_fallback(spark, sf):
    view, error = F.col("event_type") == "view", F.col("event_type") == "error"
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.max(F.when(view, F.col("ts"))).alias("seen"), F.max(F.when(error, F.col("event_id"))).alias("err"), F.max(F.when(view, F.col("event_id"))).alias("ok"))
    young = F.coalesce(F.unix_timestamp(F.lit(NOW)) - F.unix_timestamp(F.col("seen").cast("timestamp")) < 86400 * 40, F.lit(False))
    fetched = F.when(F.col("ok").isNotNull() & (F.col("err").isNull() | (F.col("ok") > F.col("err"))), "new text")
    served = temporal.stale_while_error(F.when(F.col("seen").isNotNull(), "old text"), young, fetched)
    return rows.select("user_id", served.alias("s")).select("user_id", "s.served_from", "s.stale")


# --- gates and markup ---

STRIPPED_SQL = "trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"


def _stripped(html="html"):
    return T.squeeze(F.regexp_replace(html, "<[^>]+>", " "))


@query(f"SELECT page_id, length({STRIPPED_SQL}) AS n_chars FROM pages")
def strip_tags(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(_stripped()).cast(LONG).alias("n_chars"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, CASE WHEN starts_with(href, 'http') THEN 'absolute' WHEN starts_with(href, '#') THEN 'anchor' WHEN starts_with(href, '/') THEN 'rooted' ELSE 'relative' END AS link_kind, count(*) AS n FROM l GROUP BY ALL""")
def page_links(spark, sf):
    rows = table(spark, sf, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))
    kind = F.when(F.col("href").startswith("http"), "absolute").when(F.col("href").startswith("#"), "anchor").when(F.col("href").startswith("/"), "rooted").otherwise("relative")
    return rows.groupBy("page_id", kind.alias("link_kind")).agg(F.count(F.lit(1)).alias("n"))


@query()
def html_text_lengths(spark, sf):
    from versed.functions.python import flat, visible_text

    return flat(table(spark, sf, "pages"), ["page_id"], ["html"], "n_chars long", lambda html: [(len(visible_text(html)),)])


@query("""WITH t AS (SELECT doc_id, text, lower(text) AS low, regexp_split_to_array(text, '\\n') AS ls FROM documents),
c AS (SELECT doc_id, text, low, len(list_filter(ls, lambda x: length(trim(x)) > 200)) AS prose, len(list_filter(ls, lambda x: trim(x) <> '')) AS full_, len(list_filter(ls, lambda x: regexp_matches(trim(x), '^(?:[0-9]{1,3}[.)]|[-—•*])\\s+\\S'))) AS listed FROM t)
SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN contains(low, 'captcha') OR contains(low, 'just a moment') THEN 'antibot_challenge' WHEN contains(low, 'access denied') THEN 'access_denied'
WHEN contains(low, '404 not found') THEN 'error_page' WHEN contains(low, 'table of contents') AND prose = 0 THEN 'table_of_contents' WHEN full_ >= 8 AND listed >= 8 AND listed / full_ >= 0.7 AND prose = 0 THEN 'table_of_contents'
WHEN length(trim(text, ' ' || chr(10))) < 500 THEN 'too_short' ELSE 'none' END AS kind FROM c""")
def stub_verdict(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.stub_kind(F.col("text")).alias("kind"))


@query("""SELECT doc_id, reason = '' AS store, reason FROM (SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty text' WHEN source = 'src3' AND doc_id % 2 = 0 THEN 'bylaw not pinned' WHEN trim(string_split(text, chr(10))[1]) = '' THEN 'no real title'
WHEN len(string_split(text, chr(10))) < 2 THEN 'no units' ELSE '' END AS reason FROM documents)""")
def persistence_verdict(spark, sf):
    lines = F.split("text", "\n")
    verdict = corpus.persistence(F.col("text"), F.when(F.col("source") == "src3", "bylaw").otherwise("law"), F.col("doc_id") % 2 != 0, F.get(lines, 0), F.when(F.size(lines) < 2, 0).otherwise(F.size(lines)))
    return table(spark, sf, "documents").select("doc_id", verdict.alias("v")).select("doc_id", "v.store", "v.reason")


@query("SELECT page_id, contains(html, page_id::VARCHAR) OR contains(lower(html), 'license') OR contains(lower(html), 'article') AS is_it FROM pages")
def identity_gate(spark, sf):
    return table(spark, sf, "pages").select("page_id", corpus.identity(F.col("html"), F.col("page_id").cast("string"), ("license", "article")).alias("is_it"))


@query("SELECT doc_id, CASE WHEN source = 'src1' THEN 'law' WHEN source = 'src2' THEN 'code' WHEN source = 'src3' THEN 'constitution' WHEN source = 'src4' THEN 'bylaw' ELSE 'unknown' END AS kind FROM documents")
def doc_kind(spark, sf):
    code = F.when(F.col("source") == "src1", "1").when(F.col("source") == "src2", "21").when(F.col("source") == "src3", "216").when(F.col("source") == "src4", "7")
    return table(spark, sf, "documents").select("doc_id", T.document_kind(F.col("text"), F.col("doc_id").cast("string"), code).alias("kind"))


# --- quotes ---


def _pairs(spark, sf, rules):
    """benchmark x documents that hold the item, all found in one pass over the documents."""
    from versed.functions.python import plain

    items, docs = table(spark, sf, "benchmark").select("item_id", "text"), table(spark, sf, "documents").select("doc_id", "text")
    found = patterns.matches(docs, "doc_id", "text", items, "item_id", "text", (lambda x: plain(x, rules)) if rules else None)
    return found.select(F.col("name").alias("item_id"), "doc_id", "position")


@query("SELECT b.item_id, d.doc_id, 'exact' AS status, instr(d.text, b.text) AS position FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def quote_exact(spark, sf):
    return _pairs(spark, sf, None).select("item_id", "doc_id", F.lit("exact").alias("status"), "position")


@query("""WITH b AS (SELECT item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS q FROM benchmark), d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT item_id, doc_id, 'normalized' AS status, instr(t, q) AS position FROM b JOIN d ON contains(t, q)""")
def quote_normalized(spark, sf):
    return _pairs(spark, sf, ("whitespace",)).select("item_id", "doc_id", F.lit("normalized").alias("status"), "position")


@query()
def quote_nearest(spark, sf):
    """Benchmark items in all documents that have a quarter of them in one block: status, and the quote's place or that of the window nearest to it."""
    items, docs = table(spark, sf, "benchmark").select("item_id", "text"), table(spark, sf, "documents").select("doc_id", "text")
    return patterns.near_quotes(docs, "doc_id", "text", items, "item_id", "text").select(F.col("name").alias("item_id"), "doc_id", "status", "start", "len", "block")


# --- identifiers ---


@query("""SELECT conv_id, turn, 'ev-' || substr(sha256(conv_id::VARCHAR || '|ua|' || turn::VARCHAR || '||' || role || '|' || sha256(text) || '|'), 1, 24) AS evidence_id FROM conversations""")
def evidence_id(spark, sf):
    found = ids.evidence_id(F.col("conv_id"), F.lit("ua"), F.col("turn"), F.lit(None), F.col("role"), ids.content_hash(F.col("text")), F.lit(None))
    return table(spark, sf, "conversations").select("conv_id", "turn", found.alias("evidence_id"))


@query("SELECT doc_id, upper('ua') || '|' || doc_id || '|' || source || '||' || lower(lang) AS source_key FROM documents")
def source_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.source_key(F.lit("ua"), F.col("doc_id"), F.col("source"), F.lit(None), F.upper("lang")).alias("source_key"))
