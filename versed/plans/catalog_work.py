"""Queries over the driver's tables, each beside the SQL that must give the same rows: names in texts, addressed units, oversize units, backfill, sessions, near vectors, landed payloads, one-line rules."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from versed.functions import ids
from versed.operators import backfill, corpus, patterns, resolve, vectors
from versed.plans.registry import query
from versed.plans.session import workspace
from versed.sources import documents
from versed.sources.tables import table
from versed.streaming import evidence

LONG = "long"


# --- many names at once, addressed units ---


@query("""WITH names AS (SELECT item_id, lower(w) AS name FROM (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]{4,}')) AS w FROM benchmark)),
n AS (SELECT name, min(item_id) AS first_item FROM names GROUP BY name)
SELECT name, first_item, doc_id, instr(lower(text), name) AS position FROM n JOIN documents ON contains(lower(text), name)""")
def names_in_documents(spark, sf):
    """Every word of four letters or more of the benchmark, as a name, in all documents."""
    words = table(spark, sf, "benchmark").select("item_id", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{4,}"), F.lit(0))).alias("w"))
    names = words.groupBy(F.lower("w").alias("name")).agg(F.min("item_id").alias("first_item"))
    docs = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("low"))
    found = patterns.matches(docs, "doc_id", "low", names.withColumn("of", F.col("name")), "of", "name").withColumnRenamed("name", "of")
    return found.join(names, F.col("of") == F.col("name")).select("name", "first_item", "doc_id", "position")


UNIT_KEY = "l_linenumber || CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '-1' ELSE '.2' END"


@query(f"""WITH u AS (SELECT DISTINCT l_partkey AS law, {UNIT_KEY} AS key, l_orderkey AS ordinal FROM lineitem),
r AS (SELECT p_partkey, (p_size % 7 + 1)::VARCHAR AS asked FROM part)
SELECT p_partkey, asked, key, ordinal FROM r LEFT JOIN u ON law = p_partkey AND (key = asked OR starts_with(key, asked || '-') OR starts_with(key, asked || '.'))
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY key IS NULL, key <> asked, ordinal, key) = 1""")
def addressed_units(spark, sf):
    """Each part asks its lines for one by number: that line, else the first that goes on with a hyphen or a dot."""
    tail = F.element_at(F.array(F.lit(""), F.lit("-1"), F.lit(".2")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    units = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("law"), F.concat(F.col("l_linenumber").cast("string"), tail).alias("key"), F.col("l_orderkey").alias("ordinal")).distinct()
    requests = table(spark, sf, "part").select("p_partkey", F.concat(F.lit(" "), (F.col("p_size") % 7 + 1).cast("string")).alias("asked"))
    out = corpus.fuzzy_units(requests.withColumn("law", F.col("p_partkey")), units, "law", "asked", "key", "ordinal")
    return out.select("p_partkey", F.trim("asked").alias("asked"), "unit.key", "unit.ordinal")


# --- one step over several tables, backfill, sessions ---


@query("""SELECT 'unit' AS kind, doc_id || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS name, CASE WHEN size <= 12000 THEN doc_id END AS unit, CASE WHEN size > 12000 THEN least(3000, size - (k - 1) * 3000) ELSE size END AS n
FROM (SELECT doc_id, length(text) AS size, unnest(range(1, CASE WHEN length(text) > 12000 THEN ceil(length(text) / 3000.0)::BIGINT ELSE 1 END + 1)) AS k FROM documents)
UNION ALL SELECT 'vector', vec_id::VARCHAR, vec_id, len(embedding) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents WHERE length(text) > 12000)""")
def oversize_replaced(spark, sf):
    """Units and vectors after pieces have replaced the long units and the vectors of those are gone, both read from one step."""
    units = table(spark, sf, "documents").select(F.col("doc_id").alias("unit"), F.col("doc_id").cast("string").alias("key"), "text")
    vecs = table(spark, sf, "embeddings").select(F.col("vec_id").alias("unit"), "embedding")
    new_units, new_vectors = corpus.replace_oversize(units, vecs, "unit", "key", "text")
    folder = f"{workspace(spark)}/corpus-{uuid.uuid4().hex}"
    documents.replace_tables({"units": new_units, "vectors": new_vectors}, folder)
    tables = documents.read_tables(spark, folder)
    rows = tables["units"].select(F.lit("unit").alias("kind"), F.col("key").alias("name"), "unit", F.length("text").cast(LONG).alias("n"))
    return rows.union(tables["vectors"].select(F.lit("vector").alias("kind"), F.col("unit").cast("string").alias("name"), "unit", F.size("embedding").cast(LONG).alias("n")))


@query("""SELECT doc_id, length(substr(text, 1, 6000)) AS n_chars, length(substr(text, 1, 6000)) - length(replace(substr(text, 1, 6000), 'e', '')) AS n_e FROM documents d
WHERE trim(text) <> '' AND NOT EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id)""")
def backfilled_vectors(spark, sf):
    """Vectors (length and a letter's count stand for a model) of all documents that have none, filled in by batches into a table of their own."""
    docs = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")
    path = f"{workspace(spark)}/vectors-{uuid.uuid4().hex}"
    backfill.vectors(docs, "doc_id", "text", path, lambda texts: [[len(t), t.count("e")] for t in texts], "counts", rows_of_a_wave=1 << 20)
    got = backfill.stored(spark, path)
    return got.select(F.col("key").alias("doc_id"), F.get("vector", 0).cast(LONG).alias("n_chars"), F.get("vector", 1).cast(LONG).alias("n_e"))


#: Quotas of the query below, small enough to be met.
FEW = evidence.Limits(entries=12, chars=20_000, agent=5, ttl=2 * 3600)


@query()
def session_evidence(spark, sf):
    """Every event as a text read in its user's session by the agent of its type, decided under quotas and forgetting."""
    events = table(spark, sf, "events")
    rows = evidence.prepared(events, "user_id", "ts", "event_id", F.get_json_object("props", "$.k"), F.col("value") * 100, F.col("event_type"))
    return evidence.decided(rows, FEW).select(F.col("session").cast(LONG).alias("user_id"), F.col("id").cast(LONG).alias("event_id"), "status", "n", "chars")


@query()
def nearest_by_cells(spark, sf):
    """The ten nearest of all vectors for every query vector (vec_id divisible by 100), from an inverted file."""
    rows, path = table(spark, sf, "embeddings"), f"{workspace(spark)}/cells-{uuid.uuid4().hex}"
    vectors.build(rows, "vec_id", "embedding", path)
    return vectors.nearest(rows.where("vec_id % 100 = 0"), "vec_id", "embedding", path, 10).select(F.col("query").alias("query_id"), F.col("key").alias("vec_id"), "score")


# --- landed payloads, made from the tables ---


@query("""SELECT o_custkey, 'nr-' || o_orderkey AS law_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE o_orderstatus END AS title, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE::VARCHAR ELSE 'organ ' || o_orderstatus END AS changed FROM orders""")
def change_entries(spark, sf):
    """Orders as each customer's feed of changes, an object with a list or a bare list, and back as rows."""
    k = F.col("o_orderkey")
    item = F.struct(
        F.when(k % 5 != 0, F.concat(F.lit("nr-"), k.cast("string"))).otherwise(F.lit(" ")).alias("nreg"), F.concat(F.lit("nr-"), k.cast("string")).alias("id"),
        F.when(k % 3 == 0, F.col("o_orderpriority")).alias("nazva"), F.col("o_orderstatus").alias("title"),
        F.when(k % 2 == 0, F.col("o_orderdate").cast("date").cast("string")).otherwise(F.lit("")).alias("datred"), F.concat(F.lit("organ "), F.col("o_orderstatus")).alias("organs"),
    )
    lists = table(spark, sf, "orders").groupBy("o_custkey", (k % 16).alias("page")).agg(F.collect_list(item).alias("list"))
    payload = F.when(F.col("o_custkey") % 2 == 0, F.to_json(F.struct(F.lit("9").alias("cnt"), "list"))).otherwise(F.to_json("list"))
    return documents.change_rows(lists.select("o_custkey", payload.alias("payload")), "payload", "o_custkey").select("o_custkey", "law_id", "title", "changed")


@query("""SELECT 'UA-' || o_orderkey AS tender_id, o_orderpriority AS title, CASE WHEN o_orderkey % 7 = 0 THEN 'not_found' ELSE o_orderstatus END AS status, round(o_totalprice, 2) AS amount, 'UAH' AS currency, 'buyer ' || o_custkey AS buyer, o_orderkey % 3 AS n_awards FROM orders""")
def tender_rows(spark, sf):
    """Orders as documents of a tender register, and back as compact rows."""
    k = F.col("o_orderkey")
    awards = F.slice(F.array(*(F.struct(F.lit(str(i)).alias("id"), F.lit("active").alias("status")) for i in range(2))), F.lit(1), (k % 3).cast("int"))
    data = F.struct(
        F.when(k % 4 != 0, F.concat(F.lit("UA-"), k.cast("string"))).alias("tenderID"), F.concat(F.lit("UA-"), k.cast("string")).alias("id"), F.col("o_orderpriority").alias("title"), F.when(k % 7 != 0, F.col("o_orderstatus")).alias("status"),
        F.struct(F.round("o_totalprice", 2).alias("amount"), F.lit("UAH").alias("currency")).alias("value"), F.struct(F.concat(F.lit("buyer "), F.col("o_custkey").cast("string")).alias("name")).alias("procuringEntity"), awards.alias("awards"),
    )
    rows = documents.tenders(table(spark, sf, "orders").select(F.to_json(F.struct(data.alias("data"))).alias("payload")), "payload")
    return rows.select("tender_id", "title", "status", "amount", "currency", "buyer", F.col("n_awards").cast(LONG).alias("n_awards"))


@query("""SELECT 'set-' || p_partkey AS dataset_id, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'CSV,XML' ELSE 'CSV' END AS formats, p_brand AS publisher FROM part""")
def dataset_rows(spark, sf):
    """Parts as results of an open-data catalogue, in each of the envelopes that occur, and back as normal rows."""
    k = F.col("p_partkey")
    formats = F.when(F.col("p_size") % 2 == 0, F.array(*map(F.lit, ("xml", " csv", "XML", "")))).otherwise(F.array(*map(F.lit, ("Csv", "csv", "", " "))))
    item = F.struct(F.concat(F.lit("set-"), k.cast("string")).alias("id"), F.when(k % 2 == 0, F.concat(F.lit("set-"), k.cast("string"))).alias("name"), F.col("p_name").alias("title"), F.struct(F.col("p_brand").alias("title")).alias("organization"), F.transform(formats, lambda f: F.struct(f.alias("format"))).alias("resources"))
    one = F.array(item)
    payload = F.coalesce(*(F.when(k % 5 == n, F.to_json(F.struct(one.alias(name)))) for n, name in enumerate(("results", "items", "data", "list"))), F.to_json(one))
    return documents.datasets(table(spark, sf, "part").select(payload.alias("payload")), "payload").select("dataset_id", "title", F.array_join("formats", ",").alias("formats"), "publisher")


@query("""SELECT page_id, i AS seq, (page_id * 10 + CASE i WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 5 END)::VARCHAR AS id, CASE i WHEN 1 THEN 'first ' || length(url) WHEN 2 THEN 'second row' ELSE 'last' END AS snippet FROM pages, (VALUES (1), (2), (3)) t(i)""")
def result_page_rows(spark, sf):
    """Result pages of a register made from the pages' addresses: rows, a repeated one and one without a link, and back as hits."""
    def row(n, text):
        return F.concat(F.lit("<tr><td>"), text, F.lit('</td> <a href="/Review/'), (F.col("page_id") * 10 + n).cast("string"), F.lit('">x</a></TR>'))

    def marked(text):
        return F.concat(F.lit("<b>"), text, F.lit("</b> "))

    html = F.concat(F.lit("<table>"), row(1, marked(F.concat(F.lit("first "), F.length("url").cast("string")))), row(2, F.lit(" second   row ")), F.lit("<TR><td>no link</td></TR>"), row(1, F.lit("again")), row(5, F.lit("last")), F.lit("</table>"))
    rows = documents.result_rows(table(spark, sf, "pages").select("page_id", F.regexp_replace(html, ">x</a>", "></a>").alias("html")), "page_id", "html")
    snippet = F.trim(F.regexp_replace("snippet", r"^> *", ""))
    return rows.select("page_id", F.col("seq").cast(LONG).alias("seq"), "id", snippet.alias("snippet"))


@query("""SELECT o_orderkey, 'art-' || (o_orderkey % 50) AS document, CASE o_orderkey % 3 WHEN 0 THEN '5(1)' WHEN 1 THEN '12' ELSE '7a' END AS subdivision, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE::VARCHAR END AS day, '0' || (o_orderkey % 9 + 1) || '-2001' AS slash,
CASE o_orderkey % 4 WHEN 0 THEN 'ecli' WHEN 1 THEN 'itemid' WHEN 2 THEN 'appno' END AS kind, (o_orderkey % 100) || '/01,' || (o_custkey % 100) || '/02' AS numbers, '2001-02-0' || (o_orderkey % 9 + 1) AS bracketed, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 1000) || '-15' END AS official, o_orderkey % 2 = 0 AS is_official,
'Court ' || (o_custkey % 7) AS court, CASE WHEN o_custkey % 2 = 0 THEN 'State' END AS state, o_orderkey % 3 = 0 AS allowed, 'https://x.test/a?b=' || o_custkey AS address FROM orders""")
def more_small_rules(spark, sf):
    """One-line rules on values made from orders: document ids, subdivisions, dates, kinds and numbers of applications, official ids, courts, addresses."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def nth(x, n, *values):
        return F.element_at(F.array(*(F.lit(v) if isinstance(v, (str, type(None))) else v for v in values)), (x % n + 1).cast("int"))

    def text(x):
        return x.cast("string")

    day = F.col("o_orderdate").cast("date").cast("string")
    court, state = resolve.court_and_state(F.concat(F.lit("Court "), text(c % 7), nth(c, 2, " - State", "")))
    slash = F.substring(ids.slash_date(F.concat(F.lit(" 03/0"), text(k % 9 + 1), F.lit("/2001 "))), 1, 7)
    return table(spark, sf, "orders").select(
        "o_orderkey", ids.document_id(F.concat(F.lit("/ART-"), text(k % 50), F.lit("/"))).alias("document"), ids.subdivision(nth(k, 3, "Article 5 (1)", "ст. 12.", "п. 7A")).alias("subdivision"),
        ids.iso_date(nth(k, 2, F.concat(day, F.lit("T10:00:00")), "someday")).cast("string").alias("day"), F.concat(F.substring(slash, 6, 2), F.lit("-"), F.substring(slash, 1, 4)).alias("slash"),
        ids.identifier_kind(nth(k, 4, "ecli:EU:C:2020:1", "001-123", "12345/06", "other")).alias("kind"), F.array_join(ids.application_numbers(F.concat(text(k % 100), F.lit("/01+; "), text(c % 100), F.lit("/02"))), ",").alias("numbers"),
        ids.bracketed_date(F.concat(F.lit("x:2001020"), text(k % 9 + 1), F.lit(":y"))).alias("bracketed"),
        resolve.official_from_url(F.concat(nth(k, 2, "https://zakon.rada.gov.ua/laws/show/", "https://example.org/laws/show/"), text(k % 1000), F.lit("-15?x=1"))).alias("official"),
        resolve.is_official(F.concat(text(k % 1000), nth(k, 2, "-15", " 15"))).alias("is_official"), court.alias("court"), state.alias("state"),
        resolve.allowed_url(nth(k, 3, "https://a.test/x", "http://a.test/x", "https://127.0.0.1/x"), ("a.test", "127.0.0.1")).alias("allowed"),
        resolve.without_session(F.concat(F.lit("https://x.test/a;jsessionid=1?b="), text(c), F.lit("&cid=5"))).alias("address"),
    )
