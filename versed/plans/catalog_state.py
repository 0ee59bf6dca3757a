"""Queries over the driver's tables, each beside the SQL that must give the same rows: states of catalogues, verified answers, candidates in a store, search pages, marked-up identifiers, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from versed.functions import ids, markup
from versed.operators import corpus, graph, reading, records, resolve, temporal
from versed.plans.registry import query
from versed.sources import documents
from versed.sources.tables import table

LONG = "long"


def nth(x, n, *values):
    return F.element_at(F.array(*(F.lit(v) if isinstance(v, (str, type(None))) else v for v in values)), (x % n + 1).cast("int"))


@query("""SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 2 ELSE 100 + page_id END AS found, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'u' || '00000000-0000-0000-0000-000000000000' END AS token, 'text: x' AS params_echo, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 12 END AS pages,
'254к/96-вр|Act ' || page_id || '|in force;n' || page_id || '|Second|' AS items FROM pages""")
def search_result_pages(spark, sf):
    """Search-result pages made from the pages' ids: the count, the list's token, the echo of parameters, page numbers and two of three items."""
    k = F.col("page_id")
    n = k.cast("string")
    token = "/laws/main/u00000000-0000-0000-0000-000000000000"
    head = F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("<a>Знайдено</a> <strong>"), (k + 100).cast("string"), F.lit("</strong>")))
    pages = F.when(k % 3 == 0, "").otherwise(f'<a href="{token}/page2">2</a><a href="{token}/page12">12</a>')
    items = F.concat(
        F.lit('<li> <div class="doc"><a href="/laws/show/254%D0%BA/96-%D0%B2%D1%80/sp:x" class="q" alt=" in force ">Act <b>'), n, F.lit("</b></a></div></li>"), F.lit('<li><div class="doc"><a href="/laws/show/n'), n,
        F.lit('" alt="">Second</a></div></li><li><div class="doc"><a href="/laws/show/third" alt="x">T</a></div></li>'),
    )
    html = F.concat(head, F.lit('<span class="find_params">text: <i>x</i></span>'), pages, items)
    out = documents.search_pages(table(spark, sf, "pages").select("page_id", html.alias("html")), "page_id", "html", 2)
    joined = F.array_join(F.transform("items", lambda i: F.concat_ws("|", i["law_id"], i["title"], i["status"])), ";")
    return out.select("page_id", "found", "token", "params_echo", F.col("pages").cast(LONG).alias("pages"), joined.alias("items"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'art_5' WHEN 1 THEN 'art6' WHEN 2 THEN 'para_7' WHEN 3 THEN 'para8' WHEN 4 THEN 'chp_9' END AS eid, CASE WHEN page_id % 6 < 5 THEN 'Text ' || (page_id % 6) || ' of ' || page_id END AS text, CASE WHEN page_id % 6 < 5 THEN 'ok' ELSE 'path_not_found' END AS status FROM pages""")
def units_by_eid(spark, sf):
    """Units of Akoma Ntoso documents by each spelling of their identifier; an empty element and an absent one aren't found."""
    k = F.col("page_id")
    body = F.concat(*(x for i, name in enumerate(("art_5", "art6", "para_7", "para8", "chp_9")) for x in (F.lit(f"<section eId='{name}'> Text <b>{i}</b>\n of "), k.cast("string"), F.lit("</section>"))))
    pages = table(spark, sf, "pages").select("page_id", F.concat(F.lit("<akomaNtoso><body>"), body, F.lit("<p eId='art_10'> </p><p eId='art_5'>later</p></body></akomaNtoso>")).alias("xml"))
    asked = table(spark, sf, "pages").select("page_id", nth(k, 6, " 5", "6", "7 ", "8", "chp_9", F.when(k % 4 < 2, "10").otherwise("11")).alias("path"))
    return markup.akn_find(markup.akn_table(pages, "page_id", "xml"), "page_id", asked, "path").select("page_id", "eid", "text", "status")


@query("""WITH a AS (SELECT o_orderkey, o_custkey % 400 + 1 AS n, o_custkey % 90 + 10 AS y, o_orderkey % 2 AS court FROM orders),
c AS (SELECT o_orderkey, unnest(CASE court WHEN 0 THEN ['6' || (CASE WHEN y >= 53 THEN 1900 ELSE 2000 END + y) || 'CJ' || lpad(n::VARCHAR, 4, '0'), '6' || (CASE WHEN y >= 53 THEN 1900 ELSE 2000 END + y) || 'CO' || lpad(n::VARCHAR, 4, '0'), '6' || (CASE WHEN y >= 53 THEN 1900 ELSE 2000 END + y) || 'CC' || lpad(n::VARCHAR, 4, '0')]
 ELSE ['6' || (CASE WHEN y >= 53 THEN 1900 ELSE 2000 END + y) || 'TJ' || lpad(n::VARCHAR, 4, '0'), '6' || (CASE WHEN y >= 53 THEN 1900 ELSE 2000 END + y) || 'TO' || lpad(n::VARCHAR, 4, '0')] END) AS x FROM a),
s AS (SELECT '6' || (CASE WHEN c_custkey % 90 + 10 >= 53 THEN 1900 ELSE 2000 END + c_custkey % 90 + 10) || 'C' || CASE WHEN c_custkey % 2 = 0 THEN 'J' ELSE 'O' END || lpad((c_custkey % 400 + 1)::VARCHAR, 4, '0') AS ident, min(c_custkey) AS first_cust FROM customer GROUP BY 1),
m AS (SELECT o_orderkey, ident, first_cust FROM c JOIN s ON x = ident)
SELECT a.o_orderkey, ident, first_cust FROM a LEFT JOIN m USING (o_orderkey)""")
def cases_in_store(spark, sf):
    """Case numbers of orders as candidate identifiers, and those of them that a store made from customers has."""
    def year(x):
        return F.lpad((x % 90 + 10).cast("string"), 2, "0")

    c = F.col("c_custkey")
    century = F.when(c % 90 + 10 >= 53, F.lit("19")).otherwise(F.lit("20"))
    ident = F.concat(F.lit("6"), century, year(c), F.lit("C"), F.when(c % 2 == 0, "J").otherwise("O"), F.lpad((c % 400 + 1).cast("string"), 4, "0"))
    store = table(spark, sf, "customer").groupBy(ident.alias("ident")).agg(F.min("c_custkey").alias("first_cust"))
    number = F.concat(F.when(F.col("o_orderkey") % 2 == 0, "C-").otherwise("T-"), (F.col("o_custkey") % 400 + 1).cast("string"), F.lit("/"), year(F.col("o_custkey")))
    asked = table(spark, sf, "orders").select("o_orderkey", number.alias("number"))
    return graph.existing(asked, ids.case_candidates(F.col("number")), store, "ident").select("o_orderkey", "ident", "first_cust")


@query("""SELECT o_orderkey AS request, CASE WHEN o_orderkey % 4 = 3 THEN 'unverified' WHEN o_custkey % 2 = 0 THEN 'ok' ELSE 'unverified' END AS status FROM orders""")
def verified_answers(spark, sf):
    """Requests by application number, ECLI, item id or another text: ok only where a hit carries what was asked for."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    n = F.lpad((k % 10_000).cast("string"), 5, "1")
    ecli, item, appno = F.concat(F.lit("ECLI:X:"), n), F.concat(F.lit("001-"), n), F.concat(n, F.lit("/06"))
    orders = table(spark, sf, "orders")
    asked = orders.select(k.alias("request"), nth(k, 4, appno, F.concat(F.lit(" "), F.lower(ecli)), item, "something").alias("ident"))
    right = orders.where(c % 2 == 0).select(k.alias("request"), F.concat(F.lit("1/01;"), appno).alias("appno"), ecli.alias("ecli"), item.alias("itemid"))
    wrong = orders.select(k.alias("request"), F.lit("9/09").alias("appno"), F.lit(None).cast("string").alias("ecli"), F.lit("001-9").alias("itemid"))
    return reading.verified(asked, "request", "ident", right.union(wrong), "appno", "ecli", "itemid").select("request", "status")


@query("""WITH t AS (SELECT l_partkey, max(l_shipdate)::DATE AS day FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1)
SELECT p_partkey, p_brand AS category, CASE WHEN day IS NULL THEN 'absent' WHEN date_diff('day', day, DATE '1998-10-01') < 30 THEN 'fresh' ELSE 'stale' END AS cache_status FROM part LEFT JOIN t ON l_partkey = p_partkey WHERE p_brand = (SELECT min(p_brand) FROM part)""")
def catalogue_by_category(spark, sf):
    """The parts of the first brand as a category of a catalogue, with the state of their cached text."""
    parts = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("category"))
    first = parts.agg(F.min("category")).first()[0]
    cached = table(spark, sf, "lineitem").where("l_partkey % 3 <> 0").select(F.col("l_partkey").alias("p_partkey"), F.col("l_shipdate").cast("date").cast("timestamp").alias("at"))
    return reading.catalogue(parts, "p_partkey", first, cached, "at", F.lit("1998-10-01 00:00:00"), 30).select("p_partkey", "category", "cache_status")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0 THEN 'cache' WHEN o_custkey % 2 = 0 THEN 'live' WHEN o_orderkey % 4 <> 0 THEN 'stale' ELSE 'unavailable' END AS state, NOT (NOT (o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0) AND o_custkey % 2 = 0) AS from_cache,
CASE WHEN NOT (o_orderkey % 3 = 0) AND o_custkey % 2 <> 0 AND o_orderkey % 4 <> 0 THEN o_orderdate::DATE::VARCHAR END AS stale_since FROM orders""")
def catalogue_states(spark, sf):
    k = F.col("o_orderkey")
    at = F.when(k % 4 != 0, F.col("o_orderdate").cast("date").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", temporal.catalogue_state(k % 3 == 0, F.col("o_custkey") % 2 == 0, at).alias("s")).select("o_orderkey", "s.state", "s.from_cache", "s.stale_since")


@query("""SELECT s_suppkey, 'requires_human' AS status, 'captcha' AS reason FROM supplier""")
def debtor_requests(spark, sf):
    """Requests to a register that only a person may ask."""
    return reading.refused(table(spark, sf, "supplier"), "s_suppkey", "captcha")


@query("""SELECT l_orderkey, count(*) FILTER (l_linenumber <= 2) AS n_expected FROM lineitem GROUP BY l_orderkey""")
def expected_pieces(spark, sf):
    """How many lines of an order are the unit that was expected, or pieces of it."""
    n = F.col("l_linenumber")
    number = F.when(n == 1, "5").when(n == 2, "5#2").when(n == 3, "52#1").otherwise(F.concat(F.lit("5-"), n.cast("string")))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count_if(records.is_expected(number, F.lit("5"))).alias("n_expected"))


@query("""SELECT vec_id, CASE WHEN vec_id % 3 = 1 THEN 'new' ELSE 'old' END AS model, CASE WHEN vec_id % 3 = 1 THEN 1 ELSE len(embedding) END AS n FROM embeddings""")
def vectors_merged(spark, sf):
    """Vectors after an upsert in which a third is new and a third empty or null."""
    old = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.lit("old").alias("model"))
    k = F.col("vec_id")
    new = table(spark, sf, "embeddings").where(k % 3 > 0).select("vec_id", F.when(k % 3 == 1, F.array(F.lit(1.0))).when(k % 2 == 0, F.array().cast("array<double>")).alias("v"), F.lit("new").alias("model"))
    return corpus.merge_vectors(old, new, "vec_id", "v").select("vec_id", "model", F.size("v").cast(LONG).alias("n"))


@query("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'html_url' WHEN 1 THEN 'pdf_url' WHEN 2 THEN 'eurlex_url' WHEN 3 THEN 'external_url' END AS kind FROM orders""")
def link_kinds(spark, sf):
    """Links of a row told apart by their address."""
    href = F.concat(nth(F.col("o_orderkey"), 5, "/juris/document/document.jsf?docid=", "/juris/showPdf.jsf?docid=", "https://eur-lex.europa.eu/", "http://x.test/", "#"), F.col("o_custkey").cast("string"))
    return table(spark, sf, "orders").select("o_orderkey", resolve.link_kind(href).alias("kind"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber * 10000000 + l_partkey AS seq, (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + (CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 0 END) AS n FROM lineitem)
SELECT l_orderkey, seq, first_seq FROM (SELECT *, min(seq) OVER (PARTITION BY l_orderkey) AS first_seq FROM r) QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, seq) = 1""")
def richest_lines(spark, sf):
    """The line of each order with most of two values, the first (by number and part) on a tie, at the place of the order's first line."""
    seq = F.col("l_linenumber").cast(LONG) * 10_000_000 + F.col("l_partkey")
    rows = table(spark, sf, "lineitem").select("l_orderkey", seq.alias("seq"), F.when(F.col("l_returnflag") == "R", "R").alias("a"), F.when(F.col("l_suppkey") % 2 == 0, "b").otherwise("").alias("b"))
    return records.richest(rows, ["l_orderkey"], ["a", "b"], "seq").select("l_orderkey", "seq", "first_seq")
