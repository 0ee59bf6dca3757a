"""Queries over the driver's tables, each beside the SQL that must give the same rows: sections and points of texts, units and texts of marked-up pages, filters of decisions, languages, redirects, more one-line rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from versed.functions import markup
from versed.functions import text as T
from versed.functions.python import flat, parse_sections, sequential, visible_text
from versed.operators import evidence, graph, resolve
from versed.plans.registry import query
from versed.sources import documents
from versed.sources.tables import table

LONG = "long"

# --- sections and points of texts ---


@query("""SELECT doc_id, i::VARCHAR AS num, i AS ordinal, 'Стаття ' || i || '. ' || ls[i] || '.' AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE len(ls) > 1""")
def sections_of_documents(spark, sf):
    """The lines of all documents with headers of articles before them, and back as sections; one alone is no article."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("Стаття "), (i + 1).cast("string"), F.lit(". "), x, F.lit(".")))
    docs = table(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n").alias("act"))
    return flat(docs, ["doc_id"], ["act"], "num string, ordinal long, body string, mode string", parse_sections).drop("mode")


@query("""SELECT doc_id, i AS n, i || '. p' || ls[i] || chr(10) || '0. zero' AS body FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)""")
def points_of_documents(spark, sf):
    """The lines of all documents as numbered points, each before a number that isn't the next, and back as points."""
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". p"), x, F.lit("\n0. zero")))
    docs = table(spark, sf, "documents").select("doc_id", F.array_join(lines, "\n").alias("act"))
    return flat(docs, ["doc_id"], ["act"], "n long, body string", sequential)


# --- marked-up pages ---


@query("SELECT page_id, 't' || chr(10) || chr(10) || 'Page ' || page_id || chr(10) || chr(10) || 'a & b' || chr(10) || 'c' || chr(10) || chr(10) || 'd' AS text FROM pages")
def visible_texts(spark, sf):
    """Visible text of pages made from the pages' ids: titles, headings, inline and empty elements, scripts, styles, references."""
    html = F.concat(F.lit("<html><head><title>t</title><style>s</style></head><body><script>x</script><h1>Page "), F.col("page_id").cast("string"), F.lit("</h1><p>a &amp; b <b>c</b></p><p> </p><li>d</li></body></html>"))
    return flat(table(spark, sf, "pages").select("page_id", html.alias("html")), ["page_id"], ["html"], "text string", lambda x: [(visible_text(x),)])


def _act(k):
    """A page with an article, a paragraph, sub-points, an annex and a judgment's point, all named by k."""
    n = k.cast("string")
    return F.concat(
        F.lit("<html><div class='eli-subdivision' id='art_"), (k % 90 + 1).cast("string"), F.lit("'><p>Article</p><div id='"), F.lpad((k % 90 + 1).cast("string"), 3, "0"), F.lit(".001'><p>1. First "), n,
        F.lit("</p><table><tr><td>(a)</td><td>sub "), n, F.lit("</td></tr></table></div></div><div id='anx_II'>Annex "), n, F.lit("</div><table><tr><td><p id='point7'>7</p></td><td>Seventh "), n, F.lit("</td></tr></table></html>"),
    )


@query("""WITH p AS (SELECT page_id AS k, page_id % 90 + 1 AS a FROM pages)
SELECT k AS page_id, 'art_' || a AS unit_id, 'article' AS kind FROM p UNION ALL SELECT k, 'art_' || a || '.1', 'paragraph' FROM p UNION ALL SELECT k, 'art_' || a || '(a)', 'subpoint' FROM p UNION ALL SELECT k, 'art_' || a || '.1(a)', 'subpoint' FROM p
UNION ALL SELECT k, 'anx_II', 'annex' FROM p UNION ALL SELECT k, 'point_7', 'point' FROM p""")
def units_of_pages(spark, sf):
    """The units of a page of each markup family."""
    return markup.unit_table(table(spark, sf, "pages").select("page_id", _act(F.col("page_id")).alias("html")), "page_id", "html").select("page_id", "unit_id", "kind")


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN (page_id % 90 + 1)::VARCHAR WHEN 1 THEN (page_id % 90 + 1) || '(1)(A)' WHEN 2 THEN 'annex 2' WHEN 3 THEN 'point 7' WHEN 4 THEN '95' ELSE 'annex 3' END AS locator,
CASE WHEN page_id % 6 < 4 THEN 'ok' ELSE 'path_not_found' END AS status, CASE page_id % 6 WHEN 1 THEN 'sub ' || page_id WHEN 2 THEN 'Annex ' || page_id WHEN 3 THEN 'Seventh ' || page_id END AS text FROM pages""")
def units_by_locator(spark, sf):
    """A unit of each page by its locator, of kinds that are there and that aren't."""
    pages = table(spark, sf, "pages").select("page_id")
    k = F.col("page_id")
    article = (k % 90 + 1).cast("string")
    asked = F.element_at(F.array(article, F.concat(article, F.lit("(1)(A)")), F.lit("annex 2"), F.lit("point 7"), F.lit("95"), F.lit("annex 3")), (k % 6 + 1).cast("int"))
    units = markup.unit_table(pages.select("page_id", _act(k).alias("html")), "page_id", "html")
    found = markup.find(units, "page_id", pages.select("page_id", asked.alias("locator")), "locator")
    return found.select("page_id", "locator", "status", F.when(F.col("page_id") % 6 != 0, F.col("text")).alias("text"))


@query("""WITH p AS (SELECT page_id, 'art_' || (page_id % 40 + 1) AS a FROM pages)
SELECT page_id, a AS unit_id, 'article' AS kind, 'Article ' || a[5:] || ' Scope 1. First ' || page_id || ' (a) sub one 2014. no 2. Second (a) row a (b) row b' AS text FROM p UNION ALL SELECT page_id, a || '(a)', 'subpoint', 'sub one' FROM p UNION ALL SELECT page_id, a || '(b)', 'subpoint', 'row b' FROM p
UNION ALL SELECT page_id, a || '.1', 'paragraph', 'First ' || page_id || ' (a) sub one 2014. no' FROM p UNION ALL SELECT page_id, a || '.1(a)', 'subpoint', 'sub one' FROM p UNION ALL SELECT page_id, a || '.2', 'paragraph', 'Second (a) row a (b) row b' FROM p
UNION ALL SELECT page_id, a || '.2(a)', 'subpoint', 'row a' FROM p UNION ALL SELECT page_id, a || '.2(b)', 'subpoint', 'row b' FROM p UNION ALL SELECT page_id, 'art_' || (a[5:]::INT + 1) || 'a', 'article', 'Article ' || (a[5:]::INT + 1) || 'a Last' FROM p
UNION ALL SELECT page_id, 'anx_IV', 'annex', 'ANNEX IV List ' || page_id FROM p""")
def legacy_units_of_pages(spark, sf):
    """Units of older consolidations: headings by class, marks of modification between and inside blocks, rows of tables, a number out of order, an annex."""
    k = F.col("page_id").cast("string")
    n = (F.col("page_id") % 40 + 1).cast("int")
    html = F.concat(
        F.lit("<div><p class='title-article-norm'>Article "), n.cast("string"), F.lit("</p><p class='modref'>M3</p><p class='stitle-article-norm'>Scope</p><p class='norm'>1.  First "), k,
        F.lit("</p><div><p class='modref'>B</p><p class='norm'>(a) sub one</p></div><p class='norm'>2014. no</p><div class='norm'><span class='no-parag'>2.  </span>Second</div><table><tr><td>(a)</td><td>row a</td></tr><tr><td>(b)</td><td><p class='modref'>M1</p>row b</td></tr></table><hr class='separator-short'/><p>between</p><p class='title-article-norm'>Article "),
        (n + 1).cast("string"), F.lit("a</p><p>Last</p><p class='title-annex-1'>ANNEX IV</p><p>List "), k, F.lit("</p><p class='title-division-1'>PART</p><p>x</p></div>"),
    )
    return markup.unit_table(table(spark, sf, "pages").select("page_id", html.alias("html")), "page_id", "html")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' ELSE 'REGULATION ' || page_id || ' of May' END AS title, CASE page_id % 2 WHEN 0 THEN 'Held ' || page_id ELSE CASE WHEN page_id % 3 = 0 THEN 'x' ELSE 'REGULATION ' || page_id || ' of May more x' END END AS text FROM pages""")
def page_titles(spark, sf):
    """Titles of acts and texts of judgments, of pages with and without either."""
    k = F.col("page_id")
    title = F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("<p class='oj-doc-ti'>REGULATION "), k.cast("string"), F.lit("</p>\n<p class='oj-doc-ti'>of  May</p>\n<p class='oj-doc-ti'>more</p>\n")))
    held = F.when(k % 2 == 0, F.concat(F.lit("<div id='judgment'>Held  "), k.cast("string"), F.lit("</div>"))).otherwise("")
    html = F.concat(F.lit("<body>"), title, held, F.lit("<i>x</i></body>"))
    return markup.page_texts(table(spark, sf, "pages").select("page_id", html.alias("html")), "page_id", "html")


@query("""SELECT o_orderkey, '3' || o_orderkey || 'R' || i AS celex FROM orders, (VALUES (1), (2)) t(i) WHERE i <= o_orderkey % 3""")
def notice_ids(spark, sf):
    """Ids that notices link to, of one relation and type: notices made from orders, each with none to two."""
    def uri(kind, name):
        return F.concat(F.lit("<SAMEAS><URI><TYPE>"), F.lit(kind), F.lit("</TYPE><IDENTIFIER> "), name, F.lit(" </IDENTIFIER></URI></SAMEAS>"))

    def name(i):
        return F.concat(F.lit("3"), F.col("o_orderkey").cast("string"), F.lit(f"R{i}"))

    links = F.concat(*(F.when(F.col("o_orderkey") % 3 >= i, F.concat(F.lit("<BASED_ON>"), uri("celex", name(i)), F.lit("</BASED_ON>"))).otherwise("") for i in (1, 2)))
    xml = F.concat(F.lit("<NOTICE><WORK>"), links, F.lit("<BASED_ON>"), uri("other", name(8)), F.lit("</BASED_ON><CITES>"), uri("celex", name(9)), F.lit("</CITES></WORK></NOTICE>"))
    return flat(table(spark, sf, "orders").select("o_orderkey", xml.alias("xml")), ["o_orderkey"], ["xml"], "celex string", lambda x: [(i,) for i in markup.notice_links(x, "BASED_ON") or []])


# --- filters, languages, redirects, rules ---


@query("""SELECT o_orderkey, ident FROM (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 4 = 0 THEN '3' ELSE '6' END || '2001' || CASE o_custkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'T' ELSE 'F' END || CASE o_custkey % 2 WHEN 0 THEN 'J' ELSE 'O' END || lpad((o_orderkey % 10000)::VARCHAR, 4, '0') AS ident FROM orders)
WHERE ident[1] = '6' AND ident[6] = 'C' AND ident[7] = 'J' AND o_orderdate::DATE BETWEEN DATE '1994-01-01' AND DATE '1996-12-31'""")
def decisions_filtered(spark, sf):
    """Orders as works: decisions of one court and kind within two dates, both inclusive."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    court = F.element_at(F.array(*map(F.lit, "CTF")), (c % 3 + 1).cast("int"))
    ident = F.concat(F.when(k % 4 == 0, "3").otherwise("6"), F.lit("2001"), court, F.when(c % 2 == 0, "J").otherwise("O"), F.lpad((k % 10_000).cast("string"), 4, "0"))
    works = table(spark, sf, "orders").select("o_orderkey", ident.alias("ident"), F.col("o_orderdate").cast("date").alias("day"))
    return graph.dated(graph.decisions(works, "ident", "J", "C"), "day", "1994-01-01", "1996-12-31").select("o_orderkey", "ident")


@query("""WITH d AS (SELECT doc_id, doc_id // 3 AS act, CASE lang WHEN 'en' THEN 'ENG' WHEN 'fr' THEN 'FRA' WHEN 'de' THEN 'DEU' ELSE 'SPA' END AS lang FROM documents),
b AS (SELECT act, arg_min(lang, (CASE lang WHEN 'ENG' THEN 0 WHEN 'FRA' THEN 1 ELSE 2 END)::VARCHAR || lang) AS lang FROM d GROUP BY act)
SELECT doc_id, act, 'any' AS asked, d.lang FROM d JOIN b USING (act, lang) UNION ALL SELECT doc_id, act, 'DEU', lang FROM d WHERE lang = 'DEU'""")
def texts_by_language(spark, sf):
    """Three documents in a row as the texts of an act: those in the language asked for, and in the first of a fixed order."""
    lang = F.coalesce(*(F.when(F.col("lang") == a, b) for a, b in (("en", "ENG"), ("fr", "FRA"), ("de", "DEU"))), F.lit("SPA"))
    rows = table(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 3).alias("act"), lang.alias("lang"))
    out = [evidence.language(rows, "act", "lang", asked).select("doc_id", "act", F.lit(asked or "any").alias("asked"), "lang") for asked in (None, "DEU")]
    return out[0].union(out[1])


@query("""SELECT o_orderkey, i - 1 AS seq, CASE i WHEN 1 THEN o_orderkey || '/96-вр' WHEN 2 THEN 'n' || o_custkey ELSE '100%' END AS law_id FROM orders, (VALUES (1), (2), (4)) t(i)""")
def redirected_ids(spark, sf):
    """Ids in the address of a redirect, encoded or badly encoded, an empty one among them."""
    at = F.concat(F.lit("https://x.test/laws/list/"), F.col("o_orderkey").cast("string"), F.lit("%2F96-%D0%B2%D1%80,n"), F.col("o_custkey").cast("string"), F.lit(",,100%?from=1#a/b"))
    rows = table(spark, sf, "orders").select("o_orderkey", at.alias("location"))
    last = documents.redirected(rows, "location", "o_orderkey")
    return last.select("o_orderkey", F.col("seq").cast(LONG).alias("seq"), "law_id")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN (o_orderkey % 500) || '-1' WHEN 1 THEN (o_orderkey % 500)::VARCHAR ELSE '' END AS reference, o_orderkey % 4 < 3 AS placeholder, 'Farm - ' || o_custkey || '|Tax' AS parents,
CASE WHEN o_orderkey % 2 = 0 THEN 'judgment' END AS icj_kind, CASE WHEN o_orderkey % 2 = 0 THEN '1986-06-' || (o_orderkey % 20 + 10) END AS icj_day, 2 + o_orderkey % 2 AS own_lines,
CASE WHEN o_custkey % 2 = 0 THEN 'The copy may be out of date.' || CASE WHEN o_custkey % 3 = 0 THEN ' Source: ' || o_clerk ELSE '' END WHEN o_custkey % 3 = 0 THEN 'Source: ' || o_clerk END AS notice, o_custkey % 2 = 0 AS antibot
FROM (SELECT *, 'c' || o_custkey AS o_clerk FROM orders)""")
def still_more_small_rules(spark, sf):
    """Article references, placeholder titles, parent headings, court documents' ids, own lines of a judgment, notices, antibot pages."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def text(x):
        return x.cast("string")

    def nth(x, n, *values):
        return F.element_at(F.array(*(F.lit(v) if isinstance(v, (str, type(None))) else v for v in values)), (x % n + 1).cast("int"))

    number = text(k % 500)
    icj = resolve.icj_parts(F.concat(F.lit("105-198606"), text(k % 20 + 10), nth(k, 2, "-JUD-01-00-EN", "-jud-01-00-EN")))
    lines = F.concat(F.array(F.lit("text")), F.when(k % 2 == 1, F.array(F.lit("see DISSENTING OPINION of x"))).otherwise(F.array().cast("array<string>")), F.array(F.lit("more"), F.lit("JOINT DISSENTING OPINION"), F.lit("rest")))
    return table(spark, sf, "orders").select(
        "o_orderkey", T.article_reference(F.concat(F.lit("що каже "), nth(k, 3, F.concat(F.lit("ст. "), number, F.lit("–1")), F.concat(F.lit("Стаття "), number), "договір"))).alias("reference"),
        resolve.is_placeholder(nth(k, 4, " ", F.concat(F.lit("Zakon Rada document "), number), number, "Про мову"), number).alias("placeholder"),
        F.array_join(resolve.with_parents(F.array(F.lit("Farm"), F.concat(F.lit("- "), text(c)), F.lit("Tax"))), "|").alias("parents"), icj["kind"].alias("icj_kind"), text(icj["day"]).alias("icj_day"),
        F.size(T.own_lines(lines)).cast(LONG).alias("own_lines"), evidence.notice(c % 2 == 0, F.lit(False), F.when(c % 3 == 0, F.concat(F.lit("c"), text(c))).otherwise(" ")).alias("notice"),
        (T.stub_kind(F.concat(nth(c, 2, "Just a moment ", "A long text "), F.repeat(F.lit("of words. "), 60))) == "antibot_challenge").alias("antibot"),
    )
