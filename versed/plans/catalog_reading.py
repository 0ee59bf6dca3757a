"""Queries over the driver's tables, each beside the SQL that must give the same rows: the read path, cards, refusals, identifiers from tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from versed.functions import ids
from versed.functions import text as T
from versed.operators import evidence, reading, resolve, search
from versed.plans.catalog import SIZE_SQL, TOKENS, WORDS_SQL
from versed.plans.registry import query
from versed.plans.session import workspace
from versed.sources.documents import landed
from versed.sources.tables import table

LONG = "long"
NL = "chr(10)"


def _density_sql(words, size):
    a, b = f"len(list_filter({words}, lambda w: w = 'the'))", f"len(list_filter({words}, lambda w: starts_with(w, 'thing')))"
    return f"CASE WHEN {a} > 0 AND {b} > 0 THEN {a} * 1000.0::DOUBLE / {size} + {b} * 1000.0::DOUBLE / {size} ELSE 0 END"


UNITS_SQL = f"u AS (SELECT doc_id, i::VARCHAR AS num, ps[i] AS text FROM (SELECT doc_id, string_split(text, {NL}) AS ps, unnest(range(1, len(string_split(text, {NL})) + 1)) AS i FROM documents WHERE len(string_split(text, {NL})) > 1))"
UNIT_HITS_SQL = f"h AS (SELECT doc_id, num, text, {_density_sql(WORDS_SQL, SIZE_SQL)} AS score FROM u), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, num DESC, text DESC) AS place FROM h WHERE score > 0)"


def _units(docs):
    """The lines of the documents that have several; one alone is no unit."""
    rows = docs.where(F.size(F.split("text", "\n")) > 1)
    return rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "body")).select("doc_id", (F.col("k") + 1).cast("string").alias("num"), "body")


LINE_HITS_SQL = f"""l AS (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, {NL}) AS ls FROM documents)),
g AS (SELECT doc_id, i, ls[i] AS text, array_to_string(ls[greatest(1, i - 3):least(len(ls), i + 7)], {NL}) AS win FROM l),
lh AS (SELECT doc_id, i, win, {_density_sql(WORDS_SQL, SIZE_SQL)} AS score FROM g),
lp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i DESC) AS place FROM lh WHERE score > 0),
lb AS (SELECT doc_id, win AS text FROM lp WHERE place = 1)"""


def _joined_sql(rows, text, most):
    return f"""(SELECT doc_id, string_agg(substr(t, 1, rest::BIGINT), {NL} || {NL} || '---' || {NL} || {NL} ORDER BY place) AS snippet FROM
(SELECT doc_id, place, {text} AS t, 3000 - coalesce(sum(length({text})) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest FROM {rows} WHERE place <= {most}) WHERE rest > 0 GROUP BY doc_id)"""


@query(f"""WITH {UNITS_SQL}, {UNIT_HITS_SQL}, {LINE_HITS_SQL},
d AS (SELECT doc_id, 10000.0::DOUBLE AS score, 'direct' AS score_kind, substr(text, 1, 3000) AS snippet, 0 AS stage FROM u WHERE num = '2'),
b AS (SELECT a.doc_id, a.score, 'article' AS score_kind, j.snippet, 1 AS stage FROM a JOIN {_joined_sql('a', 'text', 6)} j ON j.doc_id = a.doc_id WHERE a.place = 1),
c AS (SELECT lb.doc_id, {_density_sql(WORDS_SQL, SIZE_SQL)} AS score, 'line' AS score_kind, j.snippet, 2 AS stage FROM lb JOIN {_joined_sql('lp', 'win', 8)} j ON j.doc_id = lb.doc_id),
r AS (SELECT 'ст. 2 the thingly' AS request, * FROM d UNION ALL SELECT q, b.* FROM b, (VALUES ('ст. 2 the thingly'), ('the thingly')) t(q) UNION ALL SELECT q, c.* FROM c, (VALUES ('ст. 2 the thingly'), ('the thingly')) t(q))
SELECT request, doc_id, round(score, 6) AS score, score_kind, sha256(snippet) AS snippet_sha FROM r QUALIFY row_number() OVER (PARTITION BY request, doc_id ORDER BY stage) = 1""")
def match_query(spark, sf):
    """Two requests over all documents: one that names a unit, one that doesn't; documents of one line have no units."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    words = landed(reading.by_words(docs, "doc_id", "text", _units(docs), "num", "body", TOKENS[:2]), workspace(spark))  # both requests ask for the same ones
    out = None
    for request in ("ст. 2 the thingly", "the thingly"):
        named = "2" if request.startswith("ст") else None
        found = reading.match_query(docs, "doc_id", "text", _units(docs), "num", "body", TOKENS[:2], named, words=words)
        rows = found.select(F.lit(request).alias("request"), "doc_id", F.round("score", 6).alias("score"), "score_kind", F.sha2("snippet", 256).alias("snippet_sha"))
        out = rows if out is None else out.union(rows)
    return out


@query(f"""WITH {UNITS_SQL}, {UNIT_HITS_SQL} SELECT doc_id, num, round(score, 6) AS score FROM a ORDER BY a.score DESC, num DESC, text DESC, doc_id LIMIT 30""")
def unit_density_topk(spark, sf):
    """The units of all parsed documents by density, number and text, all descending."""
    rows = _units(table(spark, sf, "documents")).withColumn("score", T.density(F.col("body"), TOKENS[:2])).where("score > 0")
    return search.top(rows, 30, F.desc("score"), F.desc("num"), F.desc("body"), F.col("doc_id")).select("doc_id", "num", F.round("score", 6).alias("score"))


CURRENT_SQL = "v AS (SELECT source, lang AS version FROM (SELECT source, lang, row_number() OVER (PARTITION BY source ORDER BY max(doc_id) DESC) AS n FROM documents GROUP BY source, lang) WHERE n = 1), w AS (SELECT source, 'Law ' || source AS title FROM documents GROUP BY source)"


def _laws(docs):
    """laws (source, title) and versions (source, version, status): of a source's languages the one of the newest document is current."""
    laws = docs.groupBy("source").agg(F.concat(F.lit("Law "), F.first("source")).alias("title"))
    newest = docs.groupBy("source", "lang").agg(F.max("doc_id").alias("at"))
    last = newest.groupBy("source").agg(F.max("at").alias("last"))
    status = F.when(F.col("at") == F.col("last"), "current").otherwise("superseded")
    return laws, newest.join(last, "source").select("source", F.concat_ws("/", "source", "lang").alias("version_id"), F.col("lang").alias("version"), status.alias("status"))


@query(f"""WITH {CURRENT_SQL}, h AS (SELECT doc_id, source, lang, text FROM documents WHERE len(list_filter({WORDS_SQL}, lambda x: x = 'the')) > 0 AND len(list_filter({WORDS_SQL}, lambda x: starts_with(x, 'thing'))) > 0)
SELECT h.doc_id, w.title, v.version, CASE WHEN h.doc_id % 2 = 0 THEN h.doc_id::VARCHAR END AS article, substr(h.text, 1, 700) AS snippet FROM h JOIN v ON v.source = h.source AND v.version = h.lang JOIN w ON w.source = h.source""")
def text_hits_with_laws(spark, sf):
    """Full-text hits with the current version and law they belong to, as they are shown."""
    docs = table(spark, sf, "documents")
    laws, versions = _laws(docs)
    hits = search.terms_search(docs, "doc_id", "text", TOKENS[:2], every=True).select("doc_id")
    units = docs.select("doc_id", F.concat_ws("/", "source", "lang").alias("version_id"), "text")
    out = reading.located(hits, units, versions, laws, "doc_id", "version_id", "source")
    num = F.when(F.col("doc_id") % 2 == 0, F.col("doc_id").cast("string")).otherwise(F.concat(F.lit("frag-"), F.col("doc_id").cast("string")))
    snippet, article = reading.as_result(F.col("text"), num)
    return out.select("doc_id", "title", "version", article.alias("article"), snippet.alias("snippet"))


@query(f"""WITH {CURRENT_SQL}, q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id AS doc_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)), 9) AS score FROM embeddings WHERE vec_id <> 0)
SELECT s.doc_id, s.score, w.title, v.version FROM s JOIN documents d ON d.doc_id = s.doc_id JOIN v ON v.source = d.source AND v.version = d.lang JOIN w ON w.source = d.source ORDER BY s.score DESC, s.doc_id LIMIT 25""")
def vector_hits_with_laws(spark, sf):
    """The nearest vectors whose documents belong to a current version, with version and law."""
    docs, vectors = table(spark, sf, "documents"), table(spark, sf, "embeddings")
    laws, versions = _laws(docs)
    one = vectors.where("vec_id = 0").first()
    asked = F.lit(one["embedding"] if one else None).cast("array<double>")
    hits = vectors.where("vec_id <> 0").select(F.col("vec_id").alias("doc_id"), F.round(search.cosine(F.col("embedding"), asked), 9).alias("score")).where("score is not null")
    units = docs.select("doc_id", F.concat_ws("/", "source", "lang").alias("version_id"))
    out = reading.located(hits, units, versions, laws, "doc_id", "version_id", "source")
    return search.top(out, 25, F.desc("score"), F.col("doc_id")).select("doc_id", "score", "title", "version")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, ws, coalesce(list_position(list_transform(ws, lambda x: regexp_replace(lower(x), '^[^a-z0-9-]+|[^a-z0-9-]+$', '', 'g') = 'the'), true), 1) - 1 AS first FROM w),
b AS (SELECT doc_id, ws, greatest(0, least(first - 7, len(ws) - 14)) AS start FROM p)
SELECT doc_id, CASE WHEN start > 0 THEN ' … ' ELSE '' END || array_to_string(ws[start + 1:start + 14], ' ') || CASE WHEN start + 14 < len(ws) THEN ' … ' ELSE '' END AS excerpt FROM b""")
def excerpts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.excerpt(F.col("text"), ["the"]).alias("excerpt"))


@query("""SELECT conv_id, turn, CASE WHEN len(list_filter(regexp_extract_all(lower(text), '[A-Za-zА-Яа-яІіЇїЄєҐґ0-9-]+'), lambda w: replace(w, '-', '') <> '' AND w NOT IN ('на', 'по', 'що', 'та'))) > 0 THEN 'ok' ELSE 'unusable_query' END AS status
FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN regexp_replace(text, '[A-Za-z]+', '-', 'g') WHEN turn % 3 = 2 THEN 'На — що? ' || length(text) ELSE text END AS text FROM conversations WHERE length(trim(text)) > 0)
UNION ALL SELECT conv_id, -1, 'unusable_query' FROM (SELECT DISTINCT conv_id FROM conversations)""")
def query_statuses(spark, sf):
    """Each turn as a query, some without their plain letters or with service words and a number, and for each conversation one that has service words only."""
    rows = table(spark, sf, "conversations").where("length(trim(text)) > 0")
    asked = F.when(F.col("turn") % 3 == 1, F.regexp_replace("text", "[A-Za-z]+", "-")).when(F.col("turn") % 3 == 2, F.concat(F.lit("На — що? "), F.length("text").cast("string"))).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", asked.alias("text"))
    bare = rows.select("conv_id").distinct().select("conv_id", F.lit(-1).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("та - або").alias("text"))
    return rows.union(bare).select("conv_id", "turn", T.query_status(F.col("text")).alias("status"))


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'unsupported_filter' ELSE 'ok' END AS status,
CASE WHEN o_orderpriority = '5-LOW' THEN 'colour' WHEN o_orderstatus = 'F' THEN 'court=declared,date=requested' ELSE 'date=requested' END AS applied FROM orders""")
def applied_filters(spark, sf):
    rows = table(spark, sf, "orders")
    asked = F.create_map(F.lit("date"), F.col("o_orderdate").cast("string"), F.lit("court"), F.when(F.col("o_orderstatus") == "F", "x"), F.lit("colour"), F.when(F.col("o_orderpriority") == "5-LOW", "red"))
    found = reading.filters(asked, ("court", "date"), F.array(F.lit("court")))
    return rows.select("o_orderkey", found.alias("f")).select("o_orderkey", "f.status", "f.applied")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN CASE WHEN o_orderdate >= DATE '1995-01-01' THEN 'found' END WHEN o_custkey % 3 = 1 THEN 'current' ELSE 'base' END AS revision,
CASE WHEN o_orderkey % 5 = 0 THEN 'unknown' WHEN o_custkey % 3 = 0 THEN CASE WHEN o_orderdate >= DATE '1995-01-01' THEN 'as_of' ELSE 'not_in_force' END WHEN o_custkey % 3 = 1 THEN 'current' ELSE 'base' END AS basis FROM orders""")
def selected_revisions(spark, sf):
    lost = F.col("o_orderkey") % 5 == 0
    asked = lost | (F.col("o_custkey") % 3 == 0)
    found = F.when(F.col("o_orderdate").cast("date") >= F.lit("1995-01-01").cast("date"), "found")
    current = F.when(~lost & (F.col("o_custkey") % 3 != 2), "current")
    chosen = reading.select_revision(F.when(asked, "1995-01-01"), found, current, F.lit("base"))
    return table(spark, sf, "orders").select("o_orderkey", chosen.alias("r")).select("o_orderkey", "r.revision", "r.basis")


CASE_SQL = "CASE o_orderkey % 4 WHEN 0 THEN 'C' WHEN 1 THEN 'T' WHEN 2 THEN 'F' ELSE 'X' END || '-' || (o_orderkey % 9999 + 1) || '/' || lpad((o_custkey % 100)::VARCHAR, 2, '0')"


def _case(spark, sf):
    letter = F.element_at(F.array(*map(F.lit, "CTFX")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    number = F.concat(letter, F.lit("-"), (F.col("o_orderkey") % 9999 + 1).cast("string"), F.lit("/"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"))
    return table(spark, sf, "orders").withColumn("number", number)


@query(f"""SELECT o_orderkey, number, array_to_string(list_transform(CASE number[1] WHEN 'C' THEN ['CJ', 'CO', 'CC'] WHEN 'T' THEN ['TJ', 'TO'] WHEN 'F' THEN ['FJ', 'FO'] END,
lambda k: '6' || CASE WHEN o_custkey % 100 >= 53 THEN '19' ELSE '20' END || lpad((o_custkey % 100)::VARCHAR, 2, '0') || k || lpad((o_orderkey % 9999 + 1)::VARCHAR, 4, '0')), ',') AS candidates
FROM (SELECT *, {CASE_SQL} AS number FROM orders)""")
def case_numbers_of_orders(spark, sf):
    return _case(spark, sf).select("o_orderkey", "number", F.array_join(ids.case_candidates(F.col("number")), ",").alias("candidates"))


@query(f"""WITH n AS (SELECT o.o_orderkey, {CASE_SQL} AS number, count(l.l_orderkey) AS docs FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey AND l.l_quantity > 40 GROUP BY ALL)
SELECT o_orderkey, CASE WHEN number[1] = 'X' THEN 'unknown_case_number_format' WHEN o_orderkey % 7 = 0 THEN 'case_not_found' WHEN docs = 0 THEN 'registered_no_documents' ELSE 'published' END AS status FROM n""")
def case_cards(spark, sf):
    """The status of each order as a case: its lines of more than 40 are documents."""
    lines = table(spark, sf, "lineitem").where("l_quantity > 40").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = _case(spark, sf).join(lines, "o_orderkey", "left")
    status = reading.card_status(ids.case_candidates(F.col("number")).isNotNull(), F.col("o_orderkey") % 7 != 0, F.coalesce("n", F.lit(0)))
    return rows.select("o_orderkey", status.alias("status"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'http://data.europa.eu/eli/reg/' WHEN 1 THEN 'http://data.europa.eu/eli/dir/' WHEN 2 THEN 'http://data.europa.eu/eli/dec/' END || (1950 + p_partkey % 70) || '/' || (p_partkey % 9999 + 1) || '/oj' AS eli FROM part""")
def eli_of_parts(spark, sf):
    kind = F.element_at(F.array(*map(F.lit, "RLDX")), (F.col("p_size") % 4 + 1).cast("int"))
    celex = F.concat(F.lit("3"), (F.col("p_partkey") % 70 + 1950).cast("string"), kind, F.lpad((F.col("p_partkey") % 9999 + 1).cast("string"), 4, "0"))
    return table(spark, sf, "part").select("p_partkey", ids.eli(celex).alias("eli"))


LANGUAGES_SQL = "['bul', 'ces', 'dan', 'deu', 'ell', 'eng', 'est', 'fin', 'fra', 'gle', 'hrv', 'hun', 'ita', 'lav', 'lit', 'mlt', 'nld', 'pol', 'por', 'ron', 'slk', 'slv', 'spa', 'swe']"


@query(f"""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN NULL ELSE 'http://data.europa.eu/eli/reg/2016/' || p_partkey || CASE WHEN p_size % 5 = 2 THEN '/2016-05-04' ELSE '/oj' END END AS eli,
{LANGUAGES_SQL}[p_partkey % 24 + 1] AS language FROM part""")
def eli_addresses(spark, sf):
    """Addresses of all 24 languages and several formats at the end, broken ones, and ones that are none."""
    two = ("bg", "cs", "da", "de", "el", "en", "et", "fi", "fr", "ga", "hr", "hu", "it", "lv", "lt", "mt", "nl", "pl", "pt", "ro", "sk", "sl", "es", "sv")
    language = ids.language_code(F.element_at(F.array(*map(F.lit, two)), (F.col("p_partkey") % 24 + 1).cast("int")))
    kind = F.col("p_size") % 5
    whole = F.concat(F.lit("https://EUR-lex.europa.eu/ELI/reg/2016/"), F.col("p_partkey").cast("string"), F.when(kind == 2, "/2016-05-04").otherwise("/oj"), F.lit("/"), language, F.lit("/HTML/"), language, F.lit("?x=1"))
    address = F.when(kind == 0, "eli/reg").when(kind == 1, F.concat(F.lit("32016R"), F.col("p_partkey").cast("string"))).otherwise(whole)
    return table(spark, sf, "part").select("p_partkey", ids.normal_eli(address).alias("eli"), language.alias("language"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_quantity::BIGINT || 'a' WHEN 1 THEN l_quantity::BIGINT || '(' || l_linenumber || ')(c)' WHEN 2 THEN 'Annex ' || ['I', 'II', 'III', 'IV', 'V', 'VI', 'VII'][l_linenumber] ELSE 'recital ' || l_linenumber END AS canonical FROM lineitem""")
def locators_of_lines(spark, sf):
    number, line = F.col("l_quantity").cast(LONG).cast("string"), F.col("l_linenumber").cast("string")
    kind = F.col("l_linenumber") % 4
    x = F.when(kind == 0, F.concat(number, F.lit("А"))).when(kind == 1, F.concat(number, F.lit("("), line, F.lit(")(С)"))).when(kind == 2, F.concat(F.lit("додаток "), line)).otherwise(F.concat(F.lit("recital "), line))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ids.canonical_locator(x).alias("canonical"))


KINDS_SQL = "CASE right(source, 1) WHEN '0' THEN 'law' WHEN '1' THEN 'bylaw' WHEN '2' THEN 'code' WHEN '3' THEN 'bylaw' WHEN '4' THEN 'constitution' ELSE 'unknown' END"


@query(f"SELECT doc_id, {KINDS_SQL} AS kind FROM documents")
def doc_kind_by_text(spark, sf):
    """Kinds from headings in capitals (the first one that names a kind), requisite lines and ids."""
    last, date = F.substring("source", -1, 1), "від 05.04.2001"
    head = (
        F.when(last == "0", "ВЕРХОВНА РАДА УКРАЇНИ\nЗАКОН УКРАЇНИ\nПро зміни до кодексу\n").when(last == "1", "КАБІНЕТ МІНІСТРІВ УКРАЇНИ\nЗАКОН\n")
        .when(last == "2", f"Щось; Невідоме {date}\nВерховна Рада України; Кодекс України {date} № 1\nЗАКОН УКРАЇНИ\n").when(last == "4", f"Рада; Конституція України {date}\n").otherwise("Звичайний рядок\n")
    )
    ident = F.when(last == "3", "1178-2022-п").otherwise(F.col("doc_id").cast("string"))
    return table(spark, sf, "documents").select("doc_id", T.document_kind(F.concat(head, F.lower("text")), ident).alias("kind"))


@query("""WITH a AS (SELECT 'закон ' || lower(n_name) AS alias, n_nationkey::VARCHAR AS law_id FROM nation),
q AS (SELECT DISTINCT ['ЗУ ', 'закон україни ', 'Закон ', ''][p_size % 4 + 1] || 'NATION_' || (p_size % 30) AS q FROM part),
l AS (SELECT q, lower(q) AS low FROM q),
v AS (SELECT q, low AS t, 0 AS variant FROM l UNION ALL SELECT q, 'закон ' || substr(low, 4), 1 FROM l WHERE starts_with(low, 'зу ') UNION ALL SELECT q, 'закон україни ' || substr(low, 4), 2 FROM l WHERE starts_with(low, 'зу ')
UNION ALL SELECT q, 'закон ' || substr(low, 15), 1 FROM l WHERE starts_with(low, 'закон україни ') UNION ALL SELECT q, substr(low, 15), 2 FROM l WHERE starts_with(low, 'закон україни ')
UNION ALL SELECT q, substr(low, 7), CASE WHEN starts_with(low, 'закон україни ') THEN 3 ELSE 1 END FROM l WHERE starts_with(low, 'закон ')),
m AS (SELECT q, law_id, CASE WHEN alias = t THEN 1 ELSE 2 END AS stage, variant, alias FROM v JOIN a ON contains(alias, t) OR contains(t, alias))
SELECT q, law_id, CASE stage WHEN 1 THEN 'alias' ELSE 'containment' END AS matched_by FROM m QUALIFY row_number() OVER (PARTITION BY q ORDER BY stage, variant, alias, law_id) = 1""")
def alias_variants(spark, sf):
    """Aliases with a usual beginning, asked for with others."""
    aliases = table(spark, sf, "nation").select(F.concat(F.lit("закон "), F.lower("n_name")).alias("alias"), F.col("n_nationkey").cast("string").alias("law_id"))
    start = F.element_at(F.array(*map(F.lit, ("ЗУ ", "закон україни ", "Закон ", ""))), (F.col("p_size") % 4 + 1).cast("int"))
    asked = table(spark, sf, "part").select(F.concat(start, F.lit("NATION_"), (F.col("p_size") % 30).cast("string")).alias("q")).distinct()
    return resolve.by_alias(asked, "q", aliases)


@query("""SELECT event_id, floor((date_diff('second', ts, TIMESTAMP '2024-06-01') * 100 + 43200) / 86400.0) / 100 AS age, CASE user_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS flag, 'c-605/' || (user_id % 100) || ' p' AS number,
event_type || ', ' || user_id AS citation, CASE user_id % 3 WHEN 0 THEN 'url' WHEN 1 THEN 'file' END AS fault, 'doc_' || user_id || '_a' AS file_name, CASE user_id % 4 WHEN 0 THEN 'treaty' WHEN 1 THEN 'procedure' WHEN 2 THEN 'decision' ELSE 'act' END AS class,
'20' || lpad((user_id % 90 + 10)::VARCHAR, 2, '0') || '-02-01' AS redaction, user_id % 2 = 0 AS company_ok FROM events""")
def small_rules(spark, sf):
    """One-line rules on values made from events: ages, flags, case numbers, citations, addresses, file names, classes, dates, shapes."""
    user = F.col("user_id")

    def nth(n, *values):
        return F.element_at(F.array(*map(F.lit, values)), (user % n + 1).cast("int"))

    name = user.cast("string")
    order, ident = F.when(user % 4 == 1, "EU").otherwise("UA"), nth(4, "treaty:x", "32012Q1", "62018CJ0311", "435-15")
    return table(spark, sf, "events").select(
        "event_id", ids.age(F.lit("2024-06-01 00:00:00"), F.col("ts")).alias("age"), ids.flag(nth(4, " TRUE", "0", "yes", "")).alias("flag"),
        ids.case_number(F.concat(F.lit(" C-605%252F"), (user % 100).cast("string"), F.lit("%2520%20P "))).alias("number"), ids.citation(F.col("event_type"), F.lit("  "), user, F.lit(None)).alias("citation"),
        ids.address_fault(nth(3, "https://x", "act.PDF", "ст. 5")).alias("fault"), ids.file_name(F.concat(F.lit("doc/"), name, F.lit(":a"))).alias("file_name"), ids.document_class(order, ident).alias("class"),
        ids.redaction_date(F.concat(F.lit("чинна, Редакція від 01.02.20"), F.lpad((user % 90 + 10).cast("string"), 2, "0"))).alias("redaction"), ids.well_formed(nth(2, "12345678", "1234567x"), "company").alias("company_ok"),
    )


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'view') AS created, count(*) FILTER (WHERE event_type = 'click') AS skipped, count(*) FILTER (WHERE event_type NOT IN ('view', 'click')) AS failed FROM events""")
def ingest_summary(spark, sf):
    status = F.when(F.col("event_type") == "view", "created").when(F.col("event_type") == "click", "skipped").otherwise(F.col("event_type"))
    return reading.ingest_summary(table(spark, sf, "events").withColumn("status", status), "status")


@query("""SELECT l_partkey, array_to_string(list_transform(list_sort(list(DISTINCT lpad(length(l_suppkey::VARCHAR)::VARCHAR, 2, '0') || l_suppkey)), lambda u: substr(u, 3)), ',') AS units FROM lineitem GROUP BY l_partkey""")
def units_in_order(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").cast("string").alias("num"))
    return reading.units_in_order(rows, "l_partkey", "num").select("l_partkey", F.array_join("units", ",").alias("units"))


@query("""SELECT s_suppkey, array_to_string(list_filter([CASE WHEN s_nationkey % 2 = 0 AND s_suppkey % 3 = 0 THEN 'curated_without_date' END, CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 2 = 0 THEN 'authentic_translation' END, CASE WHEN s_suppkey % 5 = 0 THEN 'translation_not_told' END,
CASE WHEN s_suppkey % 7 = 0 AND s_suppkey % 11 <> 0 THEN 'staleness_not_told' END], lambda x: x IS NOT NULL), ',') AS stamp,
array_to_string(list_filter([CASE WHEN s_nationkey % 3 = 0 AND s_suppkey % 2 = 0 THEN 'no_manual_path' END, CASE WHEN s_suppkey % 4 = 0 AND s_acctbal > 0 THEN 'licence_forbids_connection' END, CASE WHEN s_suppkey % 6 = 0 AND s_acctbal < 1000 THEN 'attribution_without_text' END, CASE WHEN s_nationkey % 3 <> 0 AND s_suppkey % 9 = 0 THEN 'covered_without_verification' END], lambda x: x IS NOT NULL), ',') AS source FROM supplier""")
def envelope_faults(spark, sf):
    """Which invariants of stamps and sources the suppliers, taken as such, break."""
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    stamp = reading.stamp_faults(F.when(n % 2 == 0, "curated").otherwise("live"), F.when(k % 3 != 0, "2024"), k % 5 == 0, k % 2 == 0, F.when(k % 11 == 0, "may be Stale"), k % 7 == 0)
    source = reading.source_faults(n % 3 != 0, F.when(k % 2 != 0, "by letter"), k % 4 != 0, F.col("s_acctbal") > 0, k % 6 == 0, F.when(F.col("s_acctbal") < 1000, " ").otherwise("by name"), F.when(k % 9 != 0, "2024"))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(stamp, ",").alias("stamp"), F.array_join(source, ",").alias("source"))


@query("""SELECT doc_id, lang, CASE WHEN doc_id % 5 <> 0 THEN 'ev-1' END AS evidence_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 7 = 0 THEN '' ELSE sha256(text) END AS content_hash FROM documents WHERE doc_id % 2 = 0 AND (doc_id % 3 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0)""")
def incomplete_fragments(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 2 == 0, "ok").otherwise("not_found").alias("status"), F.when(F.col("doc_id") % 5 != 0, "ev-1").alias("evidence_id"), F.when(F.col("doc_id") % 3 == 0, None).when(F.col("doc_id") % 7 == 0, "").otherwise(ids.content_hash(F.col("text"))).alias("content_hash"))
    return reading.incomplete_fragments(rows).select("doc_id", "lang", "evidence_id", "content_hash")


@query("""SELECT vec_id, CASE WHEN label % 3 <> 0 THEN 'full_text' ELSE 'metadata' END AS content, label % 3 <> 0 AND label % 2 = 0 AS confirmable FROM embeddings""")
def confirmable_contents(spark, sf):
    content, publication = F.when(F.col("label") % 3 != 0, "full_text").otherwise("metadata"), F.when(F.col("label") % 2 == 0, "official").otherwise("summary")
    return table(spark, sf, "embeddings").select("vec_id", content.alias("content"), evidence.confirmable(content, publication).alias("confirmable"))
