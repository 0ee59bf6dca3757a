"""The read path: match cascades over units and lines, hits with the versions and laws they belong to, refusals as statuses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versed.functions import ids
from versed.functions import text as T
from versed.operators import corpus, resolve, search

#: Score of a unit that the query names, lines and units that a snippet is made of, characters of a snippet and of a result.
DIRECT, LINES, UNITS, CONTEXT, SHOWN = 10_000.0, 8, 6, 3000, 700


def match_query(docs: DataFrame, key: str, text: str, units: DataFrame, num: str, body: str, tokens: list[str], reference: str | None = None, context: int = CONTEXT, words: DataFrame | None = None) -> DataFrame:
    """key, score, score_kind and snippet of each document that a query matches; `words` is by_words() where a caller has it already.

    A unit whose number the query names comes first; else the units in which every token hits, by density, the best
    UNITS of them joined; else the LINES best lines with the lines around them, scored as the best of these windows.
    units has a row for each unit of a document (key, num, body). Ties go to the greater number, then the later line.
    """
    if not tokens:
        return docs.select(key, F.lit(0.0).alias("score"), F.lit("").alias("score_kind"), F.lit("").alias("snippet")).where("false")
    some = units.select(key, F.col(num).cast("string").alias("num"), F.col(body).alias("body"))
    named = some.where(F.col("num") == reference) if reference else some.where("false")
    direct = named.select(key, F.lit(DIRECT).alias("score"), F.lit("direct").alias("score_kind"), F.substring("body", 1, context).alias("snippet"))

    words = by_words(docs, key, text, units, num, body, tokens, context) if words is None else words
    return resolve.cascade([direct, words], key, F.desc("score")).drop("stage")


def by_words(docs: DataFrame, key: str, text: str, units: DataFrame, num: str, body: str, tokens: list[str], context: int = CONTEXT) -> DataFrame:
    """What match_query() finds without a number: units first, else lines; each text is scored once."""
    some = units.select(key, F.col(num).cast("string").alias("num"), F.col(body).alias("body")).where(T.may_hit(F.lower("body"), tokens))
    by_unit = some.withColumn("score", T.density(F.col("body"), tokens)).where("score > 0")
    by_unit = by_unit.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), F.desc("num"), F.desc("body")))).where(F.col("place") <= UNITS)
    articles = corpus.joined_within(by_unit, key, "place", F.col("body"), context, UNITS, score=F.col("score"))
    articles = articles.select(key, "score", F.lit("article").alias("score_kind"), F.col("joined").alias("snippet"))

    lines = search.line_windows(docs, key, text, tokens)
    lines = lines.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("score"), F.desc("line_no")))).where(F.col("place") <= LINES)
    fallback = corpus.joined_within(lines, key, "place", F.col("window_text"), context, LINES, score=F.when(F.col("place") == 1, T.density(F.col("window_text"), tokens)))
    fallback = fallback.select(key, "score", F.lit("line").alias("score_kind"), F.col("joined").alias("snippet"))
    return resolve.cascade([articles, fallback], key, F.desc("score")).drop("stage")


def search_in_text(docs: DataFrame, key: str, text: str, matched: DataFrame, query: str, context: int = CONTEXT) -> DataFrame:
    """key and snippet of every document: its beginning for an empty query, else what matched, else the empty text."""
    if not query.strip():
        return docs.select(key, F.coalesce(F.substring(text, 1, context), F.lit("")).alias("snippet"))
    return docs.select(key).join(matched.select(key, "snippet"), key, "left").select(key, F.coalesce("snippet", F.lit("")).alias("snippet"))


def located(hits: DataFrame, units: DataFrame, versions: DataFrame, laws: DataFrame, unit: str, version: str, law: str) -> DataFrame:
    """Hits with the unit, its current version and the law of that: hits that belong to no current version go."""
    return hits.join(units, unit).join(versions.where("status = 'current'"), version).join(laws, law)


def as_result(body: Column, num: Column) -> tuple[Column, Column]:
    """(snippet, article) of a hit as it is shown: SHOWN characters, and no article where the number is a fragment's."""
    return F.substring(body, 1, SHOWN), F.when(~num.startswith("frag-"), num)


def from_postings(postings: DataFrame, docs: DataFrame, key: str, tokens: list[str]) -> DataFrame:
    """Documents that have every token, with hits: occurrences of all of them, from an inverted index (term, key, tf)."""
    def reached(t: str) -> Column:
        start, prefix = T.stem_of(t)
        return F.col("term").startswith(start) if prefix else F.col("term") == start

    which = F.array_compact(F.array(*(F.when(reached(t), k) for k, t in enumerate(tokens))))
    rows = postings.where(reduce(lambda a, b: a | b, map(reached, tokens))).select(key, "tf", F.explode(which).alias("token"))
    found = rows.groupBy(key).agg(F.sum("tf").alias("hits"), F.count_distinct("token").alias("n")).where(F.col("n") == len(tokens)).drop("n")
    return docs.join(found, key)


def filters(requested: Column, supported: tuple[str, ...], declared: Column) -> Column:
    """(status, applied) of a request's filters (map of name to value): refused if one isn't supported, else each marked as declared by the source or requested only."""
    names = F.map_keys(F.map_filter(requested, lambda _, v: v.isNotNull()))
    unknown = F.array_sort(F.array_except(names, F.array(*map(F.lit, supported))))
    marked = F.transform(F.array_sort(names), lambda n: F.concat(n, F.when(F.array_contains(declared, n), "=declared").otherwise("=requested")))
    return F.struct(F.when(F.size(unknown) > 0, "unsupported_filter").otherwise("ok").alias("status"), F.array_join(F.when(F.size(unknown) > 0, unknown).otherwise(marked), ",").alias("applied"))


def select_revision(as_of: Column, found: Column, current: Column, base: Column) -> Column:
    """(revision, basis): that of the day asked for, or the current one, or the base text where no revisions are known; a day without a revision has none."""
    known = current.isNotNull()
    return F.struct(
        F.when(as_of.isNotNull() & known, found).when(known, current).when(as_of.isNull(), base).alias("revision"),
        F.when(as_of.isNotNull() & known & found.isNull(), "not_in_force").when(as_of.isNotNull() & known, "as_of").when(known, "current").when(as_of.isNull(), "base").otherwise("unknown").alias("basis"),
    )


def card_status(number_ok: Column, registered: Column, documents: Column) -> Column:
    """What a case's public card says: published, registered without documents, not found, or no case number at all."""
    return F.when(~number_ok, "unknown_case_number_format").when(~registered, "case_not_found").when(documents == 0, "registered_no_documents").otherwise("published")


def accepted(rows: DataFrame, verdict: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that a gate lets through, and the others with the reason, for a table of their own; verdict: (store, reason)."""
    judged = rows.withColumn("__v", verdict)
    return judged.where("__v.store").drop("__v"), judged.where("not __v.store").withColumn("reason", F.col("__v.reason")).drop("__v")


def ingest_summary(rows: DataFrame, status: str) -> DataFrame:
    """How many rows an ingest read, created, skipped and failed, in one row; what isn't created or skipped by a rule has failed."""
    s = F.col(status)
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(s == "created").alias("created"), F.count_if(s == "skipped").alias("skipped"), F.count_if(s.isNull() | ~s.isin("created", "skipped")).alias("failed"),
    )


def stamp_faults(origin: Column, verified_at: Column, translation: Column, authentic: Column, notice: Column, stale: Column) -> Column:
    """Names of the rules that a provenance stamp breaks."""
    low = F.lower(F.coalesce(notice, F.lit("")))
    rules = (
        ("curated_without_date", (origin == "curated") & verified_at.isNull()), ("authentic_translation", translation & F.coalesce(authentic, F.lit(False))),
        ("translation_not_told", translation & ~low.contains("translation")), ("staleness_not_told", stale & ~low.contains("stale")),
    )
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules)))


def source_faults(covered: Column, manual_path: Column, commercial: Column, connected: Column, attribution_needed: Column, attribution: Column, verified_at: Column) -> Column:
    """Names of the rules that a source of the coverage table breaks."""
    rules = (
        ("no_manual_path", ~covered & (F.trim(F.coalesce(manual_path, F.lit(""))) == "")), ("licence_forbids_connection", ~commercial & connected),
        ("attribution_without_text", attribution_needed & (F.trim(F.coalesce(attribution, F.lit(""))) == "")), ("covered_without_verification", covered & verified_at.isNull()),
    )
    return F.array_compact(F.array(*(F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules)))


def incomplete_fragments(rows: DataFrame, status: str = "status") -> DataFrame:
    """Fragments that are ok by status and lack an evidence id or a content hash."""
    return rows.where((F.col(status) == "ok") & (F.col("evidence_id").isNull() | F.col("content_hash").isNull() | (F.col("evidence_id") == "") | (F.col("content_hash") == "")))


def units_in_order(rows: DataFrame, key: str, num: str) -> DataFrame:
    """key and units: the numbers of each document's units, shorter ones first."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(F.struct(F.length(num).alias("size"), F.col(num).alias("num")))).alias("u")).select(key, F.col("u.num").alias("units"))


def verified(asked: DataFrame, request: str, ident: str, hits: DataFrame, appnos: str, ecli: str, itemid: str) -> DataFrame:
    """Asked requests (request, ident) with status ok where one of the request's hits carries the identifier asked for, else unverified: a source that ignores a filter answers with other rows, and these are no answer."""
    kind, wanted = ids.identifier_kind(F.col(ident)), F.trim(ident)
    rows = asked.withColumns({"__kind": kind, "__wanted": wanted}).join(hits.withColumnRenamed(request, "__request"), F.col(request) == F.col("__request"), "left")
    same = F.when(F.col("__kind") == "appno", F.array_contains(ids.application_numbers(F.col(appnos)), F.col("__wanted"))).when(F.col("__kind") == "ecli", F.upper(F.trim(ecli)) == F.upper("__wanted")).when(F.col("__kind") == "itemid", F.lower(F.trim(itemid)) == F.lower("__wanted"))
    found = rows.groupBy(request, ident).agg(F.max(F.coalesce(same, F.lit(False))).alias("__ok"))
    return found.select(request, ident, F.when(F.col("__ok"), "ok").otherwise("unverified").alias("status"))


def refused(asked: DataFrame, request: str, reason: str) -> DataFrame:
    """Requests to a register that only a person may ask: each is refused with the reason, none is answered with nothing."""
    return asked.select(request, F.lit("requires_human").alias("status"), F.lit(reason).alias("reason"))


def catalogue(rows: DataFrame, key: str, category: str | None, cached: DataFrame, fetched: str, now: Column, ttl_days: int) -> DataFrame:
    """The catalogue's rows of a category (all without one) with cache_status (absent, fresh, stale) and age_days of their cached text."""
    some = rows.where(F.col("category") == category) if category else rows
    latest = cached.groupBy(F.col(key).alias("__key")).agg(F.max(fetched).alias("__at"))
    age = ids.age_days(now, F.col("__at"))
    out = some.join(latest, F.col(key) == F.col("__key"), "left").withColumn("age_days", age)
    return out.withColumn("cache_status", F.when(F.col("__at").isNull(), "absent").when(F.col("age_days") < ttl_days, "fresh").otherwise("stale")).drop("__key", "__at")
