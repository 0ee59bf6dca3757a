"""Citations between documents: who cites a document, with filters, completeness and preferences among identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versed.operators.records import pick, richest, with_completeness


def citing(edges: DataFrame, works: DataFrame, cited: Column, src: str, dst: str, work: str) -> DataFrame:
    """The works with an edge to a cited document: one hop, each edge once."""
    return edges.where(cited).select(F.col(src).alias(work), F.col(dst).alias("cited")).distinct().join(works, work)


def decisions(works: DataFrame, ident: str, kinds: str | None = None, court: str | None = None) -> DataFrame:
    """Works whose identifier is of case law (sector 6), of the kinds (7th character) and court (6th) asked for."""
    rows = works.where(F.col(ident).startswith("6"))
    if kinds:
        rows = rows.where(F.substring(ident, 7, 1).isin(*kinds))
    return rows.where(F.substring(ident, 6, 1) == court) if court else rows


def dated(rows: DataFrame, day: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows within both bounds, inclusive; a null date fails as soon as there is a bound."""
    if since:
        rows = rows.where(F.col(day) >= F.lit(since).cast("date"))
    return rows.where(F.col(day) <= F.lit(until).cast("date")) if until else rows


def first_n(rows: DataFrame, keys: list[str], values: list[str], seq: str, n: int, *order: Column) -> DataFrame:
    """The first n raw rows with completeness judged before duplicates go, then the richest row of each key."""
    return richest(with_completeness(rows, n, *order), keys, values, seq)


def preferred(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """The identifier of each key: no corrigendum, then the shortest, then the least."""
    return pick(rows, [key], F.col(ident).contains("R(").asc(), F.length(ident).asc(), F.col(ident).asc())


def collapsed(rows: DataFrame, key: str, many: list[str]) -> DataFrame:
    """One row of each key, several values joined by bars in order."""
    return rows.groupBy(key).agg(*(F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|").alias(c) for c in many))


def existing(asked: DataFrame, candidates: Column, store: DataFrame, ident: str, day: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Asked rows with the rows of a store that have one of their candidate identifiers, within both dates; those without any have nulls."""
    kept = dated(store, day, since, until) if day else store
    each = asked.select(F.struct(*asked.columns).alias("__asked"), F.explode_outer(F.array_distinct(candidates)).alias("__one"))
    met = each.join(kept, F.col("__one") == F.col(ident)).drop("__one")
    rest = asked.select(F.struct(*asked.columns).alias("__of")).join(met.select(F.col("__asked").alias("__had")).distinct(), F.col("__of") == F.col("__had"), "left_anti")
    return met.select("__asked.*", *kept.columns).unionByName(rest.select("__of.*"), allowMissingColumns=True)
