"""Provenance of answers and evidence of a session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries and characters of a session, entries of an agent, hours a session lives.
ENTRIES, CHARS, AGENT, HOURS = 400, 6_000_000, 120, 8


def confirmable(content: Column, publication: Column) -> Column:
    return content.isin("full_text", "fragment") & ~publication.isin("card", "summary", "guidance")


def quotable(content: Column, publication: Column, authentic: Column, translated: Column, stale: Column) -> Column:
    return confirmable(content, publication) & authentic & ~translated & ~stale


def notice(stale: Column, translated: Column, attribution: Column) -> Column:
    """What an answer must say about itself, or null."""
    text = F.concat_ws(" ", F.when(stale, "The copy may be out of date."), F.when(translated, "This is a translation, not the authentic text."), F.when(F.trim(attribution) != "", F.concat(F.lit("Source: "), attribution)))
    return F.nullif(text, F.lit(""))


def navigation(rows: DataFrame) -> DataFrame:
    """Hits stamped as pointers, not evidence."""
    return rows.withColumns({"navigation_only": F.lit(True), "evidence_id": F.lit(None).cast("string"), "confirmable": F.lit(False)})


def find(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """Asked (session, document, path) with found evidence: ok for one entry by id or alias, ambiguous for several, not_found."""
    keyed = entries.select("session", "path", "evidence_id", F.explode(F.array_distinct(F.concat(F.array("document"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("document")).distinct()
    found = asked.join(keyed, ["session", "document", "path"], "left").groupBy("session", "document", "path").agg(F.count_distinct("evidence_id").alias("n"), F.min("evidence_id").alias("evidence_id"))
    return found.select("session", "document", "path", F.when(F.col("n") == 1, F.col("evidence_id")).alias("evidence_id"), F.when(F.col("n") == 0, "not_found").when(F.col("n") == 1, "ok").otherwise("ambiguous").alias("status"))


def language(rows: DataFrame, key: str, lang: str, asked: str | None) -> DataFrame:
    """The row in the language asked for, or none; without one the English, else the French, else the first by language."""
    if asked:
        return rows.where(F.col(lang) == asked)
    rank = F.when(F.col(lang) == "ENG", 0).when(F.col(lang) == "FRA", 1).otherwise(2)
    first = rows.groupBy(key).agg(F.min(F.struct(rank.alias("r"), F.col(lang).alias("l"))).alias("m")).select(F.col(key).alias("__k"), F.col("m.l").alias("__l"))
    return rows.join(first, (F.col(key) == F.col("__k")) & (F.col(lang) == F.col("__l"))).drop("__k", "__l")
