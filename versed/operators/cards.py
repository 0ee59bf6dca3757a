"""Cards of acts and works: their dated texts, what those consist of, the revision of a day, identifiers, citation data, registers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versed.operators import index, temporal

# fixed values: the shape of a base act's identifier, and the date at the end of a dated text's
BASE_ACT = r"^3\d{4}[A-Z]{1,2}\d{1,5}(?:\(\d{2}\))?$"
DATED_TEXT = r"-(\d{8})$"
# fixed value: how far a decision of an international forum binds
BINDING_SCOPE = "parties_and_this_case_only"


def consolidations(acts: DataFrame, links: DataFrame, act: str, dated: str) -> DataFrame:
    """act, dated and day: the texts based on a base act, whose id is the act's in sector 0 with a date; others go.

    links has (act, dated). A date that isn't one makes no row; repeated links make one.
    """
    base = acts.where(F.col(act).rlike(BASE_ACT)).select(act).distinct()
    own = F.col(dated).startswith(F.concat(F.lit("0"), F.substring(act, 2, 100), F.lit("-")))
    day = F.try_to_timestamp(F.nullif(F.regexp_extract(dated, DATED_TEXT, 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")
    return links.select(act, dated).distinct().join(base, act).where(own).withColumn("day", day).where("day is not null")


def composition(links: DataFrame, dated: str, part: str) -> DataFrame:
    """dated and parts: the acts that a dated text is made of, in order; one without parts has no row."""
    return links.where(F.col(part).isNotNull() & F.col(dated).isNotNull()).groupBy(dated).agg(F.array_sort(F.collect_set(part)).alias("parts"))


def act_cards(acts: DataFrame, texts: DataFrame, act: str, dated: str, today: Column) -> DataFrame:
    """Acts (act, in_force, ended, as_of) with their latest text and the revision of the day asked for.

    texts is (act, dated, day). latest_id and latest_day: the last text not after `today`, of equal days the greatest id;
    historical and ended: whether the act is no longer in force, and since when, told only beside such a text. revision_status
    is null where no day is asked; else as temporal.as_of says, with revision_id and its bounds where the day is proved.
    """
    named = texts.groupBy(act, F.col("day").alias("valid_from")).agg(F.max(dated).alias("revision_id"))
    latest = named.where(F.col("valid_from") <= today).groupBy(act).agg(F.max(F.struct("valid_from", "revision_id")).alias("last"))
    asked = acts.where("as_of is not null").select(act, "as_of").distinct()
    proved = temporal.as_of(asked, texts, act, "day").withColumnRenamed("status", "revision_status").join(named, [act, "valid_from"], "left")
    rows = acts.join(latest, act, "left").join(proved, [act, "as_of"], "left")
    gone = F.col("last").isNotNull() & ~F.coalesce("in_force", F.lit(True))
    return rows.select(
        act, F.col("last.revision_id").alias("latest_id"), F.col("last.valid_from").alias("latest_day"), gone.alias("historical"), F.when(gone, F.col("ended")).alias("ended"),
        "as_of", "revision_status", "revision_id", "valid_from", "valid_to", "known_through",
    )


def second_identifier(asked: DataFrame, works: DataFrame, ident: str, other: str) -> DataFrame:
    """Asked ids with their other id and a status: ok, none (the work has no such id) or not_found (there is no such work)."""
    known = works.where(F.col(ident).isNotNull()).groupBy(ident).agg(F.min(F.nullif(F.trim(other), F.lit(""))).alias(other), F.lit(True).alias("__known"))
    status = F.when(F.col("__known").isNull(), "not_found").when(F.col(other).isNull(), "none").otherwise("ok")
    return asked.join(known, ident, "left").withColumn("status", status).drop("__known")


def citation_data(values: dict[str, Column], nested: dict[str, Column] | None = None) -> Column:
    """A map of the named values that aren't blank; a value of the row wins over one of the nested revision, a time after a date goes."""
    def entry(name: str) -> Column:
        own = values.get(name, F.lit(None)).cast("string")
        value = F.coalesce(F.when(F.trim(own) != "", own), F.nullif((nested or {}).get(name, F.lit(None)).cast("string"), F.lit("")))
        if name.endswith("_date"):
            value = F.regexp_replace(value, r"^(\d{4}-\d{2}-\d{2})[T ]\d{2}:\d{2}.*$", "$1")
        return F.when(value.isNotNull(), F.struct(F.lit(name).alias("key"), value.alias("value")))

    return F.map_from_entries(F.array_compact(F.array(*map(entry, dict.fromkeys([*(nested or {}), *values])))))


def binding_scope(kind: Column, name: Column) -> Column:
    """(scope, notice) of a decision of an international forum, which binds its parties in this case only; null for others."""
    said = F.concat(F.lit("A decision of "), name, F.lit(" binds only the parties, and only in this case."))
    return F.when(kind == "international_forum", F.struct(F.lit(BINDING_SCOPE).alias("scope"), said.alias("notice")))


def registers(asked: DataFrame, table: DataFrame, known: Iterable[str]) -> DataFrame:
    """Asked (request, legal_order) with the registers (adapter, legal_order; a small table) of that order, or of all where it is blank.

    status is unknown_legal_order for an order that isn't known; a known one without registers is ok with none.
    """
    order = F.upper(F.trim(F.coalesce("legal_order", F.lit(""))))
    meets = table.select(F.explode(F.array("legal_order", F.lit(""))).alias("legal_order"), "adapter").distinct()
    meets = meets.groupBy("legal_order").agg(F.array_sort(F.collect_set("adapter")).alias("adapters"))
    ok = (F.col("legal_order") == "") | F.col("legal_order").isin(*known)
    none = F.array().cast("array<string>")
    rows = asked.withColumn("legal_order", order).join(meets, "legal_order", "left").withColumn("adapters", F.when(ok, F.coalesce("adapters", none)).otherwise(none))
    return rows.select("request", "legal_order", F.when(ok, "ok").otherwise("unknown_legal_order").alias("status"), "adapters", F.size("adapters").alias("total"))


def across(docs: DataFrame, key: str, path: str, queries: DataFrame, query: str, asked: str, k: int, **fields: str) -> DataFrame:
    """query, key and hits of the best k documents with every term of each query; the index at `path` is built first where there is none, and read as it is where there is one."""
    if index.state(docs.sparkSession, path) is None:
        index.build(docs, key, path, **fields)
    hits = index.counted(index.found(queries, query, asked, path))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("hits"), F.col("key")))  # kept to k a task before the shuffle
    return hits.withColumn("place", place).where(F.col("place") <= k).drop("place")
