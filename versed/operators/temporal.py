"""Validity intervals, point-in-time lookups, freshness and change states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAYS = 30


def intervals(dates: DataFrame, key: str, day: str) -> DataFrame:
    """key, valid_from, valid_to (the next date less a day), is_current and known_through (the last date) of distinct dates."""
    rows = dates.select(key, F.col(day).cast("date").alias("valid_from")).where("valid_from is not null").distinct()
    w = W.partitionBy(key).orderBy("valid_from")
    nxt = F.lead("valid_from").over(w)
    return rows.select(key, "valid_from", F.date_sub(nxt, 1).alias("valid_to"), nxt.isNull().alias("is_current"), F.max("valid_from").over(W.partitionBy(key)).alias("known_through"))


def as_of(asked: DataFrame, dates: DataFrame, key: str, day: str) -> DataFrame:
    """For each asked (key, as_of): the revision in force, if the known dates prove one.

    Before the first date and after the last nothing is proved: revision_unknown. On the last date the revision is open.
    Dates and questions are laid in one ordered line for each key, so no range join is needed.
    """
    known = dates.select(F.col(key).alias("k"), F.col(day).cast("date").alias("d")).where("d is not null").distinct()
    once = asked.select(F.col(key).alias("k"), F.col("as_of").alias("d")).distinct()  # a line is no longer than the calendar
    line = known.select("k", "d", F.lit(0).alias("turn"), F.col("d").alias("from")).unionByName(once.select("k", "d", F.lit(1).alias("turn"), F.lit(None).cast("date").alias("from")))
    w = W.partitionBy("k").orderBy("d", "turn")
    line = line.select("k", "d", "turn", F.last("from", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("valid_from"), F.first("from", ignorenulls=True).over(w.rowsBetween(1, W.unboundedFollowing)).alias("next"), F.max("from").over(W.partitionBy("k")).alias("last"))
    rows = line.where("turn = 1")
    ok = F.col("valid_from").isNotNull() & (F.col("d") <= F.col("last"))
    told = rows.select(
        F.col("k").alias("__k"), F.col("d").alias("__d"), F.when(F.col("last").isNull(), "not_found").when(ok, "ok").otherwise("revision_unknown").alias("status"),
        F.when(ok, F.col("valid_from")).alias("valid_from"), F.when(ok, F.date_sub("next", 1)).alias("valid_to"), F.when(ok & F.col("next").isNull(), F.col("last")).alias("known_through"),
    )
    return asked.select(key, "as_of").join(told, F.col(key).eqNullSafe(F.col("__k")) & F.col("as_of").eqNullSafe(F.col("__d"))).drop("__k", "__d")


def current(dates: DataFrame, key: str, day: str, today: Column) -> DataFrame:
    """key and the latest date that isn't after today; null if all are."""
    d = F.col(day).cast("date")
    return dates.groupBy(key).agg(F.max(F.when(d <= today, d)).alias("valid_from"))


def fresh(age_days: Column, ttl: Column) -> Column:
    """Younger than its time to live; a missing age is stale, 0 or null days to live count as 30."""
    return F.coalesce(age_days < F.coalesce(F.nullif(ttl, F.lit(0)), F.lit(DAYS)), F.lit(False))


def change_state(rows: DataFrame, part: list[str], order: str, digest: str, span: int = 1 << 16) -> DataFrame:
    """Rows with prev_hash and state: unknown without a row before, else same or changed.

    `order` is a whole number, one row each: a row looks back inside its stretch of it, the first of a stretch to the last
    row of the stretch before, so no task walks a whole part.
    """
    rows = rows.withColumn("__at", F.floor(F.col(order) / span))
    lasts = rows.groupBy(*part, "__at").agg(F.max_by(digest, order).alias("__last"))
    lasts = lasts.withColumn("__carried", F.lag("__last").over(W.partitionBy(*part).orderBy("__at"))).select(*(F.col(c).alias(f"__k{k}") for k, c in enumerate([*part, "__at"])), "__carried")
    same = F.lit(True)
    for k, c in enumerate([*part, "__at"]):
        same = same & F.col(c).eqNullSafe(F.col(f"__k{k}"))
    own = W.partitionBy(*part, "__at").orderBy(order)
    rows = rows.join(lasts, same).withColumn("prev_hash", F.when(F.row_number().over(own) == 1, F.col("__carried")).otherwise(F.lag(digest).over(own)))
    state = F.when(F.col("prev_hash").isNull(), "unknown").when(F.col("prev_hash") == F.col(digest), "same").otherwise("changed")
    return rows.withColumn("state", state).drop("__at", "__carried", *(f"__k{k}" for k in range(len(part) + 1)))


def stale_while_error(cached: Column, is_fresh: Column, fetched: Column) -> Column:
    """(served, served_from, stale): the fresh copy, else what was fetched, else the old copy marked stale."""
    blank = fetched.isNull() | (F.trim(fetched) == "")
    return F.struct(
        F.when(cached.isNotNull() & is_fresh, cached).when(~blank, fetched).otherwise(cached).alias("served"),
        F.when(cached.isNotNull() & is_fresh, "cache").when(~blank, "source").when(cached.isNotNull(), "stale_cache").otherwise("none").alias("served_from"),
        (cached.isNotNull() & ~is_fresh & blank).alias("stale"),
    )


def covers(valid_from: Column, valid_to: Column, day: Column) -> Column:
    return (valid_from <= day) & (valid_to.isNull() | (day <= valid_to))


def amending(composition: Column, own: Column, dated_prefix: Column) -> Column:
    """The acts of a composition that are neither the act itself nor its dated texts."""
    return F.array_sort(F.filter(F.array_except(composition, F.array(own)), lambda x: ~x.startswith(dated_prefix)))


def catalogue_state(is_fresh: Column, downloaded: Column, fetched_at: Column) -> Column:
    """(state, from_cache, stale_since) of a catalogue: cache while the copy is fresh, live after a download, stale with the day of the old copy when that failed, unavailable without any."""
    state = F.when(is_fresh & fetched_at.isNotNull(), "cache").when(downloaded, "live").when(fetched_at.isNotNull(), "stale").otherwise("unavailable")
    return F.struct(state.alias("state"), (state != "live").alias("from_cache"), F.when(state == "stale", fetched_at).alias("stale_since"))
