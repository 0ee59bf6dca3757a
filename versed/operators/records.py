"""Choosing and collapsing rows: duplicates, best rows, completeness, lookups with a status, quotas and ladders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versed.plans.session import workspace
from versed.sources.documents import landed

#: Seconds until the next try after so many failures in a row.
LADDER = (60, 300, 1800, 7200, 86400)


def pick(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key, the first in a total order; rows with a null or empty key go."""
    named = reduce(lambda a, b: a & b, (F.col(k).isNotNull() & (F.col(k).cast("string") != "") for k in keys))
    return rows.where(named).withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def filled(*columns: Column) -> Column:
    """How many of the values are neither null nor empty."""
    return sum((F.when(c.isNotNull() & (c.cast("string") != ""), 1).otherwise(0) for c in columns), F.lit(0))


def richest(rows: DataFrame, keys: list[str], values: list[str], seq: str) -> DataFrame:
    """The row of each key with most values, the first on a tie, at the place of the key's first row (first_seq)."""
    first = rows.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min(seq).alias("first_seq"))
    best = pick(rows.withColumn("__filled", filled(*(F.col(v) for v in values))), keys, F.desc("__filled"), F.col(seq)).drop("__filled")
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__k{i}") for i, k in enumerate(keys)))
    return best.join(first, same).drop(*(f"__k{i}" for i in range(len(keys))))


def with_completeness(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of a total order, and complete: whether there are no more. Takes n + 1 rows, as a page of a source would be asked for."""
    probe = rows.orderBy(*order).limit(n + 1)
    numbered = probe.withColumn("__n", F.row_number().over(W.orderBy(*order)))  # of n + 1 rows
    numbered = numbered.withColumn("complete", F.max("__n").over(W.partitionBy()) <= n)
    return numbered.where(F.col("__n") <= n).drop("__n")


def lookup(asked: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Each asked value of `key` with its row, and status ok or not_found."""
    return asked.withColumnRenamed(key, "requested").join(rows.withColumn("__found", F.lit(True)), F.col("requested") == F.col(key), "left").withColumn(
        "status", F.when(F.col("__found"), "ok").otherwise("not_found")
    ).drop("__found")


def containment(queries: DataFrame, q: str, aliases: DataFrame, alias: str, width: int = 3) -> DataFrame:
    """Pairs in which one text contains the other, found by shared grams of `width` characters and then checked.

    A contained text has all its grams in the container, so an equi-join on any one of them finds all pairs: no cross
    join. Of each text that one is taken which the fewest of the other side have. Shorter texts meet by characters.
    """
    def grams(x: Column) -> Column:
        n = F.length(x)
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - width + 1)), lambda i: F.substring(x, i, F.lit(width)))
        short = F.transform(F.split(x, ""), lambda c: c)
        return F.array_distinct(F.when(n >= width, F.concat(many, short)).otherwise(short))

    def meet(inner: DataFrame, i: str, outer: DataFrame, o: str) -> DataFrame:
        theirs = outer.select(o).distinct().select(F.col(o).alias("__o"), F.explode(grams(F.col(o))).alias("__g"))
        common = theirs.groupBy("__g").agg(F.count(F.lit(1)).alias("__n"))
        mine = inner.select(F.col(i).alias("__i")).distinct().withColumn("__g", F.explode(grams(F.col("__i"))))
        rarest = mine.join(common, "__g").groupBy("__i").agg(F.min(F.struct("__n", "__g")).alias("__r")).select("__i", F.col("__r.__g").alias("__g"))
        pairs = rarest.join(theirs, "__g").where(F.col("__o").contains(F.col("__i"))).select("__i", "__o")
        return inner.join(pairs, inner[i] == pairs["__i"]).join(outer, outer[o] == F.col("__o")).drop("__i", "__o")

    a, b = queries.where(F.col(q) != ""), aliases.where(F.col(alias) != "")
    return meet(a, q, b, alias).unionByName(meet(b, alias, a, q)).distinct()


def stretches(rows: DataFrame, part: str, *order: str) -> DataFrame:
    """Rows with __at, their stretch of the order by part and `order`: stretches are ranges of rows of about equal size, so a hot part has many. Written, since a range isn't found again the same way."""
    spread = rows.repartitionByRange(part, *order).withColumn("__at", F.spark_partition_id())
    return landed(spread, workspace(rows.sparkSession))


def quota(rows: DataFrame, part: str, order: str, size: Column, entries: int, chars: int) -> DataFrame:
    """Rows with n (place in the part), chars (running size) and allowed: both within the quota. Sums are made by stretches and carried over, so no task walks a whole part."""
    rows = stretches(rows.withColumn("__size", size), part, order)
    before = W.partitionBy("__part").orderBy("__in").rowsBetween(W.unboundedPreceding, -1)
    sums = rows.groupBy(F.col(part).alias("__part"), F.col("__at").alias("__in")).agg(F.count(F.lit(1)).alias("__n"), F.sum("__size").alias("__all"))
    sums = sums.select("__part", "__in", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__had"), F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__used"))
    rows = rows.join(sums, F.col(part).eqNullSafe(F.col("__part")) & (F.col("__at") == F.col("__in")))
    w = W.partitionBy(part, "__at").orderBy(order)
    rows = rows.withColumns({"n": F.row_number().over(w) + F.col("__had"), "chars": F.sum("__size").over(w.rowsBetween(W.unboundedPreceding, 0)) + F.col("__used")})
    return rows.withColumn("allowed", (F.col("n") <= entries) & (F.col("chars") <= chars)).drop("__size", "__at", "__part", "__in", "__had", "__used")


def ladder(events: DataFrame, part: str, order: list[str], failed: Column) -> DataFrame:
    """Failed rows with attempt (failures in a row so far) and delay_s until the next try; a success starts anew."""
    rows = stretches(events.withColumn("__fail", F.coalesce(failed, F.lit(False))), part, *order)
    w = W.partitionBy(part, "__at").orderBy(*order)
    rows = rows.withColumn("__island", F.sum((~F.col("__fail")).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    # of a stretch: its failures after the last success in it, or all; carried into the next ones up to one with a success
    ends = rows.groupBy(F.col(part).alias("__part"), F.col("__at").alias("__in"), "__island").agg(F.count_if("__fail").alias("__n"))
    ends = ends.groupBy("__part", "__in").agg(F.max_by("__n", "__island").alias("__tail"), (F.max("__island") > 0).alias("__broken"))
    along = W.partitionBy("__part").orderBy("__in")
    before = along.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("__sum", F.coalesce(F.sum("__tail").over(before), F.lit(0)))
    ends = ends.select("__part", "__in", (F.col("__sum") - F.coalesce(F.last(F.when(F.col("__broken"), F.col("__sum")), ignorenulls=True).over(before), F.lit(0))).alias("__carried"))
    rows = rows.where("__fail").join(ends, F.col(part).eqNullSafe(F.col("__part")) & (F.col("__at") == F.col("__in")))
    own = F.row_number().over(W.partitionBy(part, "__at", "__island").orderBy(*order))
    rows = rows.withColumn("attempt", own + F.when(F.col("__island") == 0, F.col("__carried")).otherwise(0))
    delays = F.array(*(F.lit(x) for x in LADDER))
    return rows.withColumn("delay_s", F.element_at(delays, F.least(F.col("attempt"), F.lit(len(LADDER))).cast("int"))).drop("__fail", "__island", "__at", "__part", "__in", "__carried")


def values(joined: Column) -> Column:
    """Sorted distinct values of a text split on bars."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(joined, r"\|"), F.trim), lambda x: x != "")))


def single(found: Column) -> Column:
    """The only value of an array, else null."""
    return F.when(F.size(found) == 1, F.get(found, 0))


def is_expected(number: Column, expected: Column) -> Column:
    """Whether a hit is the unit that was expected, or a piece of it (number#2 and so on)."""
    return F.coalesce((number == expected) | number.startswith(F.concat(expected, F.lit("#"))), F.lit(False))
