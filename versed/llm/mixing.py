"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is (its weight x the rows wanted) / its rows. Each document's number of copies is the
inverse Poisson distribution function at a uniform number that a seeded hash of its doc_id gives, so a run repeats
exactly and neither depends on partitions nor on other documents. Rates above MOST are split into equal parts with a
number each, whose sum has the same distribution. Documents are exploded by their count and sorted by a hash of
(doc_id, copy) over all partitions: a global shuffle. Rows with the same hash, as repeated rows have, may be split.

Only DataFrame functions are used. Rows are counted with partial aggregation; the table of rates joins by broadcast
while it has at most SMALL sources, else by (source, salt), so that a source with a third of all rows is spread.

Defined cases: a null source is a source of its own; a row with a null doc_id is told by a hash of its text, and the
empty id if that is null too; rows with equal doc_id get equal counts; weights are relative, a source without one (when
weights are given) goes; an empty table gives an empty result; texts pass through whole; columns of the input keep their
names, and any that are named copy_no, n_copies or shuffle_key are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from versed.llm.common import cut, whole_row

#: Largest mean of one inversion, and terms of its distribution function (1 - F is below 1e-30 then).
MOST, TERMS = 8.0, 60
#: Sources up to which the rates are broadcast, and salts beyond that.
SMALL, SALTS = 10_000, 64


def uniform(seed: int, *parts: Column) -> Column:
    """A number in (0, 1) from 52 bits of a hash."""
    text = F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(2**52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, wanted: int | None = None) -> tuple[DataFrame, int]:
    """source (as `of`), rate, parts and the distribution function (array) of one part for each source, and the number of sources."""
    counts = docs.groupBy(F.col("source").alias("of")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        counts = counts.withColumn("weight", F.coalesce(*(F.when(F.col("of").eqNullSafe(F.lit(k)), float(w)) for k, w in weights.items()), F.lit(0.0)))
    counts = cut(counts)
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"), F.count(F.lit(1)).alias("sources")).first()
    mean = F.col("weight") / F.lit(sums["weight"] or 1.0) * F.lit(sums["n"] if wanted is None else float(wanted)) / F.col("n")
    rows = counts.where(F.col("weight") > 0)
    rows = rows.select("of", mean.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST)).cast("int"))
    rows = rows.withColumn("mu", F.col("rate") / F.col("parts"))
    first = F.struct(F.exp(-F.col("mu")).alias("p"), F.array(F.exp(-F.col("mu"))).alias("cdf"))

    def term(so_far: Column, k: Column) -> Column:
        p = so_far["p"] * F.col("mu") / k
        return F.struct(p.alias("p"), F.array_append(so_far["cdf"], F.element_at(so_far["cdf"], -1) + p).alias("cdf"))

    return rows.select("of", "rate", "parts", F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, term, lambda s: s["cdf"]).alias("cdf")), sums["sources"]


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, wanted: int | None = None, seed: int = 17, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of `docs`, with copy_no (1 up), n_copies and shuffle_key: as many rows of a document as its draw says, in shuffled order."""
    table, sources = rates(docs, weights, wanted)
    names = [c for c in docs.columns if c not in ("copy_no", "n_copies", "shuffle_key")]
    key = F.coalesce(F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("string").cast("binary")), F.lit(""))
    rows = docs.select(whole_row(docs, names), F.col("source").alias("from"), key.alias("key"))
    same = F.col("from").eqNullSafe(F.col("of"))
    table = table.select("of", "parts", "cdf")
    if sources <= SMALL:
        joined = rows.join(F.broadcast(table), same)
    else:
        salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("own") == F.col("salt")))

    def drawn(i: Column) -> Column:
        return F.struct(uniform(seed, F.lit("n"), F.col("key"), i).alias("u"))

    def below(u: Column) -> Column:
        return F.size(F.filter("cdf", lambda c: c < u))

    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), drawn)
    copies = F.aggregate(draws, F.lit(0), lambda n, d: n + below(d["u"]))
    out = joined.select("row", "key", copies.alias("n_copies")).where("n_copies > 0")
    out = out.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    text = F.concat_ws(":", F.lit(str(seed)), F.lit("at"), F.col("key"), F.col("copy_no").cast("string"))
    out = out.withColumn("shuffle_key", F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long"))
    out = out.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("shuffle_key", "tie").sortWithinPartitions("shuffle_key", "key", "tie")
    return out.select(*(F.col("row").getField(c).alias(c) for c in names), "copy_no", "n_copies", "shuffle_key")
