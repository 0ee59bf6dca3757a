"""Which source answers which operation on which class of document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from versed.operators.records import pick

#: Any class, on either side.
ANY = "any"


def matching(asked: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Asked (request, operation, document_class) with the capabilities that fit; `any` fits both ways.

    Each side is expanded by the classes it can meet, so that the match is an equi-join.
    """
    want = asked.withColumn("__class", F.explode(F.when(F.col("document_class") == ANY, F.array(F.lit("*"))).otherwise(F.array("document_class", F.lit(ANY)))))
    have = capabilities.withColumnRenamed("document_class", "capability_class").withColumn("__class", F.explode(F.array("capability_class", F.lit("*"))))
    return want.join(have, ["operation", "__class"]).drop("__class").distinct()


def route(asked: DataFrame, capabilities: DataFrame, sources: DataFrame) -> DataFrame:
    """request, source_id and reason: the first verified and wired source by verified layer, declared layer and id; else why there is none."""
    fits = matching(asked, capabilities).join(sources, "source_id")
    good = pick(fits.where("verified and wired"), ["request"], F.desc("verified_rank"), F.desc("declared_rank"), F.col("source_id"))
    seen = fits.groupBy("request").agg(F.max(F.col("verified").cast("int")).alias("v"))
    return asked.join(good.select("request", "source_id"), "request", "left").join(seen, "request", "left").select(
        "request", "source_id", F.when(F.col("source_id").isNotNull(), "").when(F.col("v").isNull(), "no_capability").when(F.col("v") == 1, "not_wired").otherwise("not_verified").alias("reason"),
    )


def described(sources: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Sources with their capabilities nested, in order of operation and class."""
    nested = capabilities.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("operation", "document_class", "layer"))).alias("capabilities"))
    return sources.join(nested, "source_id", "left")


def verified_layer(capabilities: DataFrame, rank: str) -> DataFrame:
    """source_id and the verified layer of the highest rank, of equals the first by name."""
    w = W.partitionBy("source_id").orderBy(F.desc(rank), "layer")
    return capabilities.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("source_id", "layer")
