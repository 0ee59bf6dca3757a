"""Reading the tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Tables that a data folder may hold, one Parquet file or folder each.
TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as Spark reads it from any file system; columns are pruned and filters pushed down by the plans above."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
