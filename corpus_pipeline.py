"""A training-data pipeline over `documents`: rules, near-duplicates, secrets, source weights, tokens.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versed.llm import bpe, mixing, neardup, rules, secrets
from versed.llm.common import cut
from versed.llm.queries import ranks_and_pattern
from versed.sources.tables import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the label model keep; the others go."""
    return rules.keep(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the least id."""
    return neardup.keep_one(docs).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked; n_chars follows the text."""
    masked = secrets.redact(docs, secrets.train(secrets.samples(spark)))
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents replicated to equal shares of the sources, in global shuffle order."""
    return mixing.replicate(docs).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding gives the text again, for each copy."""
    ranks, pattern = ranks_and_pattern()
    decoded = bpe.decode(bpe.encode(docs.select(F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha")).alias("doc_id"), "text"), ranks, pattern), ranks)
    return decoded.select(
        F.col("doc_id.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", (F.sha2("decoded", 256) == F.col("doc_id.sha")).alias("round_trip"),
    )


STAGES = [
    ("quality rules", quality),
    ("near-duplicates", near_duplicates),
    ("secret scans", mask_secrets),
    ("source weights", mix_sources),
    ("byte-level BPE", tokens),
]

#: Near-duplicates, the label model and byte-pair merges have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
