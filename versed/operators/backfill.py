"""Filling in what is missing, in batches that survive being killed: vectors of units, and units of versions.

Progress is the table itself: a wave takes rows that the table lacks, works them out in batches, and appends what it got as
one commit. A run that is killed loses the wave in flight only; the next run takes what is still missing, so each row is
stored once. A function that fails (a quota, a broken connection) is tried again with the next batch, and after
`most_failures` failures in a row without a success the run stops and says what is left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from versed.operators.corpus import missing
from versed.plans.session import bounded

# Rows of a batch, failures in a row after which a run stops, characters of a text that a vector is made from.
BATCH, MOST_FAILURES, CHARS = 32, 6, 6000

#: Waves of no more rows than this are worked out by one task.
ONE_TASK = 4096


@dataclass(frozen=True)
class Report:
    written: int
    failed_batches: int
    remaining: int
    stopped: bool


def stored(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """key, vector and model that have been written so far."""
    schema = f"key {key_type}, vector array<double>, model string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def wave(rows: DataFrame, embed: Callable[[list[str]], list], batch: int, most_failures: int) -> DataFrame:
    """key, vector (null where there is none) and failed, the number of the failed batch: of each batch of the rows (key, text) in a task; a task stops after that many failures in a row."""
    bounded(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_a_row = failed = 0

        def answered(keys: list, texts: list[str]) -> pa.RecordBatch:
            nonlocal in_a_row, failed
            vectors, error = [None] * len(keys), None
            if in_a_row < most_failures:
                try:
                    vectors = [list(map(float, v)) if v is not None and len(v) else None for v in embed(texts)]
                    in_a_row = 0 if any(vectors) else in_a_row + 1
                except Exception:  # whatever the given function raises is a failed batch
                    in_a_row += 1
                if in_a_row:
                    failed += 1
                    error = failed
            return pa.RecordBatch.from_arrays([pa.array(keys, type=kind), pa.array(vectors, type=pa.list_(pa.float64())), pa.array([error] * len(keys), type=pa.int32())], names=["key", "vector", "failed"])

        keys, texts, kind = [], [], pa.null()
        for b in batches:
            kind = b.schema.field("key").type
            keys += b.column("key").to_pylist()
            texts += b.column("text").to_pylist()
            while len(keys) >= batch:
                yield answered(keys[:batch], texts[:batch])
                keys, texts = keys[batch:], texts[batch:]
        if keys:
            yield answered(keys, texts)

    return rows.mapInArrow(run, StructType([rows.schema["key"], *StructType.fromDDL("vector array<double>, failed int")]))


def first_of(gap: DataFrame, n: int) -> DataFrame:
    """The first n rows by place and key, in order: of many rows only places and keys pass through one task, to tell where the n-th is, and the texts are sorted in ranges."""
    if n <= ONE_TASK:
        return gap.orderBy("place", "key").limit(n)
    if gap.count() > n:
        last = gap.select("place", "key").orderBy("place", "key").limit(n).agg(F.max(F.struct("place", "key")).alias("last"))
        gap = gap.join(F.broadcast(last), F.struct("place", "key") <= F.col("last")).drop("last")  # one row
    return gap.orderBy("place", "key")


def vectors(units: DataFrame, key: str, text: str, path: str, embed: Callable[[list[str]], list], model: str, batch: int = BATCH, rows_of_a_wave: int = 4096, most_failures: int = MOST_FAILURES, most_rows: int | None = None, first: Column | None = None) -> Report:
    """Store a vector of each unit with a text that `path` has none of. `embed` turns texts (cut to CHARS) into as many vectors, or raises; empty vectors aren't stored. `first` is what the order begins with, then the key."""
    spark = units.sparkSession
    kind = units.schema[key].dataType.simpleString()
    rows = units.where(F.col(key).isNotNull() & (F.trim(F.coalesce(F.col(text), F.lit(""))) != "")).withColumn("__first", first if first is not None else F.lit(0))
    rows = rows.groupBy(F.col(key).alias("key")).agg(F.min(F.substring(text, 1, CHARS)).alias("text"), F.min("__first").alias("place"))
    written = failed = in_a_row = 0
    while in_a_row < most_failures and (most_rows is None or written < most_rows):
        gap = first_of(missing(rows, stored(spark, path, kind), "key", "key"), min(rows_of_a_wave, rows_of_a_wave if most_rows is None else most_rows - written))
        made = wave(gap.select("key", "text"), embed, batch, most_failures).cache()
        try:
            tried, got, bad = made.agg(F.count(F.lit(1)), F.count("vector"), F.coalesce(F.max("failed"), F.lit(0))).first()
            if not tried:
                break
            if got:
                made.where("vector is not null").select("key", "vector", F.lit(model).alias("model")).write.mode("append").parquet(path)
        finally:
            made.unpersist()
        written, failed = written + got, failed + bad
        in_a_row = 0 if got else in_a_row + max(1, bad)
    left = missing(rows, stored(spark, path, kind), "key", "key").count()
    return Report(written, failed, left, in_a_row >= most_failures)


def units(versions: DataFrame, key: str, text: str, have: DataFrame, other: str, chunked: Callable[[str], list[tuple]]) -> DataFrame:
    """key, num, ordinal and body: the pieces of each version that has no unit yet; `chunked` gives (num, ordinal, body) of a text."""
    from versed.functions.python import flat

    gap = missing(versions.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != ""), have, key, other)
    return flat(gap, [key], [text], "num string, ordinal long, body string", chunked)
