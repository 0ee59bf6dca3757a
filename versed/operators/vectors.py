"""Approximate nearest vectors by an inverted file: a stored table of vectors by cell, of which a query reads the nearest cells only.

Cells are those of k-means (cosine) on a sample of SAMPLE rows at most, those with the least hashes of their key; every row
is indexed. How many cells a query reads is measured when the index is built: TRIED of its rows are asked for their exact
neighbours, and as many cells as hold the share WANTED of those are the default. Where vectors lie in clusters these are
few; where they lie in all directions alike, no cells help much, and half of them may be needed. A cell's vectors may lie in many files, so a hot cell is no task of its own; a query joins its nearest
`probes` cells by an equi-join, which adaptive execution splits, and scores what it finds there exactly. With as many
probes as cells the result is that of search.nearest.

Vectors that are null, have a null component or no length, and those of another length than the most frequent one are in
no cell and have no neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from versed.operators import search
from versed.plans.session import bounded
from versed.sources.documents import read_table, replace_table

#: Rows that k-means learns from, cells at most; rows asked when probes are measured, neighbours of each, and the share of these to be found.
SAMPLE, CELLS, TRIED, NEIGHBOURS, WANTED = 50_000, 4096, 64, 10, 0.95
#: Rows of a task of k-means.
SHARE = 1024


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key and unit (doubles, of length 1) of the rows that can have neighbours."""
    v = F.col("v")
    rows = vectors.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))).where("norm > 0 and norm < double('infinity')")
    return rows.select("key", F.transform(v, lambda x: x / F.col("norm")).alias("unit"))


def build(vectors: DataFrame, key: str, vector: str, path: str, cells: int | None = None, wanted: float = WANTED) -> tuple[int, int]:
    """Write the index of all usable rows to `path`, and return its numbers of cells (about the root of the number of rows unless given) and of those that a query reads."""
    spark = vectors.sparkSession
    bounded(spark)
    rows = usable(vectors, key, vector)
    sizes = rows.groupBy(F.size("unit").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "size").first()
    length, n = (sizes["size"], sizes["n"]) if sizes else (0, 0)
    rows = rows.where(F.size("unit") == length)
    cells = min(CELLS, max(1, n), cells or max(1, round(math.sqrt(n))))
    centres = np.zeros((0, length))
    if n:
        some = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).repartition(1 + min(n, SAMPLE) // SHARE, "key")  # a limit leaves one partition, and k-means one task
        some = some.select(array_to_vector("unit").alias("features"))
        centres = np.array(KMeans(k=cells, seed=1, maxIter=15, distanceMeasure="cosine").fit(some).clusterCenters())
    table = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centres)], "cell int, centre array<double>")
    replace_table(dealt(rows, centres, 1).repartitionByRange("cell", "key").sortWithinPartitions("cell", "key"), f"{path}/vectors")
    probes = measured(read_table(spark, f"{path}/vectors"), centres, wanted)
    replace_table(table.withColumn("probes", F.lit(probes)), f"{path}/centres")
    return len(centres), probes


def measured(stored: DataFrame, centres: np.ndarray, wanted: float) -> int:
    """The number of a query's nearest cells that hold the share `wanted` of its exact neighbours, by TRIED rows of the index."""
    asked = stored.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(TRIED).select("key", "unit")
    exact = search.nearest(asked, stored.select("key", "unit"), "key", "unit", NEIGHBOURS)
    found = exact.join(stored.select("key", "cell"), "key").select("query", "cell").collect()  # TRIED x NEIGHBOURS rows at most
    orders = {r["key"]: np.argsort(np.argsort(-(centres @ np.array(r["unit"])), kind="stable"), kind="stable") for r in asked.collect()}
    ranks = np.sort([orders[r["query"]][r["cell"]] for r in found])
    return int(ranks[math.ceil(wanted * len(ranks)) - 1]) + 1 if len(ranks) else 1


def dealt(rows: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """key, unit and cell: a row for each of the `probes` nearest cells."""
    sent = rows.sparkSession.sparkContext.broadcast(centres)  # at most CELLS centres

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = min(probes, len(sent.value))
        for batch in batches:
            if batch.num_rows and most:
                x = batch.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near = np.argsort(-(x @ sent.value.T), axis=1, kind="stable")[:, :most]
                yield batch.take(pa.array(np.repeat(np.arange(batch.num_rows), most))).append_column("cell", pa.array(near.ravel().astype(np.int32)))

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *StructType.fromDDL("cell int")]))


def blocks(rows: DataFrame) -> DataFrame:
    """cell, keys and units (doubles in turn): the rows (key, unit, cell) of each Arrow batch by cell, so that many are compared at once and none is paired by itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.append(True, cell[order][1:] != cell[order][:-1]))
            x = batch.column("unit").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            keys = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)).astype(np.int32)), batch.column("key").take(pa.array(order)))
            units = [x[at].tobytes() for at in np.split(order, starts[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(cell[order[starts]]), keys, pa.array(units, pa.binary())], names=["cell", "keys", "units"])

    return rows.select("key", "unit", "cell").mapInArrow(run, StructType([rows.schema["cell"], StructField("keys", ArrayType(rows.schema["key"].dataType)), *StructType.fromDDL("units binary")]))


def centres_of(spark: SparkSession, path: str) -> tuple[np.ndarray, int]:
    """The centres of the cells, and how many cells a query reads."""
    rows = read_table(spark, f"{path}/centres").orderBy("cell").collect()  # at most CELLS
    return np.array([r["centre"] for r in rows]), rows[0]["probes"] if rows else 1


def nearest(queries: DataFrame, key: str, vector: str, path: str, k: int, probes: int | None = None) -> DataFrame:
    """query, key and score: for each query the k nearest others by cosine (9 decimals, ties by key) in its `probes` nearest cells, by default as many as were measured."""
    spark = queries.sparkSession
    bounded(spark)
    centres, own = centres_of(spark, path)
    length = centres.shape[1] if len(centres) else 0
    asked = dealt(usable(queries, key, vector).where(F.size("unit") == length), centres, probes or own)
    rows = read_table(spark, f"{path}/vectors")
    questions = blocks(asked.repartition("cell").sortWithinPartitions("cell")).select("cell", F.col("keys").alias("queries"), F.col("units").alias("asked"))
    pairs = blocks(rows).join(questions, "cell").select("queries", "asked", "keys", "units")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, asked, keys, units in zip(batch.column("queries"), batch.column("asked"), batch.column("keys"), batch.column("units"), strict=True):
                a, b = (np.frombuffer(x.as_py()).reshape(-1, length) for x in (asked, units))
                score = np.round(a @ b.T, 9)
                score[queries.values.to_numpy(zero_copy_only=False)[:, None] == keys.values.to_numpy(zero_copy_only=False)] = -np.inf  # not itself
                by_key = np.argsort(keys.values.to_numpy(zero_copy_only=False), kind="stable")
                best = by_key[np.argsort(-score[:, by_key], axis=1, kind="stable")[:, :k]]
                of = np.repeat(np.arange(len(a)), best.shape[1])
                value = score[of, best.ravel()]
                real = value > -np.inf
                yield pa.RecordBatch.from_arrays([queries.values.take(pa.array(of[real])), keys.values.take(pa.array(best.ravel()[real])), pa.array(value[real])], names=["query", "key", "score"])

    kinds = (StructField("query", asked.schema["key"].dataType), StructField("key", rows.schema["key"].dataType))
    scored = pairs.mapInArrow(run, StructType([*kinds, *StructType.fromDDL("score double")]))
    place = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.col("key")))  # kept to k a task before the shuffle
    return scored.withColumn("place", place).where(F.col("place") <= k).select("query", "key", "score")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """The share of the exact neighbours (query, key) that were found."""
    right = exact.join(found.select("query", "key"), ["query", "key"], "left_semi").count()
    return right / max(1, exact.count())
