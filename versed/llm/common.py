"""What the operators share: session settings, cut lineage, bounded Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from versed.plans.session import ship

#: Rows and bytes of text that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session from now on, so that a worker's memory doesn't grow with the length of documents. Spark reads these settings when a plan runs, so they can't be put back before."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset and all runs in this process, as in tests."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


class Scratch:
    """Tables in the shared folder that one piece of work needs until its end; as a context they go at its end, also if it fails."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.clear()

    def cut(self, df: DataFrame) -> DataFrame:
        """Write `df` as a table and read it again: later steps neither repeat its work nor depend on the executors that did it."""
        path = f"{shared_folder(self.spark)}/cut-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Remove the tables; only what has been written elsewhere may be used afterwards."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        while self.paths:
            path = hadoop(self.paths.pop())
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Write `df` as a table in the shared folder, where it stays, and read it again."""
    return Scratch(df.sparkSession).cut(df)


def named(column: str) -> F.Column:
    """The column of that very name, whatever characters it has."""
    return F.col(f"`{column.replace('`', '``')}`")


def whole_text(text: str = "text") -> F.Column:
    """The whole text; null counts as empty."""
    return F.coalesce(named(text).cast("string"), F.lit(""))


def whole_row(docs: DataFrame, names: list[str] | None = None) -> F.Column:
    """All columns of `docs` (or those) as a struct named row."""
    return F.struct(*map(named, docs.columns if names is None else names)).alias("row")


def number(column: F.Column) -> F.Column:
    """An id as a whole number; null where it is none."""
    return column.try_cast("long")


def fold(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, mod 5; labels of fold 0 are held out."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        if batch.num_rows:
            yield batch, batch.column("text").to_pylist()


def unique_labels(labels: DataFrame, name: str) -> DataFrame:
    """One label for each doc_id: nulls are left out, of several that disagree the larger counts."""
    return (
        labels.where(number(F.col("doc_id")).isNotNull() & F.col(name).isNotNull())
        .groupBy(number(F.col("doc_id")).alias("doc_id"))
        .agg(F.max(F.col(name).cast("int")).alias("label"))
    )
