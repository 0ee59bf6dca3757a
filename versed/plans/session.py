"""What a session needs for the plans of this library."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

import versed

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application; Python workers import it from there."""
    name = spark.sparkContext.applicationId
    if name in _shipped:
        return
    top = Path(versed.__file__).parent
    path = Path(tempfile.mkdtemp(prefix="spark-")) / "versed.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(name)


#: Rows and bytes that a Python worker gets at once.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def bounded(spark: SparkSession) -> None:
    """Ship the package, and bound the Arrow batches of this session from now on, so that a worker's memory doesn't grow with the length of texts. Spark reads these settings when a plan runs, so they can't be put back before."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where it is unset and all runs in this process, as in tests."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.getCheckpointDir():
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()
