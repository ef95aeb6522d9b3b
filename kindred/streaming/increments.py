"""Resumable batches over a growing folder: each micro-batch commits its rows and its place together."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def process_new_files(spark: SparkSession, source: str, schema: StructType, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 64) -> int:
    """Apply ``transform`` to files that no earlier call has seen and append the rows to ``out``; returns the number of batches.

    A file sink commits a batch and its place in one log, so a call that dies is taken up where it stopped. Batches
    are counted in that log: progress reports are kept for the last hundred only.
    """
    before = _committed(spark, checkpoint)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = transform(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return _committed(spark, checkpoint) - before


def _committed(spark: SparkSession, checkpoint: str) -> int:
    """Number of batches in the commit log of a checkpoint."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sum(f.getPath().getName().isdigit() for f in fs.listStatus(path)) if fs.exists(path) else 0
