"""Sources and sinks: explicit schemas, guarded roles, and writes that refuse to replace."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FUNCTION_ROWS = T.StructType([T.StructField(n, T.StringType()) for n in ("_split", "repository_name", "func_path_in_repository", "func_name", "whole_func_string")])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, split: str | None = None) -> DataFrame:
    """JSONL (plain or gzip) with its source file; blank lines are skipped, malformed ones raise."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path).withColumn("_source_file", F.col("_metadata.file_path"))
    return df if split is None else df.withColumn("_split", F.lit(split))


def any_of(df: DataFrame, *names: str):
    """The first of several columns that a row has."""
    there = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


def write_once(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet; an existing target is an error."""
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def missing_from(df: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Rows that a cache does not have yet."""
    return df.join(cache.select(key).distinct(), key, "left_anti")


def page_after(df: DataFrame, keys: list[str], after: tuple | None, n: int) -> DataFrame:
    """Keyset page: the n rows after a key, in key order."""
    if after is not None:
        df = df.where(F.struct(*keys) > F.struct(*[F.lit(a).alias(k) for k, a in zip(keys, after, strict=True)]))
    return df.orderBy(*keys).limit(n)
