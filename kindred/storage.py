"""Where intermediate tables live: the shared folder that the cluster names."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Used only where ``spark.checkpoint.dir`` is unset and driver and executors are one process (tests, a laptop).
LOCAL_FALLBACK = "file:///tmp/checkpoints"
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; an error where a cluster names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master == "local" or master.startswith("local["):
        return LOCAL_FALLBACK
    raise RuntimeError("spark.checkpoint.dir is unset: executors need a shared folder for intermediate tables")


def new_folder(spark: SparkSession, kind: str) -> str:
    path = f"{shared_dir(spark)}/kindred-{kind}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


#: Bytes of input for one file of a table that is made from it.
FILE_BYTES = 16 << 20


def sized(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the table ``like``, of about the same size, has pieces of FILE_BYTES, and at least one for each core; never in more than it has.

    For what is made from a scan row by row: a task of several partitions keeps the sort buffers of all of them.
    """
    return df.coalesce(pieces(like))


def pieces(like: DataFrame) -> int:
    """Pieces of FILE_BYTES in a stored table, at least one for each core."""
    estimate = int(str(like._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(1 << 30, max(like.sparkSession.sparkContext.defaultParallelism, -(-estimate // FILE_BYTES)))


def dealt(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df``, made by a shuffle, dealt anew to pieces by the size of the stored table ``like`` where it would fall into far more files.

    Adaptive execution merges small partitions, if it may; this is for sessions where it may not. Not for rows that
    are numbered on their way: a map task that is run again may number them otherwise.
    """
    conf = df.sparkSession.conf
    if all(conf.get(f"spark.sql.adaptive.{x}") == "true" for x in ("enabled", "coalescePartitions.enabled")):
        return df
    n = pieces(like)
    return df.repartition(n) if int(conf.get("spark.sql.shuffle.partitions")) > 4 * n else df


def staged(df: DataFrame, kind: str = "stage", few: bool = False, like: DataFrame | None = None, by: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. ``few``: for tables that are small
    beside the input (counts, edges, keys); they are dealt to a thirty-second of the shuffle partitions instead of
    one tiny file from each. ``like``: a table of about the same size, see ``sized``. ``by``: such a table too, for
    what comes out of a shuffle, see ``dealt``.
    """
    spark = df.sparkSession
    if few:
        df = df.repartition(max(2, int(spark.conf.get("spark.sql.shuffle.partitions")) // 32))
    elif like is not None:
        df = sized(df, like)
    elif by is not None:
        df = dealt(df, by)
    path = new_folder(spark, kind)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kindred_folder = path
    return out


def release_shuffles(spark: SparkSession) -> None:
    """Let executors delete shuffle files that nothing needs any more.

    They stay until the driver happens to collect its garbage, which a driver that only plans does rarely. To be called once
    a large staged table is written: what lies behind it is never read again.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def forget(df: DataFrame) -> None:
    """Delete what ``staged`` wrote for ``df``, once nothing reads it any more."""
    path = getattr(df, "_kindred_folder", None)
    if path:
        drop_folder(df.sparkSession, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete all folders made inside, but for those of staged tables that are put into the list."""
    keep: list[DataFrame] = []
    _open.append([])
    try:
        yield keep
    finally:
        held = {df._kindred_folder for df in keep}
        for path in _open.pop():
            if path in held:
                if _open:
                    _open[-1].append(path)
            else:
                drop_folder(spark, path)
