"""A keyed store whose rows carry digests, filled batch by batch: a batch's rows and its cursor become visible together.

Rows lie in one folder for each batch, in hash buckets of the key; a batch counts once its commit file is there. A batch that
is run again after a crash replaces its own folder, so nothing is there twice. What is read is hashed again: a row whose
digest does not fit is a miss like a row that was never there.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.storage import drop_folder


class StoreFull(ValueError):
    """An insert that would pass the bound; nothing of it was written."""


def row_digest(key: str, value: Column) -> Column:
    return F.sha2(F.concat_ws("\n", F.length(F.col(key).cast("string")).cast("string"), F.col(key).cast("string"), value), 256)


class CheckedStore:
    def __init__(self, spark: SparkSession, path: str, key: str, value: str, buckets: int = 64, bound: int | None = None):
        self.spark, self.path, self.key, self.value, self.buckets, self.bound = spark, path.rstrip("/"), key, value, buckets, bound

    def _commits(self) -> list[dict]:
        fs, root = self._fs()
        if not fs.exists(self._path(f"{root}/commits")):
            return []
        texts = self.spark.read.option("wholetext", "true").text(f"{root}/commits").collect()
        return sorted((json.loads(r[0]) for r in texts), key=lambda c: c["batch"])

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.path

    def cursor(self):
        """What the last committed batch had as its cursor; null before any."""
        done = self._commits()
        return done[-1]["cursor"] if done else None

    def insert(self, rows: DataFrame, batch: int, cursor=None) -> int:
        """Add the rows whose keys are not there yet (or only in broken rows), as one batch; returns how many.

        Of repeated keys the smallest value is taken; rows with a null key or value are left out. A batch that is
        committed already adds nothing. If the store would hold more than its bound, StoreFull is raised and nothing
        is written.
        """
        done = self._commits()
        if any(c["batch"] == batch for c in done):
            return 0
        new = rows.where(F.col(self.key).isNotNull() & F.col(self.value).isNotNull()).groupBy(self.key).agg(F.min(self.value).alias(self.value))
        there = self._sound(done)
        if there is not None:
            new = new.join(there.select(self.key), self.key, "left_anti")
        new = new.withColumn("digest", row_digest(self.key, F.col(self.value))).withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        folder = f"{self.path}/batches/batch={batch}"
        new.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        n = self.spark.read.schema(new.schema).parquet(folder).count()
        if self.bound is not None and sum(c["rows"] for c in done) + n > self.bound:
            drop_folder(self.spark, folder)
            raise StoreFull(f"{n} rows more than the {sum(c['rows'] for c in done)} there pass {self.bound}")
        self._commit({"batch": batch, "rows": n, "cursor": cursor})
        return n

    def _commit(self, note: dict) -> None:
        """One small file, renamed into its place when it is whole."""
        fs, root = self._fs()
        fs.mkdirs(self._path(f"{root}/commits"))
        temp = self._path(f"{root}/.commit-{note['batch']}")
        out = fs.create(temp, True)
        out.write(bytearray(json.dumps(note).encode()))
        out.close()
        fs.rename(temp, self._path(f"{root}/commits/{note['batch']:012d}"))

    def _sound(self, done: list[dict]) -> DataFrame | None:
        """Committed rows whose digest, made again, is the stored one; null before any."""
        folders = [f"{self.path}/batches/batch={c['batch']}" for c in done if c["rows"]]
        if not folders:
            return None
        rows = self.spark.read.option("basePath", f"{self.path}/batches").parquet(*folders)
        return rows.where(row_digest(self.key, F.col(self.value)).eqNullSafe(F.col("digest")))

    def lookup(self, keys: DataFrame) -> DataFrame:
        """``(key, value, hit)`` of each row of ``keys``: a hit has a value whose digest, made again, is the stored one; null keys are misses.

        A key that is stored in a broken row and whole in another (it was added again after a repair) is a hit.
        """
        there = self._sound(self._commits())
        asked = keys.select(self.key)
        if there is None:
            return asked.select(self.key, F.lit(None).cast("string").alias(self.value), F.lit(False).alias("hit"))
        sound = there.groupBy(self.key).agg(F.min(self.value).alias(self.value))
        return asked.join(sound, self.key, "left").select(self.key, self.value, F.col(self.value).isNotNull().alias("hit"))

    def stream(self, source: DataFrame, checkpoint: str, cursor: Column):
        """Fill the store from a stream, all that is there now; each batch commits its rows with the largest cursor among them."""

        def add(rows: DataFrame, batch: int) -> None:
            last = rows.agg(F.max(cursor)).first()[0]
            before = self.cursor()
            self.insert(rows, batch, max(x for x in (before, last) if x is not None) if (before, last) != (None, None) else None)

        query = source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
