"""Operator 12: product codes of vectors, codebooks refined by an RDD's treeAggregate over columnar blocks.

A vector's components become integers, it is cut into equal consecutive parts, and each part is replaced by the index
of the nearest of at most ``ENTRIES`` entries in the codebook of its place. Codebooks start as the parts of the vectors
with the smallest keys. In each round every batch becomes one numpy block, a row of numbers for each component; squared
distances to all entries of a place add up component by component, ``np.add.at`` sums the parts and counts them by their
nearest entry in int64 tensors, and these, of one size whatever the input, merge through the tree of reductions.

Everything is integer, so results do not depend on partitions or the order of merging. The driver gets the tensors and
sends the codebooks (both ``PARTS * ENTRIES`` parts); vectors are read again for each round and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.tables import table
from kindred.operators.hot import meet
from kindred.storage import staged

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components are held to this, so that the squared distance of vectors of 8,192 components fits 64 bits.
LARGEST = 1 << 24
#: Vectors of a block.
BLOCK = 2048


@dataclass
class Codebooks:
    """``entries``: (part, entry, position) int64; ``scale``: what components were multiplied by."""

    entries: np.ndarray
    scale: int

    def sha256(self) -> str:
        """Lowercase hex digest of all components in order, as decimal numbers with commas between."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    @property
    def dim(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]


def whole(vector: str, dim: int, parts: int = PARTS) -> Column:
    """Vectors that take part: not null, ``dim`` components, all of them finite."""
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def columns_of(vectors: pa.Array, dim: int, scale: int) -> Iterator[np.ndarray]:
    """Blocks of at most BLOCK vectors as (component, vector) integers: floors, held to LARGEST."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    for i in range(0, len(flat), BLOCK):
        x = np.floor(flat[i : i + BLOCK].T * scale)
        yield np.clip(x, -LARGEST, LARGEST).astype(np.int64)


def nearest(block: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each part (rows) and vector: the index of its nearest entry, the lowest of equal ones, and the squared distance."""
    parts, n, width = entries.shape
    at, far = np.empty((parts, block.shape[1]), dtype=np.int64), np.empty((parts, block.shape[1]), dtype=np.int64)
    for p in range(parts):
        d = np.zeros((n, block.shape[1]), dtype=np.int64)
        for j in range(width):
            gap = block[p * width + j][None] - entries[p, :, j][:, None]
            d += gap * gap
        at[p] = d.argmin(axis=0)
        far[p] = np.take_along_axis(d, at[p][None], axis=0)[0]
    return at, far


def refined(vectors: DataFrame, vector: str, books: Codebooks) -> Codebooks:
    """One round: each entry becomes the floor of the mean of the parts nearest to it; entries without a part stay."""
    entries, dim, scale = books.entries, books.dim, books.scale
    parts, n, width = entries.shape

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in columns_of(b["v"], dim, scale):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], ["block"])

    def add(total: tuple[np.ndarray, np.ndarray], row) -> tuple[np.ndarray, np.ndarray]:
        block = np.frombuffer(row["block"], dtype=np.int64).reshape(dim, -1)
        at, _ = nearest(block, entries)
        for p in range(parts):
            np.add.at(total[0][p], at[p], block[p * width : (p + 1) * width].T)
            np.add.at(total[1][p], at[p], 1)
        return total

    def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return a[0] + b[0], a[1] + b[1]

    rdd = vectors.select(F.col(vector).alias("v")).mapInArrow(blocks, "block binary").rdd
    if not rdd.getNumPartitions():
        return books
    # a merge gets about 32 tensors, the driver too
    depth, left = 2, rdd.getNumPartitions()
    while left > 1024:
        depth, left = depth + 1, left // 32
    zero = np.zeros((parts, n, width), dtype=np.int64), np.zeros((parts, n), dtype=np.int64)
    sums, counts = rdd.treeAggregate(zero, add, merge, depth)
    mean = sums // np.maximum(counts, 1)[:, :, None]
    return Codebooks(np.where(counts[:, :, None] > 0, mean, entries), scale)


def fit(vectors: DataFrame, key: str, vector: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks | None:
    """Codebooks after ``rounds``; null where no vector has a key.

    Vectors take part if they are ``whole`` and as long as the one with the smallest key whose length is a multiple of
    ``parts``. Of repeated keys the smallest vector is an entry, and all of them count in the means; null keys give no
    entry, but count. Fewer keys than ``entries`` give as many entries as keys.
    """
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))
    able = vectors.where(F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & fine).select(F.col(key).alias("k"), v.alias("v"))
    # keys first, so that only vectors of these keys meet
    first = able.agg(F.min("k")).first()[0]
    if first is None:
        return None
    dim = able.where(F.col("k") == first).agg(F.size(F.min("v"))).first()[0]
    able = able.where(F.size("v") == dim)
    keys = [r["k"] for r in able.select("k").distinct().orderBy("k").limit(entries).collect()]
    seeds = able.where(F.col("k").isin(keys)).groupBy("k").agg(F.min("v").alias("v")).toArrow().sort_by("k")
    start = np.concatenate(list(columns_of(seeds["v"].combine_chunks(), dim, scale)), axis=1)
    books = Codebooks(np.ascontiguousarray(start.reshape(parts, dim // parts, -1).transpose(0, 2, 1)), scale)
    for _ in range(rounds):
        books = refined(vectors.where(whole(vector, dim)), vector, books)
    return books


def encode(vectors: DataFrame, vector: str, books: Codebooks, code: str = "code", error: str = "error") -> DataFrame:
    """``vectors`` that are whole, with their code (two hex digits for each part) and summed squared distance, in columns that replace any of these names.

    Vectors of another length, null ones and those with null or non-finite components are left out; an empty table stays empty.
    """
    dim, entries, scale = books.dim, books.entries, books.scale
    digits = np.array([f"{i:02x}" for i in range(entries.shape[1])])

    @F.arrow_udf("code string, error long")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for v in batches:
            codes, errors = [], []
            for x in columns_of(v, dim, scale):
                at, far = nearest(x, entries)
                codes += ["".join(c) for c in digits[at.T].tolist()]
                errors += far.sum(axis=0).tolist()
            yield pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(errors, pa.int64())], ["code", "error"])

    out = vectors.where(whole(vector, dim)).withColumn("_coded", coded(F.col(vector)))
    return out.withColumns({code: F.col("_coded.code"), error: F.col("_coded.error")}).drop("_coded")


def decode(codes: DataFrame, books: Codebooks, code: str = "code", vector: str = "decoded") -> DataFrame:
    """``codes`` with the vectors that they stand for: the middles of their entries' integer cells, over the scale; null for a null code."""
    entries, scale = books.entries, books.scale
    parts = np.arange(entries.shape[0])

    @F.arrow_udf("array<double>")
    def opened(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for c in batches:
            rows = [None if s is None else ((entries[parts, np.frombuffer(bytes.fromhex(s), np.uint8)] + 0.5) / scale).ravel() for s in c.to_pylist()]
            yield pa.array(rows, pa.list_(pa.float64()))

    return codes.withColumn(vector, opened(F.col(code)))


def op12_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    books = fit(e, "vec_id", "embedding")
    if books is None:  # nothing is kept
        return e.where("false").select("vec_id", F.lit("").alias("code"), *[F.lit(0).cast("long").alias(c) for c in ("error", "label_error")], F.lit("").alias("codebooks_sha256"))
    group = F.coalesce(F.concat(F.lit("label "), F.col("label").cast("string")), F.lit("none")).alias("group")
    coded = staged(encode(e, "embedding", books).select("vec_id", "code", "error", group), "codes")
    facts = coded.groupBy("group").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return meet(coded, facts, "group", "n").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _assigned(name: str, books: str) -> str:
    return f"""{name} AS (SELECT vec_id, p, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM
  (SELECT x.vec_id, x.p, x.part, b.entry, list_sum(list_transform(list_zip(x.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM x JOIN {books} b ON x.p = b.p) GROUP BY ALL)"""


def _moved(name: str, books: str, assigned: str) -> str:
    return f"""{name} AS (SELECT b.p, b.entry, CASE WHEN s.n IS NULL THEN b.part ELSE list_transform(s.sums, lambda z: (z - ((z % s.n) + s.n) % s.n) // s.n) END AS part
  FROM {books} b LEFT JOIN (SELECT p, entry, count(*) AS n, list_transform(range(1, 1 + any_value(len(part))), lambda j: list_sum(list_transform(list(part), lambda v: v[j]))::BIGINT) AS sums FROM {assigned} GROUP BY p, entry) s USING (p, entry))"""


OP12_SQL = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor({SCALE} * v) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
x AS (SELECT vec_id, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS part FROM kept, range({PARTS}) r(p)),
b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, part FROM x QUALIFY entry < {ENTRIES}),
{_assigned("a0", "b0")}, {_moved("b1", "b0", "a0")}, {_assigned("a1", "b1")}, {_moved("b2", "b1", "a1")}, {_assigned("a2", "b2")},
codes AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY p, entry)) FROM b2) AS codebooks_sha256
FROM codes JOIN kept USING (vec_id)
"""
