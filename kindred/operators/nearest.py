"""Exact k nearest neighbours of a query set among all rows, with blocks that the triangle inequality leaves out.

Candidates go to the nearest of a bounded number of pivots and are cut, by their distance from it, into blocks of at most
about ``BLOCK`` rows: a block is a ring around its pivot. No row of a ring of radii a to b is nearer to a query at distance x
from the pivot than ``max(x - b, a - x)``. So a query first visits one near block, whose k-th distance is its bound, and then
those other blocks whose rings may hold something as near. Blocks are worked on as matrices: the rows of a block come
first and the queries that visit it stream past, so a task holds a block and a batch of queries.

Candidates are shuffled a fixed number of times, whatever the number of queries (``ROUNDS`` visits, and when they are dealt
to blocks); queries once for each block they visit. Of equal vectors only the k + 1 smallest keys can be among a
query's nearest, so others leave at once, and a vector that a third of all rows share is one like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions.vectors import EPS
from kindred.operators.keys import global_rank
from kindred.storage import staged

#: Pivots, rows of a block (more only where there would be more than MOST_BLOCKS blocks), blocks whose bounds are sent with the tasks.
PIVOTS, BLOCK, MOST_BLOCKS = 256, 4096, 1 << 16
#: Queries that meet a block as one matrix.
QUERIES = 256
#: What rounding may add to a distance, as a share.
SLACK = 1e-7
METRICS = ("euclidean", "cosine", "chebyshev")


@dataclass
class Blocks:
    """Pivots (rows), and for each block its pivot, least and largest radius, and rows."""

    pivots: np.ndarray
    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def bounds(self, x: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
        """Of each query (rows) and block: the least distance that a row of it can have, and the distance of its pivot."""
        far = spread(x, self.pivots, metric)[:, self.pivot]
        return np.maximum(0, np.maximum(far - self.high, self.low - far)), far


def spread(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of all rows of ``x`` from all of ``y`` in the space of the bounds: vectors are of length 1 there for the cosine."""
    if metric == "chebyshev":
        return np.stack([np.abs(x - p).max(axis=1) for p in y], axis=1) if len(y) else np.zeros((len(x), 0))
    square = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T)
    return np.sqrt(np.maximum(square, 0))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), EPS)


def exact(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The distance of each row of ``a`` from the row of ``b`` beside it; equal rows give equal numbers wherever they stand."""
    if metric == "chebyshev":
        return np.abs(a - b).max(axis=1)
    if metric == "euclidean":
        return np.sqrt(((a - b) ** 2).sum(axis=1))
    norms = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return 1.0 - (a * b).sum(axis=1) / np.maximum(norms, EPS)


def in_bounds(d: np.ndarray, metric: str) -> np.ndarray:
    """A distance as one of the space of the bounds (chords for the cosine)."""
    return np.sqrt(2 * np.maximum(d, 0)) if metric == "cosine" else d


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, dim)


def packed(rows: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """``(key, v)``: vectors of ``dim`` finite numbers as bytes; others leave, and so do null keys."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0
            yield pa.RecordBatch.from_arrays([b["k"], pa.array([r.tobytes() for r in x], pa.binary())], ["k", "v"])

    v = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return rows.where(fine).select(F.col(key).cast("long").alias("k"), v.alias("v")).mapInArrow(pack, "k long, v binary")


def _visit(dim: int, k: int, metric: str):
    """Rows (block, query, id, v, bound) sorted by block, candidates first: ``(q, c, d)`` of the k nearest within the bound."""

    def near(x: np.ndarray, ids: np.ndarray, most: np.ndarray, y: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, ...]:
        direct = metric == "chebyshev" or dim <= 4
        if direct:
            d = np.stack([exact(y, np.broadcast_to(q, y.shape), metric) for q in x]) if metric != "cosine" else None
        if not direct or d is None:
            d = 1.0 - (unit(x) @ unit(y).T) if metric == "cosine" else spread(x, y, metric)
        slack = SLACK * (1 + np.abs(x).max(initial=0) + np.abs(y).max(initial=0))
        # the k-th and, as a query is no neighbour of its own, one more
        kth = np.partition(d, k, axis=1)[:, k] if d.shape[1] > k + 1 else np.full(len(x), np.inf)
        i, j = np.nonzero(d <= np.minimum(kth, most)[:, None] + slack)
        keep = ids[i] != own[j]
        i, j = i[keep], j[keep]
        d = exact(x[i], y[j], metric)
        order = np.lexsort((own[j], d, i))
        i, j, d = i[order], j[order], d[order]
        turn = np.arange(len(i)) - np.searchsorted(i, i)
        keep = turn < k
        return ids[i[keep]], own[j[keep]], d[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, y, own, parts = None, None, None, []
        for b in batches:
            blocks, kind = b["block"].to_numpy(), b["query"].to_numpy(zero_copy_only=False)
            ids, most = b["id"].to_numpy(), b["bound"].to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kind.astype(np.int8)) != 0)) + 1
            for first, last in zip([0, *cuts], [*cuts, len(blocks)], strict=True):
                if first == last:
                    continue
                if blocks[first] != block:
                    block, y, parts = blocks[first], None, []
                x = rows_of(b["v"].slice(first, last - first), dim)
                if not kind[first]:
                    parts.append((x, ids[first:last]))
                    continue
                if y is None:
                    y, own = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                for i in range(0, len(x), QUERIES):
                    at = slice(first + i, min(last, first + i + QUERIES))
                    q, c, d = near(x[i : i + QUERIES], ids[at], most[at], y, own)
                    yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(c), pa.array(d)], ["q", "c", "d"])

    return run


def _met(candidates: DataFrame, visits: DataFrame, dim: int, k: int, metric: str) -> DataFrame:
    """``(q, c, d)``: the k nearest of each visited block within each query's bound."""
    none = F.lit(float("inf"))
    both = candidates.select("block", F.lit(False).alias("query"), F.col("k").alias("id"), "v", none.alias("bound")).unionByName(visits.select("block", F.lit(True).alias("query"), F.col("k").alias("id"), "v", "bound"))
    return both.repartition("block").sortWithinPartitions("block", "query").mapInArrow(_visit(dim, k, metric), "q long, c long, d double")


def _dealt(candidates: DataFrame, dim: int, metric: str, n: int, block_rows: int, pivots: int) -> tuple[DataFrame, Blocks]:
    """Candidates with their block, and what is known of the blocks."""
    if n <= block_rows:
        one = np.zeros(1)
        return candidates.withColumn("block", F.lit(0).cast("long")), Blocks(np.zeros((1, dim)), one.astype(int), one, one + np.inf, np.array([n]))
    block_rows = max(block_rows, -(-n // MOST_BLOCKS))
    at = rows_of(candidates.orderBy(F.xxhash64("v"), "k").limit(pivots).select("v").toArrow()["v"].combine_chunks(), dim)
    at = np.unique(unit(at) if metric == "cosine" else at, axis=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = rows_of(b["v"], dim)
            d = spread(unit(x) if metric == "cosine" else x, at, metric)
            p = d.argmin(axis=1) if len(d) else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([b["k"], b["v"], pa.array(p.astype(np.int64)), pa.array(d[np.arange(len(d)), p])], ["k", "v", "pivot", "r"])

    placed = global_rank(candidates.mapInArrow(assign, "k long, v binary, pivot long, r double"), [F.col("pivot"), F.col("r"), F.col("k")])
    sizes = {r["pivot"]: r["n"] for r in placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    starts, blocks, rows, block = {}, {}, 0, 0
    for p in sorted(sizes):
        starts[p], blocks[p] = rows, block
        rows, block = rows + sizes[p], block + -(-sizes[p] // block_rows)
    of = lambda known: F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in known.items() for x in kv]), F.col("pivot"))
    dealt = staged(placed.select("k", "v", "pivot", "r", (of(blocks) + F.floor((F.col("rk") - 1 - of(starts)) / block_rows)).alias("block")), "blocks")
    stats = dealt.groupBy("block").agg(F.first("pivot").alias("pivot"), F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).orderBy("block").toArrow()
    return dealt, Blocks(at, *[stats[c].to_numpy() for c in ("pivot", "low", "high", "n")])


def _visits(queries: DataFrame, dim: int, metric: str, known: Blocks, k: int, first: bool) -> DataFrame:
    """``(block, k, v, bound)``: the near block of each query, or all others that may hold something within its bound."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                b = whole.slice(i, 64)
                x = rows_of(b["v"], dim)
                least, far = known.bounds(unit(x) if metric == "cosine" else x, metric)
                enough = known.rows > k
                home = np.where(enough, least + 1e-6 * far, np.inf).argmin(axis=1)
                if first:
                    q, block = np.flatnonzero(np.full(len(x), enough.any())), home
                    block = block[q]
                else:
                    most = b["bound"].to_numpy(zero_copy_only=False)
                    limit = in_bounds(most, metric) + SLACK * (1 + np.abs(x).max(initial=0) + np.abs(known.pivots).max())
                    may = (least <= limit[:, None]) & (known.rows > 0)
                    if enough.any():
                        may[np.arange(len(x)), home] = False
                    q, block = np.nonzero(may)
                at = pa.array(q)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int64)), b["k"].take(at), b["v"].take(at), b["bound"].take(at)], ["block", "k", "v", "bound"])

    return queries.select("k", "v", "bound").mapInArrow(go, "block long, k long, v binary, bound double")


def nearest(queries: DataFrame, candidates: DataFrame, k: int, metric: str = "euclidean", q: str = "q", c: str = "c", vector: str = "v", block_rows: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """``(q, c, rk, d)``: the k nearest candidates of each query, ties by the smaller key; a candidate with the query's own key is left out.

    ``metric``: euclidean, cosine (1 less the cosine; a zero vector is at 1 from all) or chebyshev. Keys are longs, unique on
    each side. Vectors that are null, hold null or non-finite components, or are not as long as the candidate with the
    smallest key, take no part; fewer candidates than k give as many rows as there are. Both tables are read more than once.
    """
    if metric not in METRICS:
        raise ValueError(f"{metric} is none of {METRICS}")
    shape = candidates.where(F.col(c).isNotNull() & F.col(vector).isNotNull()).orderBy(c).select(F.size(vector)).first()
    dim = shape[0] if shape else 1
    rows = packed(candidates, c, vector, dim).withColumn("turn", F.row_number().over(W.partitionBy("v").orderBy("k"))).where(F.col("turn") <= k + 1)
    rows = staged(rows.select("k", "v"), "candidates")
    asked = staged(packed(queries, q, vector, dim).withColumn("bound", F.lit(float("inf"))), "queries")
    dealt, known = _dealt(rows, dim, metric, rows.count(), block_rows, pivots)
    found = staged(_met(dealt, _visits(asked, dim, metric, known, k, True), dim, k, metric), "found")
    if len(known.rows) > 1 or not (known.rows > k).any():
        kth = found.groupBy(F.col("q").alias("k")).agg(F.when(F.count("*") == k, F.max("d")).alias("kth"))
        bounded = asked.drop("bound").join(kth, "k", "left").withColumn("bound", F.coalesce("kth", F.lit(float("inf"))))
        found = found.unionByName(_met(dealt, _visits(bounded, dim, metric, known, k, False), dim, k, metric))
    rk = F.row_number().over(W.partitionBy("q").orderBy("d", "c"))
    return found.withColumn("rk", rk).where(F.col("rk") <= k).select(F.col("q").alias(q), F.col("c").alias(c), "rk", "d")
