"""How many points lie above a row in all of some coordinates at once, for every row, without pairing rows and points.

In each coordinate rows and points are ranked together (points first among equal values, so a point counts only if it is
strictly above). Ranks are cut into slabs of at most ``slab`` rows. A row and a point of one slab are compared there, by a
counting tree in the task. Otherwise they part at one level of the binary tree over slabs: the point is sent to the node of
that level as its right half, the row as its left half, and what is left is the same question with one coordinate less,
node by node. So each row is sent about log2(slabs) / 2 times for each coordinate but the last, and no task gets more
than a slab. For the last coordinate ranks are counted inside slabs by windows, and whole slabs by a sum over the node.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.operators.keys import global_rank
from kindred.storage import staged

SLAB = 1 << 16


class Wavelet:
    """Numbers below ``2**bits`` in a given order: how many of a stretch are at least some number, a look-up for each bit."""

    def __init__(self, values: np.ndarray, bits: int):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        v = values
        for b in range(bits - 1, -1, -1):
            ones = (v >> b) & 1
            before = np.concatenate([[0], np.cumsum(ones)])
            self.levels.append((b, before, len(v) - int(before[-1])))
            v = np.concatenate([v[ones == 0], v[ones == 1]])

    def at_least(self, first: np.ndarray, last: np.ndarray, least: np.ndarray) -> np.ndarray:
        """For each stretch ``first`` to ``last`` (exclusive) the numbers that are ``least`` or more."""
        n = np.zeros(len(first), dtype=np.int64)
        for b, before, zeros in self.levels:
            i, j = before[first], before[last]
            one = (least >> b) & 1 == 1
            n += np.where(one, 0, j - i)
            first, last = np.where(one, zeros + i, first - i), np.where(one, zeros + j, last - j)
        return n + last - first


def above(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row the points that are above it in all columns; columns of integers, no row level with a point.

    One column: a binary search. Two: points in the order of the first, a wavelet tree over the second. Three: the
    binary tree over the first, each level as one such structure over all of its nodes.
    """
    if not len(points) or not len(rows):
        return np.zeros(len(rows), dtype=np.int64)
    if points.shape[1] == 1:
        return len(points) - np.searchsorted(np.sort(points[:, 0]), rows[:, 0])
    # places from here on: of a point its rank in each column, of a row the first point above it
    order = np.argsort(points, axis=0)
    place = np.stack([np.searchsorted(points[order[:, j], j], rows[:, j]) for j in range(rows.shape[1])], axis=1)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(len(points))[:, None], axis=0)
    bits = int(len(points)).bit_length()
    if points.shape[1] == 2:
        tree = Wavelet(rank[order[:, 0], 1], bits)
        return tree.at_least(place[:, 0], np.full(len(rows), len(points)), place[:, 1])
    n, by_second = np.zeros(len(rows), dtype=np.int64), order[:, 1]
    for b in range(bits):
        # rows in the left half of a node count the points in its right half, points of one node side by side
        node = rank[by_second, 0] >> b
        at = by_second[np.argsort(node, kind="stable")]
        key = (rank[at, 0] >> b) * (len(points) + 1) + rank[at, 1]
        tree = Wavelet(rank[at, 2], bits)
        own = place[:, 0] >> b
        left = own & 1 == 0
        first = np.searchsorted(key, (own[left] + 1) * (len(points) + 1) + place[left, 1])
        last = np.searchsorted(key, (own[left] + 2) * (len(points) + 1))
        n[left] += tree.at_least(first, last, place[left, 2])
    # the point at the place of the row itself is above it in the first column
    level = np.flatnonzero(place[:, 0] < len(points))
    same = order[place[level, 0], 0]
    n[level] += (rank[same, 1] >= place[level, 1]) & (rank[same, 2] >= place[level, 2])
    return n


def _in_slab(dims: list[str]):
    def count(t: pa.Table) -> pa.Table:
        x = np.stack([t[d].to_numpy() for d in dims], axis=1)
        point = t["point"].to_numpy()
        rows = np.flatnonzero(~point)
        return pa.table({"id": t["id"].take(pa.array(rows)), "n": pa.array(above(x[point], x[rows]), pa.int64())})

    return count


def _counts(rows: DataFrame, dims: list[str], node: list[str], slab: int, slabs: int) -> DataFrame:
    """``(id, n)`` in parts that add up; ``rows``: id, point, ranks ``dims`` and the columns ``node`` of the question they belong to."""
    own = F.floor(F.col(dims[0]) / slab).cast("long")
    at = rows.withColumn("slab", own)
    if len(dims) == 1:
        here = F.sum(F.col("point").cast("long")).over(W.partitionBy(*node, "slab").orderBy(F.desc(dims[0])).rowsBetween(W.unboundedPreceding, 0))
        each = at.groupBy(*node, "slab").agg(F.sum(F.col("point").cast("long")).alias("k"))
        later = each.withColumn("later", F.sum("k").over(W.partitionBy(*node).orderBy(F.desc("slab")).rowsBetween(W.unboundedPreceding, -1)))
        return at.withColumn("here", here).where("not point").join(later, [*node, "slab"]).select("id", (F.col("here") + F.coalesce("later", F.lit(0))).alias("n"))
    out = at.groupBy(*node, "slab").applyInArrow(_in_slab(dims), rows.select("id", F.lit(0).cast("long").alias("n")).schema)
    levels = max(0, slabs - 1).bit_length()
    if not levels:
        return out
    k = len(node)
    parts = [F.when(F.col("point") == (F.shiftright("slab", b).bitwiseAND(1) == 1), F.struct(F.lit(b).alias(f"level{k}"), F.shiftright("slab", b + 1).alias(f"node{k}"))) for b in range(levels)]
    sent = at.withColumn("to", F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull()))).select("id", "point", *dims[1:], *node, "to.*")
    return out.unionByName(_counts(sent, dims[1:], [*node, f"level{k}", f"node{k}"], slab, slabs))


def ranked_together(points: DataFrame, rows: DataFrame, key: str, coordinates: list[str]) -> DataFrame:
    """``(id, point, r0, r1, ...)``: ranks from 0 in each coordinate among rows and points, points first among equals."""
    part = lambda df, point: df.select(F.col(key).alias("id"), F.lit(point).alias("point"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(coordinates)])
    both = part(points, True).unionByName(part(rows, False))
    for i in range(len(coordinates)):
        both = global_rank(both, [F.col(f"x{i}"), F.desc("point"), F.col("id")], f"r{i}").withColumn(f"r{i}", F.col(f"r{i}") - 1).drop(f"x{i}")
    return staged(both, "together")


def counts_above(points: DataFrame, rows: DataFrame, key: str, coordinates: list[str], slab: int = SLAB) -> DataFrame:
    """``(key, s1, s2, ...)`` for each row: sums over all sets of so many coordinates of the number of points strictly above the row in all of the set.

    ``s3`` of three coordinates counts the points above in all of them. Points and rows with a null or NaN coordinate take
    no part (those rows do not come back); without points all sums are 0. Keys must be unique in each table; both tables are
    read once for each coordinate.
    """
    fine = lambda df: df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in coordinates))
    both = ranked_together(fine(points), fine(rows), key, coordinates)
    slabs = -(-both.count() // slab)
    dims = [f"r{i}" for i in range(len(coordinates))]
    total = None
    for size in range(1, len(dims) + 1):
        for own in combinations(dims, size):
            n = _counts(both.select("id", "point", *own), list(own), [], slab, slabs).select("id", F.lit(size).alias("size"), "n")
            total = n if total is None else total.unionByName(n)
    sums = [F.sum(F.when(F.col("size") == s, F.col("n")).otherwise(0)).alias(f"s{s}") for s in range(1, len(dims) + 1)]
    return total.groupBy(F.col("id").alias(key)).agg(*sums)


def at_least_of(k: int, d: int) -> Column:
    """Number of points above in ``k`` or more of ``d`` coordinates, from the sums of ``counts_above`` (inclusion and exclusion)."""
    return sum((F.col(f"s{j}") * ((-1) ** (j - k) * comb(j - 1, k - 1)) for j in range(k, d + 1)), F.lit(0))
