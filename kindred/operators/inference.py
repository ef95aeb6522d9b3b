"""Bootstrap intervals and decisions over per-query scores: resampling in Spark, replicates' sums on the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.storage import staged

#: Clusters of a bucket about, buckets at most, replicates that a task works on at once.
CLUSTERS, MOST_BUCKETS, AT_ONCE = 4096, 1 << 16, 64


def bootstrap_mean(values: np.ndarray, replicates: int = 2000, seed: int = 17, level: float = 0.95) -> tuple[float, float, float]:
    values = np.asarray(values, dtype=float)
    if not len(values):
        return float("nan"), float("nan"), float("nan")
    rng = np.random.default_rng(seed)
    means = np.array([values[rng.integers(0, len(values), len(values))].mean() for _ in range(replicates)])
    low, high = np.quantile(means, [(1 - level) / 2, (1 + level) / 2])
    return float(values.mean()), float(low), float(high)


def bucket_draws(upto: np.ndarray, bucket: int, replicates: int, seed: int) -> np.ndarray:
    """How many draws of each replicate fall into a bucket; ``upto``: clusters in all buckets before each one, and at last in all.

    As many clusters are drawn as there are. The draws part at each node of a binary tree over the buckets by a binomial
    with the share of its left half, whose seed is the node's, so every task that comes by a node finds the same.
    """
    low, high = 0, len(upto) - 1
    draws = np.full(replicates, upto[-1], dtype=np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        here = int(upto[high] - upto[low])
        left = np.random.default_rng([seed, low, high]).binomial(draws, int(upto[mid] - upto[low]) / here if here else 0.0)
        if bucket < mid:
            draws, high = left, mid
        else:
            draws, low = draws - left, mid
    return draws


def cluster_draws(draws: np.ndarray, clusters: int, bucket: int, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """``(first replicate, counts)``: how often each cluster of a bucket (columns) is drawn in some replicates (rows)."""
    rng = np.random.default_rng([seed, bucket, 1 << 32])
    for i in range(0, len(draws), AT_ONCE):
        yield i, rng.multinomial(draws[i : i + AT_ONCE], np.full(clusters, 1 / clusters))


@dataclass(frozen=True)
class Replicates:
    """Sums of each value (columns) over all rows and over those of each replicate (rows), and how many rows these are."""

    values: list[str]
    sums: np.ndarray
    n: int
    drawn_sums: np.ndarray
    drawn_n: np.ndarray

    def means(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean of each value over all rows; and over those of each replicate that has rows."""
        fine = self.drawn_n > 0
        return self.sums / max(self.n, 1), self.drawn_sums[fine] / self.drawn_n[fine, None]

    def intervals(self, gap: tuple[str, list[str]] | None = None, level: float = 0.95) -> dict[str, tuple[float, float, float]]:
        """(mean, low, high) of each value by percentiles of the replicates, and of the gap of a value over the best of others."""
        point, each = self.means()
        names = list(self.values)
        if gap:
            at, raw = names.index(gap[0]), [names.index(r) for r in gap[1]]
            point, each = np.append(point, point[at] - point[raw].max()), np.column_stack([each, each[:, at] - each[:, raw].max(axis=1)])
            names.append("gap")
        if not self.n:
            return {name: (float("nan"),) * 3 for name in names}
        low, high = np.quantile(each, [(1 - level) / 2, (1 + level) / 2], axis=0)
        return {name: (float(point[i]), float(low[i]), float(high[i])) for i, name in enumerate(names)}


def resampled_clusters(rows: DataFrame, cluster: str, values: list[str], replicates: int = 2000, seed: int = 17) -> Replicates:
    """Whole clusters drawn with replacement, as many as there are, again and again; each brings all of its rows.

    Rows with a null cluster or a null among the values take no part. Spark sums each cluster, deals clusters to buckets by
    hash, and each bucket finds its own part of every draw (``bucket_draws``); what comes to the driver is the size of each
    bucket (at most MOST_BUCKETS) and one row of sums for each replicate. Reruns agree.
    """
    fine = rows.where(F.col(cluster).isNotNull()).dropna(subset=values)
    each = fine.groupBy(F.col(cluster).cast("string").alias("c")).agg(F.count("*").alias("n"), *[F.sum(F.col(v).cast("double")).alias(f"s{i}") for i, v in enumerate(values)])
    each = staged(each, "clusters")
    buckets = min(MOST_BUCKETS, max(1, -(-each.count() // CLUSTERS)))
    dealt = each.withColumn("b", F.pmod(F.xxhash64("c"), F.lit(buckets)).cast("int"))
    sizes = {r["b"]: r["k"] for r in dealt.groupBy("b").agg(F.count("*").alias("k")).collect()}
    upto = np.cumsum([0, *(sizes.get(b, 0) for b in range(buckets))])
    names = ["n", *[f"s{i}" for i in range(len(values))]]
    if not upto[-1]:
        return Replicates(values, np.zeros(len(values)), 0, np.zeros((0, len(values))), np.zeros(0))

    def draw(t: pa.Table) -> pa.Table:
        t = t.sort_by("c")
        b, own = t["b"][0].as_py(), np.column_stack([t[c].to_numpy() for c in names]).astype(np.float64)
        total = [counts @ own for _, counts in cluster_draws(bucket_draws(upto, b, replicates, seed), len(own), b, seed)]
        return pa.table({"r": np.arange(replicates)} | dict(zip(names, np.concatenate(total).T, strict=True)))

    schema = "r long, " + ", ".join(f"{c} double" for c in names)
    drawn = dealt.groupBy("b").applyInArrow(draw, schema).groupBy("r").agg(*[F.sum(c).alias(c) for c in names]).toArrow().sort_by("r")
    whole = each.agg(*[F.sum(c).alias(c) for c in names]).first()
    return Replicates(values, np.array([whole[c] for c in names[1:]]), int(whole["n"]), np.column_stack([drawn[c].to_numpy() for c in names[1:]]), drawn["n"].to_numpy())


def cluster_bootstrap(rows: DataFrame, cluster: str, value: str, replicates: int = 2000, seed: int = 17, level: float = 0.95) -> tuple[float, float, float]:
    """(mean, low, high) of a value over rows, whole clusters resampled; NaN without rows."""
    return resampled_clusters(rows, cluster, [value], replicates, seed).intervals(level=level)[value]


def gap_decision(points: dict[str, float], target: str, raw: list[str], least: float = 0.10) -> tuple[float, bool]:
    """(gap of the target over the best raw method, whether it reaches the threshold, itself included)."""
    gap = points[target] - max(points[r] for r in raw)
    return gap, gap >= least


def seed_interval(values: list[float], replicates: int = 2000, rng: np.random.Generator | None = None) -> dict[str, float]:
    """Mean, median, range, sample deviation and the bootstrap 95 % interval of the mean over seeds; all draws at once from ``rng``."""
    v = np.asarray(values, dtype=float)
    rng = rng or np.random.default_rng(17)
    means = v[rng.integers(0, len(v), size=(replicates, len(v)))].mean(axis=1)
    low, high = np.quantile(means, [0.025, 0.975])
    return {"mean": float(v.mean()), "median": float(np.median(v)), "min": float(v.min()), "max": float(v.max()), "std": float(v.std(ddof=1)) if len(v) > 1 else float("nan"), "low": float(low), "high": float(high)}


def difference_of_means(a: np.ndarray, b: np.ndarray, replicates: int = 2000, seed: int = 17, level: float = 0.95) -> tuple[float, float, float]:
    """Mean of paired differences a - b with its bootstrap interval."""
    return bootstrap_mean(np.asarray(a, dtype=float) - np.asarray(b, dtype=float), replicates, seed, level)
