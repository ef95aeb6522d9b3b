"""Exact search of a query set against all rows, and retrieval metrics over ranked pairs.

``pairs`` is the only place where queries meet candidates. Both sides are counted and cut into blocks of bounded
size, and each block of queries joins each block of candidates by equality, so the number of tasks grows with the
work; the top k of each block are taken before anything is shuffled (window group limit).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.functions.vectors import EPS
from kindred.operators.beside import Columns, average_ranks, each_beside, smallest
from kindred.operators.ranking import correlation


#: Rows of a block of queries and of a block of candidates.
QUERY_ROWS, CANDIDATE_ROWS = 64, 4096


def pairs(queries: DataFrame, candidates: DataFrame, q: str = "q", c: str = "c", on: str | None = None, query_rows: int = QUERY_ROWS, candidate_rows: int = CANDIDATE_ROWS) -> DataFrame:
    """Every query with every other candidate, of the same ``on`` if that is given; norms and other per-row work should already be columns."""
    nq, nc = (max(1, -(-rows.count() // size)) for rows, size in ((queries, query_rows), (candidates, candidate_rows)))
    # at least as many blocks of queries as there are cores
    nq = max(nq, min(queries.sparkSession.sparkContext.defaultParallelism * 2, nq * query_rows))
    dealt = lambda rows, key, n: F.pmod(F.xxhash64(F.col(key)), F.lit(n)).cast("int")
    left = queries.withColumn("_qb", dealt(queries, q, nq)).withColumn("_cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    right = candidates.withColumn("_cb", dealt(candidates, c, nc)).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    return left.join(right, ["_qb", "_cb", *([on] if on else [])]).drop("_qb", "_cb").where(F.col(q) != F.col(c))


def ranked(pair: DataFrame, by: list[tuple[str, Column]], q: str = "q", c: str = "c") -> DataFrame:
    """Add 1-based ranks per query, ties by ascending candidate: one shuffle for all rankings."""
    for name, d in by:
        pair = pair.withColumn(name, F.row_number().over(W.partitionBy(q).orderBy(d, c)))
    return pair


def top_k(pair: DataFrame, distance: str, k: int, q: str = "q", c: str = "c") -> DataFrame:
    return ranked(pair, [("rk", F.col(distance))], q, c).where(F.col("rk") <= k)


def average_rank(values: Column, q: str = "q") -> Column:
    """Rank with ties averaged."""
    return F.rank().over(W.partitionBy(q).orderBy(values)) + (F.count(F.lit(1)).over(W.partitionBy(q, values)) - 1) / 2


def recall_at(k: int) -> Column:
    """Share of the k true neighbours (of all candidates, if there are fewer) that the method retrieves."""
    return F.sum(((F.col("ork") <= k) & (F.col("mrk") <= k)).cast("int")) / F.least(F.lit(k), F.count(F.lit(1)))


def regret_at(k: int) -> Column:
    """Mean oracle distance of what the method retrieves less that of the true neighbours."""
    return F.avg(F.when(F.col("mrk") <= k, F.col("o"))) - F.avg(F.when(F.col("ork") <= k, F.col("o")))


def relative_error_at(k: int, least: float = 1e-8) -> Column:
    den = F.avg(F.when(F.col("ork") <= k, F.col("o")))
    return F.when(den >= least, F.avg(F.when(F.col("mrk") <= k, F.col("o"))) / den)


def constraint_error_at(k: int) -> Column:
    return F.max(F.when(F.col("mrk") <= k, F.col("o")))


def ndcg(pair: DataFrame, k: int, q: str = "q") -> DataFrame:
    """Gain exp(-d / median positive d) per query; 1 where the ideal gain is 0."""
    scale = pair.groupBy(q).agg(F.percentile(F.when(F.col("o") > 0, F.col("o")), 0.5).alias("_s"))
    gain = F.exp(-F.col("o") / F.coalesce("_s", F.lit(1.0)))
    at = lambda r: F.sum(F.when(F.col(r) <= k, gain / F.log2(F.col(r) + 1.0)))
    out = pair.where((F.col("ork") <= k) | (F.col("mrk") <= k)).join(scale, q).groupBy(q).agg(at("mrk").alias("dcg"), at("ork").alias("idcg"))
    return out.select(q, F.when(F.col("idcg") == 0, 1.0).otherwise(F.col("dcg") / F.col("idcg")).alias("ndcg"))


def average_precision(pair: DataFrame, relevant: Column, q: str = "q") -> DataFrame:
    """Mean of precision at each relevant rank; null without a relevant row."""
    seen = F.sum(relevant.cast("int")).over(W.partitionBy(q).orderBy("mrk").rowsBetween(W.unboundedPreceding, 0))
    return pair.withColumn("_p", F.when(relevant, seen / F.col("mrk"))).groupBy(q).agg(F.avg("_p").alias("ap"))


def spearman(pair: DataFrame, q: str = "q") -> DataFrame:
    """Correlation of averaged ranks per query; null where a side is constant."""
    both = pair.select(q, average_rank(F.col("o"), q).alias("x"), average_rank(F.col("m"), q).alias("y"))
    rho = both.groupBy(q).agg(correlation("x", "y").alias("rho"), F.min("x").alias("a"), F.max("x").alias("b"), F.min("y").alias("c"), F.max("y").alias("d"))
    return rho.select(q, F.when((F.col("a") < F.col("b")) & (F.col("c") < F.col("d")), F.col("rho")).alias("rho"))


def half_pairs(pair: DataFrame, q: str = "q", c: str = "c") -> DataFrame:
    """Candidate i of each query beside candidate i + (n - n div 2), by candidate order: oracle and method margins."""
    order = W.partitionBy(q).orderBy(c)
    n = F.count(F.lit(1)).over(W.partitionBy(q))
    both = pair.withColumn("i", F.row_number().over(order) - 1).withColumn("n", n)
    half = F.floor(F.col("n") / 2)
    # partner: the first half at i meets the second half at i + n - half
    side = both.withColumn("slot", F.when(F.col("i") < half, F.col("i")).when(F.col("i") >= F.col("n") - half, F.col("i") - (F.col("n") - half)))
    later = F.col("i") >= F.col("n") - half
    pick = lambda x, s: F.max(F.when(s, F.col(x)))
    return side.where("slot is not null").groupBy(q, "slot").agg((pick("o", ~later) - pick("o", later)).alias("od"), (pick("m", ~later) - pick("m", later)).alias("md"))


def triplet_score() -> Column:
    """1 if the method orders a pair as the oracle does, 1/2 for a tie of the method."""
    return F.when(F.col("md") == 0, 0.5).otherwise((F.signum("md") == F.signum("od")).cast("double"))


# The same over whole rankings of many rows: a task works through the distances of one query as arrays (``beside``). Columns
# of both sides are v, n (its norm), y (the oracle compares it), label (a double); d is the cosine distance, the method's.


def cosine_distances(a: Columns, b: Columns, at_once: int = 32) -> np.ndarray:
    """Cosine distances of all of a to all of b, each summed component by component as ``vectors.cosine_distance`` does, so with the same last bits."""
    left, right = a["v"].astype(np.float64), np.ascontiguousarray(b["v"].astype(np.float64).T)
    out = np.zeros((len(left), len(b["v"])))
    for s in range(0, len(left), at_once):
        own, dot = left[s : s + at_once], out[s : s + at_once]
        part = np.empty_like(dot)
        for i in range(min(own.shape[1], len(right))):
            dot += np.multiply(own[:, i, None], right[i], out=part)
    return 1.0 - out / np.maximum(a["n"][:, None] * b["n"], EPS)


def over_rankings(queries: DataFrame, candidates: DataFrame, measure: Callable[[dict, Columns, np.ndarray, np.ndarray], Columns | None], schema: str) -> DataFrame:
    """``measure`` of each query, called with the query, its candidates in the order of c, and both distances to them, the oracle's and the method's."""

    def judged(query: dict, found: Columns, d: np.ndarray) -> Columns | None:
        y = np.nan if query["y"] is None else query["y"]
        return measure(query, found, np.abs(y - found["y"]), d)

    return each_beside(queries, candidates, cosine_distances, judged, schema, wide=("v", "n"))


def ndcg_of(query: dict, found: Columns, o: np.ndarray, m: np.ndarray, k: int = 10) -> Columns:
    """See ``ndcg``; null without any oracle distance."""
    some = np.sort(o[o > 0])
    scale = (some[(len(some) - 1) // 2] + some[len(some) // 2]) / 2 if len(some) else 1.0
    at = lambda places: float(np.nansum(np.exp(-o[places] / scale) / np.log2(np.arange(len(places)) + 2.0)))
    dcg, ideal = at(smallest(m, k)), at(smallest(o, k))
    known = not np.isnan(o).all()
    return {"q": [query["q"]], "ndcg": [(1.0 if ideal == 0 else dcg / ideal) if known else None]}


def average_precision_of(query: dict, found: Columns, o: np.ndarray, m: np.ndarray) -> Columns:
    """See ``average_precision``; candidates of the query's label are relevant."""
    ranks = np.flatnonzero((found["label"] == query["label"])[smallest(m, len(m))]) + 1
    return {"q": [query["q"]], "ap": [float((np.arange(1, len(ranks) + 1) / ranks).mean()) if len(ranks) else None]}


def spearman_of(query: dict, found: Columns, o: np.ndarray, m: np.ndarray) -> Columns:
    """See ``spearman``."""
    x, y = average_ranks(o) - (len(o) + 1) / 2, average_ranks(m) - (len(o) + 1) / 2
    both = float(np.sqrt((x @ x) * (y @ y)))
    return {"q": [query["q"]], "rho": [float(x @ y) / both if both else None]}


def triplets_of(query: dict, found: Columns, o: np.ndarray, m: np.ndarray) -> Columns:
    """See ``half_pairs``: the sum of the scores of its pairs of different oracle distance, and how many there are; a missing margin of the method scores 0."""
    half = len(o) // 2
    od, md = o[:half] - o[len(o) - half :], m[:half] - m[len(o) - half :]
    fine = (od != 0) & ~np.isnan(od)
    od, md = od[fine], md[fine]
    return {"q": [query["q"]], "score": [float((md == 0).sum() / 2 + ((md != 0) & (np.sign(md) == np.sign(od))).sum())], "pairs": [len(od)]}


def method_ranks_of(query: dict, found: Columns, o: np.ndarray, m: np.ndarray, k: int = 10) -> Columns:
    """The method's ranks of the k candidates that are nearest by the oracle."""
    m = np.where(np.isnan(m), np.inf, m)
    near = smallest(o, k)
    return {"q": [query["q"]] * len(near), "mrk": [int((m < m[i]).sum() + (m[:i] == m[i]).sum()) + 1 for i in near]}
