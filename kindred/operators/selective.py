"""Compound queries over signed margins, conformal decisions, and risk-coverage curves."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.keys import global_rank
from kindred.operators.probes import fit_logistic
from kindred.operators.quantiles import at_ranks
from kindred.storage import staged


@dataclass(frozen=True)
class Query:
    """``all``, ``any`` or at least ``k`` of the conditions (margin > 0)."""

    kind: str
    k: int = 1

    def truth(self, margins: Column) -> Column:
        return self.holds(F.size(F.filter(margins, lambda x: x > 0)), F.size(margins))

    def holds(self, n_true: Column, n: Column) -> Column:
        return n_true == n if self.kind == "all" else n_true >= (1 if self.kind == "any" else self.k)


def conformal_rank(n: int, alpha: float) -> int:
    return min(n, math.ceil((n + 1) * (1 - alpha)))


def conformal_quantiles(scores: DataFrame, alphas: dict[str, list[float]]) -> dict[str, list[float | None]]:
    """By column: the k-th smallest score for each alpha, k = min(n, ceil((n + 1)(1 - alpha))); null without scores. ``scores`` should be a stored table."""
    own = lambda a: lambda n: [conformal_rank(n, x) - 1 for x in a]
    got = at_ranks(scores, {c: own(a) for c, a in alphas.items()})
    return {c: got[c][1] or [None] * len(a) for c, a in alphas.items()}


def conformal_quantile(scores: DataFrame, score: str, alpha: float) -> float | None:
    return conformal_quantiles(scores, {score: [alpha]})[score][0]


def interval_decision(low: Column, high: Column, query: Query) -> tuple[Column, Column, Column]:
    """(prediction, accepted, score): a condition holds if its whole interval is above 0, fails if none of it is."""
    n = F.size(low)
    sure = F.size(F.filter(low, lambda x: x > 0))
    maybe = F.size(F.filter(high, lambda x: x > 0))
    yes, no = query.holds(sure, n), ~query.holds(maybe, n)
    return yes, yes | no, F.array_min(F.zip_with(low, high, lambda a, b: F.least(F.abs(a), F.abs(b))))


def risk_coverage(rows: DataFrame, score: str, correct: Column, anchors: list[float], tie: str) -> DataFrame:
    """For each anchor: rows accepted (floor(n * anchor) best scores, ties by ``tie``) and the share of wrong ones among them.

    Rows are ranked range by range, never in one task.
    """
    n = rows.count()
    best = global_rank(rows.withColumn("wrong", (~correct).cast("int")), [F.col(score).desc(), F.col(tie)])
    cuts = [math.floor(n * a) for a in anchors]
    aggs = [F.struct(F.lit(a).alias("anchor"), F.lit(c).cast("long").alias("accepted"), F.sum(F.when(F.col("rk") <= c, F.col("wrong"))).alias("wrong")) for a, c in zip(anchors, cuts, strict=True)]
    out = best.agg(F.array(*aggs).alias("a")).select(F.explode("a").alias("a")).select("a.*")
    return out.select("anchor", "accepted", F.when(F.col("accepted") > 0, F.col("wrong") / F.col("accepted")).alias("risk"))


def selective_report(rows: DataFrame, by: list[str]) -> DataFrame:
    """Coverage and risk among accepted rows (null where none is); needs accepted and correct."""
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col("accepted").cast("int")).alias("n_accepted"), F.avg(F.col("accepted").cast("double")).alias("coverage"),
        F.avg(F.when(F.col("accepted"), (~F.col("correct")).cast("double"))).alias("risk"),
    )


def compound_conformal(fit: DataFrame, calibration: DataFrame, rows: DataFrame, vector: str, label: str, alpha: float) -> DataFrame:
    """``rows`` with prediction, accepted, score and reason of a logistic model of the whole query.

    A label is in a row's set if one less its probability is at most the conformal quantile of the
    calibration rows; a set of one label is accepted. A fit of one class raises; without calibration rows all is refused.
    """
    model = fit_logistic(fit, vector, label)
    p = model.probability(F.col(vector))
    scores = calibration.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select((1 - F.when(F.col(label).cast("int") == 1, p).otherwise(1 - p)).alias("s"))
    q = conformal_quantile(staged(scores, "scores"), "s", alpha)
    limit = F.lit(-1.0 if q is None else q)
    yes, no = (1 - p) <= limit, p <= limit
    reason = F.when(yes & no, "refused_ambiguous_prediction_set").when(yes | no, "accepted_singleton_prediction_set").otherwise("refused_empty_prediction_set")
    return rows.withColumn("prediction", yes).withColumn("accepted", yes != no).withColumn("score", F.greatest(p, 1 - p)).withColumn("reason", reason)


def confidence_decision(rows: DataFrame, probability: str, coverage: float, tie: str) -> DataFrame:
    """``rows`` with prediction, score and accepted: the floor(n * coverage) most confident rows, ties by ``tie``; no calibration."""
    p = F.col(probability)
    n = rows.count()
    cut = n if coverage == 1 else math.floor(n * coverage)
    scored = rows.withColumn("prediction", p > 1 - p).withColumn("score", F.greatest(p, 1 - p))
    return global_rank(scored, [F.col("score").desc_nulls_last(), F.col(tie)]).withColumn("accepted", F.col("rk") <= cut).drop("rk")
