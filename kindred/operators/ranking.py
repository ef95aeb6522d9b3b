"""Measures over the whole order of a table: rank correlation and average precision, ranges of rows at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.keys import average_ranks, prefix_sums
from kindred.storage import staged


def correlation(x: str, y: str) -> Column:
    """Of two columns of a group; null where one is constant, under any session's rules for division."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """``(by, spearman)``: correlation of the ranks of two columns inside each group, ties averaged; null where a side is constant.

    Rows with a null in either column take no part. Ranks run on over groups, which moves all of a group by as much.
    """
    own = staged(rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).alias("_x"), F.col(y).alias("_y")), "pairs")
    ranked = average_ranks(staged(average_ranks(own, [*by, "_x"], "_rx"), "ranks"), [*by, "_y"], "_ry")
    return ranked.groupBy(*by).agg(correlation("_rx", "_ry").alias("spearman"))


def average_precision(rows: DataFrame, score: str, positive: str) -> float | None:
    """Mean over the positive rows of the precision down to their score, equal scores counted together; null without a positive row.

    Rows with a null score or a null label take no part.
    """
    each = rows.where(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("p"))
    run = prefix_sums(each, [F.desc("s")], ["n", "p"])
    at = (F.col("before_p") + F.col("p")) / (F.col("before_n") + F.col("n"))
    total, share = run.agg(F.sum("p"), F.sum(F.col("p") * at)).first()
    return share / total if total else None


def average_precisions(rows: DataFrame, by: str, score: str, positive: str) -> dict[object, float | None]:
    """``average_precision`` of each of a few groups, all in one order: what stands before a group is taken off its running sums.

    Groups are few, as models are: a number or two for each are broadcast. Rows with a null group, score or label take no part;
    a group without such rows is not in the result.
    """
    known = rows.where(F.col(by).isNotNull() & F.col(score).isNotNull() & F.col(positive).isNotNull())
    each = known.groupBy(F.col(by).alias("g"), F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(positive).cast("long")).alias("p"))
    run = prefix_sums(each, [F.col("g"), F.desc("s")], ["n", "p"])
    run = run.join(F.broadcast(run.groupBy("g").agg(F.min("before_n").alias("n0"), F.min("before_p").alias("p0"))), "g")
    at = (F.col("before_p") - F.col("p0") + F.col("p")) / (F.col("before_n") - F.col("n0") + F.col("n"))
    return {g: share / total if total else None for g, total, share in run.groupBy("g").agg(F.sum("p"), F.sum(F.col("p") * at)).collect()}
