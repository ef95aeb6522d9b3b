"""Stable keys, hash orders, folds, and allocation of whole groups to roles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kindred.operators.hot import meet
from kindred.storage import staged


class RoleError(ValueError):
    """A role was asked for that must stay unseen."""


def stable_key(*cols: Column | str) -> Column:
    return F.sha2(F.concat_ws("\n", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]), 256)


def order_key(domain: str, context: str, value: Column | str) -> Column:
    """Domain-separated hash order: parts stand apart by NUL."""
    value = F.col(value) if isinstance(value, str) else value
    return F.sha2(F.concat(F.lit(domain), F.lit("\0"), F.lit(context), F.lit("\0"), value.cast("string")), 256)


def hash_limit(rows: DataFrame, group: str, key: Column, n: int) -> DataFrame:
    """The n rows of each group with the smallest keys."""
    return rows.withColumn("key", key).withColumn("rk", F.row_number().over(W.partitionBy(group).orderBy("key"))).where(F.col("rk") <= n)


def global_rank(rows: DataFrame, order: list[Column], name: str = "rk") -> DataFrame:
    """``rows`` with their place from 1 in a total order: ranges of rows are ranked by themselves, after the rows of earlier ranges.

    The only window without a key sees one row per range.
    """
    dealt = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    here = F.row_number().over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_here", here).join(before, "_range").withColumn(name, F.col("_here") + F.col("_before")).drop("_range", "_here", "_before")


def prefix_sums(rows: DataFrame, order: list[Column], sums: list[str]) -> DataFrame:
    """``rows`` with ``before_<column>`` for each of ``sums``: its sum over all rows that come earlier in a total order.

    Ranges of rows are summed by themselves, after the sums of earlier ranges; the only window without a key sees one row per range.
    """
    dealt = staged(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    whole = dealt.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select("_range", *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_{c}") for c in sums])
    here = W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(here), F.lit(0)) for c in sums}).join(whole, "_range")
    return out.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_{c}") for c in sums}).drop("_range", *[f"_{c}" for c in sums])


def average_ranks(rows: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """``rows`` with their rank from 1 in the order of some columns, ties averaged (a null is a value like others, the first; -0 is 0).

    Equal rows are counted first, and the counts summed up range by range, so a tie of any size is one row until its
    rank goes back to the rows; ``rows`` is read twice, so it should be a stored table.
    """
    value = lambda c: F.col(c) + 0.0 if rows.schema[c].dataType.typeName() in ("double", "float") else F.col(c)
    keyed = rows.withColumn("_tie", F.sha2(F.to_json(F.struct(*[value(c).cast("string").alias(c) for c in order]), {"ignoreNullFields": "false"}), 256))
    ties = keyed.groupBy(*order, "_tie").agg(F.count("*").alias("_n"))
    ranks = prefix_sums(ties, [F.col(c) for c in order], ["_n"]).select("_tie", (F.col("before__n") + (F.col("_n") + 1) / 2).alias(name), "_n")
    return meet(keyed, ranks, "_tie", "_n").drop("_tie", "_n")


def hash_folds(groups: DataFrame, name: str, k: int) -> DataFrame:
    """Balanced folds of distinct groups by hash order."""
    g = groups.select(name).where(F.col(name).isNotNull()).distinct().withColumn("_h", F.sha2(F.col(name).cast("string"), 256))
    return global_rank(g, [F.col("_h"), F.col(name)]).select(name, ((F.col("rk") - 1) % k).cast("int").alias("fold"))


def role_quotas(n: int, minimums: Sequence[int], weights: Sequence[float]) -> list[int]:
    """Minimums first, the rest by largest remainder; ties to the earlier role."""
    rest = n - sum(minimums)
    if rest < 0:
        raise ValueError(f"{n} groups can't meet minimums of {sum(minimums)}")
    exact = [rest * w / sum(weights) for w in weights]
    out = [m + math.floor(x) for m, x in zip(minimums, exact, strict=True)]
    by_remainder = sorted(range(len(weights)), key=lambda i: (-(exact[i] - math.floor(exact[i])), i))
    for i in by_remainder[: n - sum(out)]:
        out[i] += 1
    return out


def allocate(groups: DataFrame, name: str, roles: Sequence[str], quotas: Sequence[int], domain: str, context: str) -> DataFrame:
    """Whole groups to roles: hash order, cut at cumulative quotas."""
    out = global_rank(groups.select(name).distinct().withColumn("order_key", order_key(domain, context, name)), [F.col("order_key"), F.col(name)])
    role, up = F.lit(None).cast("string"), sum(quotas)
    for r, n in reversed(list(zip(roles, quotas, strict=True))):
        role = F.when(F.col("rk") <= up, F.lit(r)).otherwise(role)
        up -= n
    return out.withColumn("role", role)


def visible(rows: DataFrame, assignment: DataFrame, name: str, asked: Sequence[str], allowed: Sequence[str]) -> DataFrame:
    """Rows of the asked roles; a role that must stay unseen raises before anything is read."""
    if hidden := [r for r in asked if r not in allowed]:
        raise RoleError(f"hidden roles: {hidden}")
    return rows.join(assignment.where(F.col("role").isin(*asked)).select(name, "role"), name)


def cross_split_duplicates(rows: DataFrame, split: str, content: str) -> DataFrame:
    """Rows whose content stands in one split only; every occurrence of the others goes."""
    twice = rows.groupBy(content).agg(F.min(split).alias("_a"), F.max(split).alias("_b")).where("_a <> _b").select(F.col(content).alias("_c"))
    return rows.join(twice, F.col(content) == F.col("_c"), "left_anti")
