"""Rows as they must be before they are allocated, joined or connected: checks that return faults, and forms of them that raise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.operators.keys import RoleError


def eligibility(rows: DataFrame, repository: str, key: str, split: str, splits: Sequence[str], hashes: Sequence[str] = ()) -> DataFrame:
    """``rows`` with the names trimmed and a column ``fault``: null, ``identity`` (no repository, key or known split) or ``hash`` (one that is neither empty nor 64 small hex digits)."""
    trimmed = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = rows.withColumns({c: trimmed(c) for c in (repository, key, split)})
    identity = (F.col(repository) == "") | (F.col(key) == "") | ~F.col(split).isin(*splits)
    bad: Column = F.lit(False)
    for c in hashes:
        bad = bad | ~F.coalesce(F.col(c), F.lit("")).rlike("^([0-9a-f]{64})?$")
    return out.withColumn("fault", F.when(identity, "identity").when(bad, "hash"))


def require_eligible(rows: DataFrame, *args, **options) -> DataFrame:
    out = eligibility(rows, *args, **options)
    if bad := out.where("fault is not null").first():
        raise ValueError(f"not an eligible row: {bad.asDict()}")
    return out.drop("fault")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand more than once, with their counts; a null key counts as one."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_unique(rows: DataFrame, key: str) -> DataFrame:
    if bad := repeated(rows, key).first():
        raise ValueError(f"{key} stands {bad['n']} times: {bad[key]}")
    return rows


def exactly(rows: DataFrame, wanted: DataFrame, key: str, role: str, allowed: Sequence[str]) -> DataFrame:
    """The rows of all wanted keys. A key without a row raises, and so does a row whose role must stay unseen."""
    wanted = wanted.select(key).distinct()
    if missing := wanted.join(rows, key, "left_anti").first():
        raise ValueError(f"no row for key {missing[key]}")
    out = rows.join(wanted, key, "left_semi")
    if hidden := out.where(~F.coalesce(F.col(role).isin(*allowed), F.lit(False))).first():
        raise RoleError(f"hidden role: {hidden[role]}")
    return out


def excluded_groups(manifests: DataFrame, group: str, manifest: str) -> DataFrame:
    """Each trimmed group of any manifest once, with the number of manifests and rows that hold it; a row without a group raises."""
    rows = manifests.withColumn(group, F.trim(F.coalesce(F.col(group), F.lit(""))))
    if rows.where(F.col(group) == "").limit(1).count():
        raise ValueError(f"a manifest row has no {group}")
    return rows.groupBy(group).agg(F.countDistinct(manifest).alias("manifests"), F.count("*").alias("row_count"))


def bundles(records: DataFrame, owner: str, kind: str, required: Sequence[str]) -> DataFrame:
    """Whether the kinds of records that each owner has are exactly the required ones, with those that lack and the number of others."""
    per = records.groupBy(owner).agg(*[F.max((F.col(kind) == k).cast("int")).alias(f"_{i}") for i, k in enumerate(required)], F.countDistinct(F.when(~F.col(kind).isin(*required), F.col(kind))).alias("others"))
    lacking = F.concat_ws(",", *[F.when(F.coalesce(F.col(f"_{i}"), F.lit(0)) == 0, F.lit(k)) for i, k in enumerate(required)])
    return per.select(owner, lacking.alias("lacking"), "others", ((lacking == "") & (F.col("others") == 0)).alias("exact"))


def first_inserted(batches: Sequence[DataFrame], key: str, order: str) -> DataFrame:
    """All batches, one after another, with one row of each key: the first batch's, in it the smallest ``order``."""
    every = None
    for i, b in enumerate(batches):
        b = b.withColumn("batch", F.lit(i))
        every = b if every is None else every.unionByName(b)
    rest = [c for c in every.columns if c not in (key, "batch", order)]
    return every.groupBy(key).agg(F.min(F.struct("batch", order, *rest)).alias("row")).select(key, "row.*")
