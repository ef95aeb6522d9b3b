"""Audits of an allocation: name families, owners, near duplicates across roles, disjointness, splits, ordered commitments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions import names as N
from kindred.operators import duplicates as D
from kindred.operators.ledger import streamed_digests
from kindred.storage import staged


def name_families(repositories: DataFrame, repository: str = "repository", role: str = "role") -> DataFrame:
    """``(kind, signature, roles, repositories)`` of exact names and families that span two roles and two repositories."""
    s = N.signatures(F.col(repository))
    rows = repositories.select(repository, role, F.explode(F.array(F.struct(F.lit("exact").alias("kind"), s["exact"].alias("signature")), F.struct(F.lit("family").alias("kind"), s["family"].alias("signature")))).alias("x"))
    rows = rows.select(repository, role, "x.*").where("signature <> ''")
    out = rows.groupBy("kind", "signature").agg(F.countDistinct(role).alias("roles"), F.countDistinct(repository).alias("repositories"))
    return out.where("roles >= 2 and repositories >= 2")


def owners_by_role(repositories: DataFrame, roles: tuple[str, ...], repository: str = "repository", role: str = "role", rows: str = "row_count") -> DataFrame:
    """Owners whose repositories stand in two roles or more: repositories and rows in each role, and the number of roles."""
    count = [F.count_if(F.col(role) == r).alias(f"{r}_repositories") for r in roles] + [F.coalesce(F.sum(F.when(F.col(role) == r, F.col(rows))), F.lit(0)).alias(f"{r}_rows") for r in roles]
    out = repositories.groupBy(N.owner(F.col(repository)).alias("owner")).agg(*count, F.countDistinct(role).alias("roles"))
    return out.where("owner is not null and roles >= 2")


def owner_role_pairs(repositories: DataFrame, pairs: list[tuple[str, str]], roles: tuple[str, ...], **names: str) -> DataFrame:
    """One row: owners in more than one role, in both of each pair of roles, and in three or more."""
    o = owners_by_role(repositories, roles, **names)
    both = [F.count_if((F.col(f"{a}_repositories") > 0) & (F.col(f"{b}_repositories") > 0)).alias(f"{a}__{b}") for a, b in pairs]
    return o.agg(F.count("*").alias("owners"), *both, F.count_if(F.col("roles") >= 3).alias("three_or_more"))


def bucket_sizes(prints: DataFrame, fingerprint: str, most: int) -> DataFrame:
    """By band: buckets, the rows of the largest, and how many buckets and rows a bound of ``most`` rows would leave out."""
    banded = prints.select(F.posexplode(D.bands(F.col(fingerprint))).alias("band", "value")).groupBy("band", "value").agg(F.count("*").alias("n"))
    over = F.col("n") > most
    return banded.groupBy("band").agg(F.count("*").alias("buckets"), F.max("n").alias("largest"), F.count_if(over).alias("oversized"), F.coalesce(F.sum(F.when(over, F.col("n"))), F.lit(0)).alias("rows_left_out"))


def close_prints(prints: DataFrame, fingerprint: str, most: int = 3, bucket_bound: int | None = None) -> DataFrame:
    """``(f, g, distance)``: fingerprints within ``most`` bits, f <= g, each pair once, each fingerprint with itself.

    ``bucket_bound`` keeps only pairs that share a 16-bit band of at most so many distinct fingerprints, as a bounded
    audit does; what that leaves out is counted by ``bucket_sizes``.
    """
    f = prints.select(F.col(fingerprint).alias("f")).distinct()
    near = D.near_prints(f, "f", most)
    if bucket_bound is not None:
        near = staged(near, "near")
        small = f.select(F.posexplode(D.bands(F.col("f"))).alias("band", "value")).groupBy("band", "value").count().where(F.col("count") <= bucket_bound).select("band", "value")
        shared = near.select("f", "g", F.posexplode(F.zip_with(D.bands(F.col("f")), D.bands(F.col("g")), lambda a, b: F.when(a == b, a))).alias("band", "value")).where("value is not null")
        near = near.join(shared.join(small, ["band", "value"], "left_semi"), ["f", "g"], "left_semi")
    return near.unionByName(f.select("f", F.col("f").alias("g"), F.lit(0).alias("distance")))


def near_duplicate_report(prints: DataFrame, fingerprint: str, role: str, repository: str, most: int = 3, bucket_bound: int | None = None) -> DataFrame:
    """``(distance, pairs, fingerprint_pairs)`` of near rows in different roles and repositories; pairs of rows are counted, not made.

    Rows are folded to counts by fingerprint, and of the product of two counts those of equal role or equal
    repository are taken away (those of both are put back): a fingerprint with a million rows is one row here.
    """
    rows = prints.select(F.col(fingerprint).alias("f"), F.col(role).alias("role"), F.col(repository).alias("repository"))
    close = staged(close_prints(rows, "f", most, bucket_bound), "close", few=True)
    total = None
    for by, sign in (([], 1), (["role"], -1), (["repository"], -1), (["role", "repository"], 1)):
        n = rows.groupBy("f", *by).agg(F.count("*").alias("n"))
        a, b = n.withColumnRenamed("n", "na"), n.select(F.col("f").alias("g"), *by, F.col("n").alias("nb"))
        met = close.join(a.hint("merge"), "f").join(b.hint("merge"), ["g", *by])
        # a fingerprint with itself counts each pair of rows twice, and each row with itself once: these cancel out
        part = met.groupBy("f", "g", "distance").agg((F.sum(F.col("na") * F.col("nb")) * sign).alias("n"))
        total = part if total is None else total.unionByName(part)
    pairs = total.groupBy("f", "g", "distance").agg(F.sum("n").alias("n")).withColumn("n", F.when(F.col("f") == F.col("g"), F.col("n") / 2).otherwise(F.col("n")).cast("long"))
    return pairs.where("n > 0").groupBy("distance").agg(F.sum("n").alias("pairs"), F.count("*").alias("fingerprint_pairs"))


def near_pair_label(same_tree: Column, same_owner: Column, same_family: Column, shortest: Column, distance: Column, short: int = 8) -> Column:
    """What a near pair is, the first label that holds (labels are fixed values)."""
    brief = shortest <= short
    return (
        F.when(same_tree & same_owner, "EXACT_AST_RELATED_OWNER")
        .when(brief & (distance == 0) & ~same_tree, "GENERIC_SHORT_FUNCTION_COLLISION")
        .when(same_owner, "SAME_OWNER_NEAR_MATCH")
        .when(same_family, "SAME_FAMILY_NAME_NEAR_MATCH")
        .when(brief, "POSSIBLE_TEMPLATE_OR_BOILERPLATE")
        .otherwise("UNRESOLVED_NEAR_MATCH")
    )


def degrees(pairs: DataFrame, left: str = "left_key", right: str = "right_key") -> DataFrame:
    """``(key, degree)`` of the endpoints of pairs."""
    return pairs.select(F.explode(F.array(left, right)).alias("key")).groupBy("key").agg(F.count("*").alias("degree"))


def in_two_roles(rows: DataFrame, group: str, role: str) -> DataFrame:
    """Groups that break disjointness: those in more than one role, with their number of roles."""
    return rows.groupBy(group).agg(F.countDistinct(role).alias("roles")).where("roles > 1")


def require_disjoint(rows: DataFrame, group: str, role: str) -> None:
    bad = in_two_roles(rows, group, role).limit(5).collect()
    if bad:
        raise ValueError(f"groups in several roles: {sorted(str(r[group]) for r in bad)}")


def with_support(rows: DataFrame, group: str, least: int) -> DataFrame:
    """Rows of groups of ``least`` rows or more."""
    return rows.join(rows.groupBy(group).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(group), group, "left_semi")


def ordered_commitment(rows: DataFrame, by: list[str], key: str, line: str) -> DataFrame:
    """``(by, commitment, n)``: SHA-256 of a group's lines, each ended by a line break, in the order of key and line."""
    out = streamed_digests(rows, by, [key, line], F.concat(F.col(line), F.lit("\n")))
    return out.select(*by, F.col("sha256").alias("commitment"), "n")


def json_item(value: Column) -> Column:
    """A string as it stands in a JSON list."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def sequence_hash(rows: DataFrame, by: list[str], key: str, order: str) -> DataFrame:
    """``(by, sha256, n)`` of the JSON list of a group's string keys in order."""
    return streamed_digests(rows, by, [order, key], json_item(F.col(key)), "[", ",", "]")


def manifest_faults(pairs: DataFrame, group: str, order: str, digest: str, expected: Column) -> DataFrame:
    """By group: pairs, whether their order runs from 0 without a gap or repeat, and digests that differ from the expected ones."""
    o = F.col(order)
    return pairs.groupBy(group).agg(F.count("*").alias("pairs"), ((F.min(o) == 0) & (F.max(o) == F.count("*") - 1) & (F.countDistinct(o) == F.count("*"))).alias("contiguous"), F.count_if(F.col(digest) != expected).alias("wrong_digests"))


def selective_diagnostics(rows: DataFrame, by: list[str], group: str) -> DataFrame:
    """Per method: rows, accepted, refused, errors, coverage, risk (null where nothing is accepted), reasons of refusal as JSON, and the spread of groups' risks."""
    accepted, wrong = F.col("accepted"), (F.col("prediction") != F.col("truth")).cast("int")
    per = rows.groupBy(*by, group).agg(F.count("*").alias("n"), F.count_if(accepted).alias("a"), F.sum(F.when(accepted, wrong)).alias("e"))
    risk = F.when(F.col("a") > 0, F.col("e") / F.col("a"))
    out = per.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.sum("a").alias("accepted"), F.coalesce(F.sum("e"), F.lit(0)).alias("errors"), F.count_if(F.col("a") > 0).alias("groups_with_acceptance"),
        F.avg(risk).alias("mean_risk"), F.stddev_pop(risk).alias("std_risk"), F.min(risk).alias("min_risk"), F.max(risk).alias("max_risk"),
    )
    why = rows.where(~accepted).groupBy(*by, "reason").agg(F.count("*").alias("n")).groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "reason", F.col("n").cast("string")))), ",").alias("refusals"))
    out = out.join(why, by, "left").withColumn("refused", F.col("rows") - F.col("accepted"))
    return out.withColumn("coverage", F.col("accepted") / F.col("rows")).withColumn("risk", F.when(F.col("accepted") > 0, F.col("errors") / F.col("accepted"))).withColumn("refusals", F.coalesce("refusals", F.lit("")))
