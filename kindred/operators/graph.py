"""Evidence graph over groups: edges, components with content-derived ids, and role crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.ledger import streamed_digests
from kindred.storage import staged
from kindred.operators.components import connected_components


def shared_content_edges(rows: DataFrame, node: str, content: str) -> DataFrame:
    """Star edges between nodes that hold equal content: to the smallest of them, so n nodes give n - 1 edges."""
    held = rows.select(F.col(node).alias("n"), F.col(content).alias("x")).where("n is not null and x is not null").distinct()
    low = held.groupBy("x").agg(F.min("n").alias("low"))
    return held.join(low, "x").where("n <> low").select(F.col("low").alias("a"), F.col("n").alias("b")).distinct()


def resolved_edges(candidates: DataFrame, dispositions: DataFrame, rules: DataFrame, protocol: str) -> DataFrame:
    """Candidates with ``review_status`` and ``connecting``.

    candidates: candidate_id, edge_type, a, b; dispositions: candidate_id, disposition, protocol_sha256; rules: edge_type,
    requirement (AUTO, REVIEW_ONLY or APPROVED_REQUIRED), connects. AUTO edges are approved and connect as their rule
    says, REVIEW_ONLY ones never connect, the others connect once a disposition approves them and are UNRESOLVED without
    one. The query fails on a disposition that has no candidate, that a rule does not take, that was made under another
    protocol, or that comes twice, and on a type without a rule. a is the smaller of the two ends.
    """
    d = dispositions.groupBy("candidate_id").agg(F.count("*").alias("_times"), F.max("disposition").alias("disposition"), F.max("protocol_sha256").alias("_protocol"))
    c = candidates.select("*", F.lit(True).alias("_there"))
    both = c.join(d, "candidate_id", "full").join(rules.select("edge_type", "requirement", "connects"), "edge_type", "left")
    given = F.col("_times").isNotNull()
    wrong = (
        F.when(F.col("_there").isNull(), "disposition without candidate").when(F.col("requirement").isNull(), "type without rule").when(F.col("_times") > 1, "two dispositions")
        .when(given & (F.col("requirement") != "APPROVED_REQUIRED"), "rule takes no disposition").when(given & ~F.col("_protocol").eqNullSafe(F.lit(protocol)), "stale disposition")
    )
    status = F.when(wrong.isNotNull(), F.raise_error(F.concat_ws(": ", wrong, F.col("candidate_id").cast("string")))).when(F.col("requirement") == "AUTO", "APPROVED").when(F.col("requirement") == "REVIEW_ONLY", "REVIEW_ONLY").otherwise(F.coalesce("disposition", F.lit("UNRESOLVED")))
    connecting = F.when(F.col("requirement") == "AUTO", F.col("connects")).otherwise((F.col("requirement") == "APPROVED_REQUIRED") & (F.col("review_status") == "APPROVED"))
    rest = [n for n in candidates.columns if n not in ("a", "b")]
    return both.withColumn("review_status", status).withColumn("connecting", connecting).select(*rest, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "review_status", "connecting")


def components_of(nodes: DataFrame, edges: DataFrame, name: str, protocol: str) -> DataFrame:
    """Every node with its component, the component's size and its id: a hash of its sorted members and the protocol."""
    comp = connected_components(edges).withColumnRenamed("node", name)
    named = nodes.select(name).where(F.col(name).isNotNull()).distinct().join(comp, name, "left").withColumn("component", F.coalesce("component", name))
    named = staged(named, "components")
    ids = streamed_digests(named, ["component"], [name], F.col(name), between="\n", after=f"\n{protocol}")
    return named.join(ids.select("component", F.col("n").cast("int").alias("size"), F.col("sha256").alias("component_id")), "component")


def role_crossings(members: DataFrame, name: str, rows: str = "row_count") -> DataFrame:
    """For each ordered pair of roles: components that hold both, and rows of their groups in either; needs component, role and the row count."""
    by_role = members.groupBy("component", "role").agg(F.count(name).alias("groups"), F.sum(rows).alias("rows"))
    other = by_role.select(F.col("component").alias("_c"), F.col("role").alias("role_b"), F.col("groups").alias("groups_b"), F.col("rows").alias("rows_b"))
    both = by_role.join(other, (F.col("component") == F.col("_c")) & (F.col("role") < F.col("role_b")))
    return both.groupBy(F.col("role").alias("role_a"), "role_b").agg(F.count("*").alias("components"), F.sum(F.col("groups") + F.col("groups_b")).alias("groups"), F.sum(F.col("rows") + F.col("rows_b")).alias("rows"))


def outcome(metadata_complete: bool, unreviewed: int, crossings: int) -> str:
    """Missing metadata goes before open reviews, those before crossings."""
    if not metadata_complete:
        return "METADATA_INCOMPLETE"
    if unreviewed:
        return "REVIEW_REQUIRED"
    return "ROLE_CROSSING_FOUND" if crossings else "NO_ROLE_CROSSING"
