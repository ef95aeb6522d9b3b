"""Connected components of an edge table, by alternating star contractions.

Each round is two equi-joins over edges only; no adjacency list is ever gathered in one
task, a hub meets its edges by broadcast, and nothing but some counts a round reaches the driver.
Of the rounds' tables only the last stays in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.hot import meet
from kindred.storage import forget, staged


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component = its smallest node.

    Nulls and self-loops carry no link and are dropped; repeated and reversed edges count
    once; an empty edge table gives an empty result. Nodes without an edge are not listed
    (the caller fills in the node itself).
    """
    cur = (
        edges.select(F.col(left).alias("a"), F.col(right).alias("b"))
        .where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    cur = staged(cur, "edges", few=True)
    before = None
    for _ in range(max_rounds):
        # large star: each node hands its larger neighbours to the smallest node it sees
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
        large = meet(both.where("b > a"), low, "a", "n").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node links its smaller neighbours, and itself, to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old, cur = cur, staged(least.select("a", F.col("m").alias("b")).unionByName(small).distinct(), "edges", few=True)
        forget(old)
        now = tuple(cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first())
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.unionByName(roots)
