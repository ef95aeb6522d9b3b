"""Comparing all rows inside groups of any size: square tiles of bounded blocks.

A group of n rows is cut into ``ceil(n / block)`` blocks, or more where its rows are heavy; every unordered
pair of blocks (a block with itself too) is one tile and one task's unit of work, of at most about ``2 *
block`` rows. A tile emits at most one row per row it holds (its links counted, its local root), never pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.storage import staged

#: Groups of more than one block that are broadcast at most.
MOST = 100_000


def with_tiles(rows: DataFrame, group: str, item: str, block: int, weight: str | None = None, most: int | None = None) -> DataFrame:
    """Add ``tile_a``, ``tile_b`` and ``tile_side`` (0: of block a, 1: of block b); a row comes once for each tile of its block.

    With ``weight`` a block's sum of it stays near ``most`` as well. Only groups of several blocks need their
    number of blocks, and there is at most one for each ``block`` rows: up to MOST of them are broadcast, so a
    hot group's rows are not gathered; beyond that it is a plain join. A null group gives no tile.
    """
    heavy = F.sum(weight) / F.lit(float(most)) if weight else F.lit(0.0)
    sizes = rows.groupBy(group).agg(F.ceil(F.greatest(F.count("*") / F.lit(block), heavy)).cast("int").alias("_blocks")).where("_blocks > 1")
    sizes = staged(sizes, "blocks", few=True)
    sizes = F.broadcast(sizes) if sizes.limit(MOST + 1).count() <= MOST else sizes
    placed = rows.where(F.col(group).isNotNull()).join(sizes, group, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    placed = placed.withColumn("_own", F.pmod(F.xxhash64(F.col(item)), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    return placed.select(*rows.columns, "_own", other).select(
        *rows.columns,
        F.least("_own", "_other").alias("tile_a"),
        F.greatest("_own", "_other").alias("tile_b"),
        F.when(F.col("_own") <= F.col("_other"), 0).otherwise(1).alias("tile_side"),
    )


#: Rows and weight that one call works through, about, where its groups are small.
SHARD_ROWS, SHARD_WEIGHT = 1024, 1 << 20


def sharded(rows: DataFrame, keys: list[str], weight: str, work: Callable[[pd.DataFrame], pd.DataFrame | None], schema: str) -> DataFrame:
    """``work`` on each group of ``keys``, of bounded size each, many groups in a call: most groups are small, and a call costs a millisecond.

    A shard holds whole groups, by hash, and about ``SHARD_ROWS`` rows or ``SHARD_WEIGHT`` of weight.
    """
    total = rows.agg(F.count("*").alias("n"), F.sum(weight).alias("w")).first()
    shards = max(1, int(max(total["n"] / SHARD_ROWS, (total["w"] or 0) / SHARD_WEIGHT)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys, kind="stable", ignore_index=True)
        key = pdf[keys].to_numpy()
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(pdf)]
        out = [x for a, b in zip(cut[:-1], cut[1:], strict=True) if b > a and (x := work(pdf.iloc[a:b])) is not None and len(x)]
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in names}, dtype=object)

    names = [c.split(" ")[0] for c in schema.split(", ")]
    return rows.withColumn("shard", F.pmod(F.xxhash64(*keys), F.lit(shards))).groupBy("shard").applyInPandas(run, schema)


_SIGN = -(1 << 63)


def node_of(key: Column, digest: Column) -> Column:
    """A name that sorts like the long ``key``; after all of those, one by the digest where the key is null."""
    return F.coalesce(F.lpad(F.hex(key.bitwiseXOR(F.lit(_SIGN))), 16, "0"), F.concat(F.lit("~"), F.hex(digest)))


def key_of(node: Column) -> Column:
    """The key of a name that ``node_of`` gave; null where it had none."""
    half = lambda at: F.conv(F.substring(node, at, 8), 16, 10).cast("long")
    return F.when(~node.startswith("~"), F.shiftleft(half(1), 32).bitwiseOR(half(9)).bitwiseXOR(F.lit(_SIGN)))


def local_roots(linked: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Roots of the rows and of the columns of a link matrix, as positions in rows then columns (rows only if ``same``)."""
    n, m = linked.shape
    if same:
        root = np.arange(n)
        while True:
            new = np.minimum(root, np.where(linked, root[None, :], n).min(axis=1, initial=n))
            new = np.minimum(new, new[new])
            if (new == root).all():
                return root, root
            root = new
    rows, cols = np.arange(n), np.arange(n, n + m)
    while True:
        new_r = np.minimum(rows, np.where(linked, cols[None, :], n + m).min(axis=1, initial=n + m))
        new_c = np.minimum(cols, np.where(linked, new_r[:, None], n + m).min(axis=0, initial=n + m))
        both = np.concatenate([new_r, new_c])
        both = np.minimum(both, both[both])
        if (both[:n] == rows).all() and (both[n:] == cols).all():
            return rows, cols
        rows, cols = both[:n], both[n:]


def settled(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place that each of n places reaches over the edges (a, b)."""
    root = np.arange(n)
    while True:
        new = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
