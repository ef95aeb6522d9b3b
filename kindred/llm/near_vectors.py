"""Operator 1: near-duplicate vectors by PCA-ordered tiled comparison.

Vectors with equal labels are compared exactly. They are turned to the principal axes of all
vectors; inside a tile the leading axes are accumulated first, what the remaining axes can still
add is bounded by the product of suffix norms (Cauchy-Schwarz), and rows, columns and at last single
pairs leave as soon as their cosine cannot reach the threshold. Pairs that survive are decided by the
double-precision cosine of the vectors as they came.

Scale: vectors travel as packed bytes; equal ones are folded into one with a weight before anything else.
A label's vectors are dealt into cells along the two leading axes; as linked unit vectors lie within
``sqrt(2 - 2t)`` of each other on every axis, only a cell and the cells beside it meet. Cells are cut into
blocks of up to ``block`` rows by hash, so a hot label is spread over many tiles, a vector is sent once for
each block that it meets, and a tile (worked through some rows at a time) returns counts and local roots,
not pairs. Nodes are named by the smallest key of their copies, so the contraction gives the smallest key.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.tables import table
from kindred.llm.tiles import key_of, local_roots, node_of, settled
from kindred.operators.components import connected_components
from kindred.operators.hot import meet
from kindred.storage import staged

THRESHOLD = 0.93
#: Rows of a block at most, and bytes.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
#: Rows of a block that a tile works on at once.
ROWS = 512
#: Axes that are accumulated between two tests of the bound.
STEP = 8
#: Cells that are broadcast at most.
MOST = 100_000


def principal_axes(packed: DataFrame, dim: int) -> np.ndarray:
    """Principal axes (columns, strongest first) of all unit vectors of length ``dim`` in the binary column ``v``.

    Each task sums its outer products; Spark adds up dim rows of dim numbers, which is all that the driver gets.
    An empty table gives some orthonormal axes.
    """

    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = np.frombuffer(b"".join(pdf["v"]), dtype="<f8").reshape(-1, dim)
                x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(dim)} | {f"c{j}": total[:, j] for j in range(dim)})

    schema = "i long, " + ", ".join(f"c{j} double" for j in range(dim))
    sums = packed.select("v").mapInPandas(outer, schema).groupBy("i").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(dim)])
    gram = np.zeros((dim, dim))
    for row in sums.collect():
        gram[row["i"]] = row[1:]
    _, axes = np.linalg.eigh((gram + gram.T) / 2)
    return np.ascontiguousarray(axes[:, ::-1])


def linked_in_tile(a: np.ndarray, b: np.ndarray, axes: np.ndarray | None, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) with cosine(a[i], b[j]) >= threshold, in double precision. Rows must be finite and not zero; no rows give no positions."""
    na, nb = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
    ua, ub = a / na[:, None], b / nb[:, None]
    if axes is not None and axes.shape[0] == a.shape[1]:
        ua, ub = ua @ axes, ub @ axes
    low, d = threshold - 1e-9, a.shape[1]
    rest_a = np.sqrt(np.maximum(0, np.cumsum((ua * ua)[:, ::-1], axis=1)[:, ::-1]))
    rest_b = np.sqrt(np.maximum(0, np.cumsum((ub * ub)[:, ::-1], axis=1)[:, ::-1]))
    ia, ib = np.arange(len(a)), np.arange(len(b))
    part = np.zeros((len(a), len(b)))
    at = 0
    while at < d and part.size:
        end = min(d, at + step)
        part += ua[ia, at:end] @ ub[ib, at:end].T
        at = end
        if at == d:
            break
        alive = part + rest_a[ia, at][:, None] * rest_b[ib, at][None, :] >= low
        if alive.mean() < 0.02:
            break
        r, c = alive.any(axis=1), alive.any(axis=0)
        if not (r.all() and c.all()):
            ia, ib, part = ia[r], ib[c], part[np.ix_(r, c)]
    if not part.size:
        return np.zeros(0, dtype=int), np.zeros(0, dtype=int)
    if at < d:
        i, j = np.nonzero(alive)
        i, j, p = ia[i], ib[j], part[i, j]
        while at < d and len(i):
            end = min(d, at + step)
            p = p + (ua[i, at:end] * ub[j, at:end]).sum(axis=1)
            at = end
            keep = p + (rest_a[i, at] * rest_b[j, at] if at < d else 0) >= low
            i, j, p = i[keep], j[keep], p[keep]
    else:
        i, j = np.nonzero(part >= low)
        i, j = ia[i], ib[j]
    sure = np.zeros(len(i), dtype=bool)
    for s in range(0, len(i), 1 << 16):  # bounded memory where nearly all pairs link
        x, y = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
        sure[s : s + (1 << 16)] = (a[x] * b[y]).sum(axis=1) / (na[x] * nb[y]) >= threshold
    return i[sure], j[sure]


def tile_links(a: np.ndarray, b: np.ndarray, wa: np.ndarray, wb: np.ndarray, same: bool, axes: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links by weight, local root) of the rows of a and then, unless both are the ``same``, of b; some rows of a at a time."""
    n = len(a) if same else len(a) + len(b)
    count, below = np.zeros(n, dtype=np.int64), 0 if same else len(a)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for s in range(0, len(a), ROWS):
        i, j = linked_in_tile(a[s : s + ROWS], b, axes, threshold)
        if same:
            i, j = i[i + s != j], j[i + s != j]
        if not len(i):
            continue
        linked = np.zeros((min(ROWS, len(a) - s), len(b)), dtype=bool)
        linked[i, j] = True
        count[s : s + len(linked)] += linked @ wb
        if not same:
            count[below:] += linked.T @ wa[s : s + len(linked)]
        rows, cols = local_roots(linked, False)
        place = np.concatenate([np.arange(s, s + len(linked)), below + np.arange(len(b))])
        root = np.concatenate([rows, cols])
        ends.append((place[root != np.arange(len(root))], place[root[root != np.arange(len(root))]]))
    if not ends:
        return count, np.arange(n)
    return count, settled(n, np.concatenate([x for x, _ in ends]), np.concatenate([y for _, y in ends]))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        v, d, digest = [], [], []
        for label, x in zip(pdf["label"], pdf["v"], strict=True):
            x = None if x is None else np.array([np.nan if y is None else y for y in x] if x.dtype == object else x, dtype="<f8") + 0.0  # -0.0 and 0.0 are one value
            good = label is not None and x is not None and len(x) and np.isfinite(x).all()
            with np.errstate(over="ignore"):
                good = good and 0 < (x * x).sum() < np.inf
            raw = x.tobytes() if good else None
            v.append(raw)
            d.append(len(x) if good else 0)
            digest.append(hashlib.blake2b(raw + label.encode(), digest_size=16).digest() if good else None)
        yield pd.DataFrame({"id": pdf["id"], "label": pdf["label"], "d": d, "digest": digest, "v": v})


def near_vectors(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per vector: its key, ``n_links``, ``component_id`` and ``kept``.

    Vectors link if their labels are equal and their cosine is at least ``threshold`` (above 0).
    A null label, a null, empty or zero vector, and one with null or non-finite components (or a norm beyond
    doubles) link with nothing; neither do vectors of unlike lengths. Equal vectors count singly, and rows with
    the same key are separate vectors (each gets a row; they share a component if they link). A null key gets
    a row with its links, but no component. Further columns are ignored. An empty table gives no rows.
    """
    src = vectors.select(F.col(key).cast("long").cast("string").alias("id"), F.col(label).cast("string").alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    rows = src.mapInPandas(_pack, "id string, label string, d int, digest binary, v binary")
    rows = staged(rows.withColumn("id", F.col("id").cast("long")), "vectors", like=vectors)
    good = rows.where("digest is not null")
    top = good.groupBy("d").count().orderBy(F.desc("count"), "d").first()
    dim = int(top["d"]) if top else 0
    axes = principal_axes(good.where(F.col("d") == dim), dim) if dim else None
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-6) + 1e-6

    @F.pandas_udf("array<int>")
    def cell(v: pd.Series) -> pd.Series:
        out = []
        for b in v:
            x = np.frombuffer(b, dtype="<f8")
            at = (x / np.sqrt(x @ x)) @ axes[:, :2] if axes is not None and len(x) == dim else np.zeros(2)
            out.append([int(y // width) for y in (*at, 0.0)[:2]])
        return pd.Series(out)

    reps = good.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("w"), F.first("label").alias("label"), F.first("d").alias("d"), F.first("v").alias("v"))
    reps = reps.withColumn("xy", cell("v")).select("digest", "rep", "w", "label", "d", "v", node_of(F.col("rep"), F.col("digest")).alias("c"), F.get("xy", F.lit(0)).alias("x"), F.get("xy", F.lit(1)).alias("y"))
    reps = staged(reps, "vectors")
    at = ["label", "d", "x", "y"]
    least = F.greatest(F.lit(64), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES / 8) / F.col("d")))) if block >= 64 else F.lit(block)
    cells = staged(reps.groupBy(*at).agg(F.ceil(F.count("*") / least).cast("int").alias("n")), "cells", few=True)
    # a cell and those beside it, with their numbers of blocks: nine at most
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("s")
    seen = cells.select("label", "d", F.col("x").alias("x0"), F.col("y").alias("y0"), steps).select("label", "d", "x0", "y0", (F.col("x0") + F.col("s.dx")).alias("x"), (F.col("y0") + F.col("s.dy")).alias("y"), "s.dx", "s.dy")
    beside = seen.join(cells, at).groupBy("label", "d", F.col("x0").alias("x"), F.col("y0").alias("y"))
    beside = staged(beside.agg(F.collect_list(F.struct("dx", "dy", "n")).alias("beside"), F.max(F.when((F.col("dx") == 0) & (F.col("dy") == 0), F.col("n"))).alias("n")), "cells", few=True)
    # few cells meet their vectors by broadcast, so a hot label is not gathered; many are no hot ones, or adaptive execution splits them
    beside = F.broadcast(beside) if beside.limit(MOST + 1).count() <= MOST else beside
    own = F.pmod(F.xxhash64("digest"), F.col("n")).cast("int")
    placed = reps.join(beside, at).withColumn("own", own).select("c", "w", "v", *at, "own", F.explode("beside").alias("o"))
    placed = placed.select("c", "w", "v", *at, "own", "o.*").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    here, after = (F.col("dx") == 0) & (F.col("dy") == 0), (F.col("dx") > 0) | ((F.col("dx") == 0) & (F.col("dy") > 0))
    # the first block of a tile is in the cell (x, y), the second in (x + dx, y + dy), which comes after it
    first = (here & (F.col("own") <= F.col("other"))) | after
    pick = lambda yes, no: F.when(first, yes).otherwise(no)
    tiles = placed.select(
        "c", "w", "v", "label", "d", pick(F.col("x"), F.col("x") + F.col("dx")).alias("x"), pick(F.col("y"), F.col("y") + F.col("dy")).alias("y"), F.abs("dx").alias("dx"),
        F.when(F.col("dx") < 0, -F.col("dy")).when(F.col("dx") == 0, F.abs("dy")).otherwise(F.col("dy")).alias("dy"), pick(F.col("own"), F.col("other")).alias("ba"), pick(F.col("other"), F.col("own")).alias("bb"), pick(0, 1).alias("side"),
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf.iloc[0]
        same = bool(f["dx"] == 0 and f["dy"] == 0 and f["ba"] == f["bb"])
        a = pdf if same else pdf[pdf["side"] == 0]
        b = a if same else pdf[pdf["side"] == 1]
        if not len(a) or not len(b):
            return pd.DataFrame({"c": [], "root": [], "n": []}, dtype=object)
        va, vb = (np.frombuffer(b"".join(p["v"]), dtype="<f8").reshape(len(p), -1) for p in (a, b))
        n, root = tile_links(va, vb, a["w"].to_numpy(), b["w"].to_numpy(), same, axes, threshold)
        names = a["c"].to_numpy() if same else np.concatenate([a["c"].to_numpy(), b["c"].to_numpy()])
        hit = n > 0
        return pd.DataFrame({"c": names[hit], "root": names[root[hit]], "n": n[hit]})

    found = staged(tiles.groupBy("label", "d", "x", "y", "dx", "dy", "ba", "bb").applyInPandas(compare, "c string, root string, n long"), "links", few=True)
    links = found.groupBy("c").agg(F.sum("n").alias("n"))
    comp = connected_components(found, "c", "root").select(F.col("node").alias("c"), key_of(F.col("component")).alias("component_id"))
    named = reps.select("digest", "rep", "w", "c").join(links, "c", "left").join(comp, "c", "left")
    named = named.select("digest", "w", (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    # only rows that can link go through the join: those without a digest would meet in one task
    linked = meet(good.select("id", "digest"), named, "digest", "w").select("id", "n_links", "component_id")
    alone = rows.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(key), "n_links", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: DuckDB: all pairs of one label, vectors once each, components by recursion.
OP1_SQL = r"""
WITH RECURSIVE e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
g AS (SELECT *, sqrt(list_dot_product(v, v)) AS m FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
u AS (SELECT label, v, min(vec_id) AS c, count(*) AS n, first(m) AS m FROM g WHERE m > 0 GROUP BY label, v),
lk AS (SELECT a.c AS a, b.c AS b, b.n FROM u a JOIN u b ON a.label = b.label AND a.c <> b.c AND len(a.v) = len(b.v) WHERE list_dot_product(a.v, b.v) / (a.m * b.m) >= 0.93),
reach AS (SELECT a AS c, a AS r FROM lk UNION SELECT reach.c, lk.b FROM reach JOIN lk ON reach.r = lk.a),
comp AS (SELECT c, min(r) AS r FROM reach GROUP BY c),
s AS (SELECT a, sum(n) AS n FROM lk GROUP BY a),
o AS (SELECT g.vec_id, (u.n - 1 + coalesce(s.n, 0))::BIGINT AS n_links, coalesce(comp.r, u.c) AS component_id FROM g JOIN u ON g.label = u.label AND g.v = u.v LEFT JOIN s ON s.a = u.c LEFT JOIN comp ON comp.c = u.c),
t AS (SELECT * FROM o UNION ALL SELECT vec_id, 0, vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM o))
SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM t
"""
