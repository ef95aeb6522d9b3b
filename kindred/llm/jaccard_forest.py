"""Operator 4: n-gram Jaccard join by a MinHash LSH forest, with exact verification.

Each text becomes the set of its hashed five-word runs and, for each of ``trees`` trees, a path of ``depth``
16-bit MinHash values. All paths are sorted by (tree, path) over range partitions: neighbours in that order
are neighbours in the tree's prefix trie, and the length of the prefix that a row shares with the row before
or after it is the deepest node at which it has company. Rows without company down to ``shortest`` go.

1. The accepted prefix is shortened, level by level, from full depth on. At a level the members of every node
   that has more members than each of its children are compared with the node's smallest member, its head.
   From the links that this and the levels before it verified the recall is estimated: a link of similarity s
   is met at prefix length x with probability ``1 - (1 - s**x)**trees``, so each found link stands for that
   many (Horvitz-Thompson), with one more in every hundredth of similarity from the threshold up, so that
   nothing found is not taken for nothing there. Shortening ends when the estimate reaches ``recall``.
2. Each text joins the smallest head that it is ``near``, which makes clusters without chains, and inside a
   cluster all pairs are compared.
3. At the last level the members of a node that are in different clusters are compared, each pair in the first
   node that both have. Unverified candidates never chain, and no pair is compared twice.

Scale: texts with equal sets are folded into one class first (a hot group of copies is one row). Nodes and
clusters of any size become square tiles, bounded in rows and in hashes; a tile emits counts and local roots,
never pairs. Sets, not texts, are moved, and only those of classes that have company. Hot nodes meet their
rows by broadcast of a checked size. Small tiles are worked through many at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.tables import table
from kindred.llm.tiles import key_of, local_roots, node_of, sharded, with_tiles
from kindred.llm.words import U, Words, chunks, encoded, mix, shingles
from kindred.operators.components import connected_components
from kindred.operators.hot import meet
from kindred.storage import forget, staged

THRESHOLD, WIDTH, TREES, DEPTH, SHORTEST, RECALL, BLOCK = 0.8, 5, 32, 8, 4, 0.99999, 512
#: Share of the threshold from which a text joins a head's cluster: such pairs would nearly all meet in nodes anyway.
NEAR = 0.75
#: Hashes in one block of a tile, about.
BLOCK_ITEMS = 1 << 18
#: Hundredths of similarity, for the estimate of the recall.
BANDS = 20


def met(s: float, x: int, trees: int) -> float:
    """Probability that two texts of similarity s share a prefix of x values in one of the trees."""
    return 1 - (1 - s**x) ** trees


def estimated_recall(found: list[int], x: int, trees: int, threshold: float) -> float:
    """Share of the links that prefixes of x values or more meet, from the links found by band of similarity, and one more in each band."""
    low = [threshold + (1 - threshold) * i / len(found) for i in range(len(found))]
    return sum(n + 1 for n in found) / sum((n + 1) / met(s, x, trees) for n, s in zip(found, low, strict=True))


def paths(items: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """``trees`` rows of ``depth`` 16-bit MinHash values of a non-empty set."""
    k = trees * depth
    odd = (mix(np.arange(1, k + 1, dtype=U)) | U(1)).astype(np.uint32)
    add = mix(np.arange(k + 1, 2 * k + 1, dtype=U)).astype(np.uint32)
    x = (items ^ (items >> U(32))).astype(np.uint32)
    low = np.full(k, np.iinfo(np.uint32).max, dtype=np.uint32)
    for s in range(0, len(x), 256):  # stays in cache, whatever the length of the text
        h = x[s : s + 256, None] * odd[None, :]
        h += add
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        np.minimum(low, h.min(axis=0), out=low)
    return (mix(low.astype(U)) >> U(48)).astype("<u2").reshape(trees, depth)


def first_in_common(a: list[np.ndarray], b: list[np.ndarray], node: int) -> np.ndarray:
    """Whether ``node`` is the first of the nodes that a row and a column have in common. Nodes are ordered alike in all lists, and all hold ``node``."""
    before = [[x[: int(np.flatnonzero(x == node)[0])] for x in side] for side in (a, b)]
    names = np.intersect1d(*(np.concatenate(x) for x in before))
    out = np.ones((len(a), len(b)), dtype=bool)
    if len(names):
        held = []
        for side in before:
            m = np.zeros((len(side), len(names)), dtype=np.float32)
            row = np.repeat(np.arange(len(side)), [len(x) for x in side])
            flat = np.concatenate(side)
            at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
            hit = names[at] == flat
            m[row[hit], at[hit]] = 1
            held.append(m)
        out = held[0] @ held[1].T == 0
    return out


def shared(a: list[np.ndarray], b: list[np.ndarray], same: bool, most: int = 1024) -> np.ndarray:
    """Sizes of the intersections of all sets of a with all of b, by products of 0-1 matrices of bounded width."""
    every = a if same else a + b
    owner = np.repeat(np.arange(len(every)), [len(x) for x in every])
    if not len(owner):
        return np.zeros((len(a), len(b)))
    names, column, n = np.unique(np.concatenate(every), return_inverse=True, return_counts=True)
    number = np.cumsum(n > 1) - 1  # an item of one set alone is in no intersection
    keep = (n > 1)[column]
    owner, column = owner[keep], number[column[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)))
    for s in range(0, int(column[-1]) + 1 if len(column) else 0, most):
        i, j = np.searchsorted(column, [s, s + most])
        m = np.zeros((len(every), most), dtype=np.float32)
        m[owner[i:j], column[i:j] - s] = 1
        out += m @ m.T if same else m[: len(a)] @ m[len(a) :].T
    return out


def similarities(a: list[np.ndarray], b: list[np.ndarray], wanted: np.ndarray | None, same: bool) -> np.ndarray:
    """Jaccard similarities of the wanted pairs (all, if None); 0 where a pair isn't wanted."""
    size_a, size_b = np.array([len(s) for s in a])[:, None], np.array([len(s) for s in b])[None, :]
    if wanted is not None and wanted.sum() <= len(a) + len(b):  # few pairs: one after another
        out = np.zeros(wanted.shape)
        for i, j in zip(*np.nonzero(wanted), strict=True):
            both = len(np.intersect1d(a[i], b[j], assume_unique=True))
            out[i, j] = both / (len(a[i]) + len(b[j]) - both)
        return out
    both = shared(a, b, same)
    out = both / (size_a + size_b - both)
    return out if wanted is None else np.where(wanted, out, 0.0)


def _sets(texts, width: int) -> list[np.ndarray]:
    items, out = encoded(texts), []
    for i, j in chunks(items):
        words = Words(items[i:j])
        out += [shingles(words, d, width) for d in range(j - i)]
    return out


def _forest(classes: DataFrame, trees: int, depth: int, shortest: int, parts: int) -> DataFrame:
    """``(i, tree, path, deep)``: rows in the order of (tree, path) that have company at prefixes of ``shortest`` values; deep is the longest such prefix."""
    width = 2 * depth

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = None  # the last row of the batch before: tree, path, row, prefix that it shares with the row before it

        def lcp(p: np.ndarray, q: np.ndarray, same: np.ndarray) -> np.ndarray:
            return np.where(same, np.cumprod(p == q, axis=1, dtype=np.int8).sum(axis=1), 0)

        def rows(i, tree, path, deep) -> pd.DataFrame:
            keep = deep >= shortest
            return pd.DataFrame({"i": i[keep], "tree": tree[keep], "path": [p.tobytes() for p in path[keep]], "deep": deep[keep].astype(np.int32)})

        for pdf in batches:
            if not len(pdf):
                continue
            i, tree = pdf["i"].to_numpy(), pdf["tree"].to_numpy()
            path = np.frombuffer(b"".join(pdf["path"]), dtype="<u2").reshape(len(pdf), depth)
            if before is not None:
                i, tree, path = np.append(before[0], i), np.append(before[1], tree), np.concatenate([before[2], path])
            share = lcp(path[1:], path[:-1], tree[1:] == tree[:-1])
            # the first row of a partition may have company in the one before
            up = np.append([depth if before is None else before[3]], share)
            deep = np.maximum(up[:-1], share)
            yield rows(i[:-1], tree[:-1], path[:-1], deep)
            before = (i[-1:], tree[-1:], path[-1:], up[-1])
        if before is not None:  # and the last one in the next
            yield rows(*before[:3], np.array([depth]))

    tree = F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.struct(t.alias("tree"), F.substring("path", t * width + 1, F.lit(width)).alias("path")))).alias("t")
    rows = classes.select("i", tree).select("i", "t.tree", "t.path").repartitionByRange(parts, "tree", "path", "i").sortWithinPartitions("tree", "path")
    return staged(rows.mapInPandas(neighbours, "i long, tree int, path binary, deep int"), "forest", by=classes)


def _verified(edges: DataFrame, sets: DataFrame, salt: int = 512) -> DataFrame:
    """``(i, h, s)``: the similarity of each edge's sets. A hot head comes once for each ``salt`` of its edges."""
    degree = staged(edges.groupBy("h").agg(F.ceil(F.count("*") / salt).cast("int").alias("salts")), "heads", few=True)
    own = meet(edges, degree.withColumn("n", F.col("salts") * salt), "h", "n", bound=4 * salt)
    own = own.select("i", "h", F.pmod(F.xxhash64("i"), "salts").cast("int").alias("salt")).join(sets.select("i", "size", "items"), "i")
    heads = degree.select(F.col("h").alias("i"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")).join(sets.select("i", "size", "items"), "i")
    both = own.unionByName(heads.select("i", F.col("i").alias("h"), "salt", "size", "items"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        i, h = pdf["i"].to_numpy(), pdf["h"].to_numpy()
        items = [np.frombuffer(b, dtype=U) for b in pdf["items"]]
        at = int(np.flatnonzero(i == h)[0])
        rest = [k for k in range(len(i)) if k != at]
        both = np.array([len(np.intersect1d(items[k], items[at], assume_unique=True)) for k in rest], dtype=float)
        size = np.array([len(items[k]) for k in rest])
        return pd.DataFrame({"i": i[rest], "h": h[rest], "s": both / (size + len(items[at]) - both)})

    return staged(sharded(both, ["h", "salt"], "size", verify, "i long, h long, s double"), "stars", few=True)


def _compare(tiles: DataFrame, keys: list[str], threshold: float, across: bool) -> DataFrame:
    """``(c, root, n)`` of all tiles; ``across``: only pairs of different clusters, in the first node that both have."""

    def compare(pdf: pd.DataFrame) -> pd.DataFrame | None:
        same = bool(pdf["tile_a"].iloc[0] == pdf["tile_b"].iloc[0])
        a = pdf if same else pdf[pdf["tile_side"] == 0]
        b = a if same else pdf[pdf["tile_side"] == 1]
        if not len(a) or not len(b):
            return None
        wanted = None
        if across:
            wanted = a["g"].to_numpy()[:, None] != b["g"].to_numpy()[None, :]
            if not wanted.any():
                return None
            na = [np.asarray(x) for x in a["nodes"]]
            wanted &= first_in_common(na, na if same else [np.asarray(x) for x in b["nodes"]], int(a["node"].iloc[0]))
            if not wanted.any():
                return None
        sa = [np.frombuffer(x, dtype=U) for x in a["items"]]
        sb = sa if same else [np.frombuffer(x, dtype=U) for x in b["items"]]
        linked = similarities(sa, sb, np.triu(wanted, 1) if same and wanted is not None else wanted, same) >= threshold
        if same:
            linked = linked | linked.T
            np.fill_diagonal(linked, False)
        if not linked.any():
            return None
        rows, cols = local_roots(linked, same)
        n, names, root = linked @ b["w"].to_numpy(), a["c"].to_numpy(), rows
        if not same:
            n, names, root = np.concatenate([n, linked.T @ a["w"].to_numpy()]), np.concatenate([names, b["c"].to_numpy()]), np.concatenate([rows, cols])
        hit = n > 0
        return pd.DataFrame({"c": names[hit], "root": names[root[hit]], "n": n[hit].astype(np.int64)})

    return staged(sharded(tiles, keys, "size", compare, "c string, root string, n long"), "links", few=True)


def jaccard_classes(
    docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, trees: int = TREES, depth: int = DEPTH, shortest: int = SHORTEST, recall: float = RECALL, near: float = NEAR, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: key, ``class_id``, ``class_size``, ``n_links``, ``component_id``, ``kept`` and ``text_hash``.

    Words are runs of anything but white space, as they stand; a text of fewer than ``width`` words has
    one run of all of them. Two texts link if the Jaccard similarity of their sets of runs is at least
    ``threshold``. class_id is the smallest key among texts with the same set (their similarity is 1),
    component_id the smallest key that links lead to, the row's own included; kept says that it is the
    row's own key. A null, empty or blank text has no runs and links with nothing. Repeated rows are copies;
    of rows that share a key as well, each counts. A null key gets a row with null ids. Further columns are
    ignored; an empty table gives no rows. Links are decided exactly; pairs are met with the recall that
    the module describes, down to prefixes of ``shortest`` values.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # keys go to Python as strings: a null beside them can't turn them into doubles
    src = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("d"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items = encoded(pdf["t"])
            for i, j in chunks(items):
                sets = _sets(pdf["t"].iloc[i:j], width)
                yield pd.DataFrame(
                    {
                        "k": pdf["k"].iloc[i:j], "d": pdf["d"].iloc[i:j], "size": [len(s) for s in sets],
                        "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                        "path": [paths(s, trees, depth).tobytes() if len(s) else None for s in sets],
                    }
                )

    signed = src.select(F.col("k").cast("string").alias("k"), "t", "d").mapInPandas(sign, "k string, d long, size long, digest binary, path binary")
    signed = staged(signed.withColumn("k", F.col("k").cast("long")), "signed", like=docs)
    some = signed.where("digest is not null")
    classes = some.groupBy("digest").agg(F.min("k").alias("class_id"), F.count("*").alias("w"), F.first("size").alias("size"), F.min(F.struct("d", "k", "path")).alias("rep"))
    # c: a class's name, in the order of its smallest key; i: a short one
    classes = staged(classes.select("digest", "class_id", "w", "size", "rep.*", node_of(F.col("class_id"), F.col("digest")).alias("c"), F.monotonically_increasing_id().alias("i")), "classes")
    forest = _forest(classes, trees, depth, shortest, parts)

    # the sets of classes that have company
    company = classes.join(forest.select("i").distinct(), "i", "left_semi").select("i", "c", "w", "size", F.col("d").alias("_d"), F.col("k").alias("_k"))

    def lay_out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in range(0, len(pdf), 256):
                part = pdf.iloc[s : s + 256]
                yield part.drop(columns="t").assign(items=[x.tobytes() for x in _sets(part["t"], width)])

    texts = src.join(company, (F.col("d") == F.col("_d")) & F.col("k").eqNullSafe(F.col("_k"))).select("i", "c", "w", "size", "t")
    sets = texts.mapInPandas(lay_out, "i long, c string, w long, size long, items binary")
    # a row that is there twice, key and all, is one representative
    sets = staged(sets.groupBy("i").agg(*[F.first(x).alias(x) for x in ("c", "w", "size", "items")]), "sets", by=classes)

    def members(x: int) -> DataFrame:
        name = lambda n: F.xxhash64("tree", F.substring("path", 1, 2 * n))
        return forest.where(F.col("deep") >= x).select("i", "tree", name(x).alias("node"), (name(x + 1) if x < depth else F.col("i")).alias("child"))

    # 1. shorter and shorter prefixes, until the links of heads say that few are missing
    stars, bands = None, [0] * BANDS
    for x in range(depth, shortest - 1, -1):
        level = members(x)
        nodes = level.groupBy("node", "child").agg(F.count("*").alias("n"), F.min("i").alias("h")).groupBy("node").agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.min("h").alias("h")).where("n > most")
        edges = meet(level.select("i", "node"), nodes.select("node", "n", "h"), "node", "n").where("i <> h").select("i", "h").distinct()
        edges = edges if stars is None else edges.join(stars, ["i", "h"], "left_anti")
        fresh = _verified(staged(edges, "edges", few=True), sets)
        stars = fresh if stars is None else stars.unionByName(fresh)
        band = F.least(F.floor((F.col("s") - threshold) * (BANDS / (1 - threshold))), F.lit(BANDS - 1)).cast("int")
        for r in fresh.where(F.col("s") >= threshold).groupBy(band.alias("b")).count().collect():
            bands[r["b"]] += r["count"]
        if estimated_recall(bands, x, trees, threshold) >= recall:
            break

    # 2. clusters around heads
    led = stars.where(F.col("s") >= near * threshold).groupBy("i").agg(F.min("h").alias("g"))
    led = staged(led.unionByName(led.select(F.col("g").alias("i")).distinct().join(led, "i", "left_anti").withColumn("g", F.col("i"))), "groups", few=True)
    found = _compare(with_tiles(sets.join(led, "i"), "g", "c", block, "size", BLOCK_ITEMS), ["g", "tile_a", "tile_b"], threshold, False)

    # 3. across clusters: nodes of three and more, and the pairs that nodes of two are
    level = staged(level.drop("child").join(led, "i", "left").withColumn("g", F.coalesce("g", "i")), "members", few=True)
    nodes = level.groupBy("node").agg(F.count("*").alias("n"), F.min("g").alias("low"), F.max("g").alias("high"), F.min("i").alias("h"), F.max("i").alias("i")).where("low < high")
    nodes = staged(nodes, "nodes", few=True)
    shown = staged(meet(level, nodes.where("n > 2").select("node", "n"), "node", "n").select("i", "g", "tree", "node"), "across", few=True)
    lists = staged(shown.groupBy("i", "g").agg(F.transform(F.sort_array(F.collect_list(F.struct("tree", "node"))), lambda t: t["node"]).alias("nodes")), "lists", few=True)
    # one row of each text meets its sets, and then goes to its nodes, of which each tree has one at most
    tiles = with_tiles(lists.join(sets, "i").withColumn("node", F.explode("nodes")), "node", "c", block, "size", BLOCK_ITEMS)
    crossed = _compare(tiles, ["node", "tile_a", "tile_b"], threshold, True)
    twos = nodes.where("n = 2").select("i", "h").distinct().join(stars.where(F.col("s") >= threshold), ["i", "h"])
    twos = twos.join(lists.select("i", F.col("nodes").alias("of_i")), "i", "left").join(lists.select(F.col("i").alias("h"), F.col("nodes").alias("of_h")), "h", "left")
    twos = twos.where(~F.coalesce(F.arrays_overlap("of_i", "of_h"), F.lit(False))).select("i", "h")
    one = classes.select("i", "c", "w")
    twos = twos.join(one, "i").select("h", "c", "w").join(one.select(F.col("i").alias("h"), F.col("c").alias("d"), F.col("w").alias("v")), "h")
    twos = staged(twos.select(F.explode(F.array(F.struct("c", F.col("d").alias("root"), F.col("v").alias("n")), F.struct(F.col("d").alias("c"), F.col("d").alias("root"), F.col("w").alias("n")))).alias("x")).select("x.*"), "links", few=True)

    every = found.unionByName(crossed).unionByName(twos)
    links = every.groupBy("c").agg(F.sum("n").alias("n"))
    comp = connected_components(every, "c", "root").select(F.col("node").alias("c"), key_of(F.col("component")).alias("component_id"))
    named = classes.select("digest", "class_id", "w", "c").join(links, "c", "left").join(comp, "c", "left")
    named = named.select("digest", "class_id", F.col("w").alias("class_size"), (F.col("w") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "class_id").alias("component_id"))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    out = meet(some.select("k", "d", "digest"), named, "digest", "class_size").drop("digest")
    out = out.unionByName(signed.where("digest is null").select("k", "d", F.col("k").alias("class_id"), one.alias("class_size"), none.alias("n_links"), F.col("k").alias("component_id")))
    known = lambda c: F.when(F.col("k").isNotNull(), F.col(c)).alias(c)
    return out.select(F.col("k").alias(key), known("class_id"), "class_size", "n_links", known("component_id"), F.coalesce(F.col("k") == F.col("component_id"), F.lit(True)).alias("kept"), F.col("d").alias("text_hash"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` (all its columns) with one row of each group of linked texts, the one with the smallest key.

    Of rows that are there twice, key and text, one stays. Rows with a null key stay, and so do null and empty
    texts. Columns may have any names.
    """
    own = "_" * max(map(len, docs.columns))  # begins no name of docs
    k, d, n = (own + x for x in ("k", "d", "n"))
    kept = jaccard_classes(docs, key, text, **options).where(F.col("kept") & F.col(key).isNotNull())
    kept = staged(kept.groupBy(F.col(key).alias(k), F.col("text_hash").alias(d)).agg(F.count("*").alias(n)), "kept", few=True)
    on = (docs[key].cast("long") == F.col(k)) & (F.xxhash64(docs[text]) == F.col(d))
    out = docs.join(kept.where(F.col(n) == 1), on, "left_semi").unionByName(docs.where(F.col(key).isNull()))
    if kept.where(F.col(n) > 1).limit(1).count():
        out = out.unionByName(docs.join(kept.where(F.col(n) > 1), on, "left_semi").dropDuplicates([key, text]))
    return out


def op4_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("text_hash")


#: DuckDB: all pairs of classes that share a run, by counting; components by recursion.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(2, len(ws) - 3)::BIGINT), lambda i: array_to_string(ws[i:i + 4], ' ')))) AS g FROM w WHERE len(ws) > 0),
cls AS (SELECT g, min(doc_id) AS c, count(*) AS n FROM s GROUP BY g),
item AS (SELECT c, len(g) AS m, unnest(g) AS x FROM cls),
pair AS (SELECT a.c AS a, b.c AS b FROM item a JOIN item b ON a.x = b.x AND a.c <> b.c GROUP BY a.c, b.c, a.m, b.m HAVING count(*) / (a.m + b.m - count(*)) >= 0.8),
lk AS (SELECT a, sum(n)::BIGINT AS n FROM pair JOIN cls ON b = c GROUP BY a),
reach AS (SELECT a AS c, a AS r FROM pair UNION SELECT reach.c, pair.b FROM reach JOIN pair ON reach.r = pair.a),
comp AS (SELECT c, min(r) AS r FROM reach GROUP BY c),
doc AS (SELECT s.doc_id, cls.c AS class_id, cls.n AS class_size, cls.n - 1 + coalesce(lk.n, 0) AS n_links, coalesce(comp.r, cls.c) AS component_id
  FROM s JOIN cls USING (g) LEFT JOIN lk ON lk.a = cls.c LEFT JOIN comp ON comp.c = cls.c
  UNION ALL SELECT doc_id, doc_id, 1, 0, doc_id FROM w WHERE len(ws) = 0)
SELECT doc_id, class_id, class_size::BIGINT AS class_size, n_links::BIGINT AS n_links, component_id, doc_id = component_id AS kept FROM doc
"""
