"""Operator 10: removal of long repeated passages, found by recompression.

A text's words are named by content (64-bit hashes), runs of one word are named as one symbol, and
then ``ROUNDS`` rounds pair neighbouring symbols: a hash coin makes every symbol of a round a left or a
right one, and each left symbol followed by a right one becomes a new symbol, named by its two parts.
Names depend on content alone, so all tasks give equal substrings the same interior symbols without
having to agree on a dictionary. For each symbol the words that its existence depends on are kept (its
reach). Two equal windows hold the same symbols, counting those whose reach lies inside the window; so a
window can only repeat if every such symbol occurs at least twice in the corpus. Spark counts the symbols
(some five words each, a small part of the corpus), and only windows that pass are compared, by
two 64-bit hashes, from two independent hashes of each word, again by counting. Windows that hold no such symbol always pass, so the
filter loses no repeated window.

Scale: documents with equal words are folded into one first; counts are aggregated before they are
shuffled; symbols of many texts meet their counts by broadcast of a checked size, hot windows in a join that
adaptive execution can split; tables that cut the lineage are written to the shared folder. No task holds more than a document at a time
beyond its batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm.tables import table
from kindred.llm.words import U, Words, chunks, encoded, mix, powers
from kindred.operators.hot import meet
from kindred.storage import release_shuffles, staged

WINDOW = 35
ROUNDS = 6
_EDGE = np.int64(1) << 40  # a reach beyond the text


class Symbols:
    """Symbols of the words of some texts after all rounds: name, span [a, b) and reach [lo, hi) in words of the batch."""

    def __init__(self, words: Words, rounds: int = ROUNDS):
        n = len(words.hash)
        doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        name, a = words.hash, np.arange(n)
        # runs of one word
        fresh = np.ones(n, dtype=bool)
        fresh[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(fresh)
        length = np.diff(np.append(start, n))
        name, a, doc = np.where(length > 1, mix(name[start] + length.astype(U) * U(0xD6E8FEB86659FD93)), name[start]), a[start], doc[start]
        b = a + length
        left, right = self._same(doc)
        lo, hi = np.where(left, a - 1, -_EDGE), np.where(right, b + 1, _EDGE)
        for level in range(1, rounds + 1):
            coin = (mix(name + U(level * 0xA0761D6478BD642F % 2**64)) >> U(63)).astype(bool)  # True: a right symbol
            left, right = self._same(doc)
            pair = np.zeros(len(name), dtype=bool)
            pair[:-1] = ~coin[:-1] & coin[1:] & right[:-1]
            second = np.zeros(len(name), dtype=bool)
            second[1:] = pair[:-1]
            nxt, prv = np.minimum(np.arange(len(name)) + 1, max(0, len(name) - 1)), np.maximum(np.arange(len(name)) - 1, 0)
            # one that stays alone owes it to the neighbour that it might have joined
            new_lo = np.where(pair | ~coin, lo, np.where(left, np.minimum(lo, lo[prv]), -_EDGE)) if len(name) else lo
            new_hi = np.where(pair, np.maximum(hi, hi[nxt]), np.where(coin, hi, np.where(right, np.maximum(hi, hi[nxt]), _EDGE))) if len(name) else hi
            new_lo = np.where(pair, np.minimum(new_lo, lo[nxt]), np.where(~coin & right, np.minimum(new_lo, lo[nxt]), new_lo)) if len(name) else lo
            new_hi = np.where(~pair & coin & left, np.maximum(new_hi, hi[prv]), new_hi) if len(name) else hi
            named = np.where(pair, mix(mix(name + U(level)) ^ (name[nxt] * U(0xE7037ED1A0B428DB))), name) if len(name) else name
            keep = ~second
            name, a, b, lo, hi, doc = named[keep], a[keep], np.where(pair, b[nxt], b)[keep] if len(b) else b, new_lo[keep], new_hi[keep], doc[keep]
        self.name, self.a, self.b, self.lo, self.hi, self.doc = name, a, b, lo, hi, doc
        self.first = np.searchsorted(doc, np.arange(len(words.first)))

    @staticmethod
    def _same(doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.zeros(len(doc), dtype=bool), np.zeros(len(doc), dtype=bool)
        left[1:] = right[:-1] = doc[1:] == doc[:-1]
        return left, right


def inside(symbols: Symbols, d: int, words: Words, window: int) -> np.ndarray:
    """Positions (in the batch) of the symbols of text d that some window can hold with their reach."""
    at = np.arange(symbols.first[d], symbols.first[d + 1])
    return at[(symbols.lo[at] >= words.first[d]) & (symbols.hi[at] <= words.first[d + 1]) & (symbols.hi[at] - symbols.lo[at] <= window)]


def without(symbols: Symbols, at: np.ndarray, d: int, words: Words, window: int) -> np.ndarray:
    """For each window of text d, whether it holds none of the symbols ``at`` (positions that ``inside`` gave) with their reach."""
    n = max(0, words.first[d + 1] - words.first[d] - window + 1)
    lo, hi = symbols.lo[at] - words.first[d], symbols.hi[at] - words.first[d]
    if not n or not len(at):
        return np.ones(n, dtype=bool)
    held = np.bincount(np.maximum(hi - window, 0), minlength=n + 1) - np.bincount(np.minimum(lo + 1, n), minlength=n + 1)
    return np.cumsum(held)[:n] == 0


def _sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def _text_of(words: Words, d: int, keep: np.ndarray | None = None) -> bytes:
    i, j = words.first[d], words.first[d + 1]
    s, e = words.start[i:j], words.end[i:j]
    if keep is not None:
        s, e = s[keep], e[keep]
    raw = words.buf.tobytes() if len(words.offset) == 2 else words.buf[words.offset[d] : words.offset[d + 1]].tobytes()
    base = 0 if len(words.offset) == 2 else words.offset[d]
    return b" ".join([raw[x:y] for x, y in zip((s - base).tolist(), (e - base).tolist(), strict=True)])


def _windows(words: Words, d: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every window of text d, from two hashes of each word."""
    h, g = (x[words.first[d] : words.first[d + 1]] for x in (words.hash, words.other))
    n = len(h) - window + 1
    p, q = powers(len(h) + 1)
    out = []
    for x in (h, g):
        total = np.zeros(len(h) + 1, dtype=U)
        np.cumsum(x * p[: len(h)], out=total[1:])
        out.append(mix((total[window:] - total[:-window]) * q[:n]).view(np.int64))
    return out[0], out[1]


def _batches(pdf: pd.DataFrame, most: int = 1 << 18) -> Iterator[tuple[pd.DataFrame, Words]]:
    items = encoded(pdf["t"])
    for i, j in chunks(items, most):
        yield pdf.iloc[i:j], Words(items[i:j])


@dataclass(frozen=True)
class Found:
    """``named``: rid, k, d, n_words, sha per row; ``whole``: sha of texts that other rows equal; ``held``: rid, t, runs, alone; ``hits``: rid, at (repeated windows)."""

    named: DataFrame
    whole: DataFrame
    held: DataFrame
    hits: DataFrame


def _search(docs: DataFrame, key: str, text: str, window: int, rounds: int) -> Found:
    src = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(text).alias("d"))
    kind = docs.schema[key].dataType

    def name(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, words in _batches(pdf):
                symbols = Symbols(words, rounds)
                whole = [_text_of(words, d) for d in range(len(part))]
                own = [inside(symbols, d, words, window) for d in range(len(part))]
                yield pd.DataFrame(
                    {
                        "rid": part["rid"], "k": part["k"], "d": part["d"].to_numpy(), "n_words": np.diff(words.first), "sha": [_sha(b) for b in whole],
                        "names": [symbols.name[at].view(np.int64) for at in own], "bare": [bool(without(symbols, at, d, words, window).any()) for d, at in enumerate(own)],
                    }
                )

    # keys go to Python as strings: a null beside them can't turn them into doubles
    named = src.withColumn("k", F.col("k").cast("string")).withColumn("rid", F.monotonically_increasing_id()).mapInPandas(name, "rid long, k string, d long, n_words long, sha string, names array<long>, bare boolean")
    named = staged(named.withColumn("k", F.col("k").cast(kind)), "names", like=docs)
    # equal word sequences: one row speaks for all
    same = named.where(F.col("n_words") >= window).groupBy("sha").agg(F.min("rid").alias("rid"), F.count("*").alias("copies"))
    same = staged(same, "copies", by=named)
    names = named.where(F.col("n_words") >= window).select("rid", "names", "bare").join(same.select("rid"), "rid", "left_semi")
    each = names.select("rid", F.posexplode("names").alias("i", "name"))
    often = each.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
    # texts with a symbol that repeats, or with a window that holds no symbol that could tell (null, which is not collected)
    bare = names.where("bare").select("rid", F.lit(None).cast("int").alias("i"))
    at = meet(each, often, "name", "n").select("rid", "i").unionByName(bare).groupBy("rid").agg(F.collect_list("i").alias("at"))
    told = same.select("rid", (F.col("copies") == 1).alias("alone"))
    wanted = staged(named.select("rid", F.col("k").alias("_k"), F.col("d").alias("_d"), "sha").join(told, "rid").join(at, "rid"), "repeats", by=named)
    release_shuffles(docs.sparkSession)

    def regions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Starts of the windows that may repeat, as runs [from, to)."""
        for pdf in batches:
            for part, words in _batches(pdf):
                symbols, rows = Symbols(words, rounds), []
                for d, (rid, t, sha, alone, at) in enumerate(zip(part["rid"], part["t"], part["sha"], part["alone"], part["at"], strict=True)):
                    n = words.first[d + 1] - words.first[d] - window + 1
                    if n <= 0 or _sha(_text_of(words, d)) != sha:
                        continue
                    own = inside(symbols, d, words, window)
                    once = np.ones(len(own), dtype=bool)
                    once[np.asarray(at, dtype=np.int64)] = False
                    free = np.concatenate([[False], without(symbols, own[once], d, words, window), [False]])
                    edge = np.flatnonzero(free[1:] != free[:-1])
                    if len(edge):
                        rows.append((rid, t, alone, edge.astype(np.int32)))
                if rows:
                    yield pd.DataFrame(rows, columns=["rid", "t", "alone", "runs"])

    # a row that is there twice, key and all, comes twice under one rid; it is not alone
    texts = src.join(wanted, (F.col("d") == F.col("_d")) & F.col("k").eqNullSafe(F.col("_k"))).select("rid", "t", "sha", "alone", "at")
    held = staged(texts.mapInPandas(regions, "rid long, t string, alone boolean, runs array<int>"), "regions", by=docs)
    release_shuffles(docs.sparkSession)

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, words in _batches(pdf):
                keys, at, h1, h2 = [], [], [], []
                for d, (k, runs) in enumerate(zip(part["rid"], part["runs"], strict=True)):
                    x, y = _windows(words, d, window)
                    i = np.concatenate([np.arange(s, e) for s, e in zip(runs[0::2], runs[1::2], strict=True)])
                    keys.append(np.full(len(i), k))
                    at.append(i)
                    h1.append(x[i])
                    h2.append(y[i])
                if keys:
                    yield pd.DataFrame({"rid": np.concatenate(keys), "at": np.concatenate(at), "h1": np.concatenate(h1), "h2": np.concatenate(h2)})

    windows = held.select("rid", "t", "runs").mapInPandas(hashes, "rid long, at int, h1 long, h2 long")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    hits = windows.join(twice, ["h1", "h2"]).groupBy("rid").agg(F.collect_list("at").alias("at"))
    return Found(named.drop("names", "bare"), same.where("copies > 1").select("sha", F.lit(True).alias("whole")), held, hits)


def _kept(words: Words, d: int, at: np.ndarray, window: int) -> np.ndarray:
    """Whether each word of text d is outside all windows that start at ``at``."""
    n = words.first[d + 1] - words.first[d]
    cover = np.zeros(n + 1, dtype=np.int64)
    at = np.asarray(at, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return np.cumsum(cover)[:n] == 0


def repeated_words(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of ``docs``: key, ``n_words``, ``n_removed``, ``kept_sha256``, ``kept_text`` and ``text_hash`` (of the input).

    Every word in a window of ``window`` words whose words also start anywhere else (in the same text
    too) is removed, all copies alike; windows are judged on the input. ``kept_text`` is the kept words
    joined by a space, null where nothing is removed. A null or empty text has no words. Repeated rows
    are copies of each other like any others. Further columns are ignored; an empty table gives no rows.
    """
    found = _search(docs, key, text, window, rounds)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part, words in _batches(pdf):
                rows = []
                for d, (rid, at) in enumerate(zip(part["rid"], part["at"], strict=True)):
                    keep = _kept(words, d, at, window)
                    kept = _text_of(words, d, keep)
                    rows.append((rid, int(len(keep) - keep.sum()), _sha(kept), kept.decode()))
                yield pd.DataFrame(rows, columns=["rid", "n_removed", "kept_sha256", "kept_text"])

    # texts that are alike are removed whole; a copy is any text of the same words
    lone = found.held.where("alone").select("rid", "t").join(found.hits, "rid")
    trimmed = lone.mapInPandas(cut, "rid long, n_removed long, kept_sha256 string, kept_text string")
    out = found.named.join(found.whole, "sha", "left").join(trimmed, "rid", "left")
    gone = F.col("whole").isNotNull()
    return out.select(
        F.col("k").alias(key), "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(_sha(b""))).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"), F.col("d").alias("text_hash"),
    )


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """``docs`` (all its columns) with repeated words cut from the texts; rows left without a word go.

    A text that loses words becomes its kept words joined by a space, and ``n_chars``, if there is such a
    column, its new length; all other rows stay as they are. Places of windows meet the rows, not texts.
    """
    found = _search(docs, key, text, window, ROUNDS)
    own = "_" * max(map(len, docs.columns))  # begins no name of docs
    k, d, at, hit, kept = (own + x for x in ("k", "d", "at", "hit", "kept"))
    marks = found.named.join(found.whole, "sha", "left").join(found.hits, "rid", "left").where("whole or at is not null")
    marks = marks.groupBy(F.col("k").alias(k), F.col("d").alias(d)).agg(F.max(F.when(F.col("whole").isNull(), F.col("at"))).alias(at), F.lit(True).alias(hit))

    @F.pandas_udf("string")
    def cut(t: pd.Series, at: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(t), dtype=object)
        rows = pd.DataFrame({"t": t, "at": at, "i": np.arange(len(t))}).dropna(subset=["t"])
        for part, words in _batches(rows):
            for d, (i, a) in enumerate(zip(part["i"], part["at"], strict=True)):
                out[i] = _text_of(words, d, _kept(words, d, a, window)).decode()
        return out

    met = docs.join(marks, (F.xxhash64(docs[text]) == F.col(d)) & docs[key].eqNullSafe(F.col(k)), "left").where(F.col(hit).isNull() | F.col(at).isNotNull())
    out = met.withColumn(kept, cut(F.when(F.col(at).isNotNull(), docs[text]), F.col(at))).where(F.col(kept).isNull() | (F.col(kept) != ""))
    new = {text: F.coalesce(F.col(kept), docs[text])}
    if n_chars in docs.columns:
        new[n_chars] = F.when(F.col(kept).isNotNull(), F.length(kept).cast(docs.schema[n_chars].dataType)).otherwise(docs[n_chars])
    return out.select(*[new[c].alias(c) if c in new else docs[c] for c in docs.columns])


def op10_long_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_words(table(spark, sf_dir, "documents")).drop("kept_text", "text_hash")


#: DuckDB: every window as an array of words, counted over the whole corpus.
OP10_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
win AS (SELECT doc_id, p, sha256(array_to_string(ws[p:p + 34], ' ')) AS h FROM w, unnest(range(1, greatest(1, len(ws) - 33)::BIGINT)) AS r(p)),
often AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, q FROM (SELECT doc_id, unnest(range(p, p + 35)) AS q FROM win SEMI JOIN often USING (h))),
dead AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id),
kept AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(qs), 0) AS n_removed,
  CASE WHEN qs IS NULL THEN ws ELSE list_transform(list_filter(list_zip(ws, range(1, len(ws) + 1)), lambda x: NOT list_contains(qs, x[2])), lambda x: x[1]) END AS ks
  FROM w LEFT JOIN dead USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed, sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256 FROM kept
"""
