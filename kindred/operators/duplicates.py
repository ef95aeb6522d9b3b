"""Exact overlap, SimHash fingerprints with an exact join within a few bits, and name families."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def simhash_of(tokens: list[str], width: int = 5) -> str:
    """16 hex digits: sign of the summed bits of SHA-256 prefixes of NUL-joined runs; ties set a bit."""
    width = max(1, min(width, len(tokens)))
    runs = ["\0".join(tokens[i : i + width]) for i in range(len(tokens) - width + 1)] if tokens else ["<empty>"]
    words = np.frombuffer(b"".join(hashlib.sha256(r.encode()).digest()[:8] for r in runs), dtype=">u8").astype(np.uint64)
    ones = ((words[:, None] >> np.arange(63, -1, -1, dtype=np.uint64)) & np.uint64(1)).sum(axis=0)
    return np.packbits(2 * ones >= len(words)).tobytes().hex()


def _simhashes(tokens: pd.Series) -> pd.Series:
    return pd.Series([simhash_of(list(t) if t is not None else []) for t in tokens])


def simhash(tokens: Column) -> Column:
    return F.pandas_udf(_simhashes, "string")(tokens)


def prose_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9_]+"), F.lit(0))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ in two 16-digit hex strings, by 32-bit halves."""
    half = lambda h, i: F.conv(F.substring(h, i, 8), 16, 10).cast("long")
    return F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))


def bands(h: Column) -> Column:
    """Four 16-bit bands, the lowest first."""
    return F.array(*[F.conv(F.substring(h, 13 - 4 * i, 4), 16, 10).cast("int") for i in range(4)])


def _cuts(most: int) -> list[tuple[int, int]]:
    """``(shift, bits)`` of the ``most + 3`` blocks of 64 bits, the lowest first."""
    n = most + 3
    bits = [64 // n + (i < 64 % n) for i in range(n)]
    return [(sum(bits[:i]), b) for i, b in enumerate(bits)]


def _block(x: Column, cut: tuple[int, int]) -> Column:
    return F.shiftrightunsigned(x, cut[0]).bitwiseAND((1 << cut[1]) - 1)


def _tables(most: int) -> list[tuple[int, ...]]:
    """Blocks that each table of the index compares: every choice of three."""
    return list(combinations(range(most + 3), 3))


def as_long(h: Column) -> Column:
    """16 hex digits as 64 bits."""
    half = lambda i: F.conv(F.substring(h, i, 8), 16, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def hamming_candidates(prints: DataFrame, most: int = 3) -> DataFrame:
    """``(f, g)`` of different 64-bit prints (column ``f``, long, distinct) that agree in three blocks, f < g, each pair once.

    Bits are cut into ``most + 3`` blocks, so two prints within ``most`` bits agree in three of them at least. Each choice of
    three blocks is a table of its own with keys of about ``3 * 64 / (most + 3)`` bits: for three bits 20 tables with keys of
    some 32 bits, in which 10^6 unrelated prints meet by chance once in two hundred. A pair that several tables find
    counts in the first of them, which is known from the pair alone, so nothing is made distinct.
    """
    cuts, tables = _cuts(most), _tables(most)
    key = lambda t: sum((F.shiftleft(_block(F.col("f"), cuts[b]), sum(cuts[c][1] for c in t[:i])) for i, b in enumerate(t)), F.lit(0).cast("long"))
    each = F.posexplode(F.array(*[key(t) for t in tables])).alias("table", "key")
    sent = prints.select("f", each)
    # never a broadcast: the estimate is that of the prints, before they are exploded
    met = sent.join(sent.withColumnRenamed("f", "g").hint("merge"), ["table", "key"]).where("f < g")
    x = F.col("f").bitwiseXOR(F.col("g"))
    first = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(tables))):
        mask = sum(((1 << cuts[b][1]) - 1) << cuts[b][0] for b in t)
        first = F.when(x.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)) == 0, F.lit(i)).otherwise(first)
    return met.where(F.col("table") == first).select("f", "g")


def near_prints(prints: DataFrame, fingerprint: str, most: int = 3) -> DataFrame:
    """``(f, g, distance)``: fingerprints (16 hex digits) within ``most`` bits, f < g, each pair once; exact for any ``most`` up to 13.

    Null fingerprints are near nothing.
    """
    f = prints.select(as_long(F.col(fingerprint)).alias("f")).where("f is not null").distinct()
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    near = hamming_candidates(f, most).withColumn("distance", F.bit_count(F.col("f").bitwiseXOR(F.col("g")))).where(F.col("distance") <= most)
    a, b = text("f"), text("g")
    return near.select(F.least(a, b).alias("f"), F.greatest(a, b).alias("g"), "distance")


def pairs_within(rows: DataFrame, key: str, fingerprint: str, differ: list[str], most: int = 3) -> DataFrame:
    """Pairs of rows within ``most`` bits that differ in all of the ``differ`` columns, each once.

    Rows with equal fingerprints, whatever their number, go through the index as one; a pair of fingerprints is
    compared once and only then opened.
    """
    prints = rows.select(fingerprint).where(F.col(fingerprint).isNotNull()).distinct()
    close = near_prints(prints, fingerprint, most)
    close = close.unionByName(prints.select(F.col(fingerprint).alias("f"), F.col(fingerprint).alias("g"), F.lit(0).alias("distance")))
    a = rows.select(F.col(fingerprint).alias("f"), F.col(key).alias("a"), *[F.col(c).alias(f"a_{c}") for c in differ])
    b = rows.select(F.col(fingerprint).alias("g"), F.col(key).alias("b"), *[F.col(c).alias(f"b_{c}") for c in differ])
    out = close.join(a.hint("merge"), "f").join(b.hint("merge"), "g")
    for c in differ:
        out = out.where(F.col(f"a_{c}") != F.col(f"b_{c}"))
    return out.select(F.least("a", "b").alias("left_key"), F.greatest("a", "b").alias("right_key"), "distance").distinct()


def overlap_report(rows: DataFrame, content: str, role: str, group: str) -> DataFrame:
    """Contents that repeat, and those that cross roles: counts, rows, groups, largest multiplicity."""
    each = rows.groupBy(content).agg(F.count("*").alias("n"), F.countDistinct(role).alias("roles"), F.countDistinct(group).alias("groups"))
    cross = F.col("roles") > 1
    zero = F.lit(0).cast("long")
    return each.where("n > 1").agg(
        F.count("*").alias("repeated"), F.coalesce(F.sum(cross.cast("long")), zero).alias("cross_role"),
        F.coalesce(F.sum(F.when(cross, F.col("n"))), zero).alias("cross_role_rows"), F.coalesce(F.max("n"), zero).alias("largest"),
    )
