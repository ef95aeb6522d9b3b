"""Exact order statistics of whole columns by refining histograms, all columns and ranks in the same few passes.

A double's bits, turned so that they order as the numbers do, are read 16 at a time. In each pass every task counts, for
each prefix that still holds a wanted rank, how often each next digit occurs; Spark sums these counts, and each rank moves
on into the digit that holds it. After four passes all bits are known. A pass makes at most 65,536 counts for each rank,
whatever the rows: no task sorts or holds a column, and the driver gets counts only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 16
PASSES = 64 // DIGIT
_SIGN = np.uint64(1 << 63)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers: -0 counts as 0, and NaN comes last, as Spark sorts it."""
    x = np.where(np.isnan(x), np.nan, x + 0.0)
    bits = x.view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def numbers(bits: np.ndarray) -> np.ndarray:
    bits = np.asarray(bits, dtype=np.uint64)
    return np.where(bits & _SIGN, bits ^ _SIGN, ~bits).view(np.float64)


def _counts(rows: DataFrame, prefixes: Sequence[np.ndarray], turn: int) -> DataFrame:
    """``(target, digit, n)``: by column and prefix (numbered through), how often each digit of this turn follows."""
    first = np.cumsum([0, *map(len, prefixes)])
    low, high = np.uint64(64 - DIGIT * (turn + 1)), np.uint64(64 - DIGIT * turn)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(first[-1] << DIGIT, dtype=np.int64)
        for b in batches:
            for i, own in enumerate(prefixes):
                x = b.column(i).drop_null().to_numpy(zero_copy_only=False)
                key = ordered_bits(x)
                at = np.searchsorted(own, key >> high) if turn else np.zeros(len(key), dtype=np.int64)
                if turn:
                    hit = np.take(own, at, mode="clip") == key >> high
                    at, key = at[hit], key[hit]
                n += np.bincount(((first[i] + at) << DIGIT) + ((key >> low) & np.uint64((1 << DIGIT) - 1)).astype(np.int64), minlength=len(n))
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen >> DIGIT), pa.array(seen & ((1 << DIGIT) - 1)), pa.array(n[seen])], ["target", "digit", "n"])

    return rows.mapInArrow(count, "target long, digit long, n long").groupBy("target", "digit").agg(F.sum("n").alias("n"))


def at_ranks(rows: DataFrame, ranks: Mapping[str, Callable[[int], Sequence[int]]]) -> dict[str, tuple[int, list[float]]]:
    """For each column its count without nulls, and the values at the ranks (from 0, ascending) that its function names for that count.

    A function is not asked for an empty column, which gives no values. Equal values take as many ranks as there are
    of them. ``rows`` is read once in each pass, so it should be a stored table.
    """
    names = list(ranks)
    rows = rows.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    totals, wanted = [0] * len(names), [[] for _ in names]
    #: of each column: for each wanted rank its prefix so far, and its place among the rows of that prefix
    prefix, inside = [[] for _ in names], [[] for _ in names]
    for turn in range(PASSES):
        distinct = [np.unique(np.array(p, dtype=np.uint64)) if turn else np.zeros(1, dtype=np.uint64) for p in prefix]
        got = _counts(rows, distinct, turn).toArrow().to_pandas().sort_values(["target", "digit"])
        by_target = {t: (g["digit"].to_numpy(), g["n"].to_numpy().cumsum()) for t, g in got.groupby("target")}
        first = np.cumsum([0, *map(len, distinct)])
        for i in range(len(names)):
            if not turn:
                totals[i] = int(by_target[i][1][-1]) if i in by_target else 0
                wanted[i] = list(ranks[names[i]](totals[i])) if totals[i] else []
                prefix[i], inside[i] = [0] * len(wanted[i]), list(wanted[i])
            for j, (p, k) in enumerate(zip(prefix[i], inside[i], strict=True)):
                digits, upto = by_target[int(first[i] + (np.searchsorted(distinct[i], np.uint64(p)) if turn else 0))]
                at = int(np.searchsorted(upto, k, "right"))
                prefix[i][j], inside[i][j] = (p << DIGIT) | int(digits[at]), k - (int(upto[at - 1]) if at else 0)
    return {c: (totals[i], numbers(np.array(prefix[i], dtype=np.uint64)).tolist()) for i, c in enumerate(names)}


def quantiles(rows: DataFrame, points: Mapping[str, Sequence[float]]) -> dict[str, list[float] | None]:
    """Linear quantiles of whole columns, as ``percentile`` gives; null for a column without values."""

    def places(own: Sequence[float]) -> Callable[[int], list[int]]:
        return lambda n: [k for p in own for k in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))]

    out: dict[str, list[float] | None] = {}
    for c, (n, values) in at_ranks(rows, {c: places(own) for c, own in points.items()}).items():
        between = [p * (n - 1) - math.floor(p * (n - 1)) for p in points[c]]
        out[c] = [a if a == b else a + (b - a) * t for a, b, t in zip(values[::2], values[1::2], between, strict=True)] if n else None
    return out
