"""Counts of points above a row, against counting them one by one."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import dominance as D


@pytest.mark.parametrize("d", [1, 2, 3])
def test_in_memory(d):
    rng = np.random.default_rng(d)
    for n, m in ((0, 3), (3, 0), (1, 5), (40, 60), (257, 300)):
        both = np.stack([rng.permutation(n + m) for _ in range(d)], axis=1)
        points, rows = both[:n], both[n:]
        want = [(points > r).all(axis=1).sum() for r in rows]
        assert D.above(points, rows).tolist() == want


def test_wavelet():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 64, 200)
    i, j, least = rng.integers(0, 201, 500), rng.integers(0, 201, 500), rng.integers(0, 64, 500)
    i, j = np.minimum(i, j), np.maximum(i, j)
    assert D.Wavelet(v, 6).at_least(i, j, least).tolist() == [int((v[a:b] >= x).sum()) for a, b, x in zip(i, j, least, strict=True)]


def plain(points, rows, d):
    out = {}
    for k, *x in rows:
        if any(v is None or v != v for v in x):
            continue
        held = [[p > v for p, v in zip(q, x, strict=True)] for _, *q in points if not any(v is None or v != v for v in q)]
        out[k] = tuple(sum(all(h[i] for i in own) for h in held for own in combinations(range(d), s)) for s in range(1, d + 1))
    return out


@pytest.mark.parametrize("d,slab", [(1, 16), (2, 16), (3, 25), (3, 1 << 16)])
def test_counts_above(spark, d, slab):
    r = random.Random(d)
    x = lambda: r.choice([0.0, 0.0, -0.0, 1.0, r.gauss(0, 1), None, float("nan"), float("inf")] if r.random() < 0.3 else [r.gauss(0, 1), 0.5])
    points, rows = ([(i, *[x() for _ in range(d)]) for i in range(n)] for n in (150, 120))
    names = [f"c{i}" for i in range(d)]
    schema = "key long, " + ", ".join(f"{c} double" for c in names)
    p, q = spark.createDataFrame(points, schema).withColumn("slab", F.lit(1)), spark.createDataFrame(rows, schema)
    got = D.counts_above(p, q, "key", names, slab)
    want = plain(points, rows, d)
    assert {v["key"]: tuple(v[f"s{s}"] for s in range(1, d + 1)) for v in got.collect()} == want
    for k in range(1, d + 1):
        each = {v["key"]: v["n"] for v in got.select("key", D.at_least_of(k, d).alias("n")).collect()}
        sums = {i: [sum(c > v for c, v in zip(pt[1:], row[1:], strict=True)) for pt in points if not any(v is None or v != v for v in pt[1:])] for i, row in enumerate(rows) if i in want}
        assert each == {i: sum(s >= k for s in sums[i]) for i in want}


def test_empty_sides(spark):
    some = spark.createDataFrame([(1, 0.5, 0.5)], "key long, a double, b double")
    assert D.counts_above(some.where("false"), some, "key", ["a", "b"]).collect() == [(1, 0, 0)]
    assert D.counts_above(some, some.where("false"), "key", ["a", "b"]).collect() == []


def test_equal_values_are_spread_over_slabs(spark):
    same = spark.range(300).select(F.col("id").alias("key"), F.lit(1.0).alias("a"), F.lit(2.0).alias("b"))
    both = D.ranked_together(same, same, "key", ["a", "b"])
    assert both.groupBy(F.floor(F.col("r0") / 50)).count().agg(F.max("count")).first()[0] == 50
    assert D.counts_above(same, same, "key", ["a", "b"], 50).agg(F.sum("s1"), F.sum("s2"), F.count("*")).first() == (0, 0, 300)
