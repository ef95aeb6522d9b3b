"""Order statistics by refining histograms against sorting."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import quantiles as Q


def test_bits_order_as_numbers_do():
    x = np.array([float("-inf"), -1e300, -1.5, -5e-324, -0.0, 0.0, 5e-324, 1.0, 1.0 + 2**-52, 1e300, float("inf"), float("nan"), -float("nan")])
    bits = Q.ordered_bits(x)
    assert (np.diff(bits.astype(object)) >= 0).all() and bits[4] == bits[5] and bits[11] == bits[12]
    assert np.array_equal(Q.numbers(bits)[:11], x[:11] + 0.0) and math.isnan(Q.numbers(bits)[12])


@pytest.fixture(scope="module")
def columns(spark):
    r = random.Random(4)
    pick = [lambda: r.gauss(0, 1), lambda: r.choice([1e300, -1e-300, 0.0, -0.0, float("inf")]), lambda: None, lambda: float(r.randrange(5))]
    rows = [(r.choice(pick)(), float(i % 7) if i % 3 else None, i, None) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "a double, b double, c long, none double").repartition(7)


def test_ranks(columns):
    rows, df = columns
    values = {c: sorted(r[i] for r in rows if r[i] is not None) for i, c in enumerate("abc")}
    ask = {c: (lambda n: [0, n - 1, n // 2, n // 2, min(n - 1, 17)]) for c in "abc"} | {"none": lambda n: [0]}
    got = Q.at_ranks(df, ask)
    for c, v in values.items():
        assert got[c] == (len(v), [float(v[k]) for k in ask[c](len(v))])
    assert got["none"] == (0, [])


def test_quantiles_equal_percentile(columns):
    _, df = columns
    points = [0.0, 0.1, 0.25, 0.5, 0.875, 0.9, 1.0]
    finite = df.where(F.coalesce(F.abs("a") < float("inf"), F.lit(True)))
    got = Q.quantiles(finite, {"a": points, "c": points, "none": [0.5]})
    for c in "ac":
        want = finite.agg(F.percentile(c, F.array(*map(F.lit, points)))).first()[0]
        assert np.allclose(got[c], want, rtol=1e-12, atol=0)
    assert got["none"] is None
    assert Q.quantiles(finite.where("false"), {"a": [0.5]}) == {"a": None}


def test_one_value_and_ties_give_the_value_itself(spark):
    df = spark.range(1000).select(F.lit(0.1).alias("x"))
    assert Q.quantiles(df, {"x": [0.3, 0.77]}) == {"x": [0.1, 0.1]}
    assert Q.quantiles(df.limit(1), {"x": [0.0, 0.5, 1.0]}) == {"x": [0.1] * 3}


def test_counts_of_a_pass_do_not_grow_with_the_rows(spark):
    n = {rows: Q._counts(spark.range(rows).select((F.col("id") % 1000).cast("double").alias("c0")), [np.zeros(1, np.uint64)], 0).count() for rows in (10_000, 200_000)}
    assert n[10_000] == n[200_000]
