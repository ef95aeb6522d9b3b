"""Exact search with blocks left out, against comparing every query with every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import nearest as N


def plain(queries, rows, k, metric):
    out = []
    for q, x in queries:
        x = np.array(x)
        near = []
        for c, y in rows:
            y = np.array(y)
            d = np.sqrt(((x - y) ** 2).sum()) if metric == "euclidean" else np.abs(x - y).max() if metric == "chebyshev" else 1 - x @ y / max(np.sqrt(x @ x) * np.sqrt(y @ y), N.EPS)
            if c != q:
                near.append((round(float(d), 9) + 0.0, c))
        out += [(q, c, i + 1, d) for i, (d, c) in enumerate(sorted(near)[:k])]
    return sorted(out)


def clustered(dim, seed):
    """Clusters, copies, zeros, and rows far from all."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim))
    x = middle[rng.integers(0, 6, 260)] + rng.normal(size=(260, dim)) * 0.05
    x[40:90] = x[40]
    x[100:104] = 0
    x[110] *= 50
    return [(1000 - i, [float(v) for v in r]) for i, r in enumerate(x)]


@pytest.mark.parametrize("metric", N.METRICS)
@pytest.mark.parametrize("dim", [1, 3, 16])
def test_equals_comparing_all(spark, metric, dim):
    rows = clustered(dim, dim)
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, v array<double>, block string, bound int")
    queries = [(i, v) for i, v in rows if i % 4 == 0] + [(7, [0.0] * dim), (8, [3.0] * dim)]
    asked = spark.createDataFrame(queries, "q long, v array<double>")
    for block_rows in (20, 4096):
        got = N.nearest(asked, df.withColumnRenamed("id", "c"), 5, metric, block_rows=block_rows, pivots=12).collect()
        near = sorted((r["q"], r["c"], r["rk"], round(r["d"], 9) + 0.0) for r in got)
        want = plain(queries, rows, 5, metric)
        assert [x[:1] + x[2:3] for x in near] == [x[:1] + x[2:3] for x in want]
        assert np.allclose([x[3] for x in near], [x[3] for x in want], atol=2e-9)
        # a different neighbour only where rounding makes equal distances
        assert all(abs(a[3] - b[3]) < 2e-9 for a, b in zip(near, want, strict=True) if a[1] != b[1])
        assert sum(a[1] != b[1] for a, b in zip(near, want, strict=True)) <= (0 if metric != "cosine" else len(want) // 50)


def test_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [nan, 0.0]), (5, [1.0, None]), (6, [1.0]), (None, [0.0, 0.0]), (9, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "c long, v array<float>")
    got = N.nearest(df.withColumnRenamed("c", "q"), df, 10).collect()
    assert sorted((r["q"], r["c"], r["rk"]) for r in got) == [(1, 2, 1), (1, 9, 2), (2, 1, 1), (2, 9, 2), (9, 1, 1), (9, 2, 2)]
    assert N.nearest(df.withColumnRenamed("c", "q"), df.where("false"), 3).count() == 0
    assert N.nearest(df.where("false").withColumnRenamed("c", "q"), df, 3).count() == 0
    with pytest.raises(ValueError):
        N.nearest(df, df, 3, "dot")


def test_a_vector_of_many_rows(spark):
    """Copies beyond the k + 1 smallest keys leave before anything is dealt out."""
    df = spark.range(3000).select(F.col("id").alias("c"), F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    got = N.nearest(df.where("c in (0, 2999)").withColumnRenamed("c", "q"), df, 3, block_rows=2).collect()
    assert sorted((r["q"], r["c"], r["rk"], r["d"]) for r in got) == [(0, 1, 1, 0.0), (0, 2, 2, 0.0), (0, 3, 3, 0.0), (2999, 0, 1, 0.0), (2999, 1, 2, 0.0), (2999, 2, 3, 0.0)]


def test_blocks_are_left_out(spark):
    """Rows on a line: a query visits a few of 100 blocks, and what is shuffled stays below a constant times the rows."""
    n = 10_000
    rows = N.packed(spark.range(n).select(F.col("id").alias("c"), F.array(F.col("id").cast("double")).alias("v")), "c", "v", 1)
    dealt, known = N._dealt(rows, 1, "euclidean", n, 100, 50)
    assert dealt.groupBy("block").count().agg(F.max("count")).first()[0] <= 100 and len(known.rows) <= 151
    bounded = rows.where("k % 20 = 0").withColumn("bound", F.lit(5.0))
    visits = N._visits(bounded, 1, "euclidean", known, 10, False).count()
    assert visits < 4 * n / 20
