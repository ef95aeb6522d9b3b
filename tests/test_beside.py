"""Queries beside whole columns: no row for a pair, the same results as comparing row by row."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import beside as B
from kindred.operators import hard_negatives as H
from kindred.operators import retrieval as R
from conftest import same_rows

WHOLE = ("ndcg_at_k", "average_precision", "spearman_per_query", "triplet_accuracy_halves", "triplet_accuracy_pairweighted", "oracle_rank_percentiles")


def vectors(spark, path, n=60):
    r = random.Random(3)
    rows = [(i, [float(r.randrange(-2, 3)) for _ in range(64)], r.choice([0, 1, None])) for i in range(n)]
    rows = [(i, rows[i - 1][1] if i % 7 == 0 and i else v, k) for i, v, k in rows]  # copies are ties
    spark.createDataFrame([*rows, (n, None, 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return f"{path}"


def documents(spark, path, n=400):
    r = random.Random(5)
    rows = [(i, r.choice(["x,", "y.", "z\n", "w"]) * r.randrange(1, 9) + "," * r.randrange(4), r.choice("ab"), "en") for i in range(n)]
    rows = [(*x, len(x[1])) for x in rows]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return f"{path}"


@pytest.mark.parametrize("name", WHOLE)
def test_no_row_for_a_pair(spark, tmp_path, name):
    """Nothing is joined and nothing exploded but packs, so nothing of that size is broadcast or sorted; ties and a missing vector as in SQL."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    path = vectors(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    df = queries()[name](spark, path)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    same_rows(df, con, oracle_sql()[name])


@pytest.mark.parametrize("name", ["hard_negative_pairs", "hard_negative_accuracy", "hard_negative_decision", "accuracy_by_decile", "leave_one_group_out", "manifest_checks"])
def test_hard_negatives_of_many_ties(spark, tmp_path, name):
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    path = documents(spark, tmp_path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet/*.parquet'")
    df = queries()[name](spark, path)
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    same_rows(df, con, oracle_sql()[name])


@pytest.mark.parametrize("name", ["hard_negative_accuracy", "accuracy_by_decile"])
def test_accuracy_of_all_documents(spark, tmp_path, name):
    """Every document that has pairs is a query, whatever its key; a missing length wins no pair, and a missing text is in none."""
    import duckdb

    from __spark_entry__ import oracle_sql, queries

    d = spark.read.parquet(documents(spark, tmp_path / "all", 300) + "/documents.parquet").withColumn("doc_id", F.col("doc_id") * 20 + 7)
    gone = lambda c, k: F.when(F.col("doc_id") % 11 != k, F.col(c)).alias(c)
    d.select("doc_id", gone("text", 1), "source", "lang", gone("n_chars", 2)).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries()[name](spark, f"{tmp_path}")
    assert (df.count() if "queries" not in df.columns else df.agg(F.sum("queries")).first()[0]) == d.where("doc_id % 11 <> 1").count()
    same_rows(df, con, oracle_sql()[name])


def test_accuracy_of_all_pairs():
    """More pairs than a manifest holds all count, ties half."""
    r = np.random.default_rng(2)
    o, x = np.sort(r.integers(0, 40, 300)).astype(float), r.integers(0, 5, 300).astype(float)
    pairs = [(x[i], x[j]) for i in range(300) for j in range(i + 5, min(i + 26, 300)) if o[i] != o[j]]
    got = H.separated_accuracy(5, 25, lambda query, found: found["x"])({"q": 1}, {"x": x}, o)
    assert len(pairs) > 128 and got["accuracy"] == [pytest.approx(sum(0.5 if a == b else a < b for a, b in pairs) / len(pairs), abs=1e-12)]
    assert H.separated_accuracy(5, 25, lambda query, found: found["x"])({"q": 1}, {"x": x[:4]}, o[:4]) is None


@pytest.mark.parametrize("hashed", [7, 1 << 16])
def test_pairs_of_one_query(monkeypatch, hashed):
    """All pairs of places 2 to 5 apart that differ, the smallest hashes first, however many are hashed at once; a missing distance is in none."""
    monkeypatch.setattr(H, "HASHED", hashed)
    r = np.random.default_rng(1)
    o, ids = r.integers(0, 6, 50).astype(float), np.arange(100, 150)
    o[3] = np.nan
    got = H.hashed_pairs_of(2, 5, "s", 20, lambda query, found, at: {"o": o[at]})({"q": 9}, {"c": ids}, o)
    ranked = sorted((x, i) for x, i in zip(o, ids, strict=True) if x == x)
    want = sorted((hashlib.sha256(f"s\n9\n{a[1]}\n{b[1]}".encode()).hexdigest(), a[1], b[1], a[0], b[0]) for i, a in enumerate(ranked) for b in ranked[i + 2 : i + 6] if a[0] != b[0])[:20]
    assert list(zip(got["selection_sha256"], got["closer"], got["farther"], got["closer_o"], got["farther_o"], strict=True)) == want
    assert got["pair_order"] == list(range(20))


def test_blocks_hold_few_bytes(spark, monkeypatch):
    """Small blocks, several packs and groups: every query still meets all of its group but itself."""
    monkeypatch.setattr(B, "BLOCK_BYTES", 8 * 300 * 4)
    monkeypatch.setattr(B, "PACK_ROWS", 16)
    c = spark.range(600).select(F.col("id").alias("c"), (F.col("id") % 2).cast("int").alias("g"), F.col("id").cast("double").alias("x"))
    q = c.where("c % 10 = 0").withColumnRenamed("c", "q")
    gaps = lambda a, b: np.abs(a["x"][:, None] - b["x"])
    got = B.each_beside(q, c, gaps, lambda a, f, d: {"q": [a["q"]], "n": [len(d)], "s": [d.sum()]}, "q long, n long, s double", on="g").collect()
    assert sorted((r["q"], r["n"], r["s"]) for r in got) == [(i, 299, float(sum(abs(i - j) for j in range(i % 2, 600, 2)))) for i in range(0, 600, 10)]


@pytest.mark.parametrize("hashed", [50, 1 << 16])
def test_spark_hashes_runs(spark, tmp_path, monkeypatch, hashed):
    """Far more pairs than are kept are hashed by Spark, in one piece or many; the smallest come whole, with their ranks and what they carry."""
    rows = spark.range(300).select(F.col("id").alias("c"), F.lit(0).alias("g"), (F.col("id") * 7 % 40).cast("double").alias("x"), (F.col("id") * 3).cast("double").alias("m"))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    q = rows.where("c % 50 = 0").withColumnRenamed("c", "q")
    gaps = lambda a, b: np.abs(a["x"][:, None] - b["x"])
    inner = H.runs_of(5, 25, "s", 64, lambda query, found, at: {"m": found["m"][at]})

    def runs(query, found, o):
        H.HASHED = hashed
        return inner(query, found, o)

    out = B.changes_beside(q, B.cells(rows, ["g", "x"], 26, ["m"]), gaps, runs, H.runs_schema(("m",)), "g", ("x",), 25)
    assert {r[0] for r in out.select(F.length("limit")).collect()} == {16}
    schema = "q long, pair_order int, selection_sha256 string, closer long, farther long, closer_rank long, farther_rank long, closer_m double, farther_m double"
    got = sorted(r[:] for r in H.hashed_runs(out, 64, ("m",), (), lambda x: x, schema).collect())
    every, want = sorted(r[:] for r in rows.collect()), []
    for i in range(0, 300, 50):
        ranked = sorted((abs(x - every[i][2]), c, m) for c, _, x, m in every if c != i)
        two = [(a, b) for a in range(299) for b in range(a + 5, min(a + 26, 299)) if ranked[a][0] != ranked[b][0]]
        digests = sorted((hashlib.sha256(f"s\n{i}\n{ranked[a][1]}\n{ranked[b][1]}".encode()).hexdigest(), a, b) for a, b in two)[:64]
        want += [(i, k, h, ranked[a][1], ranked[b][1], a + 1, b + 1, ranked[a][2], ranked[b][2]) for k, (h, a, b) in enumerate(digests)]
    assert got == want


def test_keys_that_are_not_unique():
    """Equal digests have no limit: such a query is hashed at once."""
    o, ids = np.repeat([0.0, 1.0], 200), np.repeat([5, 6], 200)
    found = {"c": ids, "place": np.arange(400)}
    (got,) = H.runs_of(5, 25, "s", 128, lambda query, found, at: {})({"q": 9}, found, o)
    assert set(got["limit"]) == {"g"} and len(got["farther"]) == 128 and set(got["pairs"]) == {128}


def test_only_places_around_changes(spark, tmp_path, monkeypatch):
    """Copies are folded, in parts: a query meets at most the ends of each distance, however many copies there are, with all pairs that are few places apart and their places."""
    monkeypatch.setattr(B, "FOLD_ROWS", 50)
    rows = spark.range(900).select(F.col("id").alias("c"), (F.col("id") % 2).cast("int").alias("g"), ((F.col("id") * 7) % 11 % 4).cast("double").alias("x"), (F.col("id") * 3).cast("double").alias("m"))
    rows.write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    gaps = lambda a, b: np.abs(a["x"][:, None] - b["x"])

    def pairs(query, found, o):
        two = [(i, j) for i in range(len(o)) for j in range(i + 1, min(i + 4, len(o))) if o[i] != o[j]]
        return {"q": [query["q"]], "n": [len(o)], "s": [sorted(f"{found['c'][i]} {found['c'][j]} {found['place'][i]} {found['place'][j]} {found['m'][i]:.0f}" for i, j in two)]}

    folded = B.cells(rows, ["g", "x"], 4, ["m"])
    assert folded.agg(F.count("*"), F.sum("n"), F.max(F.size("c"))).first()[:] == (8, 900, 8)
    q = rows.where("c % 10 = 3 or c % 100 = 8").withColumnRenamed("c", "q")
    got = {r["q"]: r for r in B.changes_beside(q, folded, gaps, pairs, "q long, n long, s array<string>", "g", ("x",), 3).collect()}
    every = sorted(r[:] for r in rows.collect())
    assert len(got) == 99
    for i, r in got.items():
        own = every[i]
        assert r["n"] <= 4 * 8
        ranked = sorted((abs(x - own[2]), c, m) for c, g, x, m in every if g == own[1] and c != i)
        want = [f"{ranked[a][1]} {ranked[b][1]} {a} {b} {ranked[a][2]:.0f}" for a in range(len(ranked)) for b in range(a + 1, min(a + 4, len(ranked))) if ranked[a][0] != ranked[b][0]]
        assert r["s"] == sorted(want)


def test_ranks_and_smallest():
    x = np.array([2.0, np.nan, 1.0, 2.0, np.nan])
    assert B.average_ranks(x).tolist() == [2.5, 4.5, 1.0, 2.5, 4.5]
    assert B.smallest(x, 2).tolist() == [2, 0] and B.smallest(x, 4).tolist() == [2, 0, 3, 1]
    assert R.spearman_of({"q": 1}, {}, np.ones(3), np.arange(3.0))["rho"] == [None]
