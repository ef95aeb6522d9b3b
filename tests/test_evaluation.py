"""Resampling, whole-order measures and cross-validation against plain numpy."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import crossval as C
from kindred.operators import inference as I
from kindred.operators import keys as K
from kindred.operators import ranking as R


# resampled clusters


def test_draws_of_buckets_add_up():
    upto = np.cumsum([0, 5, 0, 11, 1, 8, 40])
    each = np.array([I.bucket_draws(upto, b, 500, 3) for b in range(6)])
    assert (each.sum(axis=0) == 65).all() and (each[1] == 0).all()
    share = np.diff(upto) / 65
    assert np.abs(each.mean(axis=1) - 65 * share).max() < 4 * np.sqrt(65 * share * (1 - share) / 500).max()
    assert (I.bucket_draws(upto, 2, 500, 3) == each[2]).all() and (I.bucket_draws(upto, 2, 500, 4) != each[2]).any()


def test_draws_of_clusters_add_up():
    draws = np.array([0, 3, 50] * 60)
    parts = list(I.cluster_draws(draws, 7, 2, 5))
    counts = np.concatenate([c for _, c in parts])
    assert [i for i, _ in parts] == [0, 64, 128] and (counts.sum(axis=1) == draws).all()


@pytest.mark.parametrize("per_bucket", [4, 4096])
def test_replicates_are_sums_of_drawn_clusters(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(I, "CLUSTERS", per_bucket)
    r = random.Random(per_bucket)
    rows = [(r.choice([None, *range(30)]), r.choice([None, 1.0, 2.0, r.random()]), float(i % 3)) for i in range(800)]
    df = spark.createDataFrame(rows, "c long, a double, b double").withColumn("n", F.lit("x"))
    got = I.resampled_clusters(df, "c", ["a", "b"], 130, 9)
    whole = {}
    for c, a, b in rows:
        if c is not None and a is not None:
            x = whole.setdefault(str(c), [0, 0.0, 0.0])
            whole[str(c)] = [x[0] + 1, x[1] + a, x[2] + b]
    buckets = max(1, -(-len(whole) // per_bucket))
    names = [x["c"] for x in spark.createDataFrame([(c,) for c in sorted(whole)], "c string").collect()]
    at = {x["c"]: x["b"] for x in spark.createDataFrame([(c,) for c in names], "c string").select("c", F.pmod(F.xxhash64("c"), F.lit(buckets)).alias("b")).collect()}
    size = Counter(at.values())
    upto = np.cumsum([0, *(size[b] for b in range(buckets))])
    want, drawn = np.zeros((130, 3)), np.zeros(130)
    for b in range(buckets):
        own = sorted(c for c in names if at[c] == b)
        if own:
            counts = np.concatenate([x for _, x in I.cluster_draws(I.bucket_draws(upto, b, 130, 9), len(own), b, 9)])
            drawn += counts.sum(axis=1)
            want += counts @ np.array([whole[c] for c in own])
    assert (drawn == len(whole)).all()
    assert np.allclose(got.drawn_n, want[:, 0]) and np.allclose(got.drawn_sums, want[:, 1:])
    assert got.n == sum(x[0] for x in whole.values()) and np.allclose(got.sums, [sum(x[i] for x in whole.values()) for i in (1, 2)])


def test_intervals_are_those_of_a_plain_bootstrap(spark):
    rng = np.random.default_rng(2)
    c = rng.integers(0, 60, 3000)
    v = rng.normal(size=60)[c] + rng.normal(size=3000)
    df = spark.createDataFrame(list(zip(c.tolist(), v.tolist(), (v * 0).tolist(), strict=True)), "c long, v double, z double")
    got = I.resampled_clusters(df, "c", ["v", "z"], 2000).intervals(("v", ["z"]))
    s, n = np.bincount(c, v), np.bincount(c)
    means = [s[i].sum() / n[i].sum() for i in (rng.integers(0, 60, 60) for _ in range(4000))]
    low, high = np.quantile(means, [0.025, 0.975])
    assert abs(got["v"][0] - v.mean()) < 1e-9 and got["gap"] == got["v"] and got["z"] == (0, 0, 0)
    assert abs(got["v"][1] - low) < 0.05 * (high - low) + 0.01 and abs(got["v"][2] - high) < 0.05 * (high - low) + 0.01
    assert all(np.isnan(x) for x in I.cluster_bootstrap(df.where("false"), "c", "v"))


# orders


def test_prefix_sums_and_average_ranks(spark):
    r = random.Random(7)
    rows = [(i, r.choice("ab"), r.choice([None, 0.0, -0.0, 1.5, r.random(), float("inf")])) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, x double").repartition(5)
    got = {x["id"]: x["rank"] for x in K.average_ranks(df, ["g", "x"]).collect()}
    key = lambda t: (t[1], t[2] is not None, (t[2] or 0.0) + 0.0)
    order = sorted(map(key, rows))
    want = {t[0]: (order.index(key(t)) + 1 + len(order) - order[::-1].index(key(t))) / 2 for t in rows}
    assert got == want
    run = K.prefix_sums(spark.createDataFrame([(i, i % 5) for i in range(300)], "id long, w long").repartition(6), [F.desc("id")], ["w"])
    assert {x["id"]: x["before_w"] for x in run.collect()} == {i: sum(j % 5 for j in range(i + 1, 300)) for i in range(300)}


def test_ties_that_half_of_the_rows_share(spark, monkeypatch):
    from kindred.operators import hot

    monkeypatch.setattr(hot.meet, "__defaults__", (50, 100_000))
    df = spark.range(400).select("id", F.when(F.col("id") < 200, 1.0).otherwise(F.col("id").cast("double")).alias("x"))
    got = {x["id"]: x["rank"] for x in K.average_ranks(df, ["x"]).collect()}
    assert got == {i: 100.5 if i < 200 else i + 1.0 for i in range(400)}


def test_average_precision_and_spearman_edges(spark):
    rows = [(0.9, True), (0.8, False), (0.8, True), (0.8, True), (0.1, False), (None, True), (0.5, None)]
    df = spark.createDataFrame(rows, "s double, p boolean")
    assert abs(R.average_precision(df, "s", "p") - (1 / 1 * 1 + 3 / 4 * 2) / 3) < 1e-12
    assert R.average_precision(df.where("not p"), "s", "p") is None and R.average_precision(df.where("false"), "s", "p") is None
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0), ("b", 1.0, 5.0), ("b", 1.0, 6.0), ("c", 1.0, None), ("d", 1.0, 1.0), ("d", 2.0, 9.0), ("d", 3.0, 9.5)], "g string, x double, y double")
    assert {x["g"]: x["spearman"] for x in R.spearman(df, ["g"], "x", "y").collect()} == {"a": -1.0, "b": None, "d": 1.0}


def test_average_precisions_are_those_of_each_group(spark):
    r = random.Random(11)
    rows = [(r.choice("abc"), r.choice([None, 0.5, -0.0, 0.0, r.random()]), r.choice([None, 0, 1, 1])) for _ in range(900)] + [("none", 0.5, 0), ("one", 0.1, 1), (None, 0.9, 1), ("gone", None, 1)]
    df = spark.createDataFrame(rows, "g string, s double, p int").repartition(7)
    got = R.average_precisions(df, "g", "s", "p")
    want = {g: R.average_precision(df.where(F.col("g") == g), "s", "p") for g in ("a", "b", "c")}
    assert set(got) == {"a", "b", "c", "none", "one"} and got["none"] is None and got["one"] == 1.0
    assert all(abs(got[g] - want[g]) < 1e-12 for g in want)


@pytest.mark.parametrize("files", [1, 6])
def test_fits_of_signs_are_dealt_by_rows_whatever_the_files(spark, sf_dir, tmp_path, monkeypatch, files):
    from kindred.plans import evaluation as E

    monkeypatch.setattr(E, "FIT_ROWS", 100)
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    odd = spark.createDataFrame([(900_001, None, 1), (900_002, [9.0] * 40 + [None] + [9.0] * 23, 1)], e.schema)
    e.unionByName(odd).repartition(files).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = E._signs(spark, str(tmp_path)).withColumn("part", F.spark_partition_id()).collect()
    n = e.count()
    assert len({r["part"] for r in got}) > 1 and max(Counter(r["part"] for r in got).values()) < 200 and len(got) == n + 2
    own = {k: [r["id"] for r in got if r["part"] == k] for k in {r["part"] for r in got}}
    assert all(ids == sorted(ids) for ids in own.values())
    want = e.unionByName(odd).select("vec_id", "embedding", F.pmod(F.crc32(F.col("vec_id").cast("string")), F.lit(5)).alias("fold")).collect()
    x = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in want if r["embedding"] is not None}
    train = np.array([x[r["vec_id"]] for r in want if r["fold"] < 3 and r["vec_id"] < 900_000])
    mean, sd = train.mean(axis=0)[:4], train.std(axis=0)[:4]
    for r in got:
        if r["id"] == 900_001:
            assert r["plain"] is None and r["products"] is None and r["same"] is None
            continue
        z = (x[r["id"]][:4] - mean) / sd
        assert np.allclose(r["plain"], z) and r["same"] == int(x[r["id"]][0] * x[r["id"]][1] > 0)
        assert np.allclose(r["products"], [*z, z[0] * z[1], z[0] * z[2], z[0] * z[3], z[1] * z[2], z[1] * z[3], z[2] * z[3]])


# cross-validation


def plain_ridge(x, y, alpha):
    mx, my = x.mean(axis=0), y.mean(axis=0)
    w = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return w, my - mx @ w


@pytest.fixture(scope="module")
def task(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)) * [1, 2, 0.1, 5, 1] + [0, 3, 0, -1, 0]
    x[:, 4] = 2.0
    y = np.column_stack([x[:, 0] * 2 + rng.normal(size=400), x[:, 1] - x[:, 3] + rng.normal(size=400) * 0.1])
    g = [f"g{i}" for i in rng.integers(0, 9, 400)]
    role = rng.choice(["train", "train", "train", "validation", "test"], 400)
    rows = [(i, g[i], role[i], x[i].tolist(), *y[i].tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, g string, role string, x array<double>, a double, b double")
    return x, y, np.array(g), role, df


def test_grouped_cv_equals_fitting_each_model(spark, task):
    x, y, g, _, df = task
    alphas = [0.1, 1.0, 10.0, 100.0]
    more = df.unionByName(spark.createDataFrame([(900, None, "train", [1.0] * 5, 1.0, 1.0), (901, "g1", "train", None, 1.0, 1.0), (902, "g1", "train", [1.0] * 5, None, 1.0), (903, "g1", "train", [1.0] * 4, 1.0, 1.0)], df.schema))
    got = C.grouped_cv(more.withColumn("row", F.lit(1)), "x", ["a", "b"], "g", 3, alphas)
    fold = {r["g"]: r["fold"] for r in K.hash_folds(df, "g", 3).collect()}
    f = np.array([fold[k] for k in g])
    sd = x.std(axis=0)
    sd[sd == 0] = 1
    z = (x - x.mean(axis=0)) / sd
    want = np.array([[np.mean([np.abs(y[f == k] - z[f == k] @ w - b).mean(axis=0) for k in range(3) for w, b in [plain_ridge(z[f != k], y[f != k], a)]], axis=0)] for a in alphas])[:, 0]
    assert np.abs(got.errors - want).max() < 1e-9
    assert got.alphas == [alphas[i] for i in want.argmin(axis=0)]
    for t in range(2):
        w, b = plain_ridge(z, y[:, [t]], got.alphas[t])
        assert np.abs(x @ got.w[:, t] + got.b[t] - (z @ w + b)[:, 0]).max() < 1e-9
    with pytest.raises(ValueError):
        C.grouped_cv(df.where("g = 'g1'"), "x", ["a"], "g", 3, alphas)


def test_predictions_come_from_models_that_did_not_see_the_row(spark, task, tmp_path):
    x, y, _, role, df = task
    alphas = [0.1, 10.0, 1000.0]
    p = C.prediction_relation(df, "id", "role", "x", ["a", "b"], 4, alphas)
    got = {r["id"]: r for r in p.collect()}
    train = role == "train"
    q = np.quantile(y[train], [0.25, 0.5, 0.75], axis=0)
    s = (y - q[1]) / np.maximum(q[2] - q[0], 1)
    best = []
    for t in range(2):
        errors = []
        for a in alphas:
            w, b = plain_ridge(x[train], s[train][:, [t]], a)
            errors.append((np.abs(s[role == "validation"][:, [t]] - x[role == "validation"] @ w - b).mean(), -a))
        best.append(-min(errors)[1])
    fold = np.array([got[i]["fold"] if train[i] else -1 for i in range(400)])
    assert sorted(Counter(fold[train]).values())[-1] - sorted(Counter(fold[train]).values())[0] <= 1
    for i in range(400):
        use = train & (fold != fold[i]) if train[i] else train
        want = []
        for t in range(2):
            w, b = plain_ridge(x[use], s[use][:, [t]], best[t])
            want.append((x[i] @ w + b)[0])
        assert np.abs(np.array(got[i]["predicted"]) - want).max() < 1e-8 and got[i]["model"] == (f"without-{fold[i]}" if train[i] else "all")
    C.unseen(p.where("role = 'train'"), "train", got[0]["bundle"])
    for bad in (p.withColumn("model", F.lit("all")), p.withColumn("fold", F.col("fold") + 1), p.withColumn("role", F.lit("test"))):
        with pytest.raises(C.SeenError):
            C.unseen(bad.where("fold is not null"), "train")
    with pytest.raises(C.SeenError):
        C.unseen(p.where("role = 'test'"), "test", "another bundle")
    with pytest.raises(ValueError):
        C.prediction_relation(df.where("role <> 'train'"), "id", "role", "x", ["a"], 4, alphas)


def test_predicted_search_equals_sql_over_the_stored_predictions(spark, sf_dir, tmp_path, monkeypatch):
    import duckdb

    from kindred.plans import evaluation as E

    stored = E._predictions(spark, sf_dir)
    stored.write.parquet(f"{tmp_path}/p")
    monkeypatch.setattr(E, "_predictions", lambda *a: stored)
    got = sorted((r["q"], r["c"], r["rk"], r["d"]) for r in E.predicted_executor_topk(spark, sf_dir).collect())
    sql = f"""WITH p AS (SELECT * FROM '{tmp_path}/p/*.parquet'),
    d AS (SELECT a.id AS q, b.id AS c, list_max(list_transform([1, 2, 3], lambda i: abs(a.predicted[i] - b.predicted[i]))) AS d FROM p a JOIN p b ON a.role = 'test' AND b.role = 'train'),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d, c) AS rk FROM d) SELECT q, c, rk, round(d, 6) FROM r WHERE rk <= 10"""
    assert got == sorted(duckdb.sql(sql).fetchall())


# ledgers


def test_a_chain_that_lies_in_several_ranges(spark):
    import hashlib

    from kindred.operators.ledger import chain_breaks

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [("a" if i < 900 else "b" if i < 901 else None, i, f"p{i}") for i in range(1000) if i % 97]
    df = spark.createDataFrame(rows, "chain string, at long, payload string").repartition(5)
    got = {r["at"]: (r["previous_sha256"], r["gap"]) for r in chain_breaks(df, ["chain"], "at", "payload").collect()}
    want = {}
    for before, row in zip([(0, 0, 0), *rows], rows, strict=False):
        want[row[1]] = (sha(before[2]), row[1] - before[1]) if before[0] == row[0] else (None, None)
    assert got == want
