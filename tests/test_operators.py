import collections
import json
import math
import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.__main__ import main
from kindred.functions import vectors as V
from kindred.functions.code import primitives
from kindred.functions.encoder import embed, mean_pool
from kindred.operators import duplicates as D
from kindred.operators import inference as I
from kindred.operators import keys as K
from kindred.operators import ledger as L
from kindred.operators import probes as P
from kindred.operators import retrieval as R
from kindred.operators import selective as S
from kindred.operators.components import connected_components
from kindred.operators.graph import outcome, resolved_edges
from kindred.plans import authorisation as A
from kindred.plans import workflow as WF
from kindred.plans.queries import _folded
from kindred.sources import readers
from kindred.streaming.increments import process_new_files


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {n: find(n) for n in root}


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (5, 4), (9, 9), (3, 1)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)] + [(100, i) for i in range(50, 90)]])
def test_components(spark, edges):
    got = {r.node: r.component for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "a long, b long")).collect()}
    assert got == {n: c for n, c in brute_components([e for e in edges if e[0] != e[1]]).items()}


def test_distances_of_zero_and_equal_rows(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    rows = df.select(V.cosine_distance(F.col("a"), F.col("b")).alias("c"), V.euclidean_distance(F.col("a"), F.col("b")).alias("e"), V.chebyshev_distance(F.col("a"), F.col("b")).alias("x")).collect()
    assert rows[0].c == 1.0 and rows[1].e == 0.0 and abs(rows[1].c) < 1e-12
    assert rows[0].x == 2.0


@pytest.mark.parametrize(
    ("code", "want"),
    [
        ("def f(a):\n if a and b:\n  pass\n for x in a:\n  if x: g()\n def n():\n  while 1: pass\n h()", [5, 2, 2]),
        ("def f():\n foo();foo();obj.save();factory()()", [1, 0, 4]),
        ("def f(x):\n return [a for a in x if a], (b for b in x if b)", [5, 1, 0]),
        ("def f(x):\n try:\n  with x:\n   while x: pass\n except E: pass", [3, 3, 0]),
    ],
)
def test_code_primitives(code, want):
    p = primitives(code)
    assert [p["complexity"], p["depth"], p["calls"]] == want


def test_code_reasons():
    assert [primitives(c)["reason"] for c in (None, "", "x = 1", "def f(")] == ["missing_code", "missing_code", "ast_ineligible", "ast_ineligible"]


def test_role_quotas_and_refusal():
    assert K.role_quotas(20, (2, 2, 2, 2), (0.5, 0.25, 0.125, 0.125)) == [8, 5, 4, 3]
    with pytest.raises(ValueError):
        K.role_quotas(7, (2, 2, 2, 2), (1, 1, 1, 1))


def test_hidden_roles_raise(spark):
    rows = spark.createDataFrame([("a", 1)], "source string, x int")
    with pytest.raises(K.RoleError):
        K.visible(rows, rows.withColumn("role", F.lit("reserve")), "source", ["reserve"], ["fit"])


def test_conformal_quantile(spark):
    scores = spark.createDataFrame([(float(i),) for i in range(1, 11)] + [(None,)], "s double")
    assert S.conformal_quantile(scores, "s", 0.2) == 9.0
    assert S.conformal_quantile(scores, "s", 0.9) == 2.0
    assert S.conformal_quantile(scores.where("s > 99"), "s", 0.2) is None


def test_query_truth_and_intervals(spark):
    m = spark.createDataFrame([([1.0, 1.0, -1.0],), ([1.0, 1.0, 1.0],), ([-1.0, -1.0, 1.0],)], "m array<double>")
    forms = [S.Query("all"), S.Query("any"), S.Query("k_of_n", 2)]
    got = m.select(*[q.truth(F.col("m")).alias(f"c{i}") for i, q in enumerate(forms)]).collect()
    assert [tuple(r) for r in got] == [(False, True, True), (True, True, True), (False, True, False)]
    box = spark.createDataFrame([([1.0, 0.5], [2.0, 2.0]), ([-0.2, 1.0], [0.3, 2.0]), ([-3.0, 1.0], [-1.0, 2.0])], "l array<double>, h array<double>")
    yes, accepted, _ = S.interval_decision(F.col("l"), F.col("h"), S.Query("all"))
    assert [tuple(r) for r in box.select(yes.alias("y"), accepted.alias("a")).collect()] == [(True, True), (False, False), (False, True)]


def test_simhash_ties_and_rename():
    assert D.simhash_of([]) == D.simhash_of([]) and len(D.simhash_of(["a"])) == 16
    assert D.simhash_of("a b c d e f".split()) != D.simhash_of("a b c d e g".split())


def test_hamming_and_bands(spark):
    r = spark.createDataFrame([("0" * 16, "0" * 15 + "f"), ("0" * 16, "f" * 16)], "a string, b string").select(D.hamming(F.col("a"), F.col("b")).alias("d"), D.bands(F.col("b")).alias("b")).collect()
    assert [x.d for x in r] == [4, 64] and r[0].b == [15, 0, 0, 0]


def test_near_pairs_are_all_found(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        base = int(rng.integers(0, 1 << 63)) if i % 3 else 7
        for _ in range(int(rng.integers(0, 5))):
            base ^= 1 << int(rng.integers(0, 64))
        rows.append((i, f"s{i % 4}", f"{base:016x}"))
    got = {(r.left_key, r.right_key, r.distance) for r in D.pairs_within(spark.createDataFrame(rows, "k long, s string, f string"), "k", "f", ["s"]).collect()}
    want = {(a, b, d) for a, s, f in rows for b, t, g in rows if a < b and s != t and (d := bin(int(f, 16) ^ int(g, 16)).count("1")) <= 3}
    assert got == want


def test_ridge_out_of_fold(spark, sf_dir):
    rows = P.out_of_fold(_folded(spark, sf_dir), "x", "y", "fold", 1.0).toPandas()
    x, y, f = np.array(rows["x"].tolist()), rows["y"].to_numpy(), rows["fold"].to_numpy()
    for k in range(5):
        a, b = x[f != k], y[f != k]
        mx, my = a.mean(0), b.mean()
        w = np.linalg.solve((a - mx).T @ (a - mx) + np.eye(a.shape[1]), (a - mx).T @ (b - my))
        assert np.allclose(rows["yhat"].to_numpy()[f == k], (x[f == k] - mx) @ w + my, atol=1e-8)


def _noisy(spark, n=400, d=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    y = x @ np.arange(1, d + 1) * 0.3 + rng.normal(size=n)
    rows = [(i, x[i].tolist(), float(y[i]), int(y[i] > 0)) for i in range(n)]
    return x, y, spark.createDataFrame([*rows, (n, None, 1.0, 1), (n + 1, x[0].tolist(), None, None)], "k long, v array<double>, y double, l int")


def test_logistic_is_at_the_optimum(spark):
    x, y, rows = _noisy(spark)
    m = P.fit_logistic(rows, "v", "l", c=2.0)
    p = 1 / (1 + np.exp(-(x @ m.w + m.b)))
    assert np.allclose(x.T @ (p - (y > 0)) + m.w / 2.0, 0, atol=1e-6) and abs((p - (y > 0)).sum()) < 1e-6
    got = rows.where("v is not null and l is not null").select(m.probability(F.col("v")).alias("p"), "k").orderBy("k").toPandas()["p"]
    assert np.allclose(got, p)
    with pytest.raises(ValueError):
        P.fit_logistic(rows.where("l = 1"), "v", "l")


def test_logistics_of_several_penalties_share_their_passes(spark, monkeypatch):
    x, y, rows = _noisy(spark)
    cs, passes, added = [0.01, 1.0, 100.0], [], P._added
    monkeypatch.setattr(P, "_added", lambda *a: passes.append(1) or added(*a))
    alone = [P.fit_logistic(rows, "v", "l", c) for c in cs]
    each, passes[:] = len(passes), []
    for c, m, one in zip(cs, P.fit_logistics(rows.repartition(3), "v", "l", cs), alone, strict=True):
        p = 1 / (1 + np.exp(-(x @ m.w + m.b)))
        assert np.allclose(x.T @ (p - (y > 0)) + m.w / c, 0, atol=1e-6) and abs((p - (y > 0)).sum()) < 1e-6
        assert np.allclose(m.w, one.w, atol=1e-9) and abs(m.b - one.b) < 1e-9
    assert len(passes) < each / 2
    short = spark.createDataFrame([([1.0, 2.0], 0), ([1.0, 2.0, 3.0], 1), ([1.0], 0)], "v array<double>, l int")
    with pytest.raises(Exception, match="reshape"):
        P.fit_logistics(short, "v", "l", [1.0])


def test_pls_against_deflation(spark):
    x, y, rows = _noisy(spark)
    g = P.grams(rows.withColumn("f", F.lit(0)), "v", "y", "f")[0]
    e, t, scores = x - x.mean(0), y - y.mean(), []
    for _ in range(3):
        w = e.T @ t / np.linalg.norm(e.T @ t)
        s = e @ w
        e, t = e - np.outer(s, s @ e) / (s @ s), t - s * (s @ t) / (s @ s)
        scores.append(s)
    assert np.allclose((x - x.mean(0)) @ g.pls(3), np.column_stack(scores), atol=1e-8)


def test_moments_give_r2_and_standard_scores(spark):
    x, y, rows = _noisy(spark)
    g = P.grams(rows.withColumn("f", F.lit(0)), "v", "y", "f")[0]
    w, b = g.ridge(1.0)
    assert math.isclose(g.r2(w, b), 1 - ((y - x @ w - b) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    z = (x - x.mean(0)) / x.std(0)
    s, mean, sd = g.standardised()
    assert np.allclose(s.xx, z.T @ z) and np.allclose(s.xy, z.T @ y) and np.allclose(mean, x.mean(0)) and np.allclose(sd, x.std(0))


def test_alpha_grid_and_ties(spark):
    x, y, rows = _noisy(spark)
    errors = P.alpha_errors(rows.withColumn("r", F.when(F.col("k") < 300, "fit").otherwise("validation")), "v", "y", "r", [0.1, 10.0])
    a, b = x[:300], y[:300]
    for alpha, e in errors:
        w = np.linalg.solve((a - a.mean(0)).T @ (a - a.mean(0)) + alpha * np.eye(5), (a - a.mean(0)).T @ (b - b.mean()))
        assert math.isclose(e, np.abs(y[300:] - (x[300:] - a.mean(0)) @ w - b.mean()).mean())
    assert P.best_alpha([(1.0, 2.0), (3.0, 2.0)]) == 3.0 and P.best_alpha([(1.0, 2.0), (3.0, 2.0)], larger=False) == 1.0


def test_permutations_keep_sums_and_agree(spark):
    x, y, rows = _noisy(spark)
    one = P.permuted_products(rows, "v", "y", "k", 40, block=64)
    assert np.allclose(one, P.permuted_products(rows.repartition(7), "v", "y", "k", 40, block=64))
    ones = P.permuted_products(rows.withColumn("v", F.when(F.col("v").isNotNull(), F.array(F.lit(1.0)))), "v", "y", "k", 3)
    assert np.allclose(ones, y.sum())
    g = P.grams(rows.withColumn("f", F.lit(0)), "v", "y", "f")[0]
    null = P.permutation_null(g, one, g.r2)
    assert null["observed"] > null["q99"] >= null["q95"] >= null["mean"]


def test_products_without_squares(spark):
    got = spark.createDataFrame([([2.0, 3.0, 5.0],), ([7.0],)], "v array<double>").select(P.with_products(F.col("v"))).collect()
    assert [r[0] for r in got] == [[2.0, 3.0, 5.0, 6.0, 10.0, 15.0], [7.0]]


def test_perceptron_learns_what_no_line_can(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(-1, 1, size=(600, 2))
    rows = spark.createDataFrame([(r.tolist(), int((r[0] > 0) == (r[1] > 0))) for r in x], "v array<double>, l int")
    out = P.perceptron(rows, rows.unionByName(spark.createDataFrame([(None, 1)], rows.schema)), "v", "l").toPandas()
    assert out["p1"].isna().sum() == 1
    out = out.dropna()
    assert ((out["p1"] > 0.5) == (out["l"] == 1)).mean() > 0.9


def test_compound_conformal_sets(spark):
    x, y, rows = _noisy(spark, 600)
    some = rows.where("v is not null and l is not null")
    fit, cal, test = (some.where(F.col("k") % 3 == i) for i in range(3))
    out = S.compound_conformal(fit, cal, test, "v", "l", 0.2).toPandas()
    m = P.fit_logistic(fit, "v", "l")
    p = lambda r: 1 / (1 + np.exp(-(np.array(r["v"].tolist()) @ m.w + m.b)))
    c = cal.toPandas()
    s = np.sort(np.where(c["l"] == 1, 1 - p(c), p(c)))
    q = s[min(len(s), math.ceil((len(s) + 1) * 0.8)) - 1]
    yes, no = 1 - p(out) <= q, p(out) <= q
    assert (out["prediction"] == yes).all() and (out["accepted"] == (yes ^ no)).all()
    assert set(out["reason"]) <= {"accepted_singleton_prediction_set", "refused_empty_prediction_set", "refused_ambiguous_prediction_set"}
    assert not S.compound_conformal(fit, cal.limit(0), test, "v", "l", 0.2).where("accepted").count()


def test_confidence_and_global_rank(spark):
    p = [0.9, 0.2, 0.5, 0.7, 0.9, 0.1]
    rows = spark.createDataFrame(list(enumerate(p)), "id long, p double").repartition(3)
    got = {r["id"]: r["accepted"] for r in S.confidence_decision(rows, "p", 0.5, "id").collect()}
    assert [got[i] for i in range(6)] == [True, False, False, False, True, True]
    assert not S.confidence_decision(rows, "p", 0.0, "id").where("accepted").count() and S.confidence_decision(rows, "p", 1.0, "id").where("accepted").count() == 6
    big = spark.range(5000).withColumn("x", F.col("id") % 7)
    r = K.global_rank(big, [F.col("x").desc(), F.col("id")]).toPandas().sort_values("rk")
    assert (r["rk"].to_numpy() == np.arange(1, 5001)).all() and (r["x"].diff().dropna() <= 0).all()
    assert K.global_rank(big.limit(0), [F.col("id")]).count() == 0


def test_bootstrap_and_decision(spark):
    mean, low, high = I.bootstrap_mean(np.arange(50.0))
    assert low < mean < high
    assert I.gap_decision({"a": 0.8, "b": 0.7}, "a", ["b"], least=0.05) == (pytest.approx(0.1), True)
    assert I.seed_interval([1.0, 2.0, 3.0])["std"] == 1.0
    m, lo, hi = I.cluster_bootstrap(spark.createDataFrame([(i % 5, float(i)) for i in range(50)], "c int, v double"), "c", "v", 200)
    assert lo <= m <= hi


def test_chain_and_json(tmp_path):
    c = L.Chain(tmp_path / "chain.jsonl")
    c.append({"a": 1})
    c.append({"b": "é"})
    assert [e["sequence"] for e in c.read()] == [0, 1]
    text = c.path.read_text().replace('"a":1', '"a":2')
    c.path.write_text(text)
    with pytest.raises(ValueError):
        c.read()
    assert L.canonical_json({"b": "é", "a": 1}) == '{"a":1,"b":"é"}' and "\\u" in L.canonical_json("é", True)
    L.write_json(tmp_path / "x.json", [1])
    with pytest.raises(FileExistsError):
        L.write_json(tmp_path / "x.json", [2])
    assert json.loads((tmp_path / "x.json").read_text()) == [1]


def test_put_or_conflict(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, p string")
    new, bad = L.put_or_conflict(old, spark.createDataFrame([(1, "a"), (2, "x"), (3, "c")], "k int, p string"), "k", "p")
    assert [tuple(r) for r in new.collect()] == [(3, "c")] and [tuple(r) for r in bad.collect()] == [(2, "x")]


def test_workflow_blocks_and_resumes():
    calls = []

    def step(name, status="COMPLETED"):
        def f(state):
            calls.append(name)
            return status, {"n": len(state)}

        return name, f

    first = WF.run([step("a"), step("b", "BLOCKED"), step("c")], {"x": 1})
    assert [d.status for d in first] == ["COMPLETED", "BLOCKED"]
    second = WF.run([step("a"), step("b"), step("c")], {"x": 1}, first)
    assert [d.name for d in second] == ["a", "b", "c"] and calls == ["a", "b", "b", "c"]
    with pytest.raises(WF.StepFailed) as e:
        WF.run([step("a"), ("z", lambda s: 1 / 0)], {})
    assert [d.name for d in e.value.done] == ["a"]


RULES = [("fork", "AUTO", True), ("same_code", "APPROVED_REQUIRED", True), ("name", "REVIEW_ONLY", False)]
EDGES = [("1", "fork", "b", "a"), ("2", "same_code", "a", "c"), ("3", "same_code", "c", "d"), ("4", "name", "d", "e"), ("5", "same_code", "e", "f")]


def _resolved(spark, given, edges=EDGES):
    d = spark.createDataFrame(given, "candidate_id string, disposition string, protocol_sha256 string")
    return resolved_edges(spark.createDataFrame(edges, "candidate_id string, edge_type string, a string, b string"), d, spark.createDataFrame(RULES, "edge_type string, requirement string, connects boolean"), "p1")


def test_edges_are_resolved_by_rule(spark):
    got = {r["candidate_id"]: (r["a"], r["b"], r["review_status"], r["connecting"]) for r in _resolved(spark, [("2", "APPROVED", "p1"), ("3", "REJECTED", "p1")]).collect()}
    assert got == {"1": ("a", "b", "APPROVED", True), "2": ("a", "c", "APPROVED", True), "3": ("c", "d", "REJECTED", False), "4": ("d", "e", "REVIEW_ONLY", False), "5": ("e", "f", "UNRESOLVED", False)}
    assert _resolved(spark, [], []).count() == 0


@pytest.mark.parametrize("given", [[("9", "APPROVED", "p1")], [("1", "APPROVED", "p1")], [("4", "APPROVED", "p1")], [("2", "APPROVED", "old")], [("2", "APPROVED", "p1"), ("2", "REJECTED", "p1")]])
def test_wrong_dispositions_fail(spark, given):
    with pytest.raises(Exception, match="disposition"):
        _resolved(spark, given).collect()


def test_encoder_gets_full_batches(spark):
    def make():
        def encode(texts):
            assert len(texts) == 4
            return np.array([[len(t), t.count("a")] for t in texts], dtype=np.float32)

        return encode

    rows = spark.createDataFrame([(i, "a" * i if i != 3 else None) for i in range(11)], "id long, text string")
    got = {r["id"]: r["embedding"] for r in embed(rows, "id", "text", make, 4).collect()}
    assert got == {i: [float(i), float(i)] for i in range(11) if i != 3}
    states = np.arange(12.0).reshape(1, 3, 4)
    assert np.allclose(mean_pool(states, np.array([[1, 1, 0]])), states[:, :2].mean(1)) and not mean_pool(states, np.zeros((1, 3))).any()


def test_authorised_runs_happen_once(tmp_path):
    plan = {"rows": 3}
    asked = A.request(plan, "why")
    yes, no = A.authorise(asked, "someone", "AUTHORISED"), A.authorise(asked, "someone", "REFUSED")
    for bad in [(plan, asked, no), ({"rows": 4}, asked, yes), (plan, asked | {"reason": "else"}, yes), (plan, A.request(plan, "other"), yes)]:
        with pytest.raises(A.NotAuthorised):
            A.execute_once(tmp_path, *bad, lambda p: p)
    assert not list(tmp_path.iterdir())
    receipt = A.execute_once(tmp_path, plan, asked, yes, lambda p: {"n": p["rows"]})
    with pytest.raises(FileExistsError):
        A.execute_once(tmp_path, plan, asked, yes, lambda p: {"n": 9})
    with pytest.raises(A.NotAuthorised):
        A.publish(tmp_path, receipt, {"n": 4}, "someone")
    A.publish(tmp_path, receipt, {"n": 3}, "someone")
    assert json.loads((tmp_path / "output.json").read_text()) == {"n": 3}
    failed = tmp_path / "failed"
    failed.mkdir()
    with pytest.raises(ZeroDivisionError):
        A.execute_once(failed, plan, asked, yes, lambda p: 1 / 0)
    assert {p.name for p in failed.iterdir()} == {"claim.json", "failure.json"}


def test_command_line(spark, sf_dir, tmp_path, capsys):
    main(["list"])
    assert "cosine_topk" in capsys.readouterr().out.split()
    main(["sql", "hubs"])
    assert "SELECT" in capsys.readouterr().out
    main(["run", "role_counts", sf_dir, str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0


def test_outcome_precedence():
    assert [outcome(False, 1, 1), outcome(True, 1, 1), outcome(True, 0, 1), outcome(True, 0, 0)] == ["METADATA_INCOMPLETE", "REVIEW_REQUIRED", "ROLE_CROSSING_FOUND", "NO_ROLE_CROSSING"]


def test_readers(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 2) for i in range(6)], "k int, g int")
    readers.write_once(df, str(tmp_path / "t"), ["g"])
    with pytest.raises(Exception, match="(?i)exists"):
        readers.write_once(df, str(tmp_path / "t"))
    assert [r.k for r in readers.page_after(df, ["g", "k"], (0, 2), 2).collect()] == [4, 1]
    (tmp_path / "r.jsonl").write_text('{"func_name":"f"}\n\n')
    assert readers.read_jsonl(spark, str(tmp_path / "r.jsonl"), readers.FUNCTION_ROWS, "train").select("func_name", "_split").collect()[0][:] == ("f", "train")


def test_increments(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    spark.range(10).write.parquet(src)
    schema = spark.range(1).schema
    process_new_files(spark, src, schema, lambda d: d.where("id % 2 = 0"), out, cp)
    spark.range(10, 20).write.mode("append").parquet(src)
    process_new_files(spark, src, schema, lambda d: d.where("id % 2 = 0"), out, cp)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(0, 20, 2))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 0.25, 0.5, 1.0]), min_size=2, max_size=9))
def test_ranks_break_ties_by_position(spark, values):
    from kindred.operators.retrieval import top_k

    rows = [(0, i, v) for i, v in enumerate(values)]
    got = [r.c for r in top_k(spark.createDataFrame(rows, "q long, c long, d double"), "d", 5).orderBy("rk").collect()]
    assert got == [i for v, i in sorted((v, i) for i, v in enumerate(values))][:5]


def test_no_part_of_the_library_imports_llm():
    from conftest import ROOT

    for p in (ROOT / "kindred").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"^\s*(from|import) kindred\.llm", p.read_text(), re.M), p
    assert math.isfinite(1.0)


def test_hot_keys_meet_their_facts(spark):
    from kindred.operators.hot import meet

    rows = spark.range(5000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) as k").unionByName(spark.createDataFrame([(9999, None)], "id long, k string"))
    facts = rows.where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    want = sorted(map(tuple, rows.join(facts, "k").select("id", "k", "n", "low").collect()))
    for bound, most in ((10, 100), (10, 0), (10**6, 100)):
        assert sorted(map(tuple, meet(rows, facts, "k", "n", bound, most).select("id", "k", "n", "low").collect())) == want


def test_staging_needs_a_shared_folder_on_a_cluster(spark):
    from types import SimpleNamespace

    from kindred import storage

    fake = lambda master: SimpleNamespace(sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: None)), conf=SimpleNamespace(get=lambda *_: None))
    assert storage.shared_dir(fake("local[4]")) == storage.LOCAL_FALLBACK
    for master in ("yarn", "spark://x:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(fake(master))


def test_scratch_deletes_what_is_not_kept(spark):
    import os

    from kindred import storage

    with storage.scratch(spark) as keep:
        gone, kept = storage.staged(spark.range(5)), storage.staged(spark.range(7), few=True)
        keep.append(kept)
    there = lambda d: os.path.exists(d._kindred_folder.removeprefix("file:"))
    assert kept.count() == 7 and there(kept) and not there(gone)
    storage.forget(kept)
    assert not there(kept)


def test_names_of_repositories(spark):
    from kindred.functions import names as N

    rows = ["alice/tool", "bob/tool-fork", "carol/tool-v2", "D/python-django-py", "e/aio-client", "f/old", "g/x_y.2", "h/a/b-copy", None, "plain", "/x", "y/"]
    df = spark.createDataFrame([(r,) for r in rows], "r string")
    got = [tuple(x) for x in df.select(N.owner(F.col("r")), N.name(F.col("r")), N.signatures(F.col("r"))["exact"], N.signatures(F.col("r"))["family"], N.family_name(F.col("r"))).collect()]
    assert [g[3] for g in got[:3]] == ["tool"] * 3 and got[5][2:4] == ("old", "old") and got[6][2:4] == ("x-y-2", "x-y")
    assert got[3][4] == "django" and got[4][4] == "" and got[7][:2] == ("h", "a/b-copy") and got[7][3] == "b"
    assert [g[0] for g in got[8:]] == [None] * 4
    assert df.limit(1).select(N.normalised(F.lit(" Alice/Tool "))).first()[0] == "alice/tool"
    with pytest.raises(Exception, match="no repository name"):
        df.limit(1).select(N.normalised(F.lit("nothing"))).collect()


def test_near_duplicate_report_counts_pairs_without_making_them(spark):
    import itertools

    from kindred.operators import audit as A

    rng = np.random.default_rng(8)
    base = [int(x) for x in rng.integers(0, 2**63, 6)]
    rows = [(i, f"{base[i % 6] ^ (1 << int(rng.integers(64))) if i % 2 else base[i % 6]:016x}", f"r{rng.integers(3)}", f"p{rng.integers(5)}") for i in range(120)]
    got = {r.distance: r.pairs for r in A.near_duplicate_report(spark.createDataFrame(rows, "id int, f string, role string, repo string"), "f", "role", "repo").collect()}
    want = collections.Counter()
    for a, b in itertools.combinations(rows, 2):
        d = (int(a[1], 16) ^ int(b[1], 16)).bit_count()
        if d <= 3 and a[2] != b[2] and a[3] != b[3]:
            want[d] += 1
    assert got == dict(want)
    few = A.close_prints(spark.createDataFrame(rows, "id int, f string, role string, repo string"), "f", bucket_bound=1)
    assert few.where("f < g").count() == 0


def test_recall_in_pools_smaller_than_k(spark):
    rows = spark.createDataFrame([(1, i, float(i), float(-i)) for i in range(4)], "q int, c int, o double, m double")
    r = R.ranked(rows, [("ork", F.col("o")), ("mrk", F.col("m"))])
    assert r.groupBy("q").agg(R.recall_at(10).alias("r")).first().r == 1.0 and r.groupBy("q").agg(R.recall_at(2).alias("r")).first().r == 0.0


def test_seed_interval_is_a_bootstrap():
    from kindred.operators import inference as I

    v = [0.1, 0.4, 0.2, 0.9, 0.3]
    got = I.seed_interval(v, 500, np.random.default_rng(3))
    means = np.mean(np.array(v)[np.random.default_rng(3).integers(0, 5, size=(500, 5))], axis=1)
    assert (got["low"], got["high"]) == (np.quantile(means, 0.025), np.quantile(means, 0.975))
    assert I.difference_of_means(np.ones(4), np.zeros(4))[0] == 1.0
