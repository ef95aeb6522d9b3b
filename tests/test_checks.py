"""Matrices in chunks, isolation of failing rows, payload firewall, checked store."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kindred.operators import firewall
from kindred.operators.isolate import isolated
from kindred.sources import matrix as M
from kindred.streaming.checked_store import CheckedStore, StoreFull


# matrices


def test_npy_and_npz_are_read_by_pieces(spark, tmp_path):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(5000, 7)).astype(np.float32), rng.integers(-9, 9, (3, 2))
    np.save(tmp_path / "a.npy", a)
    np.savez(tmp_path / "b.npz", one=b, two=np.arange(4.0))
    np.save(tmp_path / "none.npy", np.zeros((0, 3)))
    got = M.read_matrix(spark, str(tmp_path), piece_bytes=10_000)
    assert got.rdd.getNumPartitions() > 10
    rows = got.collect()
    own = sorted((r["row"], r["v"]) for r in rows if r["file"].endswith("a.npy"))
    assert [i for i, _ in own] == list(range(5000)) and np.array_equal(np.array([v for _, v in own], dtype=np.float32), a)
    assert sorted((r["member"], r["row"], r["v"]) for r in rows if r["member"]) == [("one", i, [float(x) for x in b[i]]) for i in range(3)] + [("two", i, [float(i)]) for i in range(4)]
    assert not [r for r in rows if r["file"].endswith("none.npy")]


@pytest.mark.parametrize("what", ["short", "nan", "objects", "fortran", "missing"])
def test_broken_matrices_raise(spark, tmp_path, what):
    x = np.arange(12.0).reshape(4, 3)
    if what == "nan":
        x[2, 1] = np.nan
    if what != "missing":
        np.save(tmp_path / "m.npy", np.asfortranarray(x) if what == "fortran" else np.array([["a"]]) if what == "objects" else x)
    if what == "short":
        os.truncate(tmp_path / "m.npy", os.path.getsize(tmp_path / "m.npy") - 8)
    with pytest.raises(Exception):
        M.read_matrix(spark, str(tmp_path / "m.npy")).collect()
    if what == "nan":
        assert M.read_matrix(spark, str(tmp_path / "m.npy"), finite=False).count() == 4


def test_a_write_that_was_ended_half_way_is_resumed(spark, tmp_path):
    rows = [(i * 3 - 50, [float(i), -1.5]) for i in range(100)] + [((1 << 62) + 1, [0.0, 0.0]), (-(1 << 62) - 1, [0.1, 0.2])]
    df = spark.createDataFrame([*rows, (None, [1.0, 1.0]), (7, None)], "k long, v array<double>").repartition(3)
    path = str(tmp_path / "m")
    first = M.write_matrix(df, "k", "v", path, 16)
    assert (first["chunks"], first["rows"], first["reused"]) == (7, 102, 0)
    assert sorted((r["key"], r["v"]) for r in M.read_chunks(spark, path).collect()) == sorted(rows)
    assert M.write_matrix(df, "k", "v", path, 16) == first | {"reused": 7}
    # ended half-way: chunks, sidecars and the manifest are missing, files are broken, a temporary file is left
    names = sorted(p for p in os.listdir(path) if p.startswith("chunk"))
    os.remove(f"{path}/manifest.json")
    os.remove(f"{path}/chunk-0000000001.json")
    os.remove(f"{path}/chunk-0000000002.values.npy")
    with open(f"{path}/chunk-0000000003.keys.npy", "r+b") as f:
        f.seek(-1, 2)
        f.write(b"\x7f")
    open(f"{path}/chunk-0000000004.values.npy.0.tmp", "w").close()
    kept = os.stat(f"{path}/chunk-0000000005.values.npy").st_mtime_ns
    assert M.write_matrix(df, "k", "v", path, 16) == first | {"reused": 4}
    assert os.stat(f"{path}/chunk-0000000005.values.npy").st_mtime_ns == kept and set(names) <= set(os.listdir(path))
    assert sorted((r["key"], r["v"]) for r in M.read_chunks(spark, path).collect()) == sorted(rows)
    other = M.write_matrix(df.withColumn("v", F.transform("v", lambda x: x + 1)), "k", "v", path, 16)
    assert other["reused"] == 0 and other["digest"] != first["digest"]


# isolation


def test_only_bad_rows_are_lost(spark):
    def picky(b):
        def deep(n):
            return 0 if n == 0 else 1 + deep(n - 1)

        out = []
        for n in b.column("n").to_pylist():
            if n == 13:
                raise KeyError("13")
            if n == 14:
                raise MemoryError
            out.append(deep(10**6 if n == 15 else 2))
        return pa.RecordBatch.from_arrays([pa.array(out)], ["depth"])

    df = spark.range(1000).select("id", (F.col("id") % 100).cast("int").alias("n"), F.lit("old").alias("depth"), F.lit(1).alias("failed"))
    got = isolated(df, picky, "depth long", ["n"])
    assert got.columns == ["id", "n", "depth", "failed"] and got.count() == 1000
    bad = {13: "KeyError", 14: "MemoryError", 15: "RecursionError"}
    assert all((r["depth"], r["failed"]) == ((None, bad[r["n"]]) if r["n"] in bad else (2, None)) for r in got.collect())
    assert isolated(df.where("false"), picky, "depth long", ["n"]).count() == 0


def test_calls_stay_few(spark, tmp_path):
    calls = str(tmp_path / "calls")

    def counted(b):
        with open(calls, "a") as f:
            f.write("x")
        if 77 in b.column("id").to_pylist():
            raise ValueError
        return pa.RecordBatch.from_arrays([b.column("id")], ["y"])

    assert isolated(spark.range(0, 4096, 1, 1), counted, "y long").where("failed is not null").count() == 1
    assert os.path.getsize(calls) <= 1 + 2 * 12 + 2


def test_wrong_numbers_of_rows_fail(spark):
    got = isolated(spark.range(3), lambda b: b.slice(0, 0), "id2 long").collect()
    assert [r["failed"] for r in got] == ["ValueError"] * 3


# payloads


def plain_violations(value, forbidden, longest, path=()):
    out = []
    if isinstance(value, dict):
        for k, v in value.items():
            if any(p in k.lower() for p in forbidden):
                out.append((".".join([*path, k]), "forbidden_key"))
            out += plain_violations(v, forbidden, longest, (*path, k))
    elif isinstance(value, list):
        for i, v in enumerate(value):
            out += plain_violations(v, forbidden, longest, (*path, str(i)))
    elif isinstance(value, str) and len(value) > longest:
        out.append((".".join(path), "long_string"))
    return out


def test_violations_at_any_depth(spark):
    nested = {"a": 1}
    for i in range(40):
        nested = {f"n{i}": [nested, "ok"]} if i % 2 else {f"n{i}": nested}
    values = [{}, [], 1, None, "short", "much too long", {"SECRET_row": {"x": ["y" * 20, None, True, 1.5]}}, {"a": {"b": [{"my_secret": 1}]}}, [["deep", ["deeper " * 3]]], nested | {"secret": nested}]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(90, None), (91, "{"), (92, "")]
    df = spark.createDataFrame(rows, "id long, p string").withColumn("path", F.lit("z")).withColumn("v", F.lit(1))
    got = sorted((r["id"], r["path"], r["reason"]) for r in firewall.violations(df, "id", "p", ("secret", "token"), 10).collect())
    want = [(i, *x) for i, v in enumerate(values) for x in plain_violations(v, ("secret", "token"), 10)] + [(i, "", "not_json") for i in (90, 91, 92)]
    assert got == sorted(want)
    v = {r["id"]: (r["verdict"], r["violations"]) for r in firewall.verdicts(df, "id", "p", ("secret", "token"), 10).collect()}
    assert v[0] == ("allowed", 0) and v[5] == ("long_string", 1) and v[6] == ("forbidden_key", 2) and v[91] == ("not_json", 1) and len(v) == 13
    assert firewall.violations(df.where("false"), "id", "p", ("secret",), 10).count() == 0


def test_digests_are_those_of_the_content(spark):
    import hashlib

    rows = [(1, '{"b": 1, "a": [1, 2]}'), (2, '{"a":[1,2],"b":1}'), (3, "{"), (4, None)]
    sha = hashlib.sha256(b'{"a":[1,2],"b":1}').hexdigest()
    df = spark.createDataFrame([(*r, sha) for r in rows] + [(5, "1", None)], "id long, p string, d string")
    assert [r["id"] for r in firewall.tampered(df, "p", "d").orderBy("id").collect()] == [3, 4, 5]


# the store


def test_store(spark, tmp_path):
    s = CheckedStore(spark, f"file://{tmp_path}/s", "k", "v", buckets=3, bound=6)
    rows = lambda *kv: spark.createDataFrame(list(kv), "k string, v string").withColumn("digest", F.lit("x"))
    assert s.cursor() is None and [r["hit"] for r in s.lookup(rows(("a", ""))).collect()] == [False]
    assert s.insert(rows(("a", "2"), ("a", "1"), ("b", "x"), (None, "n"), ("c", None)), 0, 10) == 2
    assert s.insert(rows(("a", "9"), ("d", "y")), 1, 11) == 1
    assert s.insert(rows(("z", "z")), 1, 99) == 0 and s.cursor() == 11
    with pytest.raises(StoreFull):
        s.insert(rows(*[(f"n{i}", "v") for i in range(4)]), 2)
    assert s.insert(rows(), 3, 12) == 0 and s.cursor() == 12
    asked = rows(("a", ""), ("a", ""), ("d", ""), ("n1", ""), (None, ""))
    assert sorted((r["k"] or "", r["v"], r["hit"]) for r in s.lookup(asked).collect()) == [("", None, False), ("a", "1", True), ("a", "1", True), ("d", "y", True), ("n1", None, False)]


def test_a_batch_without_a_commit_is_not_there(spark, tmp_path):
    s = CheckedStore(spark, f"file://{tmp_path}/s", "k", "v")
    one = spark.createDataFrame([("a", "1")], "k string, v string")
    s._commit, commit = lambda note: (_ for _ in ()).throw(OSError("ended")), s._commit
    with pytest.raises(OSError):
        s.insert(one, 0)
    assert not s.lookup(one).first()["hit"]
    s._commit = commit
    assert s.insert(one, 0) == 1 and s.lookup(one).first()["hit"]


def test_stream_restarts_where_it_was(spark, tmp_path):
    s = CheckedStore(spark, f"file://{tmp_path}/s", "k", "v")
    schema = "k string, v string, at long"
    add = lambda name, *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.json(f"{tmp_path}/in/{name}")
    read = lambda: spark.readStream.schema(schema).json(f"{tmp_path}/in/*")
    add("one", ("a", "1", 5), ("b", "1", 3))
    s.stream(read(), f"{tmp_path}/cp", F.col("at"))
    assert s.cursor() == 5
    add("two", ("a", "2", 9), ("c", "1", 1))
    s.stream(read(), f"{tmp_path}/cp", F.col("at"))
    s.stream(read(), f"{tmp_path}/cp", F.col("at"))
    got = s.lookup(spark.createDataFrame([("a",), ("b",), ("c",)], "k string"))
    assert s.cursor() == 9 and sorted((r["k"], r["v"]) for r in got.collect()) == [("a", "1"), ("b", "1"), ("c", "1")]
