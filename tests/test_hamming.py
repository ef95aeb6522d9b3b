"""The exact join of 64-bit fingerprints within a few bits."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from kindred.operators import duplicates as D


def planted(r, n, most):
    """Random prints, and for some of them copies with up to ``most + 1`` bits turned, anywhere or side by side."""
    out = {r.getrandbits(64) for _ in range(n)} | {0, (1 << 64) - 1, 1 << 63}
    for x in r.sample(sorted(out), n // 4):
        k = r.randrange(1, most + 2)
        bits = r.sample(range(64), k) if r.random() < 0.5 else range(s := r.randrange(64 - k), s + k)
        out.add(x ^ sum(1 << b for b in bits))
    return sorted(out)


@pytest.mark.parametrize("most", [0, 1, 3, 5])
def test_equals_comparing_all(spark, most):
    prints = planted(random.Random(most), 400, max(most, 1))
    df = spark.createDataFrame([(f"{x:016x}",) for x in prints * 2] + [(None,)], "h string")
    got = [(r["f"], r["g"], r["distance"]) for r in D.near_prints(df, "h", most).collect()]
    want = [(f"{a:016x}", f"{b:016x}", (a ^ b).bit_count()) for a, b in combinations(prints, 2) if (a ^ b).bit_count() <= most]
    assert sorted(got) == want
    assert len(got) == len(set(got))


def test_blocks_cover_all_bits():
    for most in range(14):
        cuts = D._cuts(most)
        assert len(cuts) == most + 3 and sum(((1 << b) - 1) << s for s, b in cuts) == (1 << 64) - 1


def test_candidates_stay_few(spark):
    """Unrelated prints hardly ever meet: four 16-bit bands would make some 4 * n / 65,536 candidates for each."""
    n = 60_000
    prints = spark.range(n).select(F.xxhash64("id").alias("f"))
    assert D.hamming_candidates(prints).count() < n / 500


def test_a_cluster_of_near_prints(spark):
    """Many prints that differ in the lowest bits only: all pairs within the bound are results, and each comes once."""
    prints = [b for b in range(64)]
    df = spark.createDataFrame([(f"{x:016x}",) for x in prints], "h string")
    assert D.near_prints(df, "h").count() == sum((a ^ b).bit_count() <= 3 for a, b in combinations(prints, 2))


def test_pairs_of_rows(spark):
    rows = [(1, "a", "00" * 8), (2, "b", "00" * 8), (3, "a", "00" * 7 + "07"), (4, "b", "00" * 7 + "0f"), (5, None, "00" * 8), (6, "c", None), (6, "c", None)]
    got = D.pairs_within(spark.createDataFrame(rows, "k long, s string, h string").withColumn("table", F.lit(1)), "k", "h", ["s"])
    assert sorted(map(tuple, got.collect())) == [(1, 2, 0), (2, 3, 3), (3, 4, 1)]
    assert D.near_prints(spark.createDataFrame([], "h string"), "h").count() == 0


def test_exploded_prints_are_not_broadcast(spark, tmp_path):
    """Twenty rows for each print, from an estimate of one: a stored table of prints must not lead to a broadcast."""
    spark.range(2000).select(F.xxhash64("id").alias("f")).write.parquet(f"{tmp_path}/prints")
    plan = D.hamming_candidates(spark.read.parquet(f"{tmp_path}/prints"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_copies_are_counted_not_paired(spark, tmp_path):
    """Three thousand copies in two sources: millions of pairs, of which no join makes a row."""
    from __spark_entry__ import queries

    text = "one two three four five six seven"
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(text).alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"), F.lit("en").alias("lang"), F.lit(len(text)).cast("long").alias("n_chars"))
    d.unionByName(d.limit(1).withColumns({"doc_id": F.lit(9999).cast("long"), "source": F.lit(None).cast("string")})).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["near_pair_classes"](spark, str(tmp_path))
    assert "doc_id" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in got.collect()] == [("exact", 0, 1000 * 2000)]
