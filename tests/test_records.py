import pytest

from kindred.operators import records as R
from kindred.operators.keys import RoleError


def test_eligible(spark):
    rows = spark.createDataFrame([(" a ", "1", "x", "0" * 64), ("a", "", "x", ""), (None, "2", "x", None), ("a", "3", "y", None), ("a", "4", "x", "AB"), ("a", "5", "x", None)], "r string, k string, s string, h string")
    out = {(x["r"], x["k"]): x["fault"] for x in R.eligibility(rows, "r", "k", "s", ["x"], ["h"]).collect()}
    assert out == {("a", "1"): None, ("a", ""): "identity", ("", "2"): "identity", ("a", "3"): "identity", ("a", "4"): "hash", ("a", "5"): None}
    with pytest.raises(ValueError):
        R.require_eligible(rows, "r", "k", "s", ["x"], ["h"])
    assert R.require_eligible(rows.where("k in ('1', '5')"), "r", "k", "s", ["x"], ["h"]).columns == ["r", "k", "s", "h"]


def test_exact_keys_and_repeats(spark):
    rows = spark.createDataFrame([(1, "fit"), (2, "hidden"), (3, None), (4, "fit")], "k long, role string")
    want = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    assert sorted(x["k"] for x in R.exactly(rows, want(1, 4, 4), "k", "role", ["fit"]).collect()) == [1, 4]
    with pytest.raises(ValueError):
        R.exactly(rows, want(1, 9), "k", "role", ["fit"])
    for k in (2, 3):
        with pytest.raises(RoleError):
            R.exactly(rows, want(k), "k", "role", ["fit"])
    assert R.require_unique(rows, "k") is rows
    with pytest.raises(ValueError):
        R.require_unique(rows.unionByName(rows), "k")


def test_excluded_groups_and_bundles(spark):
    rows = spark.createDataFrame([("a ", "m"), ("a", "n"), ("b", "m")], "g string, m string")
    assert sorted(tuple(x) for x in R.excluded_groups(rows, "g", "m").collect()) == [("a", 2, 2), ("b", 1, 1)]
    with pytest.raises(ValueError):
        R.excluded_groups(rows.unionByName(spark.createDataFrame([(None, "m")], rows.schema)), "g", "m")
    kinds = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "x"), ("r", "x"), ("r", "y"), ("r", "z"), ("s", None)], "o string, k string")
    assert sorted(tuple(x) for x in R.bundles(kinds, "o", "k", ["x", "y"]).collect()) == [("p", "", 0, True), ("q", "y", 0, False), ("r", "", 1, False), ("s", "x,y", 0, False)]
