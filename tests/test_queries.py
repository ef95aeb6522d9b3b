import pytest
from conftest import same_rows

from kindred.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n in ORACLES))
def test_against_sql(spark, sf_dir, duck, name):
    same_rows(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


def test_every_query_has_sql_or_is_listed():
    assert set(QUERIES) - set(ORACLES) == {"ridge_oof", "probe_quality", "alpha_grid", "pls_projection", "permuted_label_null", "compound_conformal", "interaction_probe", "perceptron_probe"} | {"cluster_bootstrap_interval", "grouped_cv", "interaction_selection", "predicted_values", "predicted_executor_topk", "predicted_executor_accuracy"}


def test_entry_imports():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
