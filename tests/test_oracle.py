"""Every registered analysis equals its SQL oracle (row count, columns, values) at sf0.001."""

import pytest

import __spark_entry__ as entry
from carelens.plans import registry
from tests.conftest import SF_SMALL
from tests.harness import compare

ORACLE = entry.oracle_sql()
MODEL_KEYS = {"readmission_model_auc", "readmission_importance", "readmission_risk_tiers",
              "readmission_roc", "readmission_confusion", "readmission_report"}


@pytest.mark.parametrize("name", sorted(set(ORACLE) & set(registry.queries())))
def test_query_matches_oracle(spark, duck_small, name):
    df = entry.queries()[name](spark, SF_SMALL)
    ok, msg = compare(df, duck_small, ORACLE[name], check_types=True, exact=True)
    assert ok, f"{name}: {msg}"


def test_every_query_has_oracle_or_is_model_based():
    missing = set(registry.queries()) - set(ORACLE)
    assert missing <= MODEL_KEYS


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["department", "quarter", "total_encounters", "readmissions",
                          "readmission_rate_pct", "benchmark_status"]
    assert df.count() > 0
