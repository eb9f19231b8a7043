"""Invariants of the analyses on the small test data (SURVEY §5: tier counts sum to n,
confusion cells sum to n, Pareto ends at 100, hours meet the budget within bounds,
AUC in [0, 1], split covers every row)."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.conftest import SF_SMALL


@pytest.fixture(scope="module")
def q():
    return entry.queries()


def test_hours_meet_budget_within_bounds(spark, q):
    df = q["hours_allocation"](spark, SF_SMALL)
    per_q = df.groupBy("quarter").agg(F.sum("hours").alias("h"), F.min("hours").alias("lo"),
                                      F.max("hours").alias("hi"), F.count(F.lit(1)).alias("n")).collect()
    for r in per_q:
        if 15 * r["n"] <= 200 <= 40 * r["n"]:
            assert abs(r["h"] - 200.0) < 1e-6 and r["lo"] >= 15.0 and r["hi"] <= 40.0


def test_pareto_ends_at_100(spark, q):
    rows = q["pareto_issue_types"](spark, SF_SMALL).collect()
    assert rows[-1]["cum_pct"] == 100.0
    assert [r["cum_count"] for r in rows] == sorted(r["cum_count"] for r in rows)


def test_split_covers_features(spark, q):
    split = q["readmission_split"](spark, SF_SMALL).agg(F.sum("n")).first()[0]
    assert split == q["readmission_features"](spark, SF_SMALL).count()


def test_score_tiers_and_confusion_sum_to_n(spark, q):
    from carelens.plans.modeling import deterministic_scores
    from carelens.sources.adapters import care_tables
    scores = deterministic_scores(care_tables(spark, SF_SMALL))
    n = scores.count()
    n_zero = scores.where("score = 0").count()
    assert q["score_risk_tiers"](spark, SF_SMALL).agg(F.sum("patients")).first()[0] == n - n_zero
    assert q["score_confusion"](spark, SF_SMALL).agg(F.sum("n")).first()[0] == n
    auc = q["score_auc"](spark, SF_SMALL).first()["auc"]
    assert 0.0 <= auc <= 1.0
    roc = q["score_roc"](spark, SF_SMALL).orderBy("threshold").collect()
    assert roc[0]["tpr"] == 1.0 and roc[0]["fpr"] == 1.0     # lowest threshold predicts all positive


def test_model_outputs(spark, q):
    auc = q["readmission_model_auc"](spark, SF_SMALL).collect()
    assert {r["model"] for r in auc} == {"logistic_regression", "random_forest", "gradient_boosting"}
    assert all(r["auc"] is None or 0.0 <= r["auc"] <= 1.0 for r in auc)
    n_test = auc[0]["n_pos"] + auc[0]["n_neg"]
    assert q["readmission_confusion"](spark, SF_SMALL).agg(F.sum("n")).first()[0] == n_test
    rep = {r["label"]: r for r in q["readmission_report"](spark, SF_SMALL).collect()}
    assert rep["accuracy"]["support"] == n_test
    imp = q["readmission_importance"](spark, SF_SMALL).collect()
    assert len(imp) == 12 and all(r["importance"] >= 0 for r in imp)
    tiers = q["readmission_risk_tiers"](spark, SF_SMALL).agg(F.sum("patients")).first()[0]
    assert tiers <= n_test
