"""Readmission-risk modelling and classifier evaluation.

``readmission_*`` analyses train models (results vary with the learner and are
checked by invariants); ``score_*`` analyses run the same evaluation operators
on a deterministic score so they can be checked exactly against SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens.operators import crossval as cv
from carelens.operators import evaluation as ev
from carelens.operators import ml
from carelens.operators.importance import permutation_importance
from carelens.sources.adapters import CareTables
from carelens.sources.dimensions import CLASSIFICATION_THRESHOLD, RISK_TIERS

CLASS_NAMES = ("No Readmit", "Readmit")
TOP_FEATURES = 12


def _models(t: CareTables) -> ml.ReadmissionModels:
    return ml.models_for(t.spark, t.sf_dir, t.encounters_of("Inpatient"), t.patients)


def readmission_features(t: CareTables) -> DataFrame:
    """The 13-feature inpatient table: numerics (NULL -> 0) and alphabetical codes."""
    return ml.feature_table(t.encounters_of("Inpatient"), t.patients)


def readmission_split(t: CareTables) -> DataFrame:
    """Train / test row counts per class for the stratified 80 / 20 split."""
    data = ml.stratified_split(t.encounters_of("Inpatient").select("encounter_id", ml.LABEL))
    return (data.groupBy(F.when(F.col("is_train"), "train").otherwise("test").alias("split"), ml.LABEL)
                .agg(F.count(F.lit(1)).alias("n"))
                .orderBy("split", ml.LABEL))


def readmission_base_rate(t: CareTables) -> DataFrame:
    """One row: inpatient encounters, readmissions and the overall rate the models start from."""
    return t.encounters_of("Inpatient").agg(
        F.count(F.lit(1)).alias("encounters"), F.sum(ml.LABEL).cast("bigint").alias("readmissions"),
        F.round(F.avg(ml.LABEL) * 100, 1).alias("base_rate_pct"))


def readmission_model_auc(t: CareTables) -> DataFrame:
    """Test-set ROC AUC of logistic regression, random forest and gradient boosting."""
    m = _models(t)
    frames = []
    for name in MODEL_NAMES:
        frames.append(ev.auc(m.scored_test(name), "risk_score", ml.LABEL)
                        .select(F.lit(name).alias("model"), "auc", "n_pos", "n_neg"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


MODEL_NAMES = ("logistic_regression", "random_forest", "gradient_boosting")


def readmission_roc(t: CareTables) -> DataFrame:
    """Test-set ROC points of the three models (one point per distinct score)."""
    m = _models(t)
    out = None
    for name in MODEL_NAMES:
        pts = ev.roc_points(m.scored_test(name), "risk_score", ml.LABEL).select(F.lit(name).alias("model"), "*")
        out = pts if out is None else out.unionByName(pts)
    return out


def readmission_confusion(t: CareTables) -> DataFrame:
    """Gradient-boosting confusion matrix on the test set at probability 0.5."""
    return ev.confusion(_models(t).scored_test("gradient_boosting"), "risk_score", ml.LABEL,
                        CLASSIFICATION_THRESHOLD)


def readmission_report(t: CareTables) -> DataFrame:
    """Gradient-boosting classification report on the test set at probability 0.5."""
    return ev.classification_report(_models(t).scored_test("gradient_boosting"), "risk_score", ml.LABEL,
                                    CLASSIFICATION_THRESHOLD, CLASS_NAMES)


def readmission_importance(t: CareTables) -> DataFrame:
    """Random-forest feature importances, top 12, flagged above their mean.
    The 13 importances are model metadata, the only values built on the driver."""
    rf = _models(t).model("random_forest").stages[-1]
    pairs = list(zip(ml.FEATURE_NAMES, [float(v) for v in rf.featureImportances.toArray()]))
    schema = T.StructType([T.StructField("feature", T.StringType()),
                           T.StructField("importance", T.DoubleType())])
    top = sorted(pairs, key=lambda p: p[1], reverse=True)[:TOP_FEATURES]
    mean = sum(v for _, v in top) / max(len(top), 1)
    df = t.spark.createDataFrame(top, schema)
    return (df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("importance").desc(), "feature")))
              .withColumn("above_mean", F.col("importance") > F.lit(mean))
              .withColumn("importance", F.round("importance", 6))
              .orderBy("rank"))


def readmission_risk_tiers(t: CareTables) -> DataFrame:
    """Gradient-boosting risk tiers on the test set with actual readmission rates."""
    scored = _models(t).scored_test("gradient_boosting")
    return ev.risk_tiers(scored, "risk_score", ml.LABEL, RISK_TIERS)


def readmission_cv_folds(t: CareTables) -> DataFrame:
    """Rows per cross-validation fold and class of the inpatient encounters."""
    return (t.encounters_of("Inpatient").groupBy(cv.fold_of(F.col("encounter_id")).alias("fold"), ml.LABEL)
            .agg(F.count(F.lit(1)).alias("n")).orderBy("fold", ml.LABEL))


def readmission_cv_auc(t: CareTables, models: tuple = ("logistic_regression",)) -> DataFrame:
    """AUC per fold of the named models, each fold scored by the fit on the others."""
    frame = ml.assemble(ml.feature_table(t.encounters_of("Inpatient"), t.patients))
    return cv.cross_validate(frame, lambda n: {m: e for m, e in ml.estimators(n).items() if m in models},
                             "encounter_id", ml.LABEL)


def readmission_permutation_importance(t: CareTables, model: str = "gradient_boosting") -> DataFrame:
    """AUC lost on the test set when a feature is permuted, per feature of one model."""
    m = _models(t)
    return permutation_importance(m.test, ml.FEATURES, ml.LABEL, m.score(model))


def deterministic_scores(t: CareTables) -> DataFrame:
    """Inpatient encounters with a reproducible score in [0, 1]:
    (numeric part of encounter_id * 13 mod 101) / 100."""
    num = F.substring("encounter_id", 4, 64).cast("bigint")
    return (t.encounters_of("Inpatient")
            .select("encounter_id", ml.LABEL, (F.pmod(num * 13, F.lit(101)).cast("double") / 100).alias("score")))


def score_auc(t: CareTables) -> DataFrame:
    return ev.auc(deterministic_scores(t), "score", ml.LABEL)


def score_roc(t: CareTables) -> DataFrame:
    return ev.roc_points(deterministic_scores(t), "score", ml.LABEL)


def score_confusion(t: CareTables) -> DataFrame:
    return ev.confusion(deterministic_scores(t), "score", ml.LABEL, CLASSIFICATION_THRESHOLD)


def score_report(t: CareTables) -> DataFrame:
    return ev.classification_report(deterministic_scores(t), "score", ml.LABEL,
                                    CLASSIFICATION_THRESHOLD, CLASS_NAMES)


def score_risk_tiers(t: CareTables) -> DataFrame:
    return ev.risk_tiers(deterministic_scores(t), "score", ml.LABEL, RISK_TIERS)
