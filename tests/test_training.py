"""Training and scoring against exact versions: Newton steps, compiled scores, cross-validation, permutation importance."""

import random

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from carelens.operators import ml
from carelens.operators.crossval import cross_validate, fold_of, grouped_auc
from carelens.operators.evaluation import auc as auc_of
from carelens.operators.importance import permutation_importance
from carelens.operators.newton import newton_logistic
from carelens.operators.scoring import compiled_score, linear_score
from carelens.sources.adapters import care_tables
from tests.conftest import SF_MED

NAMES = ["a", "b", "c", "same"]


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(3)
    rows = []
    for i in range(900):
        a, b, c = rng.gauss(5, 2), rng.randrange(6), rng.random() * 1000
        y = int(rng.random() < 1 / (1 + np.exp(-(0.8 * (a - 5) - 0.5 * (b - 2)))))
        rows.append((f"r{i}", a, b, c, 7, y, float(y)))
    df = spark.createDataFrame(rows, "id string, a double, b int, c double, same int, y int, label double")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).cache()


def logistic(reg):
    return Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
                            LogisticRegression(featuresCol="scaled", regParam=reg, maxIter=500, tol=1e-12, standardization=False)])


def auc(pairs):
    pos, neg = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg)) if pos and neg else None


def test_newton_equals_logistic_regression(frame):
    for reg in (0.0, 0.01):
        want = logistic(reg).fit(frame).stages[-1]
        got = newton_logistic(frame, NAMES, "y", reg)
        assert got["iterations"] < 20
        assert np.allclose(got["coefficients"], want.coefficients.toArray(), atol=1e-4)
        assert got["intercept"] == pytest.approx(want.intercept, abs=1e-4)
    assert newton_logistic(frame.where("a > 1e9"), NAMES, "y")["coefficients"] == [0.0] * 4


def test_newton_on_the_feature_table(spark):
    t = care_tables(spark, SF_MED)
    data = ml.assemble(ml.feature_table(t.encounters_of("Inpatient"), t.patients)).cache()
    n = data.count()
    want = ml.estimators(n)["logistic_regression"].fit(data).stages[-1]
    got = newton_logistic(data, ml.FEATURES, ml.LABEL, 1.0 / (ml.LR_C * n))
    assert np.allclose(got["coefficients"], want.coefficients.toArray(), atol=1e-4)
    assert got["intercept"] == pytest.approx(want.intercept, abs=1e-4)
    data.unpersist()


@pytest.mark.parametrize("kind", ["forest", "boosting", "logistic"])
def test_compiled_score_equals_transform(spark, frame, tmp_path, kind):
    if kind == "logistic":
        model = logistic(0.01).fit(frame)
    else:
        model = Pipeline(stages=[RandomForestClassifier(numTrees=12, maxDepth=6, seed=1) if kind == "forest" else
                                 GBTClassifier(maxIter=9, maxDepth=4, stepSize=0.3, seed=1)]).fit(frame)
    want = {r["id"]: r["p"] for r in ml.positive_probability(model, frame).select("id", F.col("risk_score").alias("p")).collect()}
    plain = frame.select("id", *NAMES)  # no vector column is needed
    got = {r["id"]: r["p"] for r in plain.select("id", compiled_score(model, NAMES, str(tmp_path)).alias("p")).collect()}
    assert got.keys() == want.keys() and len(set(got.values())) > 20
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_grouped_auc_equals_pairs(spark):
    rng = random.Random(8)
    rows = [(rng.choice("xyz"), rng.randrange(3), rng.randrange(12) / 4, rng.randrange(2)) for _ in range(800)]
    rows += [("one class", 0, 0.5, 1), ("x", 0, None, 1), ("x", 0, 0.5, None)]
    got = grouped_auc(spark.createDataFrame(rows, "m string, f int, s double, y int"), ["m", "f"], "s", "y").collect()
    for r in got:
        want = auc([(s, y) for m, f, s, y in rows if (m, f) == (r["m"], r["f"]) and s is not None and y is not None])
        assert r["auc"] == (None if want is None else pytest.approx(want, abs=1e-6))
    assert len(got) == 10


def test_cross_validation_scores_each_fold_by_the_others(spark, frame):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = cross_validate(frame, lambda n: {"lr": logistic(0.01)}, "id", "y", folds=4).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before  # the cached folds are released
    data = frame.withColumn("fold", fold_of(F.col("id"), 4))
    assert [r["fold"] for r in got] == [0, 1, 2, 3] and sum(r["n_pos"] + r["n_neg"] for r in got) == 900
    for r in got:
        rest, own = data.where(F.col("fold") != r["fold"]), data.where(F.col("fold") == r["fold"])
        scored = ml.positive_probability(logistic(0.01).fit(rest), own).select("risk_score", "y").collect()
        assert r["n_train"] == rest.count()
        assert r["auc"] == pytest.approx(auc([tuple(x) for x in scored]), abs=1e-6) and r["auc"] > 0.7
    assert cross_validate(frame.where("y = 1"), lambda n: {"lr": logistic(0.01)}, "id", "y").collect() == []


def test_permutation_ranks_a_useless_feature_last(frame):
    score = linear_score(["a", "b", "c"], [0.8, -0.5, 0.0], -3.0)
    got = permutation_importance(frame, ["a", "b", "c"], "y", score).collect()
    assert [r["feature"] for r in sorted(got, key=lambda r: r["rank"])] == ["a", "b", "c"]
    drop = {r["feature"]: r["auc_drop"] for r in got}
    assert drop["c"] == 0 and drop["a"] > drop["b"] > 0.01
    again = permutation_importance(frame, ["a", "b", "c"], "y", score).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_boosting_trains_on_few_partitions_and_every_row(spark, monkeypatch):
    rows = spark.range(900).selectExpr("id", "id % 2 AS y").repartition(40)
    cores = spark.sparkContext.defaultParallelism
    few = ml.boosting_frame(rows, 900)
    assert few.rdd.getNumPartitions() == min(cores, 40) and few.distinct().count() == 900
    monkeypatch.setattr(ml, "BOOSTING_ROWS", 900 // 30)
    assert ml.boosting_frame(rows, 900).rdd.getNumPartitions() == max(cores, 30)  # more rows, more tasks
    monkeypatch.setattr(ml, "BOOSTING_ROWS", 1)
    assert ml.boosting_frame(rows, 900).rdd.getNumPartitions() == 40


def test_each_model_is_fitted_once_and_only_boosting_on_few_partitions(spark, frame, monkeypatch):
    fits = []

    class Fit:
        def __init__(self, name):
            self.name = name

        def fit(self, train):
            fits.append((self.name, train.rdd.getNumPartitions(), train.count()))
            return self.name
    monkeypatch.setattr(ml, "estimators", lambda n: {k: Fit(k) for k in ("logistic_regression", "random_forest", "gradient_boosting")})
    models = object.__new__(ml.ReadmissionModels)
    models.data = models.train = frame.repartition(40)
    models._models, models._scores = {}, {}
    for name in ("random_forest", "gradient_boosting", "random_forest", "logistic_regression", "gradient_boosting"):
        assert models.model(name) == name
    cores = spark.sparkContext.defaultParallelism
    assert sorted(fits) == [("gradient_boosting", min(cores, 40), 900), ("logistic_regression", 40, 900), ("random_forest", 40, 900)]


def test_permutation_scores_each_row_once(spark, frame):
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return x
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    score = F.udf(counted, "double")(F.col("a"))
    got = permutation_importance(frame, ["a", "b"], "y", score).collect()
    assert len(got) == 2 and calls.value == 3 * 900
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before  # the cached scores are released


def test_evaluations_read_cached_scores(spark, frame, monkeypatch):
    calls = spark.sparkContext.accumulator(0)

    def counted(x):
        calls.add(1)
        return x
    monkeypatch.setattr(ml, "FEATURES", ["a"])
    monkeypatch.setattr(ml, "LABEL", "y")
    models = object.__new__(ml.ReadmissionModels)
    models.data = models.test = frame.withColumnRenamed("id", "encounter_id")
    models._models, models._scored, models._scores = {}, {}, {"random_forest": F.udf(counted, "double")(F.col("a"))}
    assert auc_of(models.scored_test("random_forest"), "risk_score", "y").first()["n_pos"] > 0
    assert auc_of(models.scored_test("random_forest"), "risk_score", "y").first()["auc"] > 0.5
    assert calls.value == 900
    models.release()
    assert not models._scored
