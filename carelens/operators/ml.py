"""Readmission-risk modelling with ``pyspark.ml``: feature table, deterministic
split, three classifiers and their scores.

Training is distributed by MLlib (tree aggregation per iteration / per tree
level); the assembled training frame is persisted because every iteration
rescans it. Fitted models are kept per (session, data folder) so the analyses
that share them (AUC, importance, risk tiers) fit each model once.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens.functions.tiers import right_closed_bins
from carelens.operators.scoring import compiled_score
from carelens.sources.dimensions import AGE_GROUPS
from carelens.sources.snapshot import export_root

LABEL = "readmission_30d"
CATEGORICAL = ["department", "insurance_type", "primary_icd10", "discharge_disposition",
               "age_group", "ehr_system"]
NUMERIC = ["age", "chronic_conditions", "length_of_stay", "total_charges", "er_visit_flag",
           "is_weekend_admit", "encounter_month"]
CODES = [f"{c}_code" for c in CATEGORICAL]
FEATURES = NUMERIC + CODES          # 13 features, in the reference's order of numerics then codes
FEATURE_NAMES = ["age", "chronic_conditions", "length_of_stay", "total_charges", "er_visit_flag",
                 "is_weekend_admit", "encounter_month", "department", "insurance_type",
                 "primary_icd10", "discharge_disposition", "age_group", "ehr_system"]
UNKNOWN = "Unknown"
SPLIT_SEED = 42
TRAIN_PERCENT = 80

# model settings (fixed values)
LR_C = 0.5
LR_MAX_ITER = 1000
RF_TREES, RF_DEPTH, RF_MIN_LEAF = 200, 8, 20
GBT_ITER, GBT_DEPTH, GBT_STEP = 150, 4, 0.05
MODEL_SEED = 42
#: Training rows for which a boosting step is worth a task of its own.
BOOSTING_ROWS = 20_000


def inpatient_frame(encounters: DataFrame, patients: DataFrame) -> DataFrame:
    """Inpatient encounters left-joined to their patient; calendar and age features."""
    p = patients.select("patient_id", "age", "chronic_conditions", "insurance_type", "ehr_system")
    e = encounters.where(F.col("encounter_type") == "Inpatient")
    d = F.col("encounter_date")
    dow = F.weekday(d)  # Monday = 0
    return (e.join(p, "patient_id", "left")
             .withColumns({"encounter_month": F.month(d),
                           "is_weekend_admit": dow.isin(5, 6).cast("int"),
                           "age_group": right_closed_bins("age", AGE_GROUPS)}))


def encode(frame: DataFrame) -> DataFrame:
    """Alphabetical 0-based codes per categorical column (NULL -> 'Unknown'),
    fitted on all rows before the split; numeric NULLs -> 0."""
    filled = frame.fillna(UNKNOWN, subset=CATEGORICAL)
    indexer = StringIndexer(inputCols=CATEGORICAL, outputCols=[f"{c}_idx" for c in CATEGORICAL],
                            stringOrderType="alphabetAsc", handleInvalid="keep")
    coded = indexer.fit(filled).transform(filled)
    coded = coded.withColumns({f"{c}_code": F.col(f"{c}_idx").cast("int") for c in CATEGORICAL})
    return coded.fillna(0, subset=NUMERIC)


def feature_table(encounters: DataFrame, patients: DataFrame) -> DataFrame:
    coded = encode(inpatient_frame(encounters, patients))
    return coded.select("encounter_id", LABEL, *FEATURES)


def stratified_split(df: DataFrame, key: str = "encounter_id", label: str = LABEL, seed: int = SPLIT_SEED,
                     percent: int = TRAIN_PERCENT) -> DataFrame:
    """Add ``is_train``: of each class exactly ``percent`` percent of the rows (rounded
    down), the first by md5(seed:key). Independent of partitioning and retries.

    A class is cut at the hash where its quota ends: a histogram over 4096 md5
    prefixes gives the prefix, and only that prefix's rows are ranked."""
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    df = df.withColumn("_place", place).withColumn("_cell", F.substring("_place", 1, 3))
    cells = df.groupBy(label, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = F.sum("_n").over(Window.partitionBy(label))
    room = F.floor(whole * percent / 100) - (F.sum("_n").over(w) - F.col("_n"))
    edges = cells.select(label, "_cell", F.greatest(F.least(room, F.col("_n")), F.lit(0)).alias("_room"), "_n")
    # at most 4096 rows per class
    rows = df.join(F.broadcast(edges.withColumnRenamed(label, "_y")),
                   F.col(label).eqNullSafe(F.col("_y")) & (df["_cell"] == edges["_cell"])).drop(edges["_cell"], "_y")
    cut = (F.col("_room") > 0) & (F.col("_room") < F.col("_n"))
    names = [c for c in df.columns if not c.startswith("_")]
    sure = rows.where(~cut).withColumn("is_train", F.col("_room") == F.col("_n"))
    rank = F.row_number().over(Window.partitionBy(label, "_cell").orderBy("_place"))
    edge = rows.where(cut).withColumn("is_train", rank <= F.col("_room"))
    return sure.select(*names, "is_train").unionByName(edge.select(*names, "is_train"))


def assemble(features: DataFrame) -> DataFrame:
    va = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    return va.transform(features.withColumns({c: F.col(c).cast("double") for c in FEATURES})) \
             .withColumn("label", F.col(LABEL).cast("double"))


def estimators(n_train: int) -> dict[str, Pipeline]:
    # No median-imputer stage: numeric NULLs are already zero-filled before
    # assembly, so a median imputer would be a no-op pass over the data.
    lr = Pipeline(stages=[
        StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True),
        LogisticRegression(featuresCol="scaled", labelCol="label", maxIter=LR_MAX_ITER,
                           regParam=1.0 / (LR_C * max(n_train, 1)), elasticNetParam=0.0,
                           standardization=False),
    ])
    rf = Pipeline(stages=[RandomForestClassifier(
        featuresCol="features", labelCol="label", numTrees=RF_TREES, maxDepth=RF_DEPTH,
        minInstancesPerNode=RF_MIN_LEAF, featureSubsetStrategy="sqrt", seed=MODEL_SEED)])
    gbt = Pipeline(stages=[GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=GBT_ITER, maxDepth=GBT_DEPTH,
        stepSize=GBT_STEP, seed=MODEL_SEED)])
    return {"logistic_regression": lr, "random_forest": rf, "gradient_boosting": gbt}


def positive_probability(model: PipelineModel, frame: DataFrame) -> DataFrame:
    return model.transform(frame).withColumn("risk_score", vector_to_array("probability")[1])


def boosting_frame(train: DataFrame, n_train: int) -> DataFrame:
    """``train`` in as many partitions as boosting can use: it runs a job per iteration and tree
    level, so few rows in many partitions cost their scheduling and not their work. One partition
    a core, or one per ``BOOSTING_ROWS`` rows where these are more; never more than there are."""
    cores = train.sparkSession.sparkContext.defaultParallelism
    return train.coalesce(max(cores, n_train // BOOSTING_ROWS))


class ReadmissionModels:
    """Feature table, split and the three fitted models for one data folder. A model scores as a
    compiled expression (``operators.scoring``); ``release`` gives the cached frames back."""

    def __init__(self, encounters: DataFrame, patients: DataFrame):
        feats = stratified_split(assemble(feature_table(encounters, patients)))
        self.data = feats.persist(StorageLevel.MEMORY_AND_DISK)
        self.train = self.data.where("is_train")
        self.test = self.data.where("NOT is_train")
        self._models: dict[str, PipelineModel] = {}
        self._scores: dict[str, Column] = {}
        self._scored: dict[str, DataFrame] = {}

    def model(self, name: str) -> PipelineModel:
        if name not in self._models:
            n_train = self.train.count()
            train = boosting_frame(self.train, n_train) if name == "gradient_boosting" else self.train
            self._models[name] = estimators(n_train)[name].fit(train)
        return self._models[name]

    def score(self, name: str) -> Column:
        if name not in self._scores:
            self._scores[name] = compiled_score(self.model(name), FEATURES, export_root(self.data.sparkSession))
        return self._scores[name]

    def scored_test(self, name: str) -> DataFrame:
        """The test rows with their score, cached: evaluations name it several times each."""
        if name not in self._scored:
            scored = self.test.select("encounter_id", LABEL, self.score(name).alias("risk_score"))
            self._scored[name] = scored.persist(StorageLevel.MEMORY_AND_DISK)
        return self._scored[name]

    def release(self) -> None:
        for df in (self.data, *self._scored.values()):
            df.unpersist()
        self._scored.clear()


_CACHE: dict[tuple, ReadmissionModels] = {}


def models_for(spark, sf_dir: str, encounters: DataFrame, patients: DataFrame) -> ReadmissionModels:
    key = (id(spark.sparkContext), spark.sparkContext.applicationId, sf_dir)
    if key not in _CACHE:
        for old in [k for k in _CACHE if k[:2] == key[:2]]:  # one folder's frame at a time
            _CACHE.pop(old).release()
        _CACHE[key] = ReadmissionModels(encounters, patients)
    return _CACHE[key]
