"""k-fold cross-validation on one cached frame.

Folds are a hash of the row key, so they don't depend on partitioning or retries
and every row is scored exactly once per model, by the fit that has not seen it.
All (fold, model) pairs are fitted from the same cached rows, several at a time;
the AUCs of all pairs come from one grouped cumulation over their scores.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens.operators.ranges import cumulative_counts

FOLDS = 5
FOLD_SEED = 42


def fold_of(key: Column, folds: int = FOLDS, seed: int = FOLD_SEED) -> Column:
    """Fold 0 .. folds - 1 of a row: the first 8 hex digits of md5(seed:key) modulo ``folds``;
    a NULL key counts as the empty string."""
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return F.pmod(F.conv(F.substring(place, 1, 8), 16, 10).cast("bigint"), F.lit(folds)).cast("int")


def grouped_auc(df: DataFrame, groups: list[str], score: str, label: str, scale: int = 6) -> DataFrame:
    """(groups, n_pos, n_neg, auc): the AUC of each group, ties counted one half, from one
    cumulation of negatives over (groups, score). A group of one class has a NULL auc."""
    y = F.col(label)
    counts = (df.where(F.col(score).isNotNull() & y.isNotNull())
              .groupBy(F.struct(*groups, F.col(score).alias("_s")).alias("_key"))
              .agg(F.sum(F.when(y == 1, 1).otherwise(0)).cast("bigint").alias("pos"),
                   F.sum(F.when(y == 1, 0).otherwise(1)).cast("bigint").alias("neg")))
    cum = cumulative_counts(counts, "_key", ["neg"], inclusive=False)
    # negatives of the groups before a group are a constant of it: its smallest cumulated count
    own = cum.groupBy(*[F.col(f"_key.{g}").alias(g) for g in groups]).agg(
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.min("cum_neg").alias("_base"),
        F.sum(F.col("pos") * (F.col("cum_neg") + 0.5 * F.col("neg"))).alias("_u"))
    u = F.col("_u") - F.col("n_pos") * F.col("_base")
    return own.select(*groups, "n_pos", "n_neg", F.round(F.try_divide(u, F.col("n_pos") * F.col("n_neg")), scale).alias("auc"))


def cross_validate(frame: DataFrame, estimators, key: str, label: str, folds: int = FOLDS, seed: int = FOLD_SEED,
                   parallelism: int = 3, features: tuple = ("features", "label")) -> DataFrame:
    """(model, fold, n_train, n_pos, n_neg, auc), one row per model and fold that has rows.

    ``estimators`` is a function of the number of training rows that returns estimators by
    name. The frame is cached for the fits and released before this returns; only the
    result, folds x models rows, comes to the driver."""
    spark = frame.sparkSession
    data = (frame.withColumn("fold", fold_of(F.col(key), folds, seed)).select("fold", label, *features)
            .persist(StorageLevel.MEMORY_AND_DISK))
    try:
        sizes = {r["fold"]: (r["n"], r["pos"]) for r in data.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("pos")).collect()}
        total, positive = sum(n for n, _ in sizes.values()), sum(p or 0 for _, p in sizes.values())
        jobs = []
        for fold, (n, pos) in sorted(sizes.items()):
            if 0 < positive - (pos or 0) < total - n:  # both classes are left to learn from
                jobs += [(fold, name, model, total - n) for name, model in estimators(total - n).items()]

        @inheritable_thread_target(spark)
        def scored(job):
            fold, name, model, n_train = job
            fit = model.fit(data.where(F.col("fold") != fold))
            return fit.transform(data.where(F.col("fold") == fold)).select(
                F.lit(name).alias("model"), "fold", F.lit(n_train).cast("bigint").alias("n_train"),
                vector_to_array("probability")[1].alias("score"), F.col(label).alias("label"))
        with ThreadPoolExecutor(parallelism) as pool:
            frames = list(pool.map(scored, jobs))
        kind = "model string, fold int, n_train bigint, n_pos bigint, n_neg bigint, auc double"
        if not frames:
            return spark.createDataFrame([], kind)
        rows = grouped_auc(reduce(DataFrame.unionByName, frames), ["model", "fold", "n_train"], "score", "label").collect()
        return spark.createDataFrame(rows, kind).orderBy("model", "fold")
    finally:
        data.unpersist()
