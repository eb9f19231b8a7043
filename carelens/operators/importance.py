"""Permutation importance: how much AUC a score loses when a feature is permuted.

Every block of rows (an Arrow batch) comes out once as it is and once per feature with
that feature's values permuted inside the block, without a shuffle; the seed of a
block's permutation is the feature and a digest of the block's labels and values, so a
retried task permutes alike. All versions are scored by one Column expression, once,
and their AUCs come from one grouped cumulation over the cached scores.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens.operators.crossval import grouped_auc


def _versions(features: list[str], label: str, seed: int):
    def run(batches):
        for batch in batches:
            held = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in features}
            block = crc32(batch.column(label).to_numpy(zero_copy_only=False).tobytes())
            for c in features:
                block = crc32(held[c].tobytes(), block)
            for k in range(-1, len(features)):
                columns = [pa.array(np.full(batch.num_rows, k, np.int32)), batch.column(label)]
                for i, c in enumerate(features):
                    order = np.random.default_rng([seed, k, block]).permutation(batch.num_rows) if i == k else slice(None)
                    columns.append(pa.array(held[c][order]))
                yield pa.RecordBatch.from_arrays(columns, names=["version", label, *features])
    return run


def permutation_importance(df: DataFrame, features: list[str], label: str, score: Column, seed: int = 42,
                           scale: int = 6) -> DataFrame:
    """(feature, auc, auc_drop, rank), largest drop first (ties by name). ``score`` is an expression over the
    features; rows with a NULL label or feature are left out. An AUC that is undefined gives NULLs.
    The cached scores are released before this returns; only a row per version comes to the driver."""
    rows = df.select(F.col(label).cast("double").alias(label), *[F.col(c).cast("double").alias(c) for c in features]).dropna()
    schema = f"version int, `{label}` double, " + ", ".join(f"`{c}` double" for c in features)
    versions = rows.mapInArrow(_versions(features, label, seed), schema)
    scored = versions.select("version", label, score.alias("_score")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        aucs = grouped_auc(scored, ["version"], "_score", label, scale=12)
        aucs = df.sparkSession.createDataFrame(aucs.collect(), aucs.schema)
    finally:
        scored.unpersist()
    whole = Window.partitionBy()  # one row per feature
    base = F.max(F.when(F.col("version") == -1, F.col("auc"))).over(whole)
    name = F.element_at(F.array(*[F.lit(c) for c in features]), F.col("version") + 1)
    drops = aucs.withColumn("_base", base).where("version >= 0").select(
        name.alias("feature"), F.round("auc", scale).alias("auc"), F.round(F.col("_base") - F.col("auc"), scale).alias("auc_drop"))
    return drops.withColumn("rank", F.row_number().over(whole.orderBy(F.col("auc_drop").desc_nulls_last(), "feature")))

