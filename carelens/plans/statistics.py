"""Significance tests: length of stay and overall rating by readmission,
rating versus length of stay, and their p-values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.functions.pvalue import t_p_value
from carelens.operators.quality import union_all
from carelens.operators.stats import pearson_from_sums, pooled_ttest, spearman, ttest_from_sums
from carelens.plans.survey import OVERALL, rating_moments_per_encounter
from carelens.sources.adapters import CareTables
from carelens.sources.dimensions import SIGNIFICANCE_ALPHA


def _ttest_los(t: CareTables, scale: int) -> DataFrame:
    # encounters x patients (left, unique patient ids) keeps the encounter rows, so
    # the test runs on inpatient encounters directly
    e = t.encounters_of("Inpatient")
    return pooled_ttest(e, "length_of_stay", "readmission_30d", scale=scale)


def _rating_sums(t: CareTables) -> DataFrame:
    """Sums for the tests of the rating, one row per readmission flag: n, sx, sxx over
    all rated surveys, and those with a length of stay (p*) with its sums and products.
    Surveys are first summed per encounter, so the join with encounters is 1:1."""
    j = rating_moments_per_encounter(t).join(
        t.encounters.select("encounter_id", "readmission_30d", "length_of_stay"), "encounter_id", "inner")
    y, n, sx = F.col("length_of_stay"), F.col("n"), F.col("sx")
    stayed = lambda c: F.sum(F.when(y.isNotNull(), c))
    return j.groupBy("readmission_30d").agg(
        F.sum("n").alias("n"), F.sum("sx").alias("sx"), F.sum("sxx").alias("sxx"),
        stayed(n).alias("pn"), stayed(sx).alias("psx"), stayed(F.col("sxx")).alias("psxx"),
        F.sum(n * y).alias("psy"), F.sum(n * y * y).alias("psyy"), F.sum(sx * y).alias("psxy"))


def _ttest_rating(sums: DataFrame, scale: int) -> DataFrame:
    return ttest_from_sums(sums, "readmission_30d", "n", "sx", "sxx", scale=scale)


def _pearson(sums: DataFrame, scale: int) -> DataFrame:
    return pearson_from_sums(sums, "pn", "psx", "psy", "psxx", "psyy", "psxy", scale=scale)


def ttest_los_readmission(t: CareTables) -> DataFrame:
    """Pooled two-sample t statistic: inpatient length of stay, readmitted vs not."""
    return _ttest_los(t, 4)


def ttest_rating_readmission(t: CareTables) -> DataFrame:
    """Pooled two-sample t statistic: overall rating, readmitted vs not."""
    return _ttest_rating(_rating_sums(t), 4)


def pearson_rating_los(t: CareTables) -> DataFrame:
    """Pearson r between overall rating and length of stay, with its t statistic."""
    return _pearson(_rating_sums(t), 4)


def significance_pvalues(t: CareTables) -> DataFrame:
    """Two-sided p-values of the three tests and the 5 % significance label.
    The p-value (incomplete beta) runs on three aggregated rows only."""
    full = 12
    sums = _rating_sums(t)  # one scan and join, shared by two tests
    tests = union_all([
        _ttest_los(t, full).select(F.lit("ttest_los_readmission").alias("test"), "t_stat", "dof"),
        _ttest_rating(sums, full).select(F.lit("ttest_rating_readmission").alias("test"), "t_stat", "dof"),
        _pearson(sums, full).select(F.lit("pearson_rating_los").alias("test"), "t_stat", "dof"),
    ])
    p = t_p_value(F.col("t_stat"), F.col("dof").cast("double"))
    return (tests.withColumn("p_value", F.round(p, 6))
                 .select("test", F.round("t_stat", 4).alias("t_stat"), "dof", "p_value",
                         F.when(F.col("p_value") < SIGNIFICANCE_ALPHA, "*** Significant")
                          .otherwise("Not significant").alias("significance")))


def spearman_rating_los(t: CareTables) -> DataFrame:
    """Spearman rank correlation between overall rating and length of stay.
    One shuffle of the surveys, for the join; ranks come from weighted histograms
    of the two variables."""
    rated = t.patient_surveys.where(F.col(OVERALL).isNotNull()).select("encounter_id", OVERALL)
    j = rated.join(t.encounters.select("encounter_id", "length_of_stay"), "encounter_id", "inner")
    return spearman(j, OVERALL, "length_of_stay")
