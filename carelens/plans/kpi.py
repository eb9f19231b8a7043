"""KPI dashboard analyses: readmission, length of stay, measure scorecards,
ED utilisation and monthly volume."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelens.functions.dates import month_label, quarter_label, window_start
from carelens.functions.numeric import count_when, pct, round_clean
from carelens.functions.tiers import at_least, at_most
from carelens.operators.windows import latest_rows, top_distinct
from carelens.sources.adapters import CareTables
from carelens.sources.dimensions import (
    MEASURE_TIER_ELSE, MEASURE_TIERS, READMISSION_STATUS, READMISSION_STATUS_ELSE,
)

INPATIENT = "Inpatient"
ED = "ED"


def kpi1_readmission_rate(t: CareTables, as_of: _dt.date | None = None) -> DataFrame:
    """30-day readmission rate by department and quarter over a trailing 24 months."""
    e = t.encounters_of(INPATIENT)
    rate = pct(F.sum("readmission_30d"), F.count(F.lit(1)), 2)
    return (e.where(F.col("encounter_date") >= window_start(as_of or t.as_of))
             .groupBy("department", quarter_label("encounter_date").alias("quarter"))
             .agg(F.count(F.lit(1)).alias("total_encounters"),
                  F.sum("readmission_30d").alias("readmissions"),
                  rate.alias("readmission_rate_pct"))
             .withColumn("benchmark_status",
                         at_most("readmission_rate_pct", READMISSION_STATUS, READMISSION_STATUS_ELSE))
             .orderBy(F.col("quarter").desc(), F.col("readmission_rate_pct").desc()))


def kpi2_alos_variance(t: CareTables) -> DataFrame:
    """Average length of stay per department against the hospital average.

    One scan: the hospital average is Σsum / Σcount over the per-department
    partial results (a window over at most one row per department), so the
    encounters table is not read twice."""
    e = t.encounters_of(INPATIENT).where(F.col("length_of_stay") > 0)
    per_dept = (e.groupBy("department")
                 .agg(F.sum("length_of_stay").alias("_sum"),
                      F.count(F.lit(1)).alias("inpatient_volume"),
                      F.min("length_of_stay").alias("min_los"),
                      F.max("length_of_stay").alias("max_los"),
                      F.percentile("length_of_stay", 0.5).alias("median_los")))
    everyone = Window.partitionBy()
    hospital = F.round(F.sum("_sum").over(everyone) / F.sum("inpatient_volume").over(everyone), 2)
    avg_los = F.round(F.col("_sum") / F.col("inpatient_volume"), 2)
    return (per_dept
            .select("department",
                    avg_los.alias("avg_los"),
                    avg_los.alias("median_los_approx"),
                    "inpatient_volume", "min_los", "max_los",
                    F.round("median_los", 2).alias("median_los"),
                    hospital.alias("hospital_avg_los"))
            .withColumn("variance_from_hospital_avg",
                        F.round(F.col("avg_los") - F.col("hospital_avg_los"), 2))
            .orderBy(F.col("avg_los").desc()))


def kpi3_measure_scorecard(t: CareTables) -> DataFrame:
    """Latest-quarter scorecard: rank of each department within a measure and a gap tier."""
    latest = latest_rows(t.quality_measures, "quarter")
    rank = F.rank().over(Window.partitionBy("measure").orderBy(F.col("performance_rate").desc()))
    return (latest
            .select("department", "measure", "quarter",
                    round_clean(F.col("performance_rate") * 100, 1).alias("performance_pct"),
                    round_clean(F.col("national_benchmark") * 100, 1).alias("benchmark_pct"),
                    round_clean(F.col("gap_to_benchmark") * 100, 1).alias("gap_pct"),
                    "numerator", "denominator",
                    rank.alias("dept_rank"),
                    at_least("gap_to_benchmark", MEASURE_TIERS, MEASURE_TIER_ELSE).alias("performance_tier"))
            .orderBy("measure", "dept_rank"))


def kpi4_composite_score(t: CareTables, n_quarters: int = 4) -> DataFrame:
    """Composite quality score per department over the latest four quarters."""
    qm = t.quality_measures
    recent = qm.join(top_distinct(qm, "quarter", n_quarters), "quarter", "left_semi")
    return (recent.groupBy("department")
                  .agg(F.countDistinct("measure").alias("measures_tracked"),
                       round_clean(F.avg("performance_rate") * 100, 1).alias("composite_score_pct"),
                       round_clean(F.avg("national_benchmark") * 100, 1).alias("avg_benchmark_pct"),
                       round_clean(F.avg("gap_to_benchmark") * 100, 1).alias("avg_gap_pct"),
                       count_when(F.col("gap_to_benchmark") >= 0).alias("measures_meeting_benchmark"),
                       count_when(F.col("gap_to_benchmark") < 0).alias("measures_below_benchmark"))
                  .orderBy(F.col("composite_score_pct").desc()))


def _ed_visits_by_patient(t: CareTables) -> DataFrame:
    """ED visits pre-aggregated per (patient, department) before the patient join.

    Partial aggregation collapses a patient with very many visits (or the
    orphan key shared by many encounters) to at most one row per department and
    map task, so the join input is skew-free and smaller."""
    return (t.encounters_of(ED)
             .groupBy("patient_id", "department")
             .agg(F.count(F.lit(1)).alias("_visits")))


def _ed_utilization(t: CareTables, keys: list[str]) -> DataFrame:
    p = t.patients.select("patient_id", "insurance_type", "chronic_conditions")
    joined = _ed_visits_by_patient(t).join(p, "patient_id", "inner")
    avoidable = F.when(F.col("chronic_conditions") >= 3, F.col("_visits")).otherwise(F.lit(0))
    return (joined.groupBy(*keys)
                  .agg(F.sum("_visits").alias("ed_visits"),
                       F.sum(avoidable).alias("potentially_avoidable"))
                  .where(F.col("ed_visits") >= 5)
                  .withColumn("avoidable_rate_pct", pct("potentially_avoidable", "ed_visits", 1))
                  .orderBy(F.col("avoidable_rate_pct").desc(), F.col("ed_visits").desc()))


def kpi5_ed_utilization(t: CareTables) -> DataFrame:
    """ED visits by department, payer and chronic-condition count (visits >= 5)."""
    return _ed_utilization(t, ["department", "insurance_type", "chronic_conditions"])


def kpi5_ed_rollup(t: CareTables) -> DataFrame:
    """ED visits by department and payer; here the avoidable share is informative."""
    return _ed_utilization(t, ["department", "insurance_type"])


def kpi6_monthly_volume(t: CareTables, as_of: _dt.date | None = None) -> DataFrame:
    """Monthly volume, charges and readmissions per encounter type, trailing 24 months."""
    e = t.encounters.where(F.col("encounter_date") >= window_start(as_of or t.as_of))
    return (e.groupBy(month_label("encounter_date").alias("month"), "encounter_type")
             .agg(F.count(F.lit(1)).alias("encounter_volume"),
                  F.round(F.avg("total_charges"), 2).alias("avg_charges"),
                  F.round(F.sum("total_charges"), 2).alias("total_charges"),
                  F.sum("readmission_30d").alias("readmissions"))
             .orderBy("month", "encounter_type"))
