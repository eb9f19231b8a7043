"""BI export, measure trend direction and analyst-hour allocation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelens.functions.numeric import round_clean
from carelens.operators.alloc import bounded_allocation
from carelens.operators.windows import lag_trend
from carelens.sources.adapters import CareTables
from carelens.sources.snapshot import export_root, export_snapshot
from carelens.sources.dimensions import (
    ALLOCATION_BUDGET, ALLOCATION_MAX_HOURS, ALLOCATION_MIN_HOURS,
)

# improvement per analyst-hour = BASE + SPAN * (1 - numerator / denominator)
RATE_BASE = 0.005
RATE_SPAN = 0.02


def bi_quality_export(t: CareTables) -> DataFrame:
    """Quality measures flattened for BI tools: above-benchmark flag and percents."""
    qm = t.quality_measures
    return qm.withColumns({
        "above_benchmark": (F.col("gap_to_benchmark") >= 0).cast("int"),
        "performance_pct": round_clean(F.col("performance_rate") * 100, 1),
        "benchmark_pct": round_clean(F.col("national_benchmark") * 100, 1),
        "gap_pct": round_clean(F.col("gap_to_benchmark") * 100, 1),
    })


def qm_trend_direction(t: CareTables) -> DataFrame:
    """Quarter-over-quarter change of each department's measure rate."""
    qm = t.quality_measures.select("department", "measure", "quarter", "performance_rate")
    return (lag_trend(qm, "performance_rate", ["department", "measure"], "quarter")
            .orderBy("department", "measure", "quarter"))


def improvement_rates(t: CareTables) -> DataFrame:
    """Expected improvement per analyst-hour per (quarter, department): departments
    further below full performance gain more per hour."""
    qm = t.quality_measures
    gap = F.lit(1.0) - F.sum("numerator") / F.sum("denominator")
    return (qm.groupBy("quarter", "department")
              .agg(F.round(F.lit(RATE_BASE) + F.lit(RATE_SPAN) * gap, 6).alias("rate")))


def hours_allocation(t: CareTables) -> DataFrame:
    """Weekly analyst hours per department for each quarter: budget 200, 15..40 each,
    maximising expected improvement points, next to the equal split."""
    alloc = bounded_allocation(improvement_rates(t), ["quarter"], "department", "rate",
                               ALLOCATION_BUDGET, ALLOCATION_MIN_HOURS, ALLOCATION_MAX_HOURS)
    hours = F.round("hours", 1)
    points = F.round(F.round(hours * F.col("rate") * 100, 6), 2)
    quarter = Window.partitionBy("quarter")
    return (alloc.select("quarter", "department", F.col("rate").alias("_rate"), "alloc_rank", "feasible",
                         hours.alias("hours"), points.alias("expected_points"))
                 .select("quarter", "department", round_clean(F.col("_rate"), 4).alias("rate"), "alloc_rank", "feasible",
                         "hours", "expected_points",
                         (F.col("expected_points") > F.round(F.avg("expected_points").over(quarter), 8)).alias("above_average"),
                         F.round(F.lit(ALLOCATION_BUDGET) / F.count(F.lit(1)).over(quarter), 6).alias("equal_split_hours"))
                 .orderBy("quarter", F.col("expected_points").desc(), "alloc_rank"))


def export_bi_quality(t: CareTables, path: str, fmt: str = "csv") -> None:
    """Write the BI export, one folder ``period=<quarter>`` per quarter with a header
    per file; ``quarter`` stays a column of the files, so each loads on its own."""
    from carelens.sources.io import write_partitioned
    write_partitioned(bi_quality_export(t).withColumn("period", F.col("quarter")), path, ["period"], fmt=fmt)


def _bi_digest_columns() -> list:
    """Columns of the BI export as whole numbers or text, so that every engine digests the same characters."""
    rates = [F.round(F.col(c) * 10000).cast("bigint") for c in ("performance_rate", "national_benchmark", "gap_to_benchmark")]
    return [F.col("department"), F.col("measure"), F.col("quarter"), *rates, F.col("denominator"), F.col("numerator"), F.col("above_benchmark")]


def export_bi_snapshot(t: CareTables, root: str, fmt: str = "csv") -> DataFrame:
    """Publish the BI export as the next snapshot under ``root``; returns its manifest."""
    return export_snapshot(bi_quality_export(t), root, "quarter", _bi_digest_columns(), fmt)


def bi_export_manifest(t: CareTables) -> DataFrame:
    """Rows and digest per quarter of the BI export as published and read back."""
    return export_bi_snapshot(t, export_root(t.spark)).select(F.col("period").alias("quarter"), "rows", "digest").orderBy("quarter")


def export_cms_submission(t: CareTables, path: str) -> None:
    """Write the 8-row CMS submission summary as a single CSV with a header."""
    from carelens.plans.survey import survey_cms_submission
    from carelens.sources.io import write_small_csv
    write_small_csv(survey_cms_submission(t), path)
