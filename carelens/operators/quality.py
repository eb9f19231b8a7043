"""Data-quality operators: SLA classification, completeness, orphans,
reference-range flags and row-count reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelens.functions.tiers import lookup
from carelens.sources.dimensions import (
    LAB_ABNORMAL_HIGH_SD, LAB_ABNORMAL_LOW_SD, LAB_CRITICAL_HIGH_FACTOR,
    LAB_CRITICAL_LOW_FACTOR, SEVERITY, SLA_DEFAULT_DAYS, lab_range_dim,
)

SLA_DAYS = {name: days for name, days, _, _ in SEVERITY}
SEVERITY_ORDER = {name: order for name, _, order, _ in SEVERITY}
SEVERITY_WEIGHT = {name: weight for name, _, _, weight in SEVERITY}


def sla_days(severity: Column | str, default: int | None = SLA_DEFAULT_DAYS) -> Column:
    """SLA target in days; unknown severities get ``default`` (None keeps NULL)."""
    return lookup(severity, SLA_DAYS, default)


def severity_order(severity: Column | str) -> Column:
    """Display order Critical=1 .. Low=4, NULL for unknown severities."""
    return lookup(severity, SEVERITY_ORDER)


def severity_weight(severity: Column | str) -> Column:
    return lookup(severity, SEVERITY_WEIGHT)


def completeness(df: DataFrame, table_name: str, fields: list[str]) -> DataFrame:
    """(table_name, field, total, nulls) for each field, from ONE aggregate over the table.

    ``nulls`` is a SUM over the rows, so it is NULL for an empty table, as the
    SQL form reports it."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [F.sum(F.when(F.col(f).isNull(), 1).otherwise(0)).cast("bigint").alias(f"n_{i}")
             for i, f in enumerate(fields)]
    one_row = df.agg(*aggs)
    stacked = one_row.select(
        F.lit(table_name).alias("table_name"),
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n_{i}").alias("nulls"))
                            for i, f in enumerate(fields)])).alias("s"),
        "total")
    return stacked.select("table_name", F.col("s.field").alias("field"), "total",
                          F.col("s.nulls").alias("nulls"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows without a parent row. NULL keys never match and are kept,
    exactly as LEFT JOIN ... WHERE parent.key IS NULL does. AQE broadcasts the
    parent keys below its size threshold and else splits skewed partitions."""
    return child.join(parent.select(key), key, "left_anti")


def lab_reference_flags(labs: DataFrame) -> DataFrame:
    """Recompute abnormal / critical flags from the reference-range dimension
    (eight rows: a bounded broadcast). Tests without a range get NULL flags."""
    ranges = F.broadcast(lab_range_dim(labs.sparkSession))
    v = F.col("result_value")
    abnormal = ((v < F.col("range_mu") - LAB_ABNORMAL_LOW_SD * F.col("range_sd"))
                | (v > F.col("range_mu") + LAB_ABNORMAL_HIGH_SD * F.col("range_sd")))
    critical = ((v < F.col("range_lo") * LAB_CRITICAL_LOW_FACTOR)
                | (v > F.col("range_hi") * LAB_CRITICAL_HIGH_FACTOR))
    return (labs.join(ranges, "test_name", "left")
                .select("lab_id", "patient_id", "test_name", "result_value", "result_date",
                        abnormal.cast("int").alias("abnormal_flag"),
                        critical.cast("int").alias("critical_flag"),
                        F.col("abnormal_flag").alias("stored_abnormal_flag"),
                        F.col("critical_flag").alias("stored_critical_flag")))


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count) per table; each count is a column-free scan."""
    return union_all([df.agg(F.count(F.lit(1)).alias("row_count"))
                        .select(F.lit(name).alias("table_name"), "row_count")
                      for name, df in tables.items()])
