"""Data-governance analyses: issue summaries, SLA breaches and compliance,
source scorecards, referential integrity, completeness, trends, SPC and Pareto."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.functions.dates import month_label, week_start
from carelens.functions.numeric import count_when, pct, ratio
from carelens.operators import quality
from carelens.operators.stats import control_limits
from carelens.operators.windows import running_share
from carelens.sources.adapters import CareTables
from carelens.sources.io import csv_rejects
from carelens.sources.schemas import TABLE_SCHEMAS
from carelens.sources.dimensions import (
    PARETO_CUTOFF_PCT, SLA_BREACH_ALERT_PCT, SOURCE_GRADE_ELSE, SOURCE_GRADES, severity_dim,
)


def gov1_issue_summary(t: CareTables) -> DataFrame:
    """Issue counts, resolution rate and mean days per table, type and severity."""
    g = t.data_governance_log
    return (g.groupBy("table_name", "issue_type", "severity")
             .agg(F.count(F.lit(1)).alias("issue_count"),
                  F.sum("resolved_flag").alias("resolved_count"),
                  (F.count(F.lit(1)) - F.sum("resolved_flag")).alias("open_count"),
                  pct(F.sum("resolved_flag"), F.count(F.lit(1)), 1).alias("resolution_rate_pct"),
                  F.round(F.avg("days_to_resolve"), 1).alias("avg_days_to_resolve"))
             .orderBy(quality.severity_order("severity"), F.col("issue_count").desc()))


def gov2_sla_breach(t: CareTables) -> DataFrame:
    """Open issues and issues resolved later than their SLA target."""
    g = t.data_governance_log.withColumn("sla_days", quality.sla_days("severity"))
    breached = F.col("days_to_resolve") > F.col("sla_days")
    return (g.where((F.col("resolved_flag") == 0) | ((F.col("resolved_flag") == 1) & breached))
             .select("issue_id", "table_name", "issue_type", "field_name", "severity",
                     "source_system", "detected_date", "days_to_resolve", "sla_days",
                     F.when(breached, "SLA BREACHED").otherwise("WITHIN SLA").alias("sla_status"))
             # issue_id breaks ties: with only ~124 distinct (severity, days) keys the
             # range partitioner could not otherwise split a hot key across tasks
             .orderBy(F.coalesce(quality.severity_order("severity"), F.lit(4)),
                      F.col("days_to_resolve").desc(), F.col("issue_id")))


def gov3_source_scorecard(t: CareTables) -> DataFrame:
    """Per source system: severity mix, weighted severity score and a quality grade."""
    g = t.data_governance_log
    sev = F.col("severity")
    scored = (g.groupBy("source_system")
               .agg(F.count(F.lit(1)).alias("total_issues"),
                    count_when(sev == "Critical").alias("critical"),
                    count_when(sev == "High").alias("high"),
                    count_when(sev == "Medium").alias("medium"),
                    count_when(sev == "Low").alias("low_sev"),
                    F.sum("resolved_flag").alias("resolved"),
                    F.round(F.avg("days_to_resolve"), 1).alias("avg_resolution_days"),
                    F.round(F.avg(F.coalesce(quality.severity_weight(sev), F.lit(0)).cast("double")), 2)
                    .alias("weighted_severity_score")))
    scored = scored.withColumn("resolution_rate_pct", pct("resolved", "total_issues", 1))
    grade = None
    for max_score, min_rate, label in SOURCE_GRADES:
        cond = (F.col("weighted_severity_score") < max_score) & (F.col("resolution_rate_pct") >= min_rate)
        grade = F.when(cond, label) if grade is None else grade.when(cond, label)
    return (scored.withColumn("quality_grade", grade.otherwise(SOURCE_GRADE_ELSE))
                  .orderBy("weighted_severity_score"))


def gov4_orphans(t: CareTables, cap: int = 500) -> DataFrame:
    """Encounters whose patient does not exist (first ``cap`` by encounter id)."""
    return (quality.orphans(t.encounters, t.patients, "patient_id")
            .select("encounter_id", "patient_id", "encounter_date", "encounter_type", "department",
                    F.lit("ORPHANED_ENCOUNTER").alias("issue_type"))
            .orderBy("encounter_id")
            .limit(cap))


COMPLETENESS_FIELDS = {
    "patients": ["age", "sex", "zip_code", "insurance_type"],
    "encounters": ["encounter_date", "primary_icd10", "total_charges"],
    "lab_results": ["result_value"],
}


def gov5_completeness(t: CareTables) -> DataFrame:
    """Total and NULL count per monitored field: one scan per table, not per field."""
    return (quality.union_all([quality.completeness(t.table(name), name, fields)
                               for name, fields in COMPLETENESS_FIELDS.items()])
            .orderBy("table_name", "field"))


def gov6_monthly_trend(t: CareTables) -> DataFrame:
    """Issues opened and resolved per detection month."""
    g = t.data_governance_log
    return (g.groupBy(month_label("detected_date").alias("month"))
             .agg(F.count(F.lit(1)).alias("issues_opened"),
                  F.sum("resolved_flag").alias("issues_resolved"),
                  (F.count(F.lit(1)) - F.sum("resolved_flag")).alias("net_open_delta"),
                  F.round(F.avg("days_to_resolve"), 1).alias("avg_days_to_resolve"),
                  count_when(F.col("severity").isin("Critical", "High")).alias("high_critical_count"))
             .orderBy("month"))


def sla_compliance(t: CareTables) -> DataFrame:
    """SLA breach and resolution rates per severity, in the fixed severity order.

    Issues of unknown severity have no target and never count as breached;
    NULL severities are left out; a severity without issues reports NULLs."""
    g = t.data_governance_log.where(F.col("severity").isNotNull())
    target = quality.sla_days("severity", default=None)
    breached = F.coalesce(F.col("days_to_resolve") > target, F.lit(False)).cast("int")
    per_sev = (g.groupBy("severity")
                .agg(F.count("issue_id").alias("total"),
                     F.sum(breached).alias("breached"),
                     F.sum("resolved_flag").alias("resolved"),
                     F.round(F.avg("days_to_resolve"), 2).alias("avg_days")))
    dim = severity_dim(t.spark).select("severity", "sla_days", "severity_order")
    out = dim.join(per_sev, "severity", "left")
    breach_rate = F.round(ratio("breached", "total") * 100, 2)
    return (out.select("severity", "severity_order", "sla_days", "total", "breached", "resolved", "avg_days",
                       breach_rate.alias("breach_rate"),
                       F.round(ratio("resolved", "total") * 100, 2).alias("resolution_rate"),
                       (breach_rate > SLA_BREACH_ALERT_PCT).alias("breach_alert"))
               .orderBy("severity_order"))


def spc_weekly_issues(t: CareTables) -> DataFrame:
    """Weekly issue counts with mean +/- 3 sd control limits (LCL floored at 0)."""
    weekly = (t.data_governance_log.where(F.col("detected_date").isNotNull())
              .groupBy(week_start("detected_date").alias("week"))
              .agg(F.count(F.lit(1)).alias("issues")))
    return control_limits(weekly, "issues").orderBy("week")


def pareto_issue_types(t: CareTables) -> DataFrame:
    """Issue types by count with cumulative share and the 80 % cut-off flag."""
    counts = (t.data_governance_log.where(F.col("issue_type").isNotNull())
              .groupBy("issue_type").agg(F.count(F.lit(1)).alias("issue_count")))
    shares = running_share(counts, "issue_count", [F.col("issue_count").desc(), F.col("issue_type")])
    return (shares.select("issue_type", "issue_count", "cum_count",
                          F.round("cum_pct", 4).alias("cum_pct"),
                          (F.col("cum_pct") <= PARETO_CUTOFF_PCT).alias("within_cutoff"))
                  .orderBy(F.col("issue_count").desc(), "issue_type"))


def quality_measure_derivation(t: CareTables) -> DataFrame:
    """Consistency of derived columns: gap = round(rate - benchmark, 4),
    numerator = round(rate * denominator), days_to_resolve = resolved - detected."""
    qm, g = t.quality_measures, t.data_governance_log

    def check(df, table, name, mismatch):
        return df.agg(F.count(F.lit(1)).alias("rows"),
                      F.count(F.when(mismatch, F.lit(1))).alias("mismatches")) \
                 .select(F.lit(table).alias("table_name"), F.lit(name).alias("check_name"),
                         "rows", "mismatches")

    gap = F.round(F.col("performance_rate") - F.col("national_benchmark"), 4)
    num = F.round(F.col("performance_rate") * F.col("denominator"), 0)
    days = F.datediff("resolved_date", "detected_date")
    return quality.union_all([
        check(qm, "quality_measures", "gap_to_benchmark", gap != F.col("gap_to_benchmark")),
        check(qm, "quality_measures", "numerator", num != F.col("numerator")),
        check(g, "data_governance_log", "days_to_resolve", days != F.col("days_to_resolve")),
    ])


def lab_reference_flags(t: CareTables) -> DataFrame:
    """Abnormal / critical flags recomputed from the reference ranges, next to the stored ones."""
    return quality.lab_reference_flags(t.lab_results)


def load_report(t: CareTables) -> DataFrame:
    """Row count per care table."""
    from carelens.sources.schemas import TABLE_NAMES
    return quality.row_counts({name: t.table(name) for name in TABLE_NAMES})


def encounter_csv_lines(t: CareTables) -> DataFrame:
    """The encounters as CSV lines with damage by the number of the encounter: a date, a length of stay
    or a charge that is none, lines that end early and lines with a column too many."""
    fields = TABLE_SCHEMAS["encounters"].fields
    k = F.regexp_extract("encounter_id", "([0-9]+)$", 1).cast("bigint")
    text = {f.name: F.col(f.name).cast("string") for f in fields}
    for (column, bad), (step, rest) in {("encounter_date", "not-a-date"): (97, 5), ("length_of_stay", "x"): (89, 7),
                                        ("total_charges", "12,5O"): (71, 2)}.items():
        text[column] = F.when(k % step == rest, bad).otherwise(text[column])
    cells = [text[f.name].alias(f.name) for f in fields]
    whole = F.to_csv(F.struct(*cells))
    line = (F.when(k % 83 == 11, F.to_csv(F.struct(*cells[:6]))).when(k % 79 == 3, F.concat(whole, F.lit(",surplus")))
            .otherwise(whole))
    return t.encounters.select(line.alias("line"))


def csv_reject_report(t: CareTables) -> DataFrame:
    """What the CSV intake of the damaged encounter lines rejects, per column and for whole lines."""
    return csv_rejects(encounter_csv_lines(t), "line", "encounters").orderBy("column_order")
