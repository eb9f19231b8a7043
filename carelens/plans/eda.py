"""Exploratory reports: demographics, volumes, measure views, lab rates.

These follow the grouped-frame conventions of the exploratory analyses: rows
with a NULL group key are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.functions.dates import month_label
from carelens.functions.numeric import ratio
from carelens.operators.quantiles import exact_quantiles
from carelens.operators.stats import describe, histogram
from carelens.operators.windows import latest_rows
from carelens.sources.adapters import CareTables
from carelens.sources.dimensions import READMISSION_BENCHMARK_RATE, TREND_MEASURES


def eda_describe(t: CareTables) -> DataFrame:
    """count / mean / std / min / quartiles / max of age and chronic conditions."""
    return describe(t.patients, ["age", "chronic_conditions"]).orderBy("variable", "stat_order")


FREQUENCY_COLUMNS = ["insurance_type", "department", "chronic_conditions"]


def eda_frequency(t: CareTables) -> DataFrame:
    """Value counts of payer, department and chronic-condition count in one scan:
    each row fans out to (variable, value) pairs, partial aggregation absorbs it."""
    p = t.patients
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("value"))
                                for c in FREQUENCY_COLUMNS])).alias("kv")
    return (p.select(pairs).select("kv.*").where(F.col("value").isNotNull())
             .groupBy("variable", "value").agg(F.count(F.lit(1)).alias("frequency"))
             .orderBy("variable", F.col("frequency").desc(), "value"))


def eda_age_histogram(t: CareTables) -> DataFrame:
    """20 equal-width age bins over [min, max]."""
    return histogram(t.patients, "age", 20)


def eda_monthly_encounters(t: CareTables) -> DataFrame:
    """Encounter count per month and encounter type (all dates)."""
    e = t.encounters.where(F.col("encounter_date").isNotNull() & F.col("encounter_type").isNotNull())
    return (e.groupBy(month_label("encounter_date").alias("month"), "encounter_type")
             .agg(F.count(F.lit(1)).alias("encounter_count"))
             .orderBy("month", "encounter_type"))


def eda_measure_heatmap(t: CareTables) -> DataFrame:
    """Latest quarter: department x measure performance rates, one column per
    measure in the data (Spark lists them first and refuses more than
    ``spark.sql.pivotMaxValues``)."""
    latest = latest_rows(t.quality_measures, "quarter").where(F.col("department").isNotNull())
    return (latest.where(F.col("measure").isNotNull()).groupBy("department").pivot("measure").agg(F.max("performance_rate"))
                  .orderBy("department"))


def eda_readmission_by_dept(t: CareTables) -> DataFrame:
    """Inpatient readmission rate, count and total per department, flagged
    against the 15 % benchmark."""
    e = t.encounters_of("Inpatient").where(F.col("department").isNotNull())
    return (e.groupBy("department")
             .agg(F.round(F.avg("readmission_30d"), 6).alias("rate"),
                  F.sum("readmission_30d").alias("readmissions"),
                  F.count("readmission_30d").alias("total"))
             .withColumn("above_benchmark", F.col("rate") > READMISSION_BENCHMARK_RATE)
             .orderBy("rate", "department"))


def eda_measure_trend(t: CareTables) -> DataFrame:
    """Hospital-average rate per quarter for the followed measures."""
    qm = t.quality_measures.where(F.col("measure").isin(TREND_MEASURES) & F.col("quarter").isNotNull())
    return (qm.groupBy("quarter", "measure")
              .agg(F.round(F.avg("performance_rate"), 9).alias("performance_rate"))
              .orderBy("measure", "quarter"))


def eda_lab_rates(t: CareTables) -> DataFrame:
    """Per test: results, abnormal and critical counts and rates."""
    labs = t.lab_results.where(F.col("test_name").isNotNull())
    return (labs.groupBy("test_name")
                .agg(F.count("lab_id").alias("total"),
                     F.sum("abnormal_flag").alias("abnormal"),
                     F.sum("critical_flag").alias("critical"))
                .withColumn("abnormal_rate", F.round(ratio("abnormal", "total"), 6))
                .withColumn("critical_rate", F.round(ratio("critical", "total"), 6))
                .orderBy(F.col("abnormal_rate").desc(), "test_name"))


QUARTILES = [0.25, 0.5, 0.75]


def _quartiles(df: DataFrame, group: str, value: str, scale: int) -> DataFrame:
    q = exact_quantiles(df.where(F.col(group).isNotNull()), [group], value, QUARTILES)
    q1, median, q3 = (F.get("quantiles", F.lit(i)) for i in range(3))
    # a quarter of the way between two amounts in cents often ends in a half: rounded as a double, like in the SQL form
    unit = F.lit(10.0 ** scale)
    named = {"q1": q1, "median": median, "q3": q3, "iqr": q3 - q1}
    return q.select(group, "n", *[(F.round(x * unit) / unit).alias(name) for name, x in named.items()]).orderBy(group)


def charges_quartiles(t: CareTables) -> DataFrame:
    """Exact quartiles of the charges per department (a domain without bounds)."""
    return _quartiles(t.encounters.select("department", "total_charges"), "department", "total_charges", 2)


def lab_value_quartiles(t: CareTables) -> DataFrame:
    """Exact quartiles of the result values per lab test."""
    return _quartiles(t.lab_results.select("test_name", "result_value"), "test_name", "result_value", 4)
