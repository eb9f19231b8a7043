"""The analyses give the same results on ingested care tables, and trailing-window
filters prune the date partitions of the event tables."""

import datetime as dt

from pyspark.sql import functions as F

from carelens.plans import kpi
from carelens.plans.registry import _PLANS
from carelens.sources.adapters import CareTables, care_tables
from carelens.sources.io import ingest
from carelens.sources.schemas import TABLE_NAMES
from tests.conftest import SF_SMALL

CHECKED = ["kpi1_readmission_rate", "kpi6_monthly_volume", "gov2_sla_breach", "srv4_satisfaction_outcomes",
           "kpi3_measure_scorecard", "survey_cms_submission", "eda_lab_rates"]


def test_stored_tables_give_same_results(spark, tmp_path):
    src = care_tables(spark, SF_SMALL)
    out = str(tmp_path / "care")
    ingest(spark, {n: src.table(n) for n in TABLE_NAMES}, out, partition_by={})
    stored = care_tables(spark, out, stored=True, as_of=src.as_of)
    plans = {fn.__name__: fn for fn in _PLANS}
    for name in CHECKED:
        a = sorted(map(tuple, plans[name](src).collect()), key=str)
        b = sorted(map(tuple, plans[name](stored).collect()), key=str)
        assert a == b, name


def test_date_partitions_are_pruned(spark, tmp_path):
    src = care_tables(spark, SF_SMALL)
    # a few months of encounters, partitioned by day as the default ingest does
    recent = src.encounters.where(F.col("encounter_date") >= F.lit(dt.date(2001, 5, 1)))
    out = str(tmp_path / "care")
    ingest(spark, {"patients": src.patients, "encounters": recent}, out)
    stored = care_tables(spark, out, stored=True)
    df = kpi.kpi1_readmission_rate(stored, as_of=dt.date(2001, 8, 1) + dt.timedelta(days=31 * 24 - 90))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(encounter_date" in plan
    mem = CareTables(spark, "/unused")
    mem.put(encounters=recent)
    want = kpi.kpi1_readmission_rate(mem, as_of=dt.date(2001, 8, 1) + dt.timedelta(days=31 * 24 - 90))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect()))


def test_hot_date_is_split(spark, tmp_path):
    """One day with 90 % of the rows goes to several files, the others to one each."""
    rows = spark.range(200_000).select(
        F.concat(F.lit("LAB"), F.col("id")).alias("lab_id"), F.sha2(F.col("id").cast("string"), 512).alias("patient_id"),
        F.date_add(F.lit(dt.date(2001, 1, 1)), F.when(F.col("id") % 10 == 0, (F.col("id") % 7 + 1).cast("int")).otherwise(0))
        .alias("result_date"))
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "2m")
    try:
        ingest(spark, {"lab_results": rows}, str(tmp_path / "care"))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    hot = list((tmp_path / "care" / "lab_results" / "result_date=2001-01-01").glob("*.parquet"))
    assert len(hot) > 3
    assert spark.read.parquet(str(tmp_path / "care" / "lab_results")).count() == 200_000
