"""Exact quantiles, published snapshots, CSV rejects and bucketed tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelens.operators.quantiles import exact_quantiles
from carelens.plans import statistics
from carelens.plans.exports import bi_quality_export, export_bi_snapshot
from carelens.plans.survey import OVERALL
from carelens.sources.adapters import bucketed_tables, care_tables
from carelens.sources.io import CORRUPT, csv_rejects, ingest_bucketed, parse_csv_lines
from carelens.sources.snapshot import digests, export_snapshot, latest_manifest, read_snapshot
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("ranges", [1, 3, 16])
def test_quantiles_equal_numpy(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), rng.choice([rng.gauss(0, 1e6), round(rng.random(), 1)])) for _ in range(700)]
    rows += [("one", 2.5), ("two", 1.0), ("two", 4.0), ("none", None), ("a", None), ("a", float("nan")), ("flat", 3.0), ("flat", 3.0)]
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: r for r in exact_quantiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", probs, ranges).collect()}
    groups = {g for g, v in rows} - {"none"}
    assert got.keys() == groups
    for g in groups:
        own = [v for k, v in rows if k == g and v is not None and v == v]
        assert got[g]["n"] == len(own)
        assert got[g]["quantiles"] == pytest.approx(list(np.quantile(own, probs)), rel=1e-12)
    assert exact_quantiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", probs).collect() == []


def test_snapshot_is_published_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path / "export")
    assert latest_manifest(spark, root) is None
    t = care_tables(spark, SF_SMALL)
    manifest = export_bi_snapshot(t, root)
    source = bi_quality_export(t)
    assert {r["period"]: r["rows"] for r in manifest.collect()} == {
        r["quarter"]: r["count"] for r in source.groupBy("quarter").count().collect()}
    back = read_snapshot(spark, root, source.schema, "csv")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, source.collect()))

    # a write that dies half-way leaves the snapshot before
    dying = source.withColumn("measure", F.when(F.col("department") == "Oncology", F.raise_error(F.lit("killed"))).otherwise(F.col("measure")))
    with pytest.raises(Exception, match="killed"):
        export_snapshot(dying, root, "quarter", [F.col("measure")], "csv")
    # so does one whose rows come back changed: CSV can't tell an empty text from a missing one
    lossy = source.withColumn("measure", F.when(F.col("department") == "Oncology", "").otherwise(F.col("measure")))
    with pytest.raises(ValueError, match="differs"):
        export_snapshot(lossy, root, "quarter", [F.coalesce("measure", F.lit("missing"))], "csv")
    assert sorted(map(tuple, latest_manifest(spark, root).collect())) == sorted(map(tuple, manifest.collect()))
    assert read_snapshot(spark, root, source.schema, "csv").count() == source.count()

    export_snapshot(source.where("department = 'Oncology'"), root, "quarter", [F.col("measure")], "csv")
    assert read_snapshot(spark, root, source.schema, "csv").select("department").distinct().count() == 1


def test_digest_sees_changes_repeats_and_nulls(spark):
    def digest(rows):
        df = spark.createDataFrame(rows, "p string, a string, b int")
        return {r["period"]: (r["rows"], r["digest"]) for r in digests(df, "p", [F.col("a"), F.col("b")]).collect()}
    base = [("x", "u", 1), ("x", "v", None), ("y", "", 2)]
    assert digest(base) == digest(base[::-1])
    assert digest(base)["x"] != digest(base + [base[0]])["x"]
    assert digest(base)["x"] != digest([("x", "u", 1), ("x", "v", 0)])["x"]
    assert digest(base)["y"] != digest([("y", None, 2)])["y"]


def test_csv_rejects_by_column(spark):
    good = "ENC1,PT1,2024-03-05,Inpatient,Cardiology,3.5,Home,1,0,I10,DR1,10.5"
    lines = [good, good.replace("2024-03-05", "yesterday"), good.replace("3.5", "x"), good.replace("Cardiology", ""),
             "ENC1,PT1,2024-03-05", good + ",surplus", good.replace("Home", '"a, b"')]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    got = {r["column_name"]: r for r in csv_rejects(df, "line", "encounters").collect()}
    assert got["encounter_date"]["rejected"] == 1 and got["length_of_stay"]["rejected"] == 1
    assert got["department"]["missing"] == 2 and got["total_charges"]["missing"] == 1
    assert got["(line)"]["rejected"] == 4 and got["(line)"]["rows"] == 7
    rows = parse_csv_lines(df, "line", "encounters").select("row.*").collect()
    assert rows[6]["discharge_disposition"] == "a, b" and rows[6][CORRUPT] is None
    assert rows[4][CORRUPT] == lines[4] and rows[4]["patient_id"] == "PT1"


def test_bucketed_tables_join_without_exchange(spark):
    src = care_tables(spark, SF_SMALL)
    names = ["encounters", "patient_surveys", "patients"]
    ingest_bucketed(spark, {n: src.table(n) for n in names}, "bucketed_", buckets=4)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = bucketed_tables(spark, "bucketed_", names, as_of=src.as_of)
        joined = stored.patient_surveys.select("encounter_id", OVERALL).join(
            stored.encounters.select("encounter_id", "length_of_stay"), "encounter_id")
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        sums = statistics._rating_sums(stored)
        sums.collect()
        plan = sums._jdf.queryExecution().executedPlan().toString()
        assert "encounter_id" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
        a = statistics.ttest_rating_readmission(stored).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        for n in names:
            spark.sql(f"DROP TABLE IF EXISTS bucketed_{n}")
    assert a == statistics.ttest_rating_readmission(src).collect()
