"""Mini-table tests for the null, tie, bin and edge rules of the analyses."""

import datetime as dt
import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carelens.functions.dates import window_start
from carelens.functions.pvalue import t_two_sided_p_value
from carelens.functions.tiers import at_least, at_most, right_closed_bins
from carelens.operators import evaluation as ev
from carelens.operators.alloc import bounded_allocation
from carelens.operators.stats import (
    control_limits, pairwise_correlation_matrix, pooled_ttest, quantile_bins,
)
from carelens.operators.ranges import cumulative_counts, global_row_number
from carelens.operators.windows import first_of_lowest_ntile, ntile_global, running_share
from carelens.plans import governance, kpi, survey
from carelens.sources.dimensions import (
    AGE_GROUPS, MEASURE_TIER_ELSE, MEASURE_TIERS, READMISSION_STATUS, READMISSION_STATUS_ELSE, RISK_TIERS,
)
from carelens.sources.schemas import DATA_GOVERNANCE_LOG, ENCOUNTERS, PATIENT_SURVEYS, PATIENTS


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


# ------------------------------------------------------------------ tier edges
def test_readmission_status_edges(spark):
    df = spark.createDataFrame([(15.0,), (15.01,), (18.0,), (18.01,), (None,)], "r double")
    got = rows(df.select(at_most("r", READMISSION_STATUS, READMISSION_STATUS_ELSE).alias("s")), "s")
    assert got == [("MEETS BENCHMARK",), ("NEAR BENCHMARK",), ("NEAR BENCHMARK",),
                   ("BELOW BENCHMARK",), ("BELOW BENCHMARK",)]


def test_measure_tier_edges(spark):
    df = spark.createDataFrame([(0.05,), (0.0,), (-0.05,), (-0.0501,)], "g double")
    got = [r[0] for r in df.select(at_least("g", MEASURE_TIERS, MEASURE_TIER_ELSE)).collect()]
    assert got == ["⭐ EXCEEDS", "✓ MEETS", "⚠ NEAR MISS", MEASURE_TIER_ELSE]


def test_window_start_leap_day(spark):
    got = spark.range(1).select(window_start(dt.date(2024, 2, 29)).alias("d")).first()["d"]
    assert got == dt.date(2022, 2, 28)


def test_kpi1_window_is_inclusive(spark, tables):
    base = dict(patient_id="PT000001", encounter_type="Inpatient", department="Cardiology",
                length_of_stay=1.0, discharge_disposition="Home", er_visit_flag=0,
                primary_icd10="I10", attending_provider="DR0001", total_charges=10.0)
    recs = [dict(base, encounter_id="E1", encounter_date=dt.date(1999, 8, 1), readmission_30d=1),
            dict(base, encounter_id="E2", encounter_date=dt.date(1999, 7, 31), readmission_30d=1),
            dict(base, encounter_id="E3", encounter_date=dt.date(2001, 8, 1), readmission_30d=0)]
    enc = spark.createDataFrame([tuple(r[f.name] for f in ENCOUNTERS.fields) for r in recs], ENCOUNTERS)
    out = kpi.kpi1_readmission_rate(tables(encounters=enc)).collect()
    assert sorted((r["quarter"], r["total_encounters"]) for r in out) == [("1999-Q3", 1), ("2001-Q3", 1)]


# ------------------------------------------------------------------ governance
def _gov(spark, recs):
    full = []
    for i, (sev, days, flag, source) in enumerate(recs):
        full.append((f"DQ{i:07d}", "patients", "Missing_Value", "age", dt.date(2000, 1, 3),
                     dt.date(2000, 1, 3), days, sev, flag, source))
    return spark.createDataFrame(full, DATA_GOVERNANCE_LOG)


def test_sla_breach_rules(spark, tables):
    g = _gov(spark, [("Critical", 2, 1, "Epic"),   # resolved at target: not listed
                     ("Critical", 3, 1, "Epic"),   # resolved late: listed, breached
                     ("High", 1, 0, "Epic"),       # open within: listed, within
                     ("High", 9, 0, "Epic"),       # open late: listed, breached
                     ("Odd", 31, 1, "Epic"),       # unknown severity: 30-day target
                     ("Low", None, 0, "Epic")])    # NULL days, open: within
    out = governance.gov2_sla_breach(tables(data_governance_log=g))
    got = rows(out, "severity", "days_to_resolve", "sla_days", "sla_status")
    assert got == [("Critical", 3, 2, "SLA BREACHED"), ("High", 9, 7, "SLA BREACHED"),
                   ("High", 1, 7, "WITHIN SLA"), ("Odd", 31, 30, "SLA BREACHED"),
                   ("Low", None, 30, "WITHIN SLA")]


def test_sla_compliance_unknown_and_missing_severity(spark, tables):
    g = _gov(spark, [("Critical", 5, 1, "Epic"), ("Odd", 99, 1, "Epic"), (None, 99, 1, "Epic")])
    out = {r["severity"]: r for r in governance.sla_compliance(tables(data_governance_log=g)).collect()}
    assert list(out) == ["Critical", "High", "Medium", "Low"]       # fixed order, unknown dropped
    assert out["Critical"]["breached"] == 1 and out["Critical"]["breach_rate"] == 100.0
    assert out["High"]["total"] is None                               # reindexed: NULL row


def test_gov1_keeps_null_group(spark, tables):
    g = _gov(spark, [(None, 1, 1, "Epic"), ("Low", 1, 0, "Epic")])
    out = governance.gov1_issue_summary(tables(data_governance_log=g)).collect()
    assert {r["severity"] for r in out} == {None, "Low"}


def test_source_grades(spark, tables):
    recs = ([("Low", 1, 1, "A_src")] * 10                                   # score 1.0, 100 %
            + [("Medium", 1, 1, "B_src")] * 3 + [("Low", 1, 1, "B_src")] * 6 + [("Low", 1, 0, "B_src")]  # 1.3, 90
            + [("Medium", 1, 1, "C_src")] * 8 + [("High", 1, 0, "C_src")] * 2  # 2.2, 80 -> C
            + [("Critical", 1, 0, "D_src")] * 4)                            # 4.0, 0 %
    out = {r["source_system"]: r["quality_grade"]
           for r in governance.gov3_source_scorecard(tables(data_governance_log=_gov(spark, recs))).collect()}
    assert out == {"A_src": "A", "B_src": "A", "C_src": "C", "D_src": "D"}


def test_orphans_keep_null_and_missing_keys(spark, tables):
    p = spark.createDataFrame([("PT1", 30, "F", 1, "Cardiology", "A", 1, "Epic")], PATIENTS)
    base = ("2000-01-01", "Inpatient", "Cardiology", 1.0, "Home", 0, 0, "I10", "DR0001", 1.0)
    enc = spark.createDataFrame(
        [(eid, pid, dt.date(2000, 1, 1), *base[1:]) for eid, pid in [("E1", "PT1"), ("E2", "PT9"), ("E3", None)]],
        ENCOUNTERS)
    out = governance.gov4_orphans(tables(patients=p, encounters=enc))
    assert rows(out, "encounter_id", "patient_id") == [("E2", "PT9"), ("E3", None)]


def test_completeness_all_null_and_empty(spark, tables):
    p = spark.createDataFrame([("PT1", None, "F", None, "Cardiology", None, 1, "Epic")], PATIENTS)
    enc = spark.createDataFrame([], ENCOUNTERS)
    labs = spark.createDataFrame([("L1", "PT1", "LDL", None, dt.date(2000, 1, 1), 0, 0)],
                                 "lab_id string, patient_id string, test_name string, result_value double, "
                                 "result_date date, abnormal_flag int, critical_flag int")
    out = {(r["table_name"], r["field"]): (r["total"], r["nulls"])
           for r in governance.gov5_completeness(tables(patients=p, encounters=enc, lab_results=labs)).collect()}
    assert out[("patients", "age")] == (1, 1)
    assert out[("patients", "sex")] == (1, 0)
    assert out[("encounters", "total_charges")] == (0, None)   # SUM over no rows
    assert out[("lab_results", "result_value")] == (1, 1)


# ------------------------------------------------------------------ windows
@pytest.mark.parametrize("n", [1, 7, 10, 23, 101])
def test_ntile_global_equals_window_ntile(spark, n):
    data = [(None if i % 11 == 0 else float(i % 4), f"s{i:03d}") for i in range(n)]
    df = spark.createDataFrame(data, "r double, id string")
    order = [F.col("r").asc_nulls_first(), F.col("id")]
    ref = {r["id"]: r["b"] for r in df.select("id", F.ntile(10).over(Window.orderBy(*order)).alias("b")).collect()}
    got = {r["id"]: r["b"] for r in ntile_global(df, 10, ["r", "id"], "b").collect()}
    assert got == ref


def test_global_row_number_equals_row_number(spark):
    df = spark.range(0, 997).select((F.col("id") * 7919 % 997).alias("k"), F.col("id"))
    order = [F.col("k"), F.col("id")]
    ref = {r["id"]: r["rn"] for r in df.select("id", F.row_number().over(Window.orderBy(*order)).alias("rn")).collect()}
    got = {r["id"]: r["rn"] for r in global_row_number(df, ["k", "id"], n_ranges=7, name="rn").collect()}
    assert got == ref


def test_pareto_ties_and_total(spark):
    df = spark.createDataFrame([("b", 5), ("a", 5), ("c", 10)], "t string, n long")
    out = running_share(df, "n", [F.col("n").desc(), F.col("t")]).orderBy("cum_count").collect()
    assert [r["t"] for r in out] == ["c", "a", "b"]
    assert out[-1]["cum_pct"] == 100.0


# ------------------------------------------------------------------ statistics
def test_correlation_null_pair_constant_and_single_row(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0), (2.0, None, 3.0), (3.0, 6.0, 3.0), (4.0, 8.0, 3.0)],
                               "a double, b double, c double")
    out = {(r["domain_a"], r["domain_b"]): r["correlation"]
           for r in pairwise_correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert out[("a", "b")] == 1.0 and out[("b", "a")] == 1.0     # pair (2, NULL) dropped
    assert out[("a", "c")] is None and out[("c", "c")] is None   # constant column
    assert out[("a", "a")] == 1.0
    one = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert pairwise_correlation_matrix(one, ["a", "b"]).where("domain_a='a' AND domain_b='b'").first()[2] is None


def test_quantile_bins_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 5, 6, 7, 8]], "x double")
    # quartile edges (linear): 2.75, 4.5, 6.25; right-closed, minimum in Q1
    got = [r["bin_label"] for r in quantile_bins(df, "x", ["Q1", "Q2", "Q3", "Q4"]).orderBy("x").collect()]
    assert got == ["Q1", "Q1", "Q2", "Q2", "Q3", "Q3", "Q4", "Q4"]


def test_quantile_bins_weighted_equals_expanded(spark):
    expanded = spark.createDataFrame([(1.0,)] * 3 + [(2.0,)] + [(5.0,)] * 4, "x double")
    weighted = spark.createDataFrame([(1.0, 3), (2.0, 1), (5.0, 4)], "x double, w long")
    a = {r["x"]: r["bin_label"] for r in quantile_bins(expanded, "x", ["Q1", "Q2", "Q3", "Q4"]).collect()}
    b = {r["x"]: r["bin_label"] for r in quantile_bins(weighted, "x", ["Q1", "Q2", "Q3", "Q4"], "w").collect()}
    assert a == b


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(v,) for v in [0, 40, 41, 75, 120, 121]], "age int")
    got = [r[0] for r in df.select(right_closed_bins("age", AGE_GROUPS)).collect()]
    assert got == [None, "<40", "40-60", "60-75", "75+", None]
    sc = spark.createDataFrame([(v,) for v in [0.0, 0.10, 0.1001, 0.35, 1.0]], "s double")
    got = [r[0] for r in sc.select(right_closed_bins("s", RISK_TIERS)).collect()]
    assert got == [None, "Low (<10%)", "Moderate (10-20%)", "High (20-35%)", "Very High (>35%)"]


def test_spc_constant_spike_single(spark):
    const = spark.createDataFrame([(i, 5) for i in range(6)], "w int, issues int")
    out = control_limits(const, "issues").collect()
    assert all(not r["out_of_control"] for r in out) and out[0]["sd_value"] == 0.0
    spike = spark.createDataFrame([(i, 10) for i in range(20)] + [(20, 1000)], "w int, issues int")
    flagged = [r["w"] for r in control_limits(spike, "issues").collect() if r["out_of_control"]]
    assert flagged == [20]
    low = spark.createDataFrame([(0, 1), (1, 100), (2, 1)], "w int, issues int")
    assert control_limits(low, "issues").first()["lcl"] == 0.0   # floored at 0
    one = control_limits(spark.createDataFrame([(0, 3)], "w int, issues int"), "issues").first()
    assert one["sd_value"] is None and one["out_of_control"] is False


def test_ttest_edges(spark):
    same = spark.createDataFrame([(1, 1.0), (1, 3.0), (0, 1.0), (0, 3.0)], "g int, v double")
    assert pooled_ttest(same, "v", "g").first()["t_stat"] == 0.0
    empty = spark.createDataFrame([(0, 1.0), (0, 3.0)], "g int, v double")
    r = pooled_ttest(empty, "v", "g").first()
    assert r["n_1"] == 0 and r["t_stat"] is None
    flat = spark.createDataFrame([(1, 2.0), (1, 2.0), (0, 2.0), (0, 2.0)], "g int, v double")
    assert pooled_ttest(flat, "v", "g").first()["t_stat"] is None
    # against a hand computation: a = [1,2,3], b = [4,6]
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (0, 4.0), (0, 6.0)], "g int, v double")
    sp2 = (2 * 1.0 + 1 * 2.0) / 3
    t = (2.0 - 5.0) / math.sqrt(sp2 * (1 / 3 + 1 / 2))
    assert pooled_ttest(df, "v", "g").first()["t_stat"] == round(t, 4)


def test_p_value_closed_forms():
    assert abs(t_two_sided_p_value(1.0, 1.0) - 0.5) < 1e-12
    assert abs(t_two_sided_p_value(2.0, 2.0) - (1 - 2 / math.sqrt(6))) < 1e-12
    assert t_two_sided_p_value(0.0, 5.0) == 1.0
    assert t_two_sided_p_value(None, 5.0) is None


# ------------------------------------------------------------------ allocation
def test_allocation_rules(spark):
    rates = [("q", f"d{i}", r) for i, r in enumerate([0.02, 0.02, 0.01, 0.03, 0.015, 0.011, 0.012, 0.013])]
    df = spark.createDataFrame(rates, "q string, d string, r double")
    out = bounded_allocation(df, ["q"], "d", "r", 200.0, 15.0, 40.0).collect()
    hours = {r["d"]: r["hours"] for r in out}
    assert sum(hours.values()) == 200.0
    assert all(15.0 <= h <= 40.0 for h in hours.values())
    assert hours["d3"] == 40.0 and hours["d0"] == 40.0 and hours["d1"] == 40.0   # tie broken by key
    assert sorted(hours.values()) == [15.0] * 4 + [20.0, 40.0, 40.0, 40.0]
    low = bounded_allocation(df, ["q"], "d", "r", 100.0, 15.0, 40.0).collect()
    high = bounded_allocation(df, ["q"], "d", "r", 400.0, 15.0, 40.0).collect()
    assert all(r["hours"] is None and not r["feasible"] for r in low + high)


# ------------------------------------------------------------------ evaluation
def _brute_auc(pairs):
    pos = [s for s, y in pairs if y == 1]
    neg = [s for s, y in pairs if y == 0]
    u = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return u / (len(pos) * len(neg))


def test_auc_equals_brute_force(spark):
    pairs = [((i * 37) % 23 / 10.0, int((i * 13) % 7 < 3)) for i in range(200)]
    df = spark.createDataFrame(pairs, "s double, y int")
    got = ev.auc(df, "s", "y").first()["auc"]
    assert got == round(_brute_auc(pairs), 6)


@pytest.mark.parametrize("n_ranges", [1, 9, 2000])
def test_cumulative_counts_equal_brute_force(spark, n_ranges):
    keys = [(float(k), k % 3) for k in range(0, 300, 3)]
    numbers = spark.createDataFrame(keys, "k double, v long")
    for df in (numbers, numbers.withColumn("k", F.lpad(F.col("k").cast("int").cast("string"), 5, "0"))):
        for desc in (False, True):
            out = {float(r["k"]): r["cum_v"]
                   for r in cumulative_counts(df, "k", ["v"], descending=desc, n_ranges=n_ranges).collect()}
            for k, _ in keys:
                assert out[k] == sum(v for kk, v in keys if (kk >= k if desc else kk <= k))


def test_cumulative_counts_many_keys(spark):
    df = spark.range(500_000).select((F.col("id") * 7 % 500_009).alias("k"), F.lit(1).alias("v"))
    out = cumulative_counts(df, "k", ["v"], n_ranges=200)
    near = out.agg(F.count(F.lit(1)).alias("n"), F.max("cum_v").alias("last"),
                   F.countDistinct("cum_v").alias("all")).first()
    assert (near["n"], near["last"], near["all"]) == (500_000, 500_000, 500_000)


def test_confusion_without_positive_predictions(spark):
    df = spark.createDataFrame([(0.1, 1), (0.2, 0), (0.3, 0)], "s double, y int")
    cells = rows(ev.confusion(df, "s", "y", 0.5), "actual", "predicted", "n")
    assert cells == [(0, 0, 2), (0, 1, 0), (1, 0, 1), (1, 1, 0)]
    rep = {r["label"]: r for r in ev.classification_report(df, "s", "y", 0.5, ("No", "Yes")).collect()}
    assert rep["Yes"]["precision"] == 0.0 and rep["Yes"]["recall"] == 0.0 and rep["Yes"]["f1_score"] == 0.0
    assert rep["accuracy"]["f1_score"] == round(2 / 3, 4) and rep["accuracy"]["support"] == 3


def test_risk_tiers_drop_zero_and_empty(spark):
    df = spark.createDataFrame([(0.0, 1), (0.05, 0), (0.5, 1), (0.6, 1)], "s double, y int")
    out = rows(ev.risk_tiers(df, "s", "y", RISK_TIERS), "risk_tier", "patients", "actual_readmits")
    assert out == [("Low (<10%)", 1, 0), ("Very High (>35%)", 2, 2)]


# ------------------------------------------------------------------ surveys
def _surveys(spark, ratings):
    recs = []
    for i, r in enumerate(ratings):
        doms = [r] * 8
        recs.append((f"SRV{i:07d}", f"ENC{i:07d}", dt.date(2000, 1, 3), *doms, 1, 0))
    return spark.createDataFrame(recs, PATIENT_SURVEYS)


def test_top_box_null_in_denominator_not_in_n(spark, tables):
    s = _surveys(spark, [4.5, 5.0, 3.0, None])
    out = {r["Domain"]: r for r in survey.survey_cms_submission(tables(patient_surveys=s)).collect()}
    assert out["Overall_Rating"]["Top_Box_Pct"] == 50.0           # 2 of 4 rows
    assert out["Overall_Rating"]["N_Responses"] == 3              # NULL not counted


def test_cms_submission_golden_layout(spark, tables, tmp_path):
    from carelens.sources.io import write_small_csv
    s = _surveys(spark, [4.5, 3.0])
    df = survey.survey_cms_submission(tables(patient_surveys=s))
    assert df.columns == ["Domain", "Mean_Score", "Top_Box_Pct", "N_Responses"]
    assert [r["Domain"] for r in df.collect()][0] == "Communication_Nurses"
    write_small_csv(df, str(tmp_path / "cms"))
    csv = [p for p in (tmp_path / "cms").iterdir() if p.name.endswith(".csv")]
    lines = csv[0].read_text().splitlines()
    assert lines[0] == "Domain,Mean_Score,Top_Box_Pct,N_Responses"
    assert lines[-1].startswith("Overall_Rating,")


def test_weekday_weekend_flag(spark):
    from carelens.operators.ml import inpatient_frame
    base = ("PT1", "Inpatient", "Cardiology", 1.0, "Home", 0, 0, "I10", "DR0001", 1.0)
    days = {"E_sat": dt.date(2024, 6, 1), "E_sun": dt.date(2024, 6, 2), "E_mon": dt.date(2024, 6, 3)}
    enc = spark.createDataFrame([(k, "PT1", d, *base[1:]) for k, d in days.items()], ENCOUNTERS)
    p = spark.createDataFrame([("PT1", 40, "F", 1, "Cardiology", "A", 1, "Epic")], PATIENTS)
    got = {r["encounter_id"]: r["is_weekend_admit"] for r in inpatient_frame(enc, p).collect()}
    assert got == {"E_sat": 1, "E_sun": 1, "E_mon": 0}


def test_null_rating_in_low_tier(spark):
    from carelens.sources.dimensions import SATISFACTION_TIER_ELSE, SATISFACTION_TIERS
    df = spark.createDataFrame([(None,), (4.5,), (3.5,), (3.4,)], T.StructType([T.StructField("r", T.DoubleType())]))
    got = [r[0] for r in df.select(at_least("r", SATISFACTION_TIERS, SATISFACTION_TIER_ELSE)).collect()]
    assert got == [SATISFACTION_TIER_ELSE, "High Satisfaction (4.5-5.0)", "Mid Satisfaction (3.5-4.4)",
                   SATISFACTION_TIER_ELSE]


@pytest.mark.parametrize("n", [1, 9, 23, 200])
def test_lowest_ntile_equals_window_ntile(spark, n):
    # heavy ties on the value (a hot value holds a third of the rows) and NULLs
    data = [(None if i % 17 == 0 else (2.0 if i % 3 == 0 else float(i % 7)), f"s{i:04d}", f"e{i % 5}")
            for i in range(n)]
    df = spark.createDataFrame(data, "r double, sid string, eid string")
    order = [F.col("r").asc_nulls_first(), F.col("sid"), F.col("eid")]
    ref = [r["sid"] for r in df.withColumn("b", F.ntile(10).over(Window.orderBy(*order)))
           .where("b = 1").orderBy(*order).collect()]
    for limit in (3, 500):
        got = [r["sid"] for r in first_of_lowest_ntile(df, 10, "r", ["sid", "eid"], limit, lambda x: x).collect()]
        assert got == ref[:limit]


def test_lowest_ntile_with_copies_and_a_dropping_join(spark):
    df = spark.createDataFrame([(1.0, "a")] * 6 + [(1.0, "b")] * 6 + [(3.0, "c")] * 28, "r double, s string")
    got = first_of_lowest_ntile(df, 4, "r", ["s"], 100, lambda x: x)          # the first 10 rows
    assert sorted(r["s"] for r in got.collect()) == ["a"] * 6 + ["b"] * 4
    got = first_of_lowest_ntile(df, 4, "r", ["s"], 100, lambda x: x.where("s <> 'a'"))
    assert [r["s"] for r in got.collect()] == ["b"] * 4


def test_spearman_equals_ranked_pearson(spark):
    from carelens.operators.stats import spearman
    data = [(float(i % 5), float((i * 7) % 11)) for i in range(40)] + [(None, 1.0)]
    df = spark.createDataFrame(data, "x double, y double")
    got = spearman(df, "x", "y").first()

    def avg_ranks(vals):
        order = sorted(vals)
        return {v: (order.index(v) + 1 + len(order) - order[::-1].index(v)) / 2 for v in set(vals)}
    pairs = [(a, b) for a, b in data if a is not None]
    rx, ry = avg_ranks([a for a, _ in pairs]), avg_ranks([b for _, b in pairs])
    xs, ys = [rx[a] for a, _ in pairs], [ry[b] for _, b in pairs]
    mx, my = sum(xs) / len(xs), sum(ys) / len(ys)
    cov = sum((a - mx) * (b - my) for a, b in zip(xs, ys))
    rho = cov / math.sqrt(sum((a - mx) ** 2 for a in xs) * sum((b - my) ** 2 for b in ys))
    assert got["n"] == 40 and got["rho"] == round(rho, 4)


def test_bi_export_partitioned_by_quarter(spark, tmp_path):
    from carelens.plans.exports import bi_quality_export, export_bi_quality
    from carelens.sources.adapters import care_tables
    from tests.conftest import SF_SMALL
    t = care_tables(spark, SF_SMALL)
    out = str(tmp_path / "bi")
    export_bi_quality(t, out)
    folders = {p.name for p in (tmp_path / "bi").iterdir() if p.name.startswith("period=")}
    assert folders == {f"period={r['quarter']}" for r in t.quality_measures.select("quarter").distinct().collect()}
    back = spark.read.option("header", True).csv(out)
    assert back.count() == bi_quality_export(t).count()
    one = next((tmp_path / "bi").glob("period=*/*.csv")).read_text().splitlines()
    assert "quarter" in one[0].split(",")       # a file holds every column of the table


def test_global_row_number_spreads_copies(spark):
    # a third of the rows are exact copies of one row
    df = spark.createDataFrame([(5, "x")] * 100 + [(i, f"k{i}") for i in range(200)], "v int, s string")
    out = global_row_number(df, ["v", "s"], n_ranges=6, name="rn").collect()
    assert sorted(r["rn"] for r in out) == list(range(1, 301))
    ordered = sorted(out, key=lambda r: r["rn"])
    assert [(r["v"], r["s"]) for r in ordered] == sorted((r["v"], r["s"]) for r in out)


def test_split_is_exact_per_class(spark):
    from carelens.operators.ml import stratified_split
    df = spark.createDataFrame([(f"E{i}", int(i % 7 == 0), i) for i in range(1000)] + [(None, None, 7)],
                               "encounter_id string, readmission_30d int, x int")
    out = stratified_split(df)
    got = {(r["readmission_30d"], r["is_train"]): r["count"]
           for r in out.groupBy("readmission_30d", "is_train").count().collect()}
    assert got == {(1, True): 114, (1, False): 29, (0, True): 685, (0, False): 172, (None, False): 1}
    assert out.columns == ["encounter_id", "readmission_30d", "x", "is_train"]


def test_orphans_stay_when_every_id_exists(spark):
    from carelens.operators.quality import orphans
    from carelens.sources.adapters import encounters_from, patients_from
    customer = spark.createDataFrame([(999_999, 3, "BUILDING"), (5, 1, "BUILDING")],
                                     "c_custkey long, c_nationkey long, c_mktsegment string")
    orders = spark.createDataFrame([(211, 5, 1.0, dt.date(2000, 1, 1), "2-HIGH"), (7, 5, 1.0, dt.date(2000, 1, 1), "2-HIGH"),
                                    (422, 999_999, 1.0, dt.date(2000, 1, 1), "2-HIGH")],
                                   "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate date, o_orderpriority string")
    got = orphans(encounters_from(orders), patients_from(customer), "patient_id").collect()
    assert sorted(r["encounter_id"] for r in got) == ["ENC0000211", "ENC0000422"]


def test_hot_encounter_outcomes(spark, tables):
    """One encounter holds most surveys; the quartile report counts every survey."""
    enc = [("E1", "Inpatient", 4.0, 1), ("E2", "Inpatient", 2.0, 0), ("E3", "ED", 9.0, 1)]
    t = tables(encounters=spark.createDataFrame(enc, "encounter_id string, encounter_type string, length_of_stay double, readmission_30d int"),
               patient_surveys=spark.createDataFrame(
                   [(f"S{i}", "E1", float(1 + i % 5)) for i in range(400)] + [("T1", "E2", 1.0), ("T2", "E3", 5.0)],
                   "survey_id string, encounter_id string, Overall_Rating double"))
    from carelens.plans.survey import survey_quartile_outcomes
    got = survey_quartile_outcomes(t).collect()
    assert sum(r["n"] for r in got) == 401
