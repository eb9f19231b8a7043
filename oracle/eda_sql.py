"""DuckDB oracle SQL for the exploratory reports, BI export, trend and allocation."""

from oracle.adapters_sql import MEASURES, with_views

SQL = {}

_STATS = [("count", "CAST(COUNT({c}) AS DOUBLE)"), ("mean", "AVG({c})"), ("std", "STDDEV_SAMP({c})"),
          ("min", "CAST(MIN({c}) AS DOUBLE)"), ("25%", "QUANTILE_CONT({c}, 0.25)"),
          ("50%", "QUANTILE_CONT({c}, 0.5)"), ("75%", "QUANTILE_CONT({c}, 0.75)"),
          ("max", "CAST(MAX({c}) AS DOUBLE)")]
SQL["eda_describe"] = with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, '{name}' AS statistic, {k + 1} AS stat_order, "
    f"ROUND({expr.format(c=c)}, 2) AS value FROM patients"
    for c in ["age", "chronic_conditions"] for k, (name, expr) in enumerate(_STATS)))

SQL["eda_frequency"] = with_views("\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS value, COUNT(*) AS frequency "
    f"FROM patients WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in ["insurance_type", "department", "chronic_conditions"]))

SQL["eda_age_histogram"] = with_views("""
WITH b AS (SELECT CAST(MIN(age) AS DOUBLE) AS lo, CAST(MAX(age) AS DOUBLE) AS hi FROM patients),
c AS (
    SELECT CAST(LEAST(19, COALESCE(FLOOR((age - lo) * 20 / NULLIF(hi - lo, 0)), 0)) AS INTEGER) AS bin,
           COUNT(*) AS n
    FROM patients, b WHERE age IS NOT NULL GROUP BY 1
), bins AS (SELECT CAST(range AS INTEGER) AS bin FROM range(20))
SELECT bins.bin,
       ROUND(lo + bins.bin * ((hi - lo) / 20.0), 4) AS bin_start,
       ROUND(lo + (bins.bin + 1) * ((hi - lo) / 20.0), 4) AS bin_end,
       COALESCE(c.n, 0) AS count
FROM bins CROSS JOIN b LEFT JOIN c ON bins.bin = c.bin
ORDER BY bins.bin""")

SQL["eda_monthly_encounters"] = with_views("""
SELECT strftime(encounter_date, '%Y-%m') AS month, encounter_type, COUNT(*) AS encounter_count
FROM encounters
WHERE encounter_date IS NOT NULL AND encounter_type IS NOT NULL
GROUP BY 1, 2
ORDER BY 1, 2""")

SQL["eda_measure_heatmap"] = with_views(
    "SELECT department, "
    + ", ".join(f"MAX(CASE WHEN measure = '{m}' THEN performance_rate END) AS {m}" for m in MEASURES)
    + """
FROM quality_measures
WHERE quarter = (SELECT MAX(quarter) FROM quality_measures) AND department IS NOT NULL
GROUP BY department
ORDER BY department""")

SQL["eda_readmission_by_dept"] = with_views("""
SELECT department,
       ROUND(AVG(readmission_30d), 6) AS rate,
       CAST(SUM(readmission_30d) AS BIGINT) AS readmissions,
       COUNT(readmission_30d) AS total,
       ROUND(AVG(readmission_30d), 6) > 0.15 AS above_benchmark
FROM encounters
WHERE encounter_type = 'Inpatient' AND department IS NOT NULL
GROUP BY department
ORDER BY rate, department""")

SQL["eda_measure_trend"] = with_views("""
SELECT quarter, measure, ROUND(AVG(performance_rate), 9) AS performance_rate
FROM quality_measures
WHERE measure IN ('BP_Control', 'HbA1c_Testing', 'Readmission_Rate') AND quarter IS NOT NULL
GROUP BY quarter, measure
ORDER BY measure, quarter""")

SQL["eda_lab_rates"] = with_views("""
SELECT test_name, COUNT(lab_id) AS total,
       CAST(SUM(abnormal_flag) AS BIGINT) AS abnormal,
       CAST(SUM(critical_flag) AS BIGINT) AS critical,
       ROUND(CAST(SUM(abnormal_flag) AS DOUBLE) / COUNT(lab_id), 6) AS abnormal_rate,
       ROUND(CAST(SUM(critical_flag) AS DOUBLE) / COUNT(lab_id), 6) AS critical_rate
FROM lab_results
WHERE test_name IS NOT NULL
GROUP BY test_name
ORDER BY abnormal_rate DESC, test_name""")

SQL["bi_quality_export"] = with_views("""
SELECT *,
       CAST(gap_to_benchmark >= 0 AS INTEGER) AS above_benchmark,
       ROUND(ROUND(performance_rate * 100, 8), 1) AS performance_pct,
       ROUND(ROUND(national_benchmark * 100, 8), 1) AS benchmark_pct,
       ROUND(ROUND(gap_to_benchmark * 100, 8), 1) AS gap_pct
FROM quality_measures""")

SQL["qm_trend_direction"] = with_views("""
WITH l AS (
    SELECT department, measure, quarter, performance_rate,
           LAG(performance_rate) OVER (PARTITION BY department, measure ORDER BY quarter) AS prev_value
    FROM quality_measures
)
SELECT *, ROUND(performance_rate - prev_value, 4) AS delta,
       CASE WHEN ROUND(performance_rate - prev_value, 4) > 0 THEN 'up'
            WHEN ROUND(performance_rate - prev_value, 4) < 0 THEN 'down'
            WHEN prev_value IS NOT NULL THEN 'flat' END AS trend_direction
FROM l
ORDER BY department, measure, quarter""")

SQL["hours_allocation"] = with_views("""
WITH r AS (
    SELECT quarter, department,
           ROUND(0.005 + 0.02 * (1 - CAST(SUM(numerator) AS DOUBLE) / SUM(denominator)), 6) AS rate
    FROM quality_measures GROUP BY quarter, department
), k AS (
    SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY quarter ORDER BY rate DESC, department) AS INTEGER) AS alloc_rank,
           COUNT(*) OVER (PARTITION BY quarter) AS n
    FROM r
), h AS (
    SELECT *, (200.0 >= 15.0 * n AND 200.0 <= 40.0 * n) AS feasible,
           CASE WHEN 200.0 >= 15.0 * n AND 200.0 <= 40.0 * n
                THEN 15.0 + GREATEST(0.0, LEAST(25.0, 200.0 - 15.0 * n - 25.0 * (alloc_rank - 1))) END AS hrs
    FROM k
)
, points AS (
    SELECT *, ROUND(CAST(hrs AS DOUBLE), 1) AS hours,
           CAST(ROUND(CAST(ROUND(CAST(hrs AS DOUBLE), 1) * rate * 100 AS DECIMAL(18, 6)), 2) AS DOUBLE) AS expected_points FROM h
)
SELECT quarter, department, ROUND(ROUND(rate, 8), 4) AS rate, alloc_rank, feasible, hours, expected_points,
       expected_points > ROUND(AVG(expected_points) OVER (PARTITION BY quarter), 8) AS above_average,
       ROUND(CAST(200 AS DOUBLE) / n, 6) AS equal_split_hours
FROM points""")

SQL["readmission_base_rate"] = with_views("""
SELECT COUNT(*) AS encounters, CAST(SUM(readmission_30d) AS BIGINT) AS readmissions,
       ROUND(AVG(readmission_30d) * 100, 1) AS base_rate_pct
FROM encounters WHERE encounter_type = 'Inpatient'""")


def _quartiles(table: str, group: str, value: str, scale: int) -> str:
    return f"""
SELECT {group}, n, ROUND(q[1], {scale}) AS q1, ROUND(q[2], {scale}) AS median, ROUND(q[3], {scale}) AS q3, ROUND(q[3] - q[1], {scale}) AS iqr
FROM (SELECT {group}, COUNT({value}) AS n, QUANTILE_CONT(CAST({value} AS DOUBLE), [0.25, 0.5, 0.75]) AS q
      FROM {table} WHERE {group} IS NOT NULL AND {value} IS NOT NULL GROUP BY {group}) AS groups"""


SQL["charges_quartiles"] = with_views(_quartiles("encounters", "department", "total_charges", 2), views=["encounters"])
SQL["lab_value_quartiles"] = with_views(_quartiles("lab_results", "test_name", "result_value", 4), views=["lab_results"])

_FIELDS = ["department", "measure", "quarter"] + [
    f"CAST(ROUND({c} * 10000) AS BIGINT)" for c in ("performance_rate", "national_benchmark", "gap_to_benchmark")] + [
    "denominator", "numerator", "CAST(gap_to_benchmark >= 0 AS INTEGER)"]
_TEXT = " || '|' || ".join(f"COALESCE('=' || CAST({c} AS VARCHAR), '-')" for c in _FIELDS)
SQL["bi_export_manifest"] = with_views(f"""
SELECT quarter, COUNT(*) AS rows, CAST(SUM(CAST('0x' || md5({_TEXT})[:15] AS BIGINT)) AS VARCHAR) AS digest
FROM quality_measures GROUP BY quarter""", views=["quality_measures"])
