"""DuckDB oracle SQL for the governance analyses, written from the output contract."""

from oracle.adapters_sql import with_views

#: Severity dimension: days allowed, display order, weight. Fixed values.
SEVERITIES = """(VALUES ('Critical', 2, 1, 4), ('High', 7, 2, 3), ('Medium', 14, 3, 2), ('Low', 30, 4, 1))
    AS sev(severity, allowed, place, weight)"""
LOG = f"(data_governance_log LEFT JOIN {SEVERITIES} USING (severity))"

SQL = {}

SQL["gov1_issue_summary"] = with_views("""
SELECT table_name, issue_type, severity, n AS issue_count, done AS resolved_count, n - done AS open_count,
       ROUND(100.0::DOUBLE * done / n, 1) AS resolution_rate_pct, avg_days_to_resolve
FROM (
    SELECT table_name, issue_type, severity, COUNT(*) AS n, COUNT(*) FILTER (resolved_flag = 1) AS done,
           ROUND(MEAN(days_to_resolve), 1) AS avg_days_to_resolve
    FROM data_governance_log GROUP BY ALL) AS groups""", views=["data_governance_log"])

SQL["gov2_sla_breach"] = with_views(f"""
SELECT issue_id, table_name, issue_type, field_name, severity, source_system, detected_date, days_to_resolve,
       CAST(COALESCE(allowed, 30) AS INTEGER) AS sla_days,
       IF(days_to_resolve > COALESCE(allowed, 30), 'SLA BREACHED', 'WITHIN SLA') AS sla_status
FROM {LOG}
WHERE resolved_flag = 0 OR days_to_resolve > COALESCE(allowed, 30)""", views=["data_governance_log"])

SQL["gov3_source_scorecard"] = with_views(f"""
-- a source is graded for its severity and for its resolution; the worse grade counts
SELECT sources.*, GREATEST(by_severity.grade, by_resolution.grade) AS quality_grade
FROM (
    SELECT source_system, COUNT(*) AS total_issues,
           COUNT(*) FILTER (place = 1) AS critical, COUNT(*) FILTER (place = 2) AS high,
           COUNT(*) FILTER (place = 3) AS medium, COUNT(*) FILTER (place = 4) AS low_sev,
           COUNT(*) FILTER (resolved_flag = 1) AS resolved,
           ROUND(MEAN(days_to_resolve), 1) AS avg_resolution_days,
           ROUND(MEAN(COALESCE(weight, 0)), 2) AS weighted_severity_score,
           ROUND(100.0::DOUBLE * COUNT(*) FILTER (resolved_flag = 1) / COUNT(*), 1) AS resolution_rate_pct
    FROM {LOG} GROUP BY source_system) AS sources
JOIN (VALUES (0.0, 1.5, 'A'), (1.5, 2.0, 'B'), (2.0, 2.5, 'C'), (2.5, 99.0, 'D')) AS by_severity(lo, hi, grade)
  ON by_severity.lo <= weighted_severity_score AND weighted_severity_score < by_severity.hi
JOIN (VALUES (90.0, 101.0, 'A'), (80.0, 90.0, 'B'), (70.0, 80.0, 'C'), (0.0, 70.0, 'D')) AS by_resolution(lo, hi, grade)
  ON by_resolution.lo <= resolution_rate_pct AND resolution_rate_pct < by_resolution.hi""", views=["data_governance_log"])

SQL["gov4_orphans"] = with_views("""
SELECT encounter_id, patient_id, encounter_date, encounter_type, department,
       'ORPHANED_ENCOUNTER' AS issue_type
FROM encounters AS child
WHERE NOT EXISTS (FROM patients AS parent WHERE parent.patient_id = child.patient_id)
QUALIFY ROW_NUMBER() OVER (ORDER BY encounter_id) <= 500""", views=["patients", "encounters"])


def _missing(table: str, fields: str) -> str:
    marks = ", ".join(f"CAST({f} IS NULL AS INTEGER) AS {f}" for f in fields.split())
    return f"""
SELECT '{table}' AS table_name, field, COUNT(*) AS total, CAST(SUM(gap) AS BIGINT) AS nulls
FROM (UNPIVOT (SELECT {marks} FROM {table}) ON * INTO NAME field VALUE gap) AS {table}_gaps GROUP BY field"""


SQL["gov5_completeness"] = with_views("\nUNION ALL".join([
    _missing("patients", "age sex zip_code insurance_type"),
    _missing("encounters", "encounter_date primary_icd10 total_charges"),
    _missing("lab_results", "result_value")]), views=["patients", "encounters", "lab_results"])

SQL["gov6_monthly_trend"] = with_views("""
SELECT printf('%04d-%02d', year(detected_date), month(detected_date)) AS month,
       COUNT(*) AS issues_opened,
       COUNT(*) FILTER (resolved_flag = 1) AS issues_resolved,
       COUNT(*) FILTER (resolved_flag = 0) AS net_open_delta,
       ROUND(MEAN(days_to_resolve), 1) AS avg_days_to_resolve,
       COUNT(*) FILTER (list_contains(['High', 'Critical'], severity)) AS high_critical_count
FROM data_governance_log
GROUP BY ALL""", views=["data_governance_log"])

SQL["sla_compliance"] = with_views("""
WITH dim(severity, sla_days, severity_order) AS (
    VALUES ('Critical', 2, 1), ('High', 7, 2), ('Medium', 14, 3), ('Low', 30, 4)
), per_sev AS (
    SELECT g.severity,
           COUNT(g.issue_id) AS total,
           CAST(SUM(CASE WHEN g.days_to_resolve > d.sla_days THEN 1 ELSE 0 END) AS BIGINT) AS breached,
           CAST(SUM(g.resolved_flag) AS BIGINT) AS resolved,
           ROUND(AVG(g.days_to_resolve), 2) AS avg_days
    FROM data_governance_log g LEFT JOIN dim d ON g.severity = d.severity
    WHERE g.severity IS NOT NULL
    GROUP BY g.severity
)
SELECT d.severity, CAST(d.severity_order AS INTEGER) AS severity_order, CAST(d.sla_days AS INTEGER) AS sla_days,
       p.total, p.breached, p.resolved, p.avg_days,
       ROUND(CAST(p.breached AS DOUBLE) / p.total * 100, 2) AS breach_rate,
       ROUND(CAST(p.resolved AS DOUBLE) / p.total * 100, 2) AS resolution_rate,
       ROUND(CAST(p.breached AS DOUBLE) / p.total * 100, 2) > 20 AS breach_alert
FROM dim d LEFT JOIN per_sev p ON d.severity = p.severity
ORDER BY d.severity_order""")

SQL["spc_weekly_issues"] = with_views("""
WITH weekly AS (
    SELECT CAST(date_trunc('week', detected_date) AS DATE) AS week, COUNT(*) AS issues
    FROM data_governance_log WHERE detected_date IS NOT NULL GROUP BY 1
), s AS (SELECT AVG(issues) AS m, STDDEV_SAMP(issues) AS sd FROM weekly)
SELECT week, issues,
       ROUND(m, 4) AS mean_value, ROUND(sd, 4) AS sd_value,
       ROUND(m + 3 * sd, 4) AS ucl,
       ROUND(GREATEST(0.0, m - 3 * sd), 4) AS lcl,
       COALESCE(issues > m + 3 * sd OR issues < GREATEST(0.0, m - 3 * sd), FALSE) AS out_of_control
FROM weekly, s
ORDER BY week""")

SQL["pareto_issue_types"] = with_views("""
WITH c AS (
    SELECT issue_type, COUNT(*) AS issue_count
    FROM data_governance_log WHERE issue_type IS NOT NULL GROUP BY issue_type
), r AS (
    SELECT issue_type, issue_count,
           CAST(SUM(issue_count) OVER (ORDER BY issue_count DESC, issue_type
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_count,
           SUM(issue_count) OVER () AS total
    FROM c
)
SELECT issue_type, issue_count, cum_count,
       ROUND(CAST(cum_count AS DOUBLE) / total * 100, 4) AS cum_pct,
       CAST(cum_count AS DOUBLE) / total * 100 <= 80 AS within_cutoff
FROM r
ORDER BY issue_count DESC, issue_type""")

SQL["quality_measure_derivation"] = with_views("""
SELECT 'quality_measures' AS table_name, 'gap_to_benchmark' AS check_name, COUNT(*) AS rows,
       COUNT(CASE WHEN ROUND(performance_rate - national_benchmark, 4) <> gap_to_benchmark THEN 1 END) AS mismatches
FROM quality_measures
UNION ALL
SELECT 'quality_measures', 'numerator', COUNT(*),
       COUNT(CASE WHEN ROUND(performance_rate * denominator, 0) <> numerator THEN 1 END)
FROM quality_measures
UNION ALL
SELECT 'data_governance_log', 'days_to_resolve', COUNT(*),
       COUNT(CASE WHEN date_diff('day', detected_date, resolved_date) <> days_to_resolve THEN 1 END)
FROM data_governance_log""")

SQL["lab_reference_flags"] = with_views("""
WITH ranges(test_name, lo, hi, mu, sd) AS (
    VALUES ('HbA1c', 4.0, 14.0, 5.7, 1.8), ('LDL', 40.0, 220.0, 105.0, 30.0),
           ('Systolic_BP', 80.0, 200.0, 128.0, 18.0), ('Diastolic_BP', 50.0, 120.0, 80.0, 12.0),
           ('eGFR', 5.0, 120.0, 75.0, 22.0), ('INR', 0.8, 4.0, 1.2, 0.5),
           ('Hemoglobin', 6.0, 18.0, 13.5, 2.0), ('Creatinine', 0.4, 6.0, 1.0, 0.5)
), r AS (
    SELECT test_name, CAST(lo AS DOUBLE) AS lo, CAST(hi AS DOUBLE) AS hi,
           CAST(mu AS DOUBLE) AS mu, CAST(sd AS DOUBLE) AS sd FROM ranges
)
SELECT l.lab_id, l.patient_id, l.test_name, l.result_value, l.result_date,
       CAST(l.result_value < r.mu - 1.0 * r.sd OR l.result_value > r.mu + 2.0 * r.sd AS INTEGER) AS abnormal_flag,
       CAST(l.result_value < r.lo * 1.2 OR l.result_value > r.hi * 0.9 AS INTEGER) AS critical_flag,
       l.abnormal_flag AS stored_abnormal_flag,
       l.critical_flag AS stored_critical_flag
FROM lab_results l LEFT JOIN r ON l.test_name = r.test_name""")

SQL["load_report"] = with_views("""
SELECT 'patients' AS table_name, COUNT(*) AS row_count FROM patients
UNION ALL SELECT 'encounters', COUNT(*) FROM encounters
UNION ALL SELECT 'quality_measures', COUNT(*) FROM quality_measures
UNION ALL SELECT 'patient_surveys', COUNT(*) FROM patient_surveys
UNION ALL SELECT 'data_governance_log', COUNT(*) FROM data_governance_log
UNION ALL SELECT 'lab_results', COUNT(*) FROM lab_results""")


#: Columns of the encounters in table order. Fixed values.
ENCOUNTER_COLUMNS = ["encounter_id", "patient_id", "encounter_date", "encounter_type", "department", "length_of_stay",
                     "discharge_disposition", "readmission_30d", "er_visit_flag", "primary_icd10", "attending_provider",
                     "total_charges"]
_DAMAGE = {"encounter_date": "k % 97 = 5", "length_of_stay": "k % 89 = 7", "total_charges": "k % 71 = 2 AND NOT cut"}
_ROWS = "\nUNION ALL ".join(
    f"SELECT '{c}' AS column_name, {i + 1} AS column_order, COUNT(*) AS rows, "
    f"COUNT(*) FILTER ({f'({c} IS NULL AND NOT ({_DAMAGE[c]}))' if c in _DAMAGE else f'{c} IS NULL'}{' OR cut' if i > 5 else ''}) AS missing, "
    f"COUNT(*) FILTER ({_DAMAGE.get(c, 'FALSE')}) AS rejected FROM damaged" for i, c in enumerate(ENCOUNTER_COLUMNS))
SQL["csv_reject_report"] = with_views(f"""
WITH damaged AS (SELECT *, k % 83 = 11 AS cut, k % 79 = 3 AS surplus
  FROM (SELECT *, CAST(regexp_extract(encounter_id, '([0-9]+)$', 1) AS BIGINT) AS k FROM encounters) AS numbered)
{_ROWS}
UNION ALL SELECT '(line)', {len(ENCOUNTER_COLUMNS) + 1}, COUNT(*), 0,
  COUNT(*) FILTER (cut OR surplus OR k % 97 = 5 OR k % 89 = 7 OR k % 71 = 2) FROM damaged""", views=["encounters"])
