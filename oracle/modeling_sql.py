"""DuckDB oracle SQL for the feature table and the deterministic-score evaluations."""

from oracle.adapters_sql import with_views

SQL = {}

_CATS = ["department", "insurance_type", "primary_icd10", "discharge_disposition", "age_group", "ehr_system"]

SQL["readmission_features"] = with_views("""
WITH f AS (
    SELECT e.encounter_id, e.readmission_30d, p.age, p.chronic_conditions, e.length_of_stay,
           e.total_charges, e.er_visit_flag,
           CAST(isodow(e.encounter_date) IN (6, 7) AS INTEGER) AS is_weekend_admit,
           CAST(month(e.encounter_date) AS INTEGER) AS encounter_month,
           COALESCE(e.department, 'Unknown') AS department,
           COALESCE(p.insurance_type, 'Unknown') AS insurance_type,
           COALESCE(e.primary_icd10, 'Unknown') AS primary_icd10,
           COALESCE(e.discharge_disposition, 'Unknown') AS discharge_disposition,
           COALESCE(CASE WHEN p.age > 0 AND p.age <= 40 THEN '<40'
                         WHEN p.age > 40 AND p.age <= 60 THEN '40-60'
                         WHEN p.age > 60 AND p.age <= 75 THEN '60-75'
                         WHEN p.age > 75 AND p.age <= 120 THEN '75+' END, 'Unknown') AS age_group,
           COALESCE(p.ehr_system, 'Unknown') AS ehr_system
    FROM encounters e LEFT JOIN patients p ON e.patient_id = p.patient_id
    WHERE e.encounter_type = 'Inpatient'
)
SELECT encounter_id, readmission_30d,
       COALESCE(age, 0) AS age, COALESCE(chronic_conditions, 0) AS chronic_conditions,
       COALESCE(length_of_stay, 0) AS length_of_stay, COALESCE(total_charges, 0) AS total_charges,
       COALESCE(er_visit_flag, 0) AS er_visit_flag, COALESCE(is_weekend_admit, 0) AS is_weekend_admit,
       COALESCE(encounter_month, 0) AS encounter_month,
""" + ",\n".join(f"       CAST(DENSE_RANK() OVER (ORDER BY {c}) - 1 AS INTEGER) AS {c}_code" for c in _CATS)
    + "\nFROM f")

_SCORES = """
WITH s AS (
    SELECT encounter_id, readmission_30d AS y,
           CAST((CAST(SUBSTRING(encounter_id, 4) AS BIGINT) * 13) % 101 AS DOUBLE) / 100 AS score
    FROM encounters WHERE encounter_type = 'Inpatient'
)"""

SQL["score_auc"] = with_views(_SCORES + """,
r AS (
    SELECT y, RANK() OVER (ORDER BY score) + (COUNT(*) OVER (PARTITION BY score) - 1) / 2.0 AS ar
    FROM s WHERE score IS NOT NULL AND y IS NOT NULL
), t AS (
    SELECT SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS p, SUM(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS n,
           SUM(CASE WHEN y = 1 THEN ar ELSE 0 END) AS rs
    FROM r
)
SELECT CAST(p AS BIGINT) AS n_pos, CAST(n AS BIGINT) AS n_neg,
       ROUND((rs - p * (p + 1) / 2.0) / (CAST(p AS DOUBLE) * n), 6) AS auc
FROM t""", views=["encounters"])

SQL["score_roc"] = with_views(_SCORES + """,
c AS (
    SELECT score, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN y = 1 THEN 0 ELSE 1 END) AS neg
    FROM s WHERE score IS NOT NULL AND y IS NOT NULL GROUP BY score
), k AS (
    SELECT score,
           SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
           SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
           SUM(pos) OVER () AS p, SUM(neg) OVER () AS n
    FROM c
)
SELECT score AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       ROUND(CAST(tp AS DOUBLE) / p, 6) AS tpr, ROUND(CAST(fp AS DOUBLE) / n, 6) AS fpr
FROM k
UNION ALL
SELECT CAST('inf' AS DOUBLE), 0, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)""", views=["encounters"])

SQL["readmission_split"] = with_views("""
WITH n AS (SELECT readmission_30d, COUNT(*) AS n FROM encounters WHERE encounter_type = 'Inpatient' GROUP BY 1)
SELECT 'train' AS split, readmission_30d, n * 80 // 100 AS n FROM n
UNION ALL
SELECT 'test', readmission_30d, n - n * 80 // 100 FROM n""", views=["encounters"])

SQL["score_confusion"] = with_views(_SCORES + """,
cells(actual, predicted) AS (VALUES (0, 0), (0, 1), (1, 0), (1, 1)),
c AS (
    SELECT CAST(y AS INTEGER) AS actual, CAST(score >= 0.5 AS INTEGER) AS predicted, COUNT(*) AS n
    FROM s WHERE score IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2
)
SELECT CAST(cells.actual AS INTEGER) AS actual, CAST(cells.predicted AS INTEGER) AS predicted,
       COALESCE(c.n, 0) AS n
FROM cells LEFT JOIN c ON cells.actual = c.actual AND cells.predicted = c.predicted
ORDER BY 1, 2""", views=["encounters"])

SQL["score_report"] = with_views(_SCORES + """,
m AS (
    SELECT CAST(COUNT(CASE WHEN y = 1 AND score >= 0.5 THEN 1 END) AS DOUBLE) AS tp,
           CAST(COUNT(CASE WHEN y = 0 AND score >= 0.5 THEN 1 END) AS DOUBLE) AS fp,
           CAST(COUNT(CASE WHEN y = 1 AND score < 0.5 THEN 1 END) AS DOUBLE) AS fn,
           CAST(COUNT(CASE WHEN y = 0 AND score < 0.5 THEN 1 END) AS DOUBLE) AS tn
    FROM s WHERE score IS NOT NULL AND y IS NOT NULL
), k AS (
    SELECT *,
           COALESCE(tp / NULLIF(tp + fp, 0), 0) AS p1, COALESCE(tp / NULLIF(tp + fn, 0), 0) AS r1,
           COALESCE(tn / NULLIF(tn + fn, 0), 0) AS p0, COALESCE(tn / NULLIF(tn + fp, 0), 0) AS r0
    FROM m
), f AS (
    SELECT *, COALESCE(2 * p1 * r1 / NULLIF(p1 + r1, 0), 0) AS f1,
              COALESCE(2 * p0 * r0 / NULLIF(p0 + r0, 0), 0) AS f0,
              tp + fn AS s1, tn + fp AS s0
    FROM k
)
SELECT 'No Readmit' AS label, 1 AS row_order, ROUND(p0, 4) AS precision, ROUND(r0, 4) AS recall,
       ROUND(f0, 4) AS f1_score, CAST(s0 AS BIGINT) AS support FROM f
UNION ALL SELECT 'Readmit', 2, ROUND(p1, 4), ROUND(r1, 4), ROUND(f1, 4), CAST(s1 AS BIGINT) FROM f
UNION ALL SELECT 'accuracy', 3, NULL, NULL, ROUND(COALESCE((tp + tn) / NULLIF(s0 + s1, 0), 0), 4),
                 CAST(s0 + s1 AS BIGINT) FROM f
UNION ALL SELECT 'macro avg', 4, ROUND((p0 + p1) / 2, 4), ROUND((r0 + r1) / 2, 4), ROUND((f0 + f1) / 2, 4),
                 CAST(s0 + s1 AS BIGINT) FROM f
UNION ALL SELECT 'weighted avg', 5, ROUND((p0 * s0 + p1 * s1) / (s0 + s1), 4),
                 ROUND((r0 * s0 + r1 * s1) / (s0 + s1), 4), ROUND((f0 * s0 + f1 * s1) / (s0 + s1), 4),
                 CAST(s0 + s1 AS BIGINT) FROM f""", views=["encounters"])

SQL["score_risk_tiers"] = with_views(_SCORES + """,
t AS (
    SELECT *, CASE WHEN score > 0.0 AND score <= 0.10 THEN 'Low (<10%)'
                   WHEN score > 0.10 AND score <= 0.20 THEN 'Moderate (10-20%)'
                   WHEN score > 0.20 AND score <= 0.35 THEN 'High (20-35%)'
                   WHEN score > 0.35 AND score <= 1.0 THEN 'Very High (>35%)' END AS risk_tier
    FROM s
)
SELECT risk_tier, COUNT(y) AS patients, CAST(SUM(y) AS BIGINT) AS actual_readmits,
       ROUND(AVG(score), 6) AS avg_risk_score,
       ROUND(CAST(SUM(y) AS DOUBLE) / COUNT(y), 6) AS actual_rate,
       CASE risk_tier WHEN 'Low (<10%)' THEN 1 WHEN 'Moderate (10-20%)' THEN 2
                      WHEN 'High (20-35%)' THEN 3 WHEN 'Very High (>35%)' THEN 4 END AS tier_order
FROM t WHERE risk_tier IS NOT NULL
GROUP BY risk_tier ORDER BY tier_order""", views=["encounters"])


SQL["readmission_cv_folds"] = with_views("""
SELECT CAST(CAST('0x' || md5('42:' || COALESCE(encounter_id, ''))[:8] AS BIGINT) % 5 AS INTEGER) AS fold, readmission_30d, COUNT(*) AS n
FROM encounters WHERE encounter_type = 'Inpatient' GROUP BY ALL""")
