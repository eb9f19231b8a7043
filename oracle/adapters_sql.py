"""The six care tables as DuckDB SQL over the raw test tables.

Written independently of the DataFrame adapter in ``carelens.sources.adapters``;
``tests/test_adapters.py`` checks both produce identical tables.
"""

from __future__ import annotations

#: Value lists of the mapping, stated here a second time so that a wrong list in the engine shows. Fixed values.
DEPARTMENTS = ["Cardiology", "Oncology", "Neurology", "Orthopedics", "Primary Care", "Endocrinology",
               "Pulmonology", "Nephrology"]
MEASURES = ["BP_Control", "HbA1c_Testing", "Colorectal_Screening", "Mammography", "Flu_Vaccine",
            "Statin_Therapy", "Readmission_Rate", "CAHPS_Composite"]
DISCHARGE_DISPOSITIONS = ["Home", "SNF", "Rehab", "AMA", "Expired", "Transferred"]
ICD10_CODES = ["I10", "E11", "J18", "M79", "Z12", "I25", "N18", "C34", "F32", "G20"]
ENCOUNTER_TYPES = {"1-URGENT": "Inpatient", "2-HIGH": "ED", "3-MEDIUM": "Outpatient", "4-NOT SPECIFIED": "Telehealth"}
GOV_TABLES = ["patients", "encounters", "quality_measures", "patient_surveys", "lab_results"]
GOV_ISSUE_TYPES = ["Missing_Value", "Duplicate_Record", "Out_of_Range", "Format_Error", "Referential_Integrity",
                   "Late_Submission", "Coding_Error"]
GOV_FIELDS = ["patient_id", "encounter_date", "icd10_code", "total_charges", "performance_rate", "age", "zip_code"]
GOV_SEVERITIES = ["Low", "Medium", "High", "Critical"]
GOV_SOURCES = ["Epic", "Clarity", "Manual_Entry", "External_Feed"]
LAB_TESTS_ODD = {"click": "Diastolic_BP", "view": "INR", "purchase": "Hemoglobin", "signup": "Creatinine"}
LAB_TESTS = {"click": "HbA1c", "view": "LDL", "purchase": "Systolic_BP", "signup": "eGFR"}


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pick(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(values))
    return f"(CASE CAST({expr} AS INTEGER) {arms} END)"


def case_map(expr: str, mapping: dict, default: str) -> str:
    arms = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in mapping.items())
    return f"(CASE {expr} {arms} ELSE {_q(default)} END)"


def ident(prefix: str, expr: str, width: int) -> str:
    return f"('{prefix}' || printf('%0{width}d', {expr}))"


PATIENTS = f"""
SELECT {ident('PT', 'c_custkey', 6)} AS patient_id,
       CAST(18 + c_custkey % 77 AS INTEGER) AS age,
       CASE WHEN c_custkey % 50 = 0 THEN 'Other' WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex,
       CAST(CASE WHEN c_custkey % 89 = 0 THEN NULL ELSE 55901 + c_nationkey END AS INTEGER) AS zip_code,
       {pick('c_custkey % 8', DEPARTMENTS)} AS department,
       c_mktsegment AS insurance_type,
       CAST(c_custkey % 7 AS INTEGER) AS chronic_conditions,
       CASE WHEN c_nationkey % 4 = 0 THEN 'Clarity' ELSE 'Epic' END AS ehr_system
FROM customer"""

ENCOUNTERS = f"""
SELECT {ident('ENC', 'o_orderkey', 7)} AS encounter_id,
       CASE WHEN o_orderkey % 211 = 0 THEN {ident('PTX', 'o_orderkey', 7)} ELSE {ident('PT', 'o_custkey', 6)} END AS patient_id,
       CAST(o_orderdate AS DATE) AS encounter_date,
       {case_map('o_orderpriority', ENCOUNTER_TYPES, 'Observation')} AS encounter_type,
       CASE WHEN o_orderkey % 131 = 0 THEN NULL ELSE {pick('o_orderkey % 8', DEPARTMENTS)} END AS department,
       CAST((o_orderkey * 5 + o_custkey) % 61 AS DOUBLE) / 4 AS length_of_stay,
       {pick('o_custkey % 6', DISCHARGE_DISPOSITIONS)} AS discharge_disposition,
       CAST((o_orderkey * 7 + o_custkey) % 6 = 0 AS INTEGER) AS readmission_30d,
       CAST((o_orderkey + o_custkey) % 5 = 0 AS INTEGER) AS er_visit_flag,
       {pick('o_custkey % 10', ICD10_CODES)} AS primary_icd10,
       {ident('DR', 'o_orderkey % 150 + 1', 4)} AS attending_provider,
       o_totalprice AS total_charges
FROM orders"""

QUALITY_MEASURES = f"""
SELECT {pick('d', DEPARTMENTS)} AS department,
       {pick('m', MEASURES)} AS measure,
       quarter,
       ROUND(CAST(num AS DOUBLE) / den, 4) AS performance_rate,
       CAST(60 + (d * 5 + m * 3) % 14 AS DOUBLE) / 100 AS national_benchmark,
       ROUND(ROUND(CAST(num AS DOUBLE) / den, 4) - CAST(60 + (d * 5 + m * 3) % 14 AS DOUBLE) / 100, 4)
           AS gap_to_benchmark,
       CAST(den AS INTEGER) AS denominator,
       CAST(ROUND(ROUND(CAST(num AS DOUBLE) / den, 4) * den, 0)
            + CASE WHEN (d + m) % 9 = 4 AND quarter LIKE '%Q3' THEN 1 ELSE 0 END AS INTEGER) AS numerator
FROM (
    SELECT l_partkey % 8 AS d, l_suppkey % 8 AS m,
           CAST(YEAR(l_shipdate) AS VARCHAR) || '-Q' || CAST(QUARTER(l_shipdate) AS VARCHAR) AS quarter,
           COUNT(*) AS den,
           COUNT(CASE WHEN l_returnflag <> 'R' THEN 1 END) AS num
    FROM lineitem
    GROUP BY 1, 2, 3
) g"""


def _domain(k: int) -> str:
    overall = "(1 + FLOOR(l_quantity * 16 / 50) / 4)"
    return (f"LEAST(5.0, GREATEST(1.0, {overall} + "
            f"CAST((l_partkey * {k} + l_suppkey) % 5 - 2 AS DOUBLE) / 4))")


PATIENT_SURVEYS = f"""
SELECT {ident('SRV', 'l_orderkey * 10 + l_linenumber', 7)} AS survey_id,
       {ident('ENC', 'l_orderkey', 7)} AS encounter_id,
       CAST(l_shipdate AS DATE) AS survey_date,
       {_domain(1)} AS Communication_Nurses,
       {_domain(2)} AS Communication_Doctors,
       {_domain(3)} AS Responsiveness,
       CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE {_domain(4)} END AS Pain_Management,
       {_domain(5)} AS Medication_Communication,
       {_domain(6)} AS Discharge_Info,
       {_domain(7)} AS Hospital_Environment,
       CAST(1 + FLOOR(l_quantity * 16 / 50) / 4 AS DOUBLE) AS Overall_Rating,
       CAST((l_suppkey + l_linenumber) % 11 > 1 AS INTEGER) AS would_recommend,
       CAST(l_returnflag <> 'R' AS INTEGER) AS top_box_score
FROM lineitem"""

DATA_GOVERNANCE_LOG = f"""
SELECT {ident('DQ', 'l_orderkey * 10 + l_linenumber', 7)} AS issue_id,
       {pick('l_suppkey % 5', GOV_TABLES)} AS table_name,
       {pick('LEAST(6, l_partkey % 10)', GOV_ISSUE_TYPES)} AS issue_type,
       {pick('l_partkey % 7', GOV_FIELDS)} AS field_name,
       CAST(l_shipdate AS DATE) AS detected_date,
       CAST(l_shipdate AS DATE) + CAST((l_partkey + l_linenumber) % 31 AS INTEGER) AS resolved_date,
       CAST((l_partkey + l_linenumber) % 31 AS INTEGER) AS days_to_resolve,
       CASE WHEN (l_orderkey * 10 + l_linenumber) % 97 = 0 THEN NULL ELSE {pick('l_orderkey % 4', GOV_SEVERITIES)} END AS severity,
       CAST((l_suppkey + l_linenumber) % 8 <> 0 AS INTEGER) AS resolved_flag,
       {pick('(l_orderkey + l_linenumber) % 4', GOV_SOURCES)} AS source_system
FROM lineitem"""

LAB_RESULTS = f"""
SELECT {ident('LAB', 'event_id', 7)} AS lab_id,
       {ident('PT', 'user_id', 6)} AS patient_id,
       CASE WHEN event_id % 2 = 1 THEN {case_map('event_type', LAB_TESTS_ODD, 'HbA1c')}
            ELSE {case_map('event_type', LAB_TESTS, 'Creatinine')} END AS test_name,
       value AS result_value,
       CAST(ts AS DATE) AS result_date,
       CAST(value > 100 AS INTEGER) AS abnormal_flag,
       CAST(value > 200 AS INTEGER) AS critical_flag
FROM events"""

VIEWS = {
    "patients": PATIENTS,
    "encounters": ENCOUNTERS,
    "quality_measures": QUALITY_MEASURES,
    "patient_surveys": PATIENT_SURVEYS,
    "data_governance_log": DATA_GOVERNANCE_LOG,
    "lab_results": LAB_RESULTS,
}


def with_views(body: str, views: list[str] | None = None) -> str:
    """Prefix a query with the care-table CTEs it uses (all when not given)."""
    names = views or [v for v in VIEWS if v in body]
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in names)
    stripped = body.lstrip()
    if stripped[:4].upper() == "WITH":
        return f"WITH {ctes},\n{stripped[4:].lstrip()}"
    return f"WITH {ctes}\n{body}"
