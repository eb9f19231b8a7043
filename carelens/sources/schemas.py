"""Fixed schemas of the six care-quality tables and the small dimension tables.

Every table is read with an explicit StructType; nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import types as T

PATIENTS = T.StructType([
    T.StructField("patient_id", T.StringType()),
    T.StructField("age", T.IntegerType()),
    T.StructField("sex", T.StringType()),
    T.StructField("zip_code", T.IntegerType()),
    T.StructField("department", T.StringType()),
    T.StructField("insurance_type", T.StringType()),
    T.StructField("chronic_conditions", T.IntegerType()),
    T.StructField("ehr_system", T.StringType()),
])

ENCOUNTERS = T.StructType([
    T.StructField("encounter_id", T.StringType()),
    T.StructField("patient_id", T.StringType()),
    T.StructField("encounter_date", T.DateType()),
    T.StructField("encounter_type", T.StringType()),
    T.StructField("department", T.StringType()),
    T.StructField("length_of_stay", T.DoubleType()),
    T.StructField("discharge_disposition", T.StringType()),
    T.StructField("readmission_30d", T.IntegerType()),
    T.StructField("er_visit_flag", T.IntegerType()),
    T.StructField("primary_icd10", T.StringType()),
    T.StructField("attending_provider", T.StringType()),
    T.StructField("total_charges", T.DoubleType()),
])

QUALITY_MEASURES = T.StructType([
    T.StructField("department", T.StringType()),
    T.StructField("measure", T.StringType()),
    T.StructField("quarter", T.StringType()),
    T.StructField("performance_rate", T.DoubleType()),
    T.StructField("national_benchmark", T.DoubleType()),
    T.StructField("gap_to_benchmark", T.DoubleType()),
    T.StructField("denominator", T.IntegerType()),
    T.StructField("numerator", T.IntegerType()),
])

# Survey domains in table order (the last one is the overall rating).
SURVEY_DOMAINS = [
    "Communication_Nurses", "Communication_Doctors", "Responsiveness", "Pain_Management",
    "Medication_Communication", "Discharge_Info", "Hospital_Environment", "Overall_Rating",
]

PATIENT_SURVEYS = T.StructType(
    [T.StructField("survey_id", T.StringType()),
     T.StructField("encounter_id", T.StringType()),
     T.StructField("survey_date", T.DateType())]
    + [T.StructField(d, T.DoubleType()) for d in SURVEY_DOMAINS]
    + [T.StructField("would_recommend", T.IntegerType()),
       T.StructField("top_box_score", T.IntegerType())]
)

DATA_GOVERNANCE_LOG = T.StructType([
    T.StructField("issue_id", T.StringType()),
    T.StructField("table_name", T.StringType()),
    T.StructField("issue_type", T.StringType()),
    T.StructField("field_name", T.StringType()),
    T.StructField("detected_date", T.DateType()),
    T.StructField("resolved_date", T.DateType()),
    T.StructField("days_to_resolve", T.IntegerType()),
    T.StructField("severity", T.StringType()),
    T.StructField("resolved_flag", T.IntegerType()),
    T.StructField("source_system", T.StringType()),
])

LAB_RESULTS = T.StructType([
    T.StructField("lab_id", T.StringType()),
    T.StructField("patient_id", T.StringType()),
    T.StructField("test_name", T.StringType()),
    T.StructField("result_value", T.DoubleType()),
    T.StructField("result_date", T.DateType()),
    T.StructField("abnormal_flag", T.IntegerType()),
    T.StructField("critical_flag", T.IntegerType()),
])

TABLE_SCHEMAS = {
    "patients": PATIENTS,
    "encounters": ENCOUNTERS,
    "quality_measures": QUALITY_MEASURES,
    "patient_surveys": PATIENT_SURVEYS,
    "data_governance_log": DATA_GOVERNANCE_LOG,
    "lab_results": LAB_RESULTS,
}

TABLE_NAMES = list(TABLE_SCHEMAS)
