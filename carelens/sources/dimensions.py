"""Dimension tables and thresholds used by the analyses.

Fixed values: the numbers and labels below define the reported results and are
kept exactly as the analyses specify them, in their natural order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

# ---------------------------------------------------------------- fixed values
DEPARTMENTS = [
    "Cardiology", "Oncology", "Neurology", "Orthopedics",
    "Primary Care", "Endocrinology", "Pulmonology", "Nephrology",
]

MEASURES = [
    "BP_Control", "HbA1c_Testing", "Colorectal_Screening", "Mammography",
    "Flu_Vaccine", "Statin_Therapy", "Readmission_Rate", "CAHPS_Composite",
]

# severity -> (SLA days, display order, severity weight)
SEVERITY = [
    ("Critical", 2, 1, 4),
    ("High", 7, 2, 3),
    ("Medium", 14, 3, 2),
    ("Low", 30, 4, 1),
]
SLA_DEFAULT_DAYS = 30

# test -> (lo, hi, mu, sd)
LAB_RANGES = [
    ("HbA1c", 4.0, 14.0, 5.7, 1.8),
    ("LDL", 40.0, 220.0, 105.0, 30.0),
    ("Systolic_BP", 80.0, 200.0, 128.0, 18.0),
    ("Diastolic_BP", 50.0, 120.0, 80.0, 12.0),
    ("eGFR", 5.0, 120.0, 75.0, 22.0),
    ("INR", 0.8, 4.0, 1.2, 0.5),
    ("Hemoglobin", 6.0, 18.0, 13.5, 2.0),
    ("Creatinine", 0.4, 6.0, 1.0, 0.5),
]
# abnormal: v < mu - 1*sd or v > mu + 2*sd; critical: v < 1.2*lo or v > 0.9*hi
LAB_ABNORMAL_LOW_SD = 1.0
LAB_ABNORMAL_HIGH_SD = 2.0
LAB_CRITICAL_LOW_FACTOR = 1.2
LAB_CRITICAL_HIGH_FACTOR = 0.9

# readmission benchmark status on the rate in percent (upper bounds, inclusive)
READMISSION_STATUS = [(15.0, "MEETS BENCHMARK"), (18.0, "NEAR BENCHMARK")]
READMISSION_STATUS_ELSE = "BELOW BENCHMARK"
READMISSION_BENCHMARK_RATE = 0.15

# measure tier on gap_to_benchmark (lower bounds, inclusive)
MEASURE_TIERS = [(0.05, "⭐ EXCEEDS"), (0.0, "✓ MEETS"), (-0.05, "⚠ NEAR MISS")]
MEASURE_TIER_ELSE = "✗ BELOW"

# source grade: (max weighted severity, exclusive; min resolution rate %, inclusive)
SOURCE_GRADES = [(1.5, 90.0, "A"), (2.0, 80.0, "B"), (2.5, 70.0, "C")]
SOURCE_GRADE_ELSE = "D"

# survey satisfaction tier on Overall_Rating (lower bounds, inclusive)
SATISFACTION_TIERS = [(4.5, "High Satisfaction (4.5-5.0)"), (3.5, "Mid Satisfaction (3.5-4.4)")]
SATISFACTION_TIER_ELSE = "Low Satisfaction (<3.5)"

# right-closed bins (lo, hi] with labels
AGE_GROUPS = [(0, 40, "<40"), (40, 60, "40-60"), (60, 75, "60-75"), (75, 120, "75+")]
RISK_TIERS = [
    (0.0, 0.10, "Low (<10%)"),
    (0.10, 0.20, "Moderate (10-20%)"),
    (0.20, 0.35, "High (20-35%)"),
    (0.35, 1.0, "Very High (>35%)"),
]
SATISFACTION_QUARTILES = ["Q1 (Low)", "Q2", "Q3", "Q4 (High)"]

TOP_BOX_THRESHOLD = 4.5
DOMAIN_MEAN_BANDS = [(3.8, "GREEN"), (3.4, "AMBER")]   # else RED
TOP_BOX_BANDS = [(40.0, "GREEN"), (25.0, "AMBER")]     # else RED
ACCEPTABLE_SCORE = 3.5

SLA_BREACH_ALERT_PCT = 20.0
PARETO_CUTOFF_PCT = 80.0
SPC_SIGMA = 3.0
SIGNIFICANCE_ALPHA = 0.05
CLASSIFICATION_THRESHOLD = 0.5

# analyst-hour allocation: weekly budget and per-department bounds
ALLOCATION_BUDGET = 200.0
ALLOCATION_MIN_HOURS = 15.0
ALLOCATION_MAX_HOURS = 40.0

# measures followed in the quarterly trend view
TREND_MEASURES = ["BP_Control", "HbA1c_Testing", "Readmission_Rate"]
# ------------------------------------------------------------ end fixed values


def severity_dim(spark: SparkSession) -> DataFrame:
    """Four-row severity dimension: SLA days, display order and weight."""
    schema = T.StructType([
        T.StructField("severity", T.StringType()),
        T.StructField("sla_days", T.IntegerType()),
        T.StructField("severity_order", T.IntegerType()),
        T.StructField("severity_weight", T.IntegerType()),
    ])
    return spark.createDataFrame(SEVERITY, schema)


def lab_range_dim(spark: SparkSession) -> DataFrame:
    """Eight-row reference-range dimension."""
    schema = T.StructType([
        T.StructField("test_name", T.StringType()),
        T.StructField("range_lo", T.DoubleType()),
        T.StructField("range_hi", T.DoubleType()),
        T.StructField("range_mu", T.DoubleType()),
        T.StructField("range_sd", T.DoubleType()),
    ])
    return spark.createDataFrame(LAB_RANGES, schema)
