"""The six care-quality tables as views over the driver's test tables.

The test data is a TPC-H-like star schema; each care table is a narrow,
column-pruned projection of one source table (``quality_measures`` is an
aggregate over ``lineitem``). Ids are zero-padded to a minimum width but never
truncated, so keys stay unique at any scale.

NULLs, orphan encounters and repeated survey ids are injected on purpose so
the null and integrity rules of the analyses are exercised.
"""

from __future__ import annotations

import datetime as _dt
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.functions.dates import quarter_label
from carelens.functions.tiers import lookup
from carelens.sources.dimensions import DEPARTMENTS, MEASURES

# Fixed values of the mapping from the test tables.
DISCHARGE_DISPOSITIONS = ["Home", "SNF", "Rehab", "AMA", "Expired", "Transferred"]
ICD10_CODES = ["I10", "E11", "J18", "M79", "Z12", "I25", "N18", "C34", "F32", "G20"]
ENCOUNTER_TYPE_BY_PRIORITY = {
    "1-URGENT": "Inpatient", "2-HIGH": "ED", "3-MEDIUM": "Outpatient",
    "4-NOT SPECIFIED": "Telehealth",
}
ENCOUNTER_TYPE_ELSE = "Observation"
GOV_TABLES = ["patients", "encounters", "quality_measures", "patient_surveys", "lab_results"]
GOV_ISSUE_TYPES = ["Missing_Value", "Duplicate_Record", "Out_of_Range", "Format_Error",
                   "Referential_Integrity", "Late_Submission", "Coding_Error"]
GOV_FIELDS = ["patient_id", "encounter_date", "icd10_code", "total_charges",
              "performance_rate", "age", "zip_code"]
GOV_SEVERITIES = ["Low", "Medium", "High", "Critical"]
GOV_SOURCES = ["Epic", "Clarity", "Manual_Entry", "External_Feed"]
LAB_TEST_BY_EVENT = {"click": "HbA1c", "view": "LDL", "purchase": "Systolic_BP", "signup": "eGFR"}
LAB_TEST_ELSE = "Creatinine"
LAB_TEST_BY_EVENT_ODD = {"click": "Diastolic_BP", "view": "INR", "purchase": "Hemoglobin", "signup": "Creatinine"}
LAB_TEST_ELSE_ODD = "HbA1c"      # events with an odd id
ORPHAN_PREFIX = "PTX"       # ids outside the patient key space, one per orphan order
ORPHAN_EVERY = 211          # every 211th order points at a missing patient
AS_OF = _dt.date(2001, 8, 1)   # trailing windows over the test data end here
NULL_ZIP_EVERY = 89         # every 89th customer has no zip code
NULL_PAIN_EVERY = 53        # every 53rd part leaves Pain_Management empty
NULL_DEPARTMENT_EVERY = 131  # every 131st order names no department
NULL_SEVERITY_EVERY = 97    # every 97th issue has no severity


def _pick(idx: Column, values: list[str]) -> Column:
    return lookup(idx.cast("int"), dict(enumerate(values)))


def _id(prefix: str, key: Column, width: int) -> Column:
    """``prefix`` and the key, padded with zeros to a least width, never cut."""
    text = key.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text))


def _flag(cond: Column) -> Column:
    return cond.cast("int")


def patients_from(customer: DataFrame) -> DataFrame:
    k = F.col("c_custkey")
    return customer.select(
        _id("PT", k, 6).alias("patient_id"),
        (F.lit(18) + k % 77).cast("int").alias("age"),
        F.when(k % 50 == 0, "Other").when(k % 2 == 0, "M").otherwise("F").alias("sex"),
        F.when(k % NULL_ZIP_EVERY == 0, F.lit(None))
         .otherwise(F.lit(55901) + F.col("c_nationkey")).cast("int").alias("zip_code"),
        _pick(k % 8, DEPARTMENTS).alias("department"),
        F.col("c_mktsegment").alias("insurance_type"),
        (k % 7).cast("int").alias("chronic_conditions"),
        F.when(F.col("c_nationkey") % 4 == 0, "Clarity").otherwise("Epic").alias("ehr_system"),
    )


def encounters_from(orders: DataFrame) -> DataFrame:
    ok, ck = F.col("o_orderkey"), F.col("o_custkey")
    return orders.select(
        _id("ENC", ok, 7).alias("encounter_id"),
        F.when(ok % ORPHAN_EVERY == 0, _id(ORPHAN_PREFIX, ok, 7))
         .otherwise(_id("PT", ck, 6)).alias("patient_id"),
        F.col("o_orderdate").cast("date").alias("encounter_date"),
        lookup("o_orderpriority", ENCOUNTER_TYPE_BY_PRIORITY, ENCOUNTER_TYPE_ELSE).alias("encounter_type"),
        F.when(ok % NULL_DEPARTMENT_EVERY != 0, _pick(ok % 8, DEPARTMENTS)).alias("department"),
        (((ok * 5 + ck) % 61).cast("double") / 4).alias("length_of_stay"),
        _pick(ck % 6, DISCHARGE_DISPOSITIONS).alias("discharge_disposition"),
        _flag((ok * 7 + ck) % 6 == 0).alias("readmission_30d"),
        _flag((ok + ck) % 5 == 0).alias("er_visit_flag"),
        _pick(ck % 10, ICD10_CODES).alias("primary_icd10"),
        _id("DR", ok % 150 + 1, 4).alias("attending_provider"),
        F.col("o_totalprice").alias("total_charges"),
    )


def quality_measures_from(lineitem: DataFrame) -> DataFrame:
    """Aggregate of lineitem per (part class, supplier class, ship quarter).
    Partial aggregation runs before the shuffle; the result is tiny."""
    d, m = F.col("l_partkey") % 8, F.col("l_suppkey") % 8
    grouped = (lineitem
               .groupBy(d.alias("d"), m.alias("m"), quarter_label(F.col("l_shipdate").cast("date")).alias("quarter"))
               .agg(F.count(F.lit(1)).alias("den"),
                    F.count(F.when(F.col("l_returnflag") != "R", F.lit(1))).alias("num")))
    rate = F.round(F.col("num").cast("double") / F.col("den"), 4)
    bench = (F.lit(60) + (F.col("d") * 5 + F.col("m") * 3) % 14).cast("double") / 100
    return grouped.select(
        _pick(F.col("d"), DEPARTMENTS).alias("department"),
        _pick(F.col("m"), MEASURES).alias("measure"),
        F.col("quarter"),
        rate.alias("performance_rate"),
        bench.alias("national_benchmark"),
        F.round(rate - bench, 4).alias("gap_to_benchmark"),
        F.col("den").cast("int").alias("denominator"),
        # by the rule of the derivation check, with an error in one cell in nine of each third quarter
        (F.round(rate * F.col("den"), 0)
         + F.when(((F.col("d") + F.col("m")) % 9 == 4) & F.col("quarter").endswith("Q3"), 1).otherwise(0))
        .cast("int").alias("numerator"),
    )


def patient_surveys_from(lineitem: DataFrame) -> DataFrame:
    pk, sk, ln = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    overall = F.lit(1.0) + F.floor(F.col("l_quantity") * 16 / 50) / 4
    domains = []
    names = ["Communication_Nurses", "Communication_Doctors", "Responsiveness", "Pain_Management",
             "Medication_Communication", "Discharge_Info", "Hospital_Environment"]
    for k, name in enumerate(names, start=1):
        v = F.least(F.lit(5.0), F.greatest(F.lit(1.0), overall + ((pk * k + sk) % 5 - 2).cast("double") / 4))
        if name == "Pain_Management":
            v = F.when(pk % NULL_PAIN_EVERY == 0, F.lit(None).cast("double")).otherwise(v)
        domains.append(v.alias(name))
    return lineitem.select(
        _id("SRV", F.col("l_orderkey") * 10 + ln, 7).alias("survey_id"),
        _id("ENC", F.col("l_orderkey"), 7).alias("encounter_id"),
        F.col("l_shipdate").cast("date").alias("survey_date"),
        *domains,
        overall.alias("Overall_Rating"),
        _flag((sk + ln) % 11 > 1).alias("would_recommend"),
        _flag(F.col("l_returnflag") != "R").alias("top_box_score"),
    )


def governance_log_from(lineitem: DataFrame) -> DataFrame:
    ok, pk, sk, ln = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    detected = F.col("l_shipdate").cast("date")
    days = ((pk + ln) % 31).cast("int")
    return lineitem.select(
        _id("DQ", ok * 10 + ln, 7).alias("issue_id"),
        _pick(sk % 5, GOV_TABLES).alias("table_name"),
        _pick(F.least(F.lit(6), pk % 10), GOV_ISSUE_TYPES).alias("issue_type"),
        _pick(pk % 7, GOV_FIELDS).alias("field_name"),
        detected.alias("detected_date"),
        F.date_add(detected, days).alias("resolved_date"),
        days.alias("days_to_resolve"),
        F.when((ok * 10 + ln) % NULL_SEVERITY_EVERY != 0, _pick(ok % 4, GOV_SEVERITIES)).alias("severity"),
        _flag((sk + ln) % 8 != 0).alias("resolved_flag"),
        _pick((ok + ln) % 4, GOV_SOURCES).alias("source_system"),
    )


def lab_results_from(events: DataFrame) -> DataFrame:
    v = F.col("value")
    return events.select(
        _id("LAB", F.col("event_id"), 7).alias("lab_id"),
        _id("PT", F.col("user_id"), 6).alias("patient_id"),
        F.when(F.col("event_id") % 2 == 1, lookup("event_type", LAB_TEST_BY_EVENT_ODD, LAB_TEST_ELSE_ODD))
         .otherwise(lookup("event_type", LAB_TEST_BY_EVENT, LAB_TEST_ELSE)).alias("test_name"),
        v.alias("result_value"),
        F.col("ts").cast("date").alias("result_date"),
        _flag(v > 100).alias("abnormal_flag"),
        _flag(v > 200).alias("critical_flag"),
    )


@dataclass
class CareTables:
    """Lazily built DataFrames of the six care tables for one data folder.

    ``as_of`` ends the trailing windows: by default the last day of the test
    data, and today for stored tables."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    stored: bool = False     # True: sf_dir holds the six care tables written by ``ingest``
    as_of: _dt.date | None = None
    given: set = field(default_factory=set)     # tables that a caller put in itself

    def __post_init__(self):
        if self.as_of is None:
            self.as_of = _dt.date.today() if self.stored else AS_OF

    def put(self, **frames: DataFrame) -> None:
        """Use these DataFrames as the named care tables."""
        self._cache.update(frames)
        self.given.update(frames)

    def _src(self, name: str, cols: list[str]) -> DataFrame:
        return self.spark.read.parquet(os.path.join(self.sf_dir, f"{name}.parquet")).select(*cols)

    def _get(self, key, build):
        if key not in self._cache:
            if self.stored:
                from carelens.sources.io import read_parquet_table
                self._cache[key] = read_parquet_table(self.spark, os.path.join(self.sf_dir, key), key)
            else:
                self._cache[key] = build()
        return self._cache[key]

    @property
    def patients(self) -> DataFrame:
        return self._get("patients", lambda: patients_from(
            self._src("customer", ["c_custkey", "c_nationkey", "c_mktsegment"])))

    @property
    def encounters(self) -> DataFrame:
        return self._get("encounters", lambda: encounters_from(
            self._src("orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])))

    def encounters_of(self, kind: str) -> DataFrame:
        """Encounters of one type. The type is mapped from a stored column, so the
        filter goes on that column, where the Parquet scan can use it."""
        if self.stored or "encounters" in self.given:
            return self.encounters.where(F.col("encounter_type") == kind)
        orders = self._src("orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
        priority = F.col("o_orderpriority")
        known = [k for k, v in ENCOUNTER_TYPE_BY_PRIORITY.items() if v == kind]
        if kind == ENCOUNTER_TYPE_ELSE:
            orders = orders.where(priority.isNull() | ~priority.isin(*ENCOUNTER_TYPE_BY_PRIORITY))
        else:
            orders = orders.where(priority == known[0] if len(known) == 1 else priority.isin(*known))
        return encounters_from(orders)

    @property
    def quality_measures(self) -> DataFrame:
        """A small aggregate (departments x measures x quarters) of the line items;
        ``ingest`` stores it as a table of its own."""
        return self._get("quality_measures", lambda: quality_measures_from(
            self._src("lineitem", ["l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"])))

    @property
    def patient_surveys(self) -> DataFrame:
        return self._get("patient_surveys", lambda: patient_surveys_from(
            self._src("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                   "l_quantity", "l_returnflag", "l_shipdate"])))

    @property
    def data_governance_log(self) -> DataFrame:
        return self._get("data_governance_log", lambda: governance_log_from(
            self._src("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"])))

    @property
    def lab_results(self) -> DataFrame:
        return self._get("lab_results", lambda: lab_results_from(
            self._src("events", ["event_id", "ts", "user_id", "event_type", "value"])))

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)


_REGISTRY: dict[tuple, CareTables] = {}


def care_tables(spark: SparkSession, sf_dir: str, refresh: bool = False, stored: bool = False,
                as_of: _dt.date | None = None) -> CareTables:
    """The care tables of one data folder, defined once per session (like tables
    registered in a catalog). Only the lazy plans are kept, no data; pass
    ``refresh=True`` to re-list the folder after its files changed. With
    ``stored=True`` the folder holds the six tables written by ``ingest``."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir, stored, as_of)
    if refresh or key not in _REGISTRY:
        _REGISTRY[key] = CareTables(spark, sf_dir, stored=stored, as_of=as_of)
    return _REGISTRY[key]


def bucketed_tables(spark: SparkSession, prefix: str, names: list[str], as_of: _dt.date | None = None) -> CareTables:
    """The care tables that ``ingest_bucketed`` saved under ``prefix``."""
    tables = CareTables(spark, prefix, stored=True, as_of=as_of)
    tables.put(**{n: spark.table(f"{prefix}{n}") for n in names})
    return tables
