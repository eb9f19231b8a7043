"""Patient-survey analyses: domain scores, top-box rates, correlations,
satisfaction versus clinical outcomes, follow-up lists and the CMS summary.

Joins of surveys to encounters first reduce the surveys to ONE row per
encounter (counts per tier, rating sums) where the analysis only needs those;
partial aggregation runs map-side, so an encounter carrying a large share of all
surveys reaches the shuffle as one row per map task, and the aggregate's hash
partitioning on encounter_id is reused by the join: a single shuffle of the
survey side and a 1:1 join. Analyses that need the rating distribution
(quartiles, ranks) join the surveys themselves, also on one shuffle; a hot
encounter there is a skewed join, which AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.functions.dates import month_label, quarter_label
from carelens.functions.numeric import pct
from carelens.functions.sqlexpr import ident, stack, string
from carelens.functions.tiers import at_least, lookup
from carelens.operators.stats import (
    available_case_correlation, pairwise_correlation_matrix, quantile_bins,
)
from carelens.operators.windows import first_of_lowest_ntile
from carelens.sources.adapters import CareTables
from carelens.sources.dimensions import (
    ACCEPTABLE_SCORE, DOMAIN_MEAN_BANDS, SATISFACTION_QUARTILES, SATISFACTION_TIER_ELSE,
    SATISFACTION_TIERS, TOP_BOX_BANDS, TOP_BOX_THRESHOLD,
)
from carelens.sources.schemas import SURVEY_DOMAINS

OVERALL = "Overall_Rating"
ITEM_DOMAINS = SURVEY_DOMAINS[:-1]
SRV1_ALIASES = ["avg_comm_nurses", "avg_comm_doctors", "avg_responsiveness", "avg_pain_mgmt",
                "avg_med_comm", "avg_discharge_info", "avg_environment", "avg_overall"]


def weighted_avg(value: str, weight: str = "w"):
    """AVG(value) over the original rows when each row stands for ``weight`` rows."""
    v = F.col(value)
    return F.try_divide(F.sum(F.when(v.isNotNull(), F.col(weight) * v)),
                        F.sum(F.when(v.isNotNull(), F.col(weight))).cast("double"))


def rating_moments_per_encounter(t: CareTables, rating: str = OVERALL) -> DataFrame:
    """(encounter_id, n, sx, sxx) over the non-NULL ratings of each encounter."""
    x = F.col(rating)
    return (t.patient_surveys.where(x.isNotNull())
            .groupBy("encounter_id")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(x * x).alias("sxx")))


def srv1_domain_summary(t: CareTables) -> DataFrame:
    """One row: mean per domain, recommend share, stored top-box share, survey count."""
    s = t.patient_surveys
    return s.agg(*[F.round(F.avg(d), 2).alias(a) for d, a in zip(SURVEY_DOMAINS, SRV1_ALIASES)],
                 F.round(F.lit(100.0) * F.avg("would_recommend"), 1).alias("pct_would_recommend"),
                 F.round(F.lit(100.0) * F.avg("top_box_score"), 1).alias("top_box_pct"),
                 F.count(F.lit(1)).alias("total_surveys"))


def srv2_topbox_by_quarter(t: CareTables) -> DataFrame:
    """Responses, top-box and recommend rates, mean overall rating per survey quarter."""
    s = t.patient_surveys
    n = F.count(F.lit(1))
    return (s.groupBy(quarter_label("survey_date").alias("quarter"))
             .agg(n.alias("responses"),
                  pct(F.sum("top_box_score"), n, 1).alias("top_box_pct"),
                  pct(F.sum("would_recommend"), n, 1).alias("recommend_pct"),
                  F.round(F.avg(OVERALL), 2).alias("avg_overall_rating"))
             .orderBy("quarter"))


def srv3_domain_correlation(t: CareTables) -> DataFrame:
    """Correlation of each item domain with the overall rating (available-case means)."""
    return (available_case_correlation(t.patient_surveys, ITEM_DOMAINS, OVERALL)
            .orderBy(F.abs("correlation").desc()))


def srv4_satisfaction_outcomes(t: CareTables) -> DataFrame:
    """Inpatient outcomes (stay, readmission, charges) per satisfaction tier."""
    inpatient = (t.encounters_of("Inpatient")
                 .select("encounter_id", "length_of_stay", "readmission_30d", "total_charges"))
    tier = at_least(OVERALL, SATISFACTION_TIERS, SATISFACTION_TIER_ELSE)
    labels = [label for _, label in SATISFACTION_TIERS] + [SATISFACTION_TIER_ELSE]
    per_enc = (t.patient_surveys.groupBy("encounter_id")
               .agg(*[F.count(F.when(tier == lab, F.lit(1))).alias(f"w{i}") for i, lab in enumerate(labels)]))
    j = per_enc.join(inpatient, "encounter_id", "inner")
    # one row per (encounter, tier) with surveys in it
    long = j.select(F.explode(F.array(*[F.struct(F.lit(lab).alias("satisfaction_tier"),
                                                 F.col(f"w{i}").alias("w"))
                                        for i, lab in enumerate(labels)])).alias("k"),
                    "length_of_stay", "readmission_30d", "total_charges") \
            .select("k.*", "length_of_stay", "readmission_30d", "total_charges").where(F.col("w") > 0)
    return (long.groupBy("satisfaction_tier")
                .agg(F.sum("w").alias("n"),
                     F.round(weighted_avg("length_of_stay"), 2).alias("avg_los"),
                     F.round(F.lit(100.0) * weighted_avg("readmission_30d"), 1).alias("readmission_rate_pct"),
                     F.round(weighted_avg("total_charges"), 0).alias("avg_charges"))
                .orderBy(F.col("satisfaction_tier").desc()))


def srv5_low_score_followup(t: CareTables, cap: int = 200) -> DataFrame:
    """Surveys in the lowest overall-rating decile, with their encounter, first ``cap``.

    Ties are broken by survey and encounter id, which makes the list deterministic."""
    enc = t.encounters.select("encounter_id", "department", "encounter_type", "encounter_date",
                              "attending_provider")
    first = first_of_lowest_ntile(t.patient_surveys.select("survey_id", "encounter_id", OVERALL), 10, OVERALL,
                                  ["survey_id", "encounter_id"], cap,
                                  lambda s: s.join(enc, "encounter_id", "inner"))
    return first.select("survey_id", "encounter_id", OVERALL, "department", "encounter_type", "encounter_date",
                        "attending_provider", F.lit("FOLLOW_UP_REQUIRED").alias("action_flag"))


def _top_box_share_sql(d: str) -> str:
    """Share of rows with the score at or above the top-box threshold (NULL counts as not)."""
    return f"avg(CASE WHEN {ident(d)} >= {TOP_BOX_THRESHOLD} THEN 1.0D ELSE 0.0D END)"


def survey_domain_stats(t: CareTables) -> DataFrame:
    """Per domain: mean, sample sd, median (3 dp then 2 dp), top-box % (score >= 4.5,
    NULL counted as not top-box) and colour bands. One aggregate pass."""
    aggs = []
    for i, d in enumerate(SURVEY_DOMAINS):
        q = ident(d)
        aggs += [f"avg({q}) AS m{i}", f"stddev_samp({q}) AS s{i}", f"percentile({q}, 0.5) AS p{i}",
                 f"{_top_box_share_sql(d)} AS t{i}"]
    one = t.patient_surveys.selectExpr(*aggs)
    rows = [[string(d), str(i + 1), f"round(round(m{i}, 3), 2)", f"round(round(s{i}, 3), 2)",
             f"round(round(p{i}, 3), 2)", f"round(t{i} * 100, 2)"] for i, d in enumerate(SURVEY_DOMAINS)]
    stacked = one.selectExpr(stack(rows, ["domain", "domain_order", "mean", "std_dev", "median", "top_box_pct"]))
    return (stacked.withColumn("mean_band", at_least("mean", DOMAIN_MEAN_BANDS, "RED"))
                   .withColumn("top_box_band", at_least("top_box_pct", TOP_BOX_BANDS, "RED"))
                   .withColumn("meets_acceptable", F.col("mean") >= ACCEPTABLE_SCORE)
                   .orderBy("domain_order"))


def survey_monthly_trend(t: CareTables) -> DataFrame:
    """Mean overall rating, recommend share and survey count per month."""
    s = t.patient_surveys.where(F.col("survey_date").isNotNull())
    return (s.groupBy(month_label("survey_date").alias("month"))
             .agg(F.round(F.avg(OVERALL), 6).alias("overall"),
                  F.round(F.avg("would_recommend"), 6).alias("recommend"),
                  F.count("survey_id").alias("n"))
             .orderBy("month"))


def survey_corr_matrix(t: CareTables) -> DataFrame:
    """8 x 8 domain correlation matrix (pairwise complete), long form."""
    return pairwise_correlation_matrix(t.patient_surveys, SURVEY_DOMAINS)


def survey_quartile_outcomes(t: CareTables) -> DataFrame:
    """Inpatient stay and readmission per overall-rating quartile (qcut, right-closed).

    Surveys are first cut to those of the wanted encounters and then summed per
    encounter and rating on one shuffle by encounter; every reported quantity is
    additive per rating value, so edges (frequency-weighted exact percentiles)
    and bins are computed on one row per distinct rating."""
    inpatient = (t.encounters_of("Inpatient")
                 .where(F.col("readmission_30d").isNotNull() & F.col("length_of_stay").isNotNull())
                 .select("encounter_id", "length_of_stay", "readmission_30d"))
    rated = t.patient_surveys.where(F.col(OVERALL).isNotNull()).select("encounter_id", OVERALL, "survey_id")
    per_rating = (rated.join(inpatient, "encounter_id", "inner").groupBy(OVERALL)
                  .agg(F.count(F.lit(1)).alias("w"), F.sum("length_of_stay").alias("w_los"),
                       F.sum("readmission_30d").alias("w_readmit"), F.count("survey_id").alias("n_ids")))
    binned = quantile_bins(per_rating, OVERALL, SATISFACTION_QUARTILES, weight="w")
    order = lookup("sat_quartile", {lab: i + 1 for i, lab in enumerate(SATISFACTION_QUARTILES)})
    return (binned.groupBy(F.col("bin_label").alias("sat_quartile"))
                  .agg(F.round(F.sum("w_los") / F.sum("w"), 6).alias("avg_los"),
                       F.round(F.sum("w_readmit") / F.sum("w"), 6).alias("readmit_rate"),
                       F.sum("n_ids").alias("n"))
                  .orderBy(order))


def survey_cms_submission(t: CareTables) -> DataFrame:
    """CMS-style summary: Domain, Mean_Score, Top_Box_Pct, N_Responses (domain order)."""
    aggs = []
    for i, d in enumerate(SURVEY_DOMAINS):
        aggs += [f"avg({ident(d)}) AS m{i}", f"{_top_box_share_sql(d)} AS t{i}", f"count({ident(d)}) AS n{i}"]
    one = t.patient_surveys.selectExpr(*aggs)
    rows = [[string(d), str(i + 1), f"round(m{i}, 2)", f"round(t{i} * 100, 2)", f"n{i}"]
            for i, d in enumerate(SURVEY_DOMAINS)]
    stacked = one.selectExpr(stack(rows, ["Domain", "domain_order", "Mean_Score", "Top_Box_Pct", "N_Responses"]))
    return stacked.orderBy("domain_order").select("Domain", "Mean_Score", "Top_Box_Pct", "N_Responses")
