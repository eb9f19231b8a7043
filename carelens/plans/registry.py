"""Name -> analysis registry used by ``__spark_entry__`` and ``bench.py``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carelens.plans import eda, exports, governance, kpi, modeling, statistics, survey
from carelens.sources.adapters import care_tables

_PLANS = [
    kpi.kpi1_readmission_rate, kpi.kpi2_alos_variance, kpi.kpi3_measure_scorecard,
    kpi.kpi4_composite_score, kpi.kpi5_ed_utilization, kpi.kpi5_ed_rollup, kpi.kpi6_monthly_volume,
    governance.gov1_issue_summary, governance.gov2_sla_breach, governance.gov3_source_scorecard,
    governance.gov4_orphans, governance.gov5_completeness, governance.gov6_monthly_trend,
    governance.sla_compliance, governance.spc_weekly_issues, governance.pareto_issue_types,
    governance.quality_measure_derivation, governance.lab_reference_flags, governance.load_report,
    governance.csv_reject_report,
    survey.srv1_domain_summary, survey.srv2_topbox_by_quarter, survey.srv3_domain_correlation,
    survey.srv4_satisfaction_outcomes, survey.srv5_low_score_followup, survey.survey_domain_stats,
    survey.survey_monthly_trend, survey.survey_corr_matrix, survey.survey_quartile_outcomes,
    survey.survey_cms_submission,
    statistics.ttest_los_readmission, statistics.ttest_rating_readmission,
    statistics.pearson_rating_los, statistics.significance_pvalues, statistics.spearman_rating_los,
    eda.eda_describe, eda.eda_frequency, eda.eda_age_histogram, eda.eda_monthly_encounters,
    eda.eda_measure_heatmap, eda.eda_readmission_by_dept, eda.eda_measure_trend, eda.eda_lab_rates,
    eda.charges_quartiles, eda.lab_value_quartiles,
    exports.bi_quality_export, exports.qm_trend_direction, exports.hours_allocation, exports.bi_export_manifest,
    modeling.readmission_features, modeling.readmission_base_rate, modeling.readmission_split, modeling.readmission_cv_folds,
    modeling.readmission_cv_auc, modeling.readmission_model_auc,
    modeling.readmission_importance, modeling.readmission_permutation_importance, modeling.readmission_risk_tiers, modeling.readmission_roc,
    modeling.readmission_confusion, modeling.readmission_report,
    modeling.score_auc, modeling.score_roc, modeling.score_confusion, modeling.score_report,
    modeling.score_risk_tiers,
]


def _bind(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(care_tables(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: _bind(fn) for fn in _PLANS}
