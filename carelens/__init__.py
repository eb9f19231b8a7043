"""carelens: care-quality analytics expressed as Spark DataFrame plans.

Layout
------
sources/    fixed schemas, dimension tables, adapters over the test tables, readers and sinks
functions/  column-expression helpers (dates, ratios, tiers, bins, p-values)
operators/  reusable DataFrame operators (rates, quality checks, windows, statistics,
            allocation, evaluation, model training)
plans/      the named analyses (KPI, governance, survey, EDA, statistics, modelling)
streaming/  Structured Streaming form of the governance alerting
"""

__all__ = ["session"]
