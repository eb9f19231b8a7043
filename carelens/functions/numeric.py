"""Ratio and rounding helpers.

Spark 4 runs with ANSI mode on, where ``x / 0`` raises; every ratio goes through
``try_divide`` so an empty denominator yields NULL, as the SQL forms do.
Literals are doubles (``F.lit(100.0)``) so results stay DOUBLE, never DECIMAL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num, den) -> Column:
    """num / den as DOUBLE, NULL when den is 0 or NULL."""
    return F.try_divide(_c(num).cast("double"), _c(den))


def pct(num, den, scale: int | None = None) -> Column:
    """100 * num / den, optionally rounded (half away from zero)."""
    v = F.try_divide(F.lit(100.0) * _c(num), _c(den))
    return F.round(v, scale) if scale is not None else v


def flag(cond: Column) -> Column:
    """Boolean condition as INT 0/1 (NULL stays NULL)."""
    return cond.cast("int")


def count_when(cond: Column) -> Column:
    """SUM(CASE WHEN cond THEN 1 ELSE 0 END): BIGINT, NULL over zero rows."""
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def round_clean(x, scale: int, guard: int = 8) -> Column:
    """Round a value derived from exact decimals (4-dp rates times 100, means of
    them) to ``scale`` digits after first rounding away binary noise at ``guard``
    digits, so 0.5385 * 100 (= 53.849999...) reports 53.9 as decimal
    arithmetic does."""
    return F.round(F.round(_c(x), guard), scale)
