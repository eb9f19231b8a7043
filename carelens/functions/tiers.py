"""Tier, band and bin expressions built from the dimension lists.

They compile to CASE WHEN chains, so lookups against the small fixed dimensions
cost no join and stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lookup(col, mapping: Mapping, default=None) -> Column:
    """Dictionary lookup ``CASE col WHEN k THEN v ... ELSE default END``."""
    col = _c(col)
    expr = None
    for k, v in mapping.items():
        expr = (F.when(col == F.lit(k), F.lit(v)) if expr is None
                else expr.when(col == F.lit(k), F.lit(v)))
    if expr is None:
        return F.lit(default)
    return expr.otherwise(F.lit(default)) if default is not None else expr


def at_least(col, bands: Iterable[tuple], otherwise: str) -> Column:
    """First band whose lower bound ``col >= lo`` holds; bands in descending order.
    NULL input falls to ``otherwise`` (as a SQL CASE with ELSE does)."""
    col = _c(col)
    expr = None
    for lo, label in bands:
        cond = col >= F.lit(lo)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise))


def at_most(col, bands: Iterable[tuple], otherwise: str) -> Column:
    """First band whose upper bound ``col <= hi`` holds; bands in ascending order."""
    col = _c(col)
    expr = None
    for hi, label in bands:
        cond = col <= F.lit(hi)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(otherwise))


def right_closed_bins(col, bins: Iterable[tuple]) -> Column:
    """Label of the bin ``lo < col <= hi``; NULL outside every bin (pd.cut semantics)."""
    col = _c(col)
    expr = None
    for lo, hi, label in bins:
        cond = (col > F.lit(lo)) & (col <= F.lit(hi))
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr


def bin_order(col, bins: Iterable[tuple]) -> Column:
    """1-based position of the label produced by :func:`right_closed_bins`."""
    return lookup(col, {label: i + 1 for i, (_, _, label) in enumerate(bins)})
