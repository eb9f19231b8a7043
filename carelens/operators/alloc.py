"""Bounded budget allocation.

Maximise sum(rate_i * h_i) subject to sum(h_i) = budget and lo <= h_i <= hi.
With a single equality budget and box bounds the optimum is greedy: every item
gets ``lo``, then the remaining budget fills items in descending rate order up
to ``hi``. That closed form is a window over each group (a group is one
planning period, at most one row per department), so any number of periods is
solved in parallel with no solver and no driver round trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bounded_allocation(df: DataFrame, group_cols: list[str], item_col: str, rate_col: str,
                       budget: float, lo: float, hi: float) -> DataFrame:
    """Add ``alloc_rank``, ``feasible`` and ``hours`` (NULL when the budget cannot
    be met within the bounds). Ties in rate go to the smaller item key."""
    group = Window.partitionBy(*group_cols)
    ordered = group.orderBy(F.col(rate_col).desc(), F.col(item_col).asc())
    n = F.count(F.lit(1)).over(group)
    rank = F.row_number().over(ordered)
    feasible = (F.lit(budget) >= F.lit(lo) * n) & (F.lit(budget) <= F.lit(hi) * n)
    extra = F.greatest(F.lit(0.0),
                       F.least(F.lit(hi - lo), F.lit(budget) - F.lit(lo) * n - F.lit(hi - lo) * (rank - 1)))
    return (df.withColumn("alloc_rank", rank)
              .withColumn("feasible", feasible)
              .withColumn("hours", F.when(F.col("feasible"), F.lit(lo) + extra)))
