"""Ordering operators: latest / top-k distinct keys, distributed global row
numbers and NTILE, running shares and period-over-period trends.

Unpartitioned windows (``Window.partitionBy()``) are used only on inputs whose
size is bounded by a dimension (departments, issue types, weeks); everything
that grows with the data goes through :mod:`carelens.operators.ranges`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens.operators.ranges import cumulative_counts, global_row_number, position

def latest_rows(df: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` equals the maximum ``key`` (a scalar subquery, evaluated once)."""
    return df.where(F.col(key) == df.agg(F.max(key)).scalar())


def top_distinct(df: DataFrame, key: str, n: int, descending: bool = True) -> DataFrame:
    """The ``n`` largest (or smallest) distinct values of ``key``: at most ``n`` rows,
    so it is safe to broadcast."""
    order = F.col(key).desc() if descending else F.col(key).asc()
    return F.broadcast(df.select(key).distinct().orderBy(order).limit(n))


def ntile_from_row_number(row_number: Column, n_rows: Column, k: int) -> Column:
    """NTILE(k) bucket of a 1-based row number among ``n_rows`` rows: the first
    ``n mod k`` buckets hold one row more, as the SQL window function does."""
    q = F.floor(n_rows / k)
    r = n_rows - q * k
    big = r * (q + 1)
    return F.when(row_number <= big, F.floor((row_number - 1) / (q + 1)) + 1) \
            .otherwise(r + F.floor((row_number - big - 1) / q) + 1).cast("int")


def ntile_global(df: DataFrame, k: int, order: list[str], name: str = "ntile") -> DataFrame:
    """Distributed ``NTILE(k) OVER (ORDER BY order)``, ascending with NULL first."""
    n = df.agg(F.count(F.lit(1))).scalar()
    numbered = global_row_number(df, order, name="_rn").withColumn("_n", n)  # one subquery, referenced once
    return numbered.withColumn(name, ntile_from_row_number(F.col("_rn"), F.col("_n"), k)).drop("_rn", "_n")


def first_of_lowest_ntile(df: DataFrame, k: int, value: str, tiebreak: list[str], limit: int,
                          join: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first ``limit`` rows of ``join(bucket 1)``, where bucket 1 is that of
    ``NTILE(k) OVER (ORDER BY value, tiebreak...)`` (ascending, NULL first), in
    that order. ``join`` adds columns and may drop rows.

    Bucket 1 is the first ceil(n / k) rows. The histogram of ``value`` gives the
    value t on which it ends and how many rows with exactly t belong to it. Rows
    below t belong to it for certain; of the rows at t only those that reach the
    top ``limit`` are ranked, by counting the rows at t that come before each of
    them. So no part of the table is numbered or sorted as a whole."""
    hist = df.groupBy(value).agg(F.count(F.lit(1)).alias("_c"))
    # NULL is the lowest value: (is not null, value) orders it first
    keyed = hist.select(F.struct(F.col(value).isNotNull().alias("known"), F.col(value).alias("v")).alias("_k"), "_c")
    size = F.ceil(F.col("_n") / F.lit(float(k)))
    cut = (cumulative_counts(keyed, "_k", ["_c"]).withColumn("_n", hist.agg(F.sum("_c")).scalar())
           .where(F.col("cum__c") >= size)
           .agg(F.min(F.struct("_k", (size - (F.col("cum__c") - F.col("_c"))).alias("room"))).alias("cut")))
    here = F.struct(F.col(value).isNotNull().alias("known"), F.col(value).alias("v"))
    low = df.withColumn("_cut", cut.scalar()).where(here <= F.col("_cut._k"))
    low = low.withColumn("_tie", here == F.col("_cut._k"))
    ranking = [F.col(c).asc_nulls_first() for c in [value, *tiebreak]]
    top = join(low).orderBy(*ranking).limit(limit)
    key = F.struct(*tiebreak)
    # at most ``limit`` rows in one array; every use of this subquery is the same one, which runs once
    packed = top.agg(F.collect_list(F.struct(*[F.col(c) for c in top.columns])).alias("_top"))
    own = F.array_sort(F.array_distinct(F.transform(F.filter("_top", lambda x: x["_tie"]),
                                                    lambda x: F.struct(*[x[c].alias(c) for c in tiebreak]))))
    packed = packed.select(F.struct("_top", own.alias("_own")).alias("_packed"))
    ties = low.where("_tie").withColumn("_packed", packed.scalar()).withColumn("_own", F.col("_packed._own"))
    before = (ties.groupBy(position(F.col("_own"), key, limit, strict=False).alias("_at"))
              .agg(F.count(F.lit(1)).alias("_c")))
    # at most limit + 1 rows: how many ties stand before the j-th of the top's keys
    counts = before.agg(F.array_sort(F.collect_list(F.struct("_at", "_c"))).alias("_counts"))
    rows = (counts.withColumn("_packed", packed.scalar())
            .select("_packed._own", "_counts", F.explode("_packed._top").alias("_row")).select("_own", "_counts", "_row.*"))
    ranked = rows.withColumn("_j", position(F.col("_own"), key, limit, strict=False) - 1)
    ahead = F.aggregate(F.filter("_counts", lambda x: x["_at"] <= F.col("_j")), F.lit(0).cast("long"),
                        lambda a, x: a + x["_c"])
    copy = F.row_number().over(Window.partitionBy("_tie", *tiebreak).orderBy(*[F.col(c) for c in tiebreak]))
    return (ranked.withColumn("_copy", copy)
                  .where(~F.col("_tie") | (ahead + F.col("_copy") <= F.col("_cut.room")))
                  .drop("_cut", "_tie", "_own", "_counts", "_j", "_copy").orderBy(*ranking))


def running_share(df: DataFrame, value: str, order: list[Column]) -> DataFrame:
    """Running total and cumulative percent of ``value`` along ``order``.
    For aggregated inputs only (one row per category)."""
    upto = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy()
    return (df.withColumn("cum_count", F.sum(value).over(upto))
              .withColumn("cum_pct", F.col("cum_count") / F.sum(value).over(total) * 100.0))


def lag_trend(df: DataFrame, value: str, keys: list[str], order: str,
              flat_tolerance: float = 0.0) -> DataFrame:
    """Previous value per series, delta and direction ('up' / 'flat' / 'down')."""
    w = Window.partitionBy(*keys).orderBy(order)
    prev = F.lag(value).over(w)
    delta = F.round(F.col(value) - F.col("prev_value"), 4)
    return (df.withColumn("prev_value", prev)
              .withColumn("delta", delta)
              .withColumn("trend_direction",
                          F.when(F.col("delta") > flat_tolerance, "up")
                           .when(F.col("delta") < -flat_tolerance, "down")
                           .when(F.col("delta").isNotNull(), "flat")))
