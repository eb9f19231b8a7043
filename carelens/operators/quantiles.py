"""Exact quantiles of a column with an unbounded domain, per group, by distributed selection.

The (group, value) histogram is dealt into key ranges with the counts before each
range. A wanted rank then lies in one known range; only the ranges that hold one
are sorted, the others are dropped by their counts. No task ever holds all
values of a group, so one department with a third of all rows needs no more room
than any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from carelens.operators.ranges import with_range


def exact_quantiles(df: DataFrame, groups: list[str], value: str, probs: list[float], n_ranges: int | None = None) -> DataFrame:
    """(groups, n, quantiles): exact quantiles with linear interpolation between the two
    neighbouring ranks, in the order of ``probs``; NULL values (and NaN) don't count, NULL
    groups are groups. Groups without a value are absent."""
    x = F.col(value).cast("double")
    key = F.struct(*[F.struct(F.col(g).isNotNull().alias("known"), F.col(g).alias("v")).alias(g) for g in groups], x.alias("_x"))
    hist = (df.where(x.isNotNull() & ~F.isnan(x)).groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_c")))
    group = F.struct(*[F.col(f"_key.{g}").alias(g) for g in groups]) if groups else F.lit(0)
    ranged = with_range(hist, F.col("_key"), [F.sum("_c")], n_ranges, after=True).withColumn("_g", group)

    # ranks are counted over all groups in key order; a group starts after those before it
    sizes = hist.groupBy(group.alias("_g")).agg(F.sum("_c").alias("n"))
    starts = with_range(sizes, F.col("_g"), [F.sum("n")], n_ranges)
    run = Window.partitionBy("_range").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("_g", "n", (F.get("_before", F.lit(0)) + F.coalesce(F.sum("n").over(run), F.lit(0))).alias("_start"))
    at = [(F.col("n") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array(*[F.col("_start") + f(a).cast("bigint") for a in at for f in (F.floor, F.ceil)])
    starts = starts.withColumn("_wanted", wanted)

    here = ranged.join(starts, "_g").where(F.exists("_wanted", lambda w: (w >= F.get("_before", F.lit(0))) & (
        F.col("_after").isNull() | (w < F.get("_after", F.lit(0))))))
    # a group's rows of a range begin where the range or the group does, whichever is later
    frame = Window.partitionBy("_range", "_g").orderBy("_key").rowsBetween(Window.unboundedPreceding, 0)
    cum = F.greatest(F.get("_before", F.lit(0)), F.col("_start")) + F.sum("_c").over(frame)
    found = here.withColumn("_last", cum)
    inside = lambda w: (w >= F.col("_last") - F.col("_c")) & (w < F.col("_last"))
    picks = []
    for i in range(2 * len(probs)):
        picks.append(F.max(F.when(inside(F.get("_wanted", F.lit(i))), F.col("_key._x"))).alias(f"_p{i}"))
    one = found.groupBy("_g", "n").agg(*picks)
    out = []
    for i, p in enumerate(probs):
        h = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"_p{2 * i}"), F.col(f"_p{2 * i + 1}")
        out.append(low + (high - low) * (h - F.floor(h)))
    return one.select(*[F.col(f"_g.{g}.v").alias(g) for g in groups], "n", F.array(*out).alias("quantiles"))
