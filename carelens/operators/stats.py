"""Statistical operators as one-pass aggregates.

Each operator reduces its input with built-in aggregate functions (partial
aggregation before the shuffle, one row or one row per group out), then
derives the statistic with column arithmetic. The ``*_from_sums`` forms take
partial sums per row, so inputs can be pre-aggregated per join key before a
join (one row per key) and the statistic still comes out exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carelens.functions.numeric import ratio
from carelens.functions.sqlexpr import ident as _q, stack as _stack_sql, string as _lit

_REL_EPS = 1e-12


def _clamp_unit(r: Column) -> Column:
    """Clamp rounding overshoot into [-1, 1]; NULL stays NULL (least/greatest skip NULLs)."""
    return F.when(r.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r)))


def control_limits(df: DataFrame, value: str, sigma: float = 3.0, scale: int = 4) -> DataFrame:
    """Shewhart limits mean +/- sigma * sd (sample sd) over all rows of an
    aggregated series (one row per period: the window is bounded by them); LCL
    floored at 0; strict out-of-control test."""
    every = Window.partitionBy()
    base = (df.withColumn("_m", F.avg(value).over(every)).withColumn("_sd", F.stddev_samp(value).over(every)))
    mean, sd = F.col("_m"), F.col("_sd")
    ucl = mean + F.lit(sigma) * sd
    lcl = F.greatest(F.lit(0.0), mean - F.lit(sigma) * sd)
    v = F.col(value)
    return base.select(*df.columns,
                       F.round(mean, scale).alias("mean_value"),
                       F.round(sd, scale).alias("sd_value"),
                       F.round(ucl, scale).alias("ucl"),
                       F.round(lcl, scale).alias("lcl"),
                       F.coalesce((v > ucl) | (v < lcl), F.lit(False)).alias("out_of_control"))


def ttest_from_sums(df: DataFrame, group: str, n: str, s: str, q: str, scale: int = 4) -> DataFrame:
    """Pooled-variance two-sample t statistic from per-row partial sums
    (n = count, s = sum of x, q = sum of x^2) of group = 1 against group = 0.

    Rows may be pre-aggregated (e.g. one row per encounter); the statistic only
    needs the three sums per group. One row: n_1, n_0, mean_1, mean_0, t_stat, dof;
    a group with fewer than two values gives a NULL statistic."""
    sums = []
    for g in (1, 0):
        inside = F.col(group) == g
        sums += [F.sum(F.when(inside, F.col(n))).alias(f"n{g}"),
                 F.sum(F.when(inside, F.col(s))).alias(f"s{g}"),
                 F.sum(F.when(inside, F.col(q))).alias(f"q{g}")]
    m = df.agg(*sums)
    for g in (1, 0):
        cn, cs, cq = F.col(f"n{g}").cast("double"), F.col(f"s{g}"), F.col(f"q{g}")
        m = m.withColumn(f"mean{g}", ratio(cs, cn)) \
             .withColumn(f"var{g}", F.try_divide(cq - cs * cs / cn, cn - 1))
    n1 = F.coalesce(F.col("n1"), F.lit(0)).cast("double")
    n0 = F.coalesce(F.col("n0"), F.lit(0)).cast("double")
    dof = n1 + n0 - 2
    sp2 = F.try_divide((n1 - 1) * F.col("var1") + (n0 - 1) * F.col("var0"), dof)
    t = F.try_divide(F.col("mean1") - F.col("mean0"), F.sqrt(sp2 * (F.lit(1.0) / n1 + F.lit(1.0) / n0)))
    return m.select(n1.cast("bigint").alias("n_1"), n0.cast("bigint").alias("n_0"),
                    F.round("mean1", scale).alias("mean_1"), F.round("mean0", scale).alias("mean_0"),
                    F.round(t, scale).alias("t_stat"), dof.cast("bigint").alias("dof"))


def pooled_ttest(df: DataFrame, value: str, group: str, scale: int = 4) -> DataFrame:
    """Pooled-variance t statistic of ``value`` between group = 1 and group = 0 (NULLs left out)."""
    x = F.col(value)
    rows = df.where(x.isNotNull()).select(group, F.lit(1).alias("_n"), x.alias("_s"), (x * x).alias("_q"))
    return ttest_from_sums(rows, group, "_n", "_s", "_q", scale)


def pearson_from_sums(df: DataFrame, n: str, sx: str, sy: str, sxx: str, syy: str, sxy: str,
                      scale: int = 4) -> DataFrame:
    """Pearson r from partial sums over complete pairs, with n and the t statistic
    t = r * sqrt((n - 2) / (1 - r^2)). One row: n, r, t_stat, dof."""
    m = df.agg(*[F.sum(c).alias(a) for c, a in
                 [(n, "n"), (sx, "sx"), (sy, "sy"), (sxx, "sxx"), (syy, "syy"), (sxy, "sxy")]])
    cn, csx, csy = F.col("n").cast("double"), F.col("sx"), F.col("sy")
    cov = F.col("sxy") - csx * csy / cn
    vx, vy = F.col("sxx") - csx * csx / cn, F.col("syy") - csy * csy / cn
    r = F.try_divide(cov, F.sqrt(vx * vy))
    m = m.withColumn("r", _clamp_unit(r))
    t = F.col("r") * F.sqrt(F.try_divide(cn - 2, F.lit(1.0) - F.col("r") * F.col("r")))
    n0 = F.coalesce(F.col("n"), F.lit(0)).cast("bigint")
    return m.select(n0.alias("n"), F.round("r", scale).alias("r"), F.round(t, scale).alias("t_stat"),
                    (n0 - 2).alias("dof"))


def pearson(df: DataFrame, x: str, y: str, scale: int = 4) -> DataFrame:
    """Pearson r of two columns over rows where both are present."""
    cx, cy = F.col(x), F.col(y)
    rows = df.where(cx.isNotNull() & cy.isNotNull()).select(
        F.lit(1).alias("_n"), cx.alias("_sx"), cy.alias("_sy"), (cx * cx).alias("_sxx"),
        (cy * cy).alias("_syy"), (cx * cy).alias("_sxy"))
    return pearson_from_sums(rows, "_n", "_sx", "_sy", "_sxx", "_syy", "_sxy", scale)


def average_ranks(df: DataFrame, columns: list[str], weight: str) -> DataFrame:
    """(column, value, rank) of each distinct non-NULL value of each of the columns: its
    average 1-based rank among the weighted rows (ties share the mean of their ranks),
    plus the rows of the columns before it in the list, a constant that no
    correlation sees. The histograms of all columns are cumulated in one go, without
    a global sort of rows."""
    from carelens.operators.ranges import cumulative_counts
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("column"), F.col(c).cast("double").alias("value"), F.col(weight).alias("_c"))
                                for i, c in enumerate(columns)]))
    hist = (df.select(cells.alias("_cell")).select("_cell.*").where(F.col("value").isNotNull())
              .groupBy(F.struct("column", "value").alias("_key")).agg(F.sum("_c").cast("bigint").alias("_c")))
    cum = cumulative_counts(hist, "_key", ["_c"])
    return cum.select("_key.column", "_key.value", (F.col("cum__c") - (F.col("_c") - 1) / 2.0).alias("rank"))


def spearman(df: DataFrame, x: str, y: str, weight: str | None = None, scale: int = 4) -> DataFrame:
    """Spearman rank correlation (Pearson r of average ranks) over complete pairs
    of two numeric columns. One row: n, rho.

    The data is reduced to the joint histogram of (x, y) with counts, once; its
    readers share that exchange. Average ranks come from its marginals, and the rank
    moments from the histogram joined with the ranks (one row per distinct value)."""
    w = F.col(weight) if weight else F.lit(1)
    joint = (df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
               .groupBy(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
               .agg(F.sum(w).cast("bigint").alias("_w")))
    ranks = average_ranks(joint, ["_x", "_y"], "_w")
    rx = ranks.where("column = 0").select(F.col("value").alias("_x"), F.col("rank").alias("_rx"))
    ry = ranks.where("column = 1").select(F.col("value").alias("_y"), F.col("rank").alias("_ry"))
    ranked = joint.join(rx, "_x", "inner").join(ry, "_y", "inner")
    cw = F.col("_w").cast("double")
    # ranks from the middle of all, so that the sums of squares stay small
    mid = F.col("_n") / 2.0
    ranked = ranked.withColumn("_n", joint.agg(F.sum("_w")).scalar())
    a, b = F.col("_rx") - mid, F.col("_ry") - F.col("_n") - mid
    sums = ranked.select(cw.alias("n"), (cw * a).alias("sx"), (cw * b).alias("sy"), (cw * a * a).alias("sxx"),
                         (cw * b * b).alias("syy"), (cw * a * b).alias("sxy"))
    return pearson_from_sums(sums, "n", "sx", "sy", "sxx", "syy", "sxy", scale) \
        .select("n", F.col("r").alias("rho"))


def available_case_correlation(df: DataFrame, xs: list[str], y: str, scale: int = 4) -> DataFrame:
    """Correlation of each ``x`` with ``y`` where the means use every non-NULL
    value of their own column while the cross product uses complete pairs (the
    SQL sums form). Computed in ONE pass with stable built-in moments:

        S_xy = n_p * covar_pop_p(x, y) + n_p * (mean_p(x) - mean(x)) * (mean_p(y) - mean(y))
        r    = S_xy / (sqrt(n_x * var_pop(x)) * sqrt(n_y * var_pop(y)))

    where ``_p`` is over complete pairs. Returns (domain, correlation) rows."""
    qy = _q(y)
    aggs = [f"count({qy}) AS ny", f"var_pop({qy}) AS vy", f"avg({qy}) AS my"]
    for i, x in enumerate(xs):
        qx = _q(x)
        both = f"{qx} IS NOT NULL AND {qy} IS NOT NULL"
        aggs += [f"count(CASE WHEN {both} THEN 1 END) AS np{i}", f"covar_pop({qx}, {qy}) AS cp{i}",
                 f"avg(CASE WHEN {both} THEN {qx} END) AS mxp{i}", f"avg(CASE WHEN {both} THEN {qy} END) AS myp{i}",
                 f"avg({qx}) AS mx{i}", f"count({qx}) AS nx{i}", f"var_pop({qx}) AS vx{i}"]
    one = df.selectExpr(*aggs)
    rows = []
    for i, x in enumerate(xs):
        s_xy = f"(np{i} * cp{i} + np{i} * (mxp{i} - mx{i}) * (myp{i} - my))"
        den = f"(sqrt(nx{i} * vx{i}) * sqrt(ny * vy))"
        rows.append([_lit(x), f"round(try_divide({s_xy}, {den}), {scale})"])
    return one.selectExpr(_stack_sql(rows, ["domain", "correlation"]))


def pairwise_correlation_matrix(df: DataFrame, cols: list[str], scale: int = 4) -> DataFrame:
    """Full correlation matrix, each pair over its complete rows (pandas ``corr``),
    in long form (domain_a, domain_b, correlation, lower_triangle).

    One pass of plain sums (count, sums, sums of squares and of products per
    pair over complete pairs): cheap, map-side combinable aggregates. A constant
    column gives NULL instead of a division error. Values on a bounded scale
    (survey ratings) keep the sums well conditioned. The wide aggregate and the
    long form are written as SQL expressions (one call each, parsed in the JVM)."""
    aggs = []
    for i, a in enumerate(cols):
        qa = _q(a)
        aggs += [f"count({qa}) AS n_{i}", f"sum({qa}) AS s_{i}", f"sum({qa} * {qa}) AS q_{i}"]
        for j, b in enumerate(cols[:i]):
            qb = _q(b)
            both = f"{qa} IS NOT NULL AND {qb} IS NOT NULL"
            aggs += [f"count(CASE WHEN {both} THEN 1 END) AS n_{i}_{j}",
                     f"sum(CASE WHEN {both} THEN {qa} END) AS sa_{i}_{j}",
                     f"sum(CASE WHEN {both} THEN {qb} END) AS sb_{i}_{j}",
                     f"sum(CASE WHEN {both} THEN {qa} * {qa} END) AS qa_{i}_{j}",
                     f"sum(CASE WHEN {both} THEN {qb} * {qb} END) AS qb_{i}_{j}",
                     f"sum({qa} * {qb}) AS x_{i}_{j}"]
    one = df.selectExpr(*aggs)

    def centered(q: str, s_: str, n: str) -> str:
        # sum of squared deviations; rounding noise of a constant column counts as 0
        v = f"({q} - {s_} * {s_} / {n})"
        return f"CASE WHEN {v} > {_REL_EPS!r} * {q} THEN {v} END"

    def cell(i: int, j: int) -> str:
        if i == j:
            return f"CASE WHEN ({centered(f'q_{i}', f's_{i}', f'CAST(n_{i} AS DOUBLE)')}) IS NOT NULL THEN 1.0D END"
        hi, lo = max(i, j), min(i, j)
        n = f"CAST(n_{hi}_{lo} AS DOUBLE)"
        cov = f"(x_{hi}_{lo} - sa_{hi}_{lo} * sb_{hi}_{lo} / {n})"
        den = (f"sqrt(({centered(f'qa_{hi}_{lo}', f'sa_{hi}_{lo}', n)}) * "
               f"({centered(f'qb_{hi}_{lo}', f'sb_{hi}_{lo}', n)}))")
        r = f"try_divide({cov}, {den})"
        return f"CASE WHEN {r} IS NOT NULL THEN least(1.0D, greatest(-1.0D, {r})) END"

    rows = ", ".join(f"{_lit(a)}, {_lit(b)}, round({cell(i, j)}, {scale}), {'true' if j <= i else 'false'}"
                     for i, a in enumerate(cols) for j, b in enumerate(cols))
    return one.selectExpr(
        f"stack({len(cols) ** 2}, {rows}) AS (domain_a, domain_b, correlation, lower_triangle)")


DESCRIBE_STATS = ["count", "mean", "std", "min", "25%", "50%", "75%", "max"]


def describe(df: DataFrame, cols: list[str], scale: int = 2) -> DataFrame:
    """count / mean / std / min / quartiles / max per column, long form
    (variable, statistic, value). Quartiles are exact (linear interpolation);
    the value-to-count map they keep is small for bounded domains such as age."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).cast("double").alias(f"count_{i}"), F.avg(c).alias(f"mean_{i}"),
                 F.stddev_samp(c).alias(f"std_{i}"), F.min(c).cast("double").alias(f"min_{i}"),
                 F.percentile(c, [0.25, 0.5, 0.75]).alias(f"q_{i}"),
                 F.max(c).cast("double").alias(f"max_{i}")]
    one = df.agg(*aggs)
    cells = []
    for i, c in enumerate(cols):
        values = [F.col(f"count_{i}"), F.col(f"mean_{i}"), F.col(f"std_{i}"), F.col(f"min_{i}"),
                  F.col(f"q_{i}")[0], F.col(f"q_{i}")[1], F.col(f"q_{i}")[2], F.col(f"max_{i}")]
        for k, (name, v) in enumerate(zip(DESCRIBE_STATS, values)):
            cells.append(F.struct(F.lit(c).alias("variable"), F.lit(name).alias("statistic"),
                                  F.lit(k + 1).alias("stat_order"), F.round(v, scale).alias("value")))
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def histogram(df: DataFrame, col: str, bins: int = 20, scale: int = 4) -> DataFrame:
    """Equal-width histogram over [min, max] with the last bin closed (numpy
    semantics); every bin is reported, empty ones with count 0. The bounds are
    scalar subqueries, each attached once as a column."""
    x = F.col(col)
    bounded = (df.where(x.isNotNull())
                 .withColumn("_lo", df.agg(F.min(x).cast("double")).scalar())
                 .withColumn("_hi", df.agg(F.max(x).cast("double")).scalar()))
    lo, hi = F.col("_lo"), F.col("_hi")
    idx = F.least(F.lit(bins - 1), F.coalesce(
        F.floor(F.try_divide((x - lo) * bins, hi - lo)), F.lit(0))).cast("int")
    counts = (bounded.groupBy(idx.alias("bin"))
                     .agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("lo"), F.first("_hi").alias("hi")))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    # bounds for empty bins come from any non-empty bin (a window over `bins` rows)
    everyone = Window.partitionBy()
    joined = (all_bins.join(counts, "bin", "left")
                      .withColumn("lo", F.max("lo").over(everyone))
                      .withColumn("hi", F.max("hi").over(everyone)))
    width = F.try_divide(F.col("hi") - F.col("lo"), F.lit(float(bins)))
    return (joined.select("bin",
                          F.round(F.col("lo") + F.col("bin") * width, scale).alias("bin_start"),
                          F.round(F.col("lo") + (F.col("bin") + 1) * width, scale).alias("bin_end"),
                          F.coalesce(F.col("n"), F.lit(0)).alias("count"))
                  .orderBy("bin"))


def quantile_bins(df: DataFrame, col: str, labels: list[str], weight: str | None = None) -> DataFrame:
    """Assign equal-frequency bins (qcut): edges are the exact quantiles at
    1/k .. (k-1)/k; bins are right-closed and the lowest includes the minimum.
    With ``weight`` the quantiles are frequency-weighted."""
    k = len(labels)
    probs = [i / k for i in range(1, k)]
    q = (F.percentile(F.col(col), probs, F.col(weight).cast("long")) if weight
         else F.percentile(F.col(col), probs))
    withedges = df.withColumn("_edges", df.agg(q).scalar())   # one subquery, attached once
    x, edges = F.col(col), F.col("_edges")
    label = None
    for i, lab in enumerate(labels[:-1]):
        cond = x <= edges[i]
        label = F.when(cond, lab) if label is None else label.when(cond, lab)
    label = label.when(x.isNotNull(), labels[-1])
    return withedges.withColumn("bin_label", label).drop("_edges")
