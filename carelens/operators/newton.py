"""Logistic regression by Newton steps from Gram sums.

A step needs the gradient (a sum per feature) and the Hessian (a weighted sum per pair
of features): one aggregate over the rows, combined map-side, whatever their number. Only
these sums reach the driver, which solves a system of the size of the feature list.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.functions.sqlexpr import ident


def scale_sums(df: DataFrame, features: list[str]) -> tuple[list[float], list[float]]:
    """Mean and sample standard deviation of each feature, in one pass."""
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(features)],
                 *[F.stddev_samp(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(features)]).first()
    return [row[f"m{i}"] or 0.0 for i in range(len(features))], [row[f"s{i}"] or 0.0 for i in range(len(features))]


def newton_logistic(df: DataFrame, features: list[str], label: str, reg: float = 0.0, max_iter: int = 50,
                    tol: float = 1e-10) -> dict:
    """Minimum of mean log-loss + reg / 2 * |coefficients|^2 on the centred and scaled features (the
    intercept is not penalised): {intercept, coefficients, mean, sd, iterations}. Rows with a
    NULL label or feature are left out; a constant feature has coefficient 0."""
    d = len(features)
    df = df.select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)]).dropna()
    names = [f"f{i}" for i in range(d)]
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        mean, sd = scale_sums(df, names)
        z = ["1.0D"] + [f"(({ident(n)} - {m!r}D) * {(1 / s if s else 0.0)!r}D)" for n, m, s in zip(names, mean, sd)]
        scaled = df.selectExpr("y", *[f"{e} AS z{i}" for i, e in enumerate(z)])
        pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
        beta, steps = np.zeros(d + 1), 0
        penalty = np.diag([0.0] + [reg] * d)
        while steps < max_iter:
            steps += 1
            margin = " + ".join(f"{b!r}D * z{i}" for i, b in enumerate(beta.tolist()))
            p = scaled.selectExpr("*", f"1 / (1 + exp(-({margin}))) AS p").selectExpr("*", "p - y AS e", "p * (1 - p) AS w")
            row = p.selectExpr("count(1) AS n", *[f"sum(e * z{i}) AS g{i}" for i in range(d + 1)],
                               *[f"sum(w * z{i} * z{j}) AS h{i}_{j}" for i, j in pairs]).first()
            n = row["n"]
            if not n:
                break
            gradient = np.array([row[f"g{i}"] for i in range(d + 1)]) / n + penalty @ beta
            hessian = penalty.copy()
            for i, j in pairs:
                hessian[i, j] += row[f"h{i}_{j}"] / n
                if i != j:
                    hessian[j, i] += row[f"h{i}_{j}"] / n
            step = np.linalg.lstsq(hessian, gradient, rcond=1e-12)[0]  # a constant feature has no curvature
            beta = beta - step
            if np.abs(step).max() < tol:
                break
    finally:
        df.unpersist()
    return {"intercept": float(beta[0]), "coefficients": beta[1:].tolist(), "mean": mean, "sd": sd, "iterations": steps}
