"""Two-sided p-value of Student's t, as a vectorised pandas UDF.

Spark has no t-distribution CDF. With t = sqrt(dof) * tan(angle) the density
turns into a power of the cosine, which is smooth and falls off within a few
1 / sqrt(dof), so one Gauss-Legendre rule over that stretch gives the tail to
about 1e-13. It is applied to aggregated rows only (one per test).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODES, WEIGHTS = np.polynomial.legendre.leggauss(256)
REACH = 14.0  # tail beyond this many 1 / sqrt(dof) is below exp(-90)


def t_two_sided_p_value(t: float | None, dof: float | None) -> float | None:
    if t is None or dof is None or np.isnan(t) or np.isnan(dof) or dof <= 0:
        return None
    if np.isinf(t):
        return 0.0
    if t == 0:
        return 1.0
    start = math.atan(abs(t) / math.sqrt(dof))
    half = min(math.pi / 2 - start, REACH / math.sqrt(dof)) / 2
    angle = start + half * (1 + NODES)
    log_norm = math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2) - math.log(math.pi) / 2
    tail = half * np.sum(WEIGHTS * np.exp(log_norm + (dof - 1) * np.log(np.cos(angle))))
    return float(min(1.0, 2 * tail))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p-value of a t statistic with ``dof`` degrees of freedom."""
    return pd.Series([t_two_sided_p_value(a, b) for a, b in zip(t.astype("float64"), dof.astype("float64"))],
                     dtype="float64")
