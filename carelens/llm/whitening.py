"""Embedding whitening with an exact covariance by polarisation.

Entries become whole numbers x = floor(scale * c) + shift. The distinct x vectors
are the fit list. Var(x_i + x_j) - Var(x_i) - Var(x_j) is twice Cov(x_i, x_j), so the
only sums that are taken are those of squares: of every centred dimension and of
every sum of two centred dimensions. The centre of a dimension is the whole number
next below its mean, so all squares and sums are exact whole numbers; what the
mean differs from the centre is taken off exactly at the end (n * sum of squares
- square of the sum), in arbitrary precision, and the covariance is rounded once,
when it is assembled for ``eigh`` on the driver (d x d numbers for d dimensions).

Jobs: the fit list (copies are merged before the shuffle, so a vector that makes
up a third of all rows costs a row per task), its sums, its squares (one row per
pair of dimensions and task, summed by pair), the covariance of the whitened fit
list and at last the rows. Squares are summed in doubles while every sum stays
below 2 ** 53, where doubles are exact, else in Python's whole numbers.

Edge cases: null vectors and vectors with a null or non-finite entry have no rows;
where lengths differ, the commonest (the longer one of equally common) is used and
other vectors have no rows; x is held within +-2 ** 53; components whose eigenvalue
is nought within double precision are left out, as nothing can be divided by it, so
an empty table, a single vector and empty vectors give no rows; rows that repeat an
id are projected each for itself; a null id stays null; extra columns are ignored.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carelens.llm.store import stored

BOUND = 2 ** 53
ROWS = 2048


def whole_vectors(rows: DataFrame, vector: str, scale: int, shift: int) -> DataFrame:
    """Column ``x`` of every row whose vector is complete; other rows go."""
    held = F.col(vector).cast("array<double>")
    ok = held.isNotNull() & F.forall(held, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(held, lambda c: (F.greatest(F.least(F.floor(F.greatest(F.least(
        c * scale, F.lit(float(BOUND))), F.lit(-float(BOUND)))) + shift, F.lit(BOUND)), F.lit(-BOUND))).cast("long"))
    return rows.filter(ok).withColumn("x", x).filter(F.size("x") > 0)


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), -1)


def _sums(batches):
    """Number of rows and sum of each dimension, one row per dimension and task."""
    n, total = 0, None
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS // 4):  # 512 entries below 2 ** 53 add up within a long
            x = _matrix(batch.column("x").slice(lo, ROWS // 4))
            s = x.sum(axis=0).astype(object)
            n, total = n + len(x), s if total is None else total + s
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(total))), pa.array(np.full(len(total), n)), _decimals(total)], names=["i", "n", "s"])


def _decimals(values) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def squares(y: np.ndarray) -> np.ndarray:
    """Sums of y_i ** 2 on the diagonal and of (y_i + y_j) ** 2 above it, exact."""
    d = y.shape[1]
    out = np.zeros((d, d), object)
    big = 4 * int(np.abs(y).max(initial=0)) ** 2
    rows = min(ROWS, BOUND // big) if big else ROWS
    if rows == 0:
        for r in y.astype(object):
            out += np.triu(np.add.outer(r, r) ** 2, 1) + np.diag(r * r)
        return out
    y = y.astype(float)
    for lo in range(0, len(y), rows):
        part, some = y[lo:lo + rows], np.zeros((d, d))
        for i in range(d):
            some[i, i] = part[:, i] @ part[:, i]
            both = part[:, i + 1:] + part[:, i:i + 1]
            some[i, i + 1:] = np.einsum("ij,ij->j", both, both)
        out += some.astype(np.int64)
    return out


def _squares(shared):
    def run(batches):
        total = None
        for batch in batches:
            y = _matrix(batch.column("x")) - shared.value
            part = squares(y)
            total = part if total is None else total + part
        if total is None:
            return
        for i in range(len(total)):
            j = np.arange(i, len(total))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), i)), pa.array(j), _decimals(total[i, i:])],
                                             names=["i", "j", "q"])
    return run


def covariance(n: int, offset: list[int], square: np.ndarray) -> np.ndarray:
    """Covariance, divisor n, from the exact sums of centred values and of squares."""
    d = len(offset)
    # n ** 2 * variance of each dimension and of each sum of two
    spread = np.zeros((d, d), object)
    for i in range(d):
        for j in range(i, d):
            t = offset[i] + (offset[j] if j > i else 0)
            spread[i, j] = n * int(square[i, j]) - t * t
    out = np.zeros((d, d))
    for i in range(d):
        out[i, i] = spread[i, i] / n ** 2
        for j in range(i + 1, d):
            out[i, j] = out[j, i] = (spread[i, j] - spread[i, i] - spread[j, j]) / (2 * n ** 2)
    return out


class Whitening:
    """Centre, components and eigenvalues (falling) of a fit list."""

    def __init__(self, n: int, sums: list[int], square: np.ndarray, components: int):
        self.n = n
        self.centre = np.array([s // n for s in sums], np.int64)
        self.offset = [s - n * (s // n) for s in sums]
        v = covariance(n, self.offset, square)
        e, w = np.linalg.eigh(v)
        e, w = e[::-1], w[:, ::-1]
        keep = e > len(e) * np.finfo(float).eps * max(float(e.max(initial=0)), 0)
        keep[components:] = False
        self.trace, self.e, self.w = float(np.trace(v)), e[keep], w[:, keep]
        self.rest = sum(t * t for t in self.offset)
        self.error = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        y = (x - self.centre).astype(float) - np.array(self.offset, float) / self.n
        return (y @ self.w) / np.sqrt(self.e)

    def deviation(self, x: np.ndarray) -> list[int]:
        """Sum over the dimensions of (n * x - S) ** 2."""
        y = x - self.centre
        top = int(np.abs(y).max(initial=0))
        small = len(self.offset) * max(top * top, top * self.n) < 2 ** 62
        y = y if small else y.astype(object)
        t = np.array(self.offset, np.int64 if small else object)
        a, b = (y * y).sum(axis=1), (y * t).sum(axis=1)
        return [self.n * self.n * int(p) - 2 * self.n * int(q) + self.rest for p, q in zip(a, b)]


def _moments(shared):
    """Sums of the whitened values and of their products, a row per entry and task."""
    def run(batches):
        m, s, p = shared.value, 0.0, 0.0
        for batch in batches:
            z = shared.value.project(_matrix(batch.column("x")))
            s, p = s + z.sum(axis=0), p + z.T @ z
        if np.ndim(p):
            i, j = np.triu_indices(len(m.e))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(np.arange(len(m.e)), i)), pa.array(np.append(np.full(len(m.e), -1), j)),
                 pa.array(np.append(s, p[i, j]))], names=["i", "j", "s"])
    return run


def _projected(shared, kind):
    def run(batches):
        m = shared.value
        k = len(m.e)
        share = m.e / m.trace
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                x = _matrix(part.column("x"))
                row = np.repeat(np.arange(len(x)), k)
                dev = np.array([Decimal(v) for v in m.deviation(x)], object)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                     pa.array(np.full(len(row), m.n)), pa.array(dev[row], pa.decimal128(38, 0)),
                     pa.array(m.project(x).reshape(-1)), pa.array(np.tile(share, len(x))),
                     pa.array(np.full(len(row), m.error))],
                    names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def fit_whitening(fit: DataFrame, components: int) -> Whitening | None:
    """The whitening of the vectors ``x`` of a stored table; None without a component."""
    context = fit.sparkSession.sparkContext
    got = (fit.mapInArrow(_sums, "i long, n long, s decimal(38,0)").groupBy("i")
           .agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect())  # a row per dimension
    if not got:
        return None
    n, sums = got[0]["n"], [int(r["s"]) for r in got]
    centre = context.broadcast(np.array([s // n for s in sums], np.int64))
    square = np.zeros((len(sums), len(sums)), object)
    for r in (fit.mapInArrow(_squares(centre), "i long, j long, q decimal(38,0)").groupBy("i", "j")
              .agg(F.sum("q").alias("q")).toLocalIterator()):  # a row per pair of dimensions
        square[r["i"], r["j"]] = int(r["q"])
    centre.destroy()
    m = Whitening(n, sums, square, components)
    if not len(m.e):
        return None
    shared = context.broadcast(m)
    k = len(m.e)
    first, product = np.zeros(k), np.zeros((k, k))
    for r in (fit.mapInArrow(_moments(shared), "i long, j long, s double").groupBy("i", "j")
              .agg(F.sum("s").alias("s")).collect()):  # at most (components + 1) ** 2 rows
        if r["j"] < 0:
            first[r["i"]] = r["s"] / n
        else:
            product[r["i"], r["j"]] = product[r["j"], r["i"]] = r["s"] / n
    shared.destroy()
    m.error = float(np.abs(product - np.outer(first, first) - np.eye(k)).max())
    return m


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16, scale: int = 64,
           shift: int = 1_000_000) -> DataFrame:
    """(key, component, n, deviation decimal(38,0), whitened, explained, identity_error): a row
    for each complete vector and component, by falling eigenvalue."""
    kind = dict(rows.dtypes)[key]
    rows = whole_vectors(rows.select(F.col(key).alias("id"), F.col(vector).alias("held")), "held", scale, shift).select("id", "x")
    fit = stored(rows.select("x").distinct())
    size = fit.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c"))
    size = size.orderBy(F.desc("c"), F.desc("d")).first()
    d = size["d"] if size else 0
    m = fit_whitening(fit.filter(F.size("x") == d), components)
    schema = (f"id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
              "identity_error double")
    if m is None:
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("id", key)
    shared = rows.sparkSession.sparkContext.broadcast(m)
    return rows.filter(F.size("x") == d).mapInArrow(_projected(shared, kind), schema).withColumnRenamed("id", key)
