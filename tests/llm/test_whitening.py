"""Whitening against a plain version in whole numbers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from carelens.llm.whitening import BOUND, covariance, squares, whiten

SCHEMA = "vec_id long, embedding array<float>, x string, id long, i int"


def plain(rows, components=16):
    """(n, {vec_id: deviation}, eigenvalues, components, trace, {vec_id: whitened}) of (id, vector) rows."""
    xs = [(k, tuple(math.floor(64 * float(np.float32(c))) + 1000000 for c in v)) for k, v in rows
          if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in xs})
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    v = np.array([[float(sum((x[i] - Fraction(s[i], n)) * (x[j] - Fraction(s[j], n)) for x in fit) / n)
                   for j in range(d)] for i in range(d)])
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    dev = {k: sum((n * a - b) ** 2 for a, b in zip(x, s)) for k, x in xs}
    z = {k: [float(a - Fraction(b, n)) for a, b in zip(x, s)] @ w / np.sqrt(np.maximum(e, 1e-300)) for k, x in xs}
    return n, dev, e, np.trace(v), z


def test_whitening_equals_plain_version(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 0.3, (60, 20)) @ rng.normal(0, 1, (20, 20))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(base)]
    rows += [(100 + i, rows[3][1]) for i in range(40)]  # one vector in many rows counts once
    rows += [(200, None), (201, [None] + rows[0][1][1:]), (202, [float("nan")] + rows[0][1][1:]),
             (203, [float("inf")] + rows[0][1][1:]), (204, [1.0, 2.0]), (205, []), (7, rows[8][1]), (None, rows[9][1])]
    want_n, dev, e, trace, z = plain([r for r in rows if r[0] != 204 and r[0] != 205])
    got = whiten(spark.createDataFrame([(k, v, "a", 1, 2) for k, v in rows], SCHEMA)).collect()
    assert len(got) == 16 * (60 + 40 + 2)
    assert {r.n for r in got} == {want_n} == {60}
    sign = {}
    for r in got:
        if r.vec_id in (None, 7):
            continue
        assert int(r.deviation) == dev[r.vec_id]
        assert r.explained == pytest.approx(e[r.component - 1] / trace, rel=1e-9)
        assert 0 <= r.identity_error < 1e-9
        w = z[r.vec_id][r.component - 1]
        if abs(w) > 1e-3:
            assert sign.setdefault(r.component, np.sign(w * r.whitened)) == np.sign(w * r.whitened)
        assert abs(r.whitened) == pytest.approx(abs(w), rel=1e-6, abs=1e-7)


def test_squares_and_covariance_are_exact_for_large_values():
    rng = np.random.default_rng(1)
    for top in (50, 10 ** 6, 2 ** 40, BOUND):
        y = rng.integers(-top, top, (300, 4))
        q = squares(y)
        big = y.astype(object)
        for i in range(4):
            assert q[i, i] == sum(big[:, i] ** 2)
            for j in range(i + 1, 4):
                assert q[i, j] == sum((big[:, i] + big[:, j]) ** 2)
        want = np.cov(y.astype(float).T, bias=True)
        assert np.allclose(covariance(300, [int(v) for v in big.sum(axis=0)], q), want, rtol=1e-9, atol=1e-9 * top ** 2)


def test_few_and_degenerate_vectors(spark):
    make = lambda rows: spark.createDataFrame([(k, v, "a", 1, 2) for k, v in rows], SCHEMA)
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(i, [0.5, 1.5]) for i in range(5)]):
        out = whiten(make(rows))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        assert out.collect() == []
    # rank one: a single component; values beyond the bound are held
    got = whiten(make([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [2.0, 1.0])])).collect()
    assert {r.component for r in got} == {1} and all(r.explained == 1.0 for r in got)
    assert sorted(r.whitened for r in got) == pytest.approx([-math.sqrt(1.5), 0, math.sqrt(1.5)])
    # the second eigenvalue is below double precision of the first
    assert len(whiten(make([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 1.0])])).collect()) == 3
