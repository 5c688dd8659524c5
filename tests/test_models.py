"""Linear models from sums of products against solutions on the rows."""

import numpy as np
import pytest

from tidewater.plans import models as M


def rows(n, seed=1):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [1, 10, 100] + [5, 0, 1000]
    x[:, 2] += 40 * x[:, 0]
    y = 3 * x[:, 0] - 0.2 * x[:, 1] + 7 + r.normal(size=n)
    return [(int(i), *map(float, v), 4.0, float(t)) for i, (v, t) in enumerate(zip(x, y))]


def fit(spark, data, **spec):
    df = spark.createDataFrame(data, "l_orderkey long, a double, b double, c double, flat double, label double").repartition(3)
    out = {}
    for r in M.linear_models(df, ("a", "b", "c", "flat"), spec=M.LinearSpec(**spec)).collect():
        out.setdefault((r.model, r.penalty), {})[r.term] = r
    return out


def test_against_the_rows(spark):
    data = rows(600)
    got = fit(spark, [*data, (601, None, 1.0, 1.0, 4.0, 1.0), (None, 1.0, 1.0, 1.0, 4.0, 1.0)], ridge=(0.0, 0.5), lasso=(0.0, 0.05, 0.4), folds=5)
    x = np.array([d[1:4] for d in data])
    y = np.array([d[5] for d in data])
    held = np.arange(600) % 5 == 0
    m, s, my, sy = x[~held].mean(0), x[~held].std(0), y[~held].mean(), y[~held].std()
    z, t = (x[~held] - m) / s, (y[~held] - my) / sy
    n = len(z)
    for (model, penalty), terms in got.items():
        w = np.array([terms[c].coefficient for c in "abc"])
        assert terms["flat"].coefficient == 0
        b = w * s / sy
        grad = z.T @ (z @ b - t) / n
        if model == "ridge":
            assert np.allclose(grad + penalty * b, 0, atol=1e-9)
        else:       # the optimality conditions of the lasso
            on = b != 0
            assert np.allclose(grad[on] + penalty * np.sign(b[on]), 0, atol=1e-9) and (abs(grad[~on]) <= penalty + 1e-9).all()
        e = y[held] - terms["intercept"].coefficient - x[held] @ w
        assert terms["a"].rmse == pytest.approx(np.sqrt((e * e).mean()), rel=1e-7)
        assert terms["a"].r2 == pytest.approx(1 - (e * e).sum() / ((y[held] - y[held].mean()) ** 2).sum(), rel=1e-7)
    assert sum(got["lasso", 0.4][c].coefficient == 0 for c in "abc") >= 1


def test_no_rows_and_no_held_out_rows(spark):
    got = fit(spark, [])
    assert all(r.coefficient is None and r.rmse is None for m in got.values() for r in m.values())
    got = fit(spark, [(1, 1.0, 2.0, 3.0, 4.0, 5.0), (2, 2.0, 2.0, 3.0, 4.0, 7.0)], ridge=(0.0,), lasso=(0.0,))
    assert got["ridge", 0.0]["a"].coefficient == pytest.approx(2) and got["ridge", 0.0]["a"].rmse is None


def test_one_scan(spark):
    """All models come from a single aggregate over the features."""
    seen = []
    real = M.sums_of_products
    M.sums_of_products = lambda *a: seen.append(1) or real(*a)
    try:
        assert len(fit(spark, rows(50))) == 6 and len(seen) == 1
    finally:
        M.sums_of_products = real
