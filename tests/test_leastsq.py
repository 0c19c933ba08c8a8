"""Least squares with rank detection."""

import numpy as np
import pytest

from metricspark.operators import leastsq


def frame(spark, x, y):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [tuple(float(v) for v in (*r, t)) for r, t in zip(x, y)]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in [*names, "y"])), names


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_weights_equal_numpy(spark, offset):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 6)) * [1, 10, 100, 1, 2, 3] + offset
    y = x @ [1, -2, 0.5, 0, 3, 1] + 7 + rng.normal(size=500)
    df, names = frame(spark, x, y)
    m = leastsq.fit(df, names, "y")
    c = x - x.mean(axis=0)
    w, *_ = np.linalg.lstsq(c, y - y.mean(), rcond=None)
    assert [m.weights[n] for n in names] == pytest.approx(list(w), rel=1e-6)
    assert m.dependent == [] and m.n == 500
    e = y - y.mean() - c @ w
    assert m.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) @ (y - y.mean())), abs=1e-9)
    got = m.predict(df).select("prediction").toPandas()["prediction"].to_numpy()
    assert np.abs(got - (y - e)).max() < 1e-4


def test_dependent_and_constant_columns_are_reported(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(2, 300))
    x = np.column_stack([a, 3 * a + 100, b, a - 2 * b, np.full(300, 5.0)])
    df, names = frame(spark, x, 2 * a + b + 1)
    m = leastsq.fit(df, names, "y")
    assert m.dependent == ["x1", "x3", "x4"] and m.r2 == pytest.approx(1.0)
    assert (m.weights["x0"], m.weights["x2"], m.intercept) == pytest.approx((2.0, 1.0, 1.0))
    table = {r.term: (r.coefficient, r.dependent) for r in m.coefficients(spark).collect()}
    assert table["x1"] == (0.0, True) and not table["intercept"][1]


def test_missing_values_no_rows_and_constant_label(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (None, 9.0), (float("nan"), 9.0), (3.0, None), (4.0, 8.0)],
                               "x0 double, y double")
    m = leastsq.fit(df, ["x0"], "y")
    assert m.n == 3 and m.weights["x0"] == pytest.approx(2.0) and m.intercept == pytest.approx(0.0)
    none = leastsq.fit(df.limit(0), ["x0"], "y")
    assert none.n == 0 and none.r2 is None and none.dependent == ["x0"] and none.intercept == 0.0
    flat = leastsq.fit(df.selectExpr("x0", "3D AS y"), ["x0"], "y")
    assert flat.r2 is None and flat.intercept == pytest.approx(3.0) and flat.weights["x0"] == pytest.approx(0.0)


def test_pivots_do_not_depend_on_last_bits():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(200, 3))
    x = np.column_stack([a[:, 0], a[:, 0] * 7 + 1, a[:, 1]])
    c = np.corrcoef(x.T)
    for noise in (0.0, 1e-13, -1e-13):
        _, chosen = leastsq.pivoted_cholesky(c + np.diag([0.0, noise, 0.0]))
        assert chosen[0] == 0 and sorted(chosen) == [0, 2]
