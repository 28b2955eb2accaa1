import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import panel, paths

COLUMNS = ["a", "b", "c", "d", "still"]


def made(n=600, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1.0, 50.0, 0.01, 3.0] + [0.0, 1e6, 5.0, -2.0]
    x = np.column_stack([x, np.full(n, 7.0)])
    x[:, 3] += 0.8 * x[:, 0]
    y = (x[:, 0] - 0.02 * (x[:, 1] - 1e6) + rng.normal(size=n) > 0.3).astype(float)
    return x, y, np.where(y == 1, 2.5, 0.75)


def frame(spark, x, y, w, partitions):
    rows = [(*map(float, v), float(t), float(u)) for v, t, u in zip(x, y, w, strict=True)]
    return spark.createDataFrame(rows, "a double, b double, c double, d double, still double, y double, w double").repartition(partitions)


def scaled(x, y, w):
    p = w / w.sum()
    mean, sd = p @ x, np.sqrt(p @ (x - p @ x) ** 2)
    sd[sd < 1e-9] = 1.0
    return (x - mean) / sd, y - p @ y, p, mean, sd


@pytest.mark.parametrize("partitions", [1, 4, 90])
def test_moments_do_not_depend_on_partitions(spark, partitions):
    x, y, w = made()
    m = paths.moments(frame(spark, x, y, w, partitions), COLUMNS, "y", F.col("w"))
    one = paths.moments_of(np.column_stack([x, y]), w)
    assert m.rows == 600 and m.weight == pytest.approx(w.sum())
    assert np.allclose(m.mean, one.mean, rtol=1e-12) and np.allclose(m.products, one.products, rtol=1e-9, atol=1e-8)


def test_ridge_against_normal_equations(spark):
    x, y, w = made()
    m = paths.moments(frame(spark, x, y, w, 3), COLUMNS, "y", F.col("w"))
    z, t, p, mean, sd = scaled(x, y, w)
    for point in paths.path(m, "ridge", paths.ladder(m)):
        b = np.linalg.solve((z * p[:, None]).T @ z + point.penalty * np.eye(5), (z * p[:, None]).T @ t) / sd
        assert np.allclose(point.weights, b, rtol=1e-8, atol=1e-10)
        assert point.intercept == pytest.approx((w / w.sum()) @ y - b @ mean, rel=1e-7)


def test_lasso_is_the_minimum(spark):
    x, y, w = made()
    m = paths.moments(frame(spark, x, y, w, 3), COLUMNS, "y", F.col("w"))
    z, t, p, _, sd = scaled(x, y, w)
    fits = paths.path(m, "lasso", paths.ladder(m))
    assert len(fits) == 20 and not fits[0].weights.any() and np.count_nonzero(fits[-1].weights) >= 3
    gram, target = (z * p[:, None]).T @ z, (z * p[:, None]).T @ t
    for point in fits:
        b = point.weights * sd
        slope = target - gram @ b
        assert (np.abs(slope) <= point.penalty + 1e-9).all()
        assert np.allclose(slope[b != 0], point.penalty * np.sign(b[b != 0]), atol=1e-9)
        # brute force: the best of all sign patterns, each solved exactly
        best = None
        for pattern in np.ndindex(3, 3, 3, 3):
            signs = np.array([*pattern, 1]) - 1.0
            on = np.flatnonzero(signs)
            c = np.zeros(5)
            if len(on):
                c[on] = np.linalg.solve(gram[np.ix_(on, on)], target[on] - point.penalty * signs[on])
                if (np.sign(c[on]) != signs[on]).any():
                    continue
            value = c @ gram @ c / 2 - target @ c + point.penalty * np.abs(c).sum()
            if best is None or value < best[0]:
                best = (value, c)
        assert np.allclose(b, best[1], rtol=1e-8, atol=1e-8)


def test_rows_that_take_no_part_and_empty_tables(spark):
    rows = spark.createDataFrame([(1.0, 1.0, 1.0), (None, 0.0, 1.0), (float("nan"), 1.0, 1.0), (9.0, None, 1.0), (9.0, 1.0, 0.0), (9.0, 1.0, None)], "a double, y double, w double")
    m = paths.moments(rows, ["a"], "y", F.col("w"))
    assert (m.rows, m.weight) == (3, 3.0) and m.mean.tolist() == pytest.approx([1 / 3, 2 / 3])
    none = paths.moments(rows.limit(0), ["a"], "y")
    assert none.rows == 0 and paths.ladder(none, 3) == [0.0] * 3
    assert [(p.weights.tolist(), p.intercept) for k in ("ridge", "lasso") for p in paths.path(none, k, [1.0])] == [([0.0], 0.0)] * 2
    with pytest.raises(ValueError):
        paths.path(m, "other", [1.0])


def test_scores_equal_the_weights(spark):
    x, y, w = made(50)
    rows = frame(spark, x, y, w, 2)
    m = paths.moments(rows, COLUMNS, "y")
    fits = paths.path(m, "lasso", paths.ladder(m, 4)) + paths.path(m, "ridge", [0.1])
    got = paths.scored(rows, COLUMNS, fits, COLUMNS).collect()
    assert len(got) == 250
    at = {(p.kind, p.step): p for p in fits}
    for r in got:
        assert r.s == pytest.approx(at[r.kind, r.step].intercept + sum(at[r.kind, r.step].weights[i] * r[c] for i, c in enumerate(COLUMNS)), rel=1e-9, abs=1e-9)


def test_lags_honour_gaps(spark):
    rows = [("f", 1995, 1.0), ("f", 1996, 2.0), ("f", 1998, 4.0), ("g", 1996, float("nan")), ("g", 1997, 7.0), ("h", 1995, 3.0), ("h", 1995, 5.0), ("h", 1996, 0.0), (None, 1995, 1.0), (None, 1996, 1.0), ("i", None, 1.0)]
    out = panel.lagged(spark.createDataFrame(rows, "firm string, year int, x double"), ["firm"], "year", ["x"])
    got = sorted(((r.firm, r.year, r.x_t1) for r in out.collect()), key=repr)
    wanted = [("f", 1995, None), ("f", 1996, 1.0), ("f", 1998, None), ("g", 1996, None), ("g", 1997, None), ("h", 1995, None), ("h", 1995, None), ("h", 1996, 5.0), (None, 1995, None), (None, 1996, None), ("i", None, None)]
    assert got == sorted(wanted, key=repr) and out.columns == ["firm", "year", "x", "x_t1"]
    two = panel.lagged(spark.createDataFrame(rows[:3], "firm string, year int, x double"), ["firm"], "year", ["x"], back=2)
    assert sorted((r.year, r.x_t2) for r in two.collect()) == [(1995, None), (1996, None), (1998, 2.0)]


def test_group_z_scores(spark):
    rows = [("k", 1, 1.0), ("k", 1, 3.0), ("k", 1, None), ("k", 2, 9.0), ("m", 1, 4.0), ("m", 1, 4.0), (None, 1, 1.0), (None, 1, 5.0), ("n", 1, float("nan"))]
    out = panel.group_standardized(spark.createDataFrame(rows, "kind string, year int, x double"), ["kind", "year"], ["x"])
    got = sorted(((r.kind, r.year, None if r.x_zind is None else round(r.x_zind, 9)) for r in out.collect()), key=repr)
    h = round(0.5**0.5, 9)
    wanted = [("k", 1, -h), ("k", 1, h), ("k", 1, None), ("k", 2, 0.0), ("m", 1, 0.0), ("m", 1, 0.0), (None, 1, -h), (None, 1, h), ("n", 1, None)]
    assert got == sorted(wanted, key=repr) and out.columns == ["kind", "year", "x", "x_zind"]
    empty = panel.group_standardized(spark.createDataFrame([], "kind string, year int, x double"), ["kind", "year"], ["x"])
    assert empty.count() == 0
