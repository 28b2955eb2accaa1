import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.functions import expressions as ex, metrics


def rank_auc(y, s):
    """The AUC from midranks, counted in NumPy."""
    _, at, n = np.unique(s, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[at]
    p = int((y == 1).sum())
    return float((rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))) if 0 < p < len(y) else float("nan")


def frame(spark, rows):
    return spark.createDataFrame(rows, "cell string, id long, y int, s double")


def made(n=400, seed=3, levels=12):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    s = np.round(rng.normal(size=n) + y, 0 if levels < 20 else 3)
    return y, s


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_metrics_against_numpy(spark, buckets):
    y, s = made()
    rows = [("a", i, int(y[i]), float(s[i])) for i in range(len(y))] + [("b", i, 1, 0.5) for i in range(5)]
    out = {r.cell: r for r in metrics.ranking_metrics(frame(spark, rows), ["cell"], buckets).collect()}
    assert out["a"].auc == pytest.approx(rank_auc(y, s), abs=1e-12)
    order = sorted(range(len(y)), key=lambda i: (-s[i], i))
    k = max(1, int(0.05 * len(y)))
    assert out["a"].p_at_k == pytest.approx(np.mean([y[i] for i in order[:k]]))
    ap, tp, n, last = 0.0, 0, 0, 0.0
    best, recall = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        tp, n = int(y[s >= t].sum()), int((s >= t).sum())
        p, r = tp / n, tp / y.sum()
        ap, last = ap + (r - last) * p, r
        best = max(best, 2 * p * r / (p + r + 1e-10))
        if (n - tp) / (len(y) - y.sum()) <= 0.1:
            recall = max(recall, r)
    assert (out["a"].ap, out["a"].f1_best, out["a"].recall_at_fpr) == pytest.approx((ap, best, recall), abs=1e-10)
    assert math.isnan(out["b"].auc)


def test_auc_properties(spark):
    y, s = made(levels=99)
    df = frame(spark, [("a", i, int(y[i]), float(s[i])) for i in range(len(y))])
    auc = lambda x: metrics.curve(x, ["cell"]).groupBy("cell").agg(metrics.auc_of().alias("v")).first().v
    assert auc(df) + auc(df.withColumn("s", -F.col("s"))) == pytest.approx(1)
    assert auc(df) == pytest.approx(auc(df.withColumn("s", F.exp("s"))))
    assert auc(df.withColumn("s", F.lit(1.0))) == 0.5


def test_zero_signs_nulls_and_nan(spark):
    df = frame(spark, [("a", 1, 1, 0.0), ("a", 2, 0, -0.0), ("a", 3, None, 9.0), ("a", 4, 1, None), ("a", 5, 0, float("nan"))])
    assert metrics.curve(df, ["cell"]).count() == 1
    assert metrics.ranking_metrics(df, ["cell"]).first().auc == 0.5


def test_delong_sign_and_degenerate(spark):
    y, s = made(levels=99)
    rng = np.random.default_rng(5)
    t = s + rng.normal(size=len(s))
    df = spark.createDataFrame([("c", i, int(y[i]), float(s[i]), float(t[i])) for i in range(len(y))], "cell string, id long, y int, s_a double, s_b double")
    a = metrics.delong(df, ["cell"]).first()
    b = metrics.delong(df.select("cell", "id", "y", F.col("s_b").alias("s_a"), F.col("s_a").alias("s_b")), ["cell"]).first()
    assert a.z == pytest.approx(-b.z) and a.delta == pytest.approx(-b.delta) and a.z * a.delta < 0
    assert a.p == pytest.approx(math.erfc(abs(a.z) / math.sqrt(2)))
    same = metrics.delong(df.withColumn("s_b", F.col("s_a")), ["cell"]).first()
    assert (same.z, same.p) == (0.0, 1.0)
    one = metrics.delong(df.withColumn("y", F.lit(1)), ["cell"]).first()
    assert (one.auc_a, one.z, one.p) == (0.0, 0.0, 1.0)


def test_two_sided_p(spark):
    z = [0.0, 1e-300, 1e-12, 1e-3, 0.3, 0.7071, 0.7072, 1.0, 1.96, 3.3, *np.linspace(0.01, 37.0, 3001), 38.0, 60.0, 1e200, float("inf")]
    z = [float(v) for v in z]
    df = spark.createDataFrame([(v,) for x in z for v in (x, -x)] + [(None,), (float("nan"),)], "z double").select("z", metrics.two_sided_p("z").alias("p"))
    assert "Python" not in df._jdf.queryExecution().toString()
    for r in df.collect():
        if r.z is None or math.isnan(r.z):
            assert r.p is None or math.isnan(r.p)
        elif abs(r.z) <= 37:
            assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-13, abs=0)
        else:
            assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), abs=1e-307)


def test_quantiles(spark):
    _, s = made(levels=99)
    df = frame(spark, [("a", i, 1, float(x)) for i, x in enumerate(s)])
    p = [0.0, 0.1, 0.5, 0.77, 0.999, 1.0]
    assert metrics.quantiles(df, p, 5) == pytest.approx(list(np.quantile(s, p)))


def test_expressions(spark):
    df = spark.createDataFrame([("1",), ("600001",), ("1234567",), (None,)], "f string")
    got = [tuple(r) for r in df.select(ex.zfill(F.col("f")), ex.ts_code(F.col("f"))).collect()]
    assert got == [("000001", "000001.SZ"), ("600001", "600001.SH"), ("1234567", "1234567.SZ"), (None, None)]
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in df.select(ex.number(F.col("v"))).collect()] == [1.5, None, None, None]
    assert [r[0] for r in df.select(ex.filled(ex.number(F.col("v")))).collect()] == [1.5, 0.0, 0.0, 0.0]
