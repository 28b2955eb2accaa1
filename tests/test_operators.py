import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import graph, learners, panel, reporting
from gridlark.sources import sinks, tables
from gridlark.streaming import snapshots


def test_modalities():
    class Frame:
        columns = ["firm_id", "fini_b", "fin_a", "feat_z", "feat_a", "audit_x"]

    c = panel.Catalogue()
    assert c.columns(Frame, "M3") == ["feat_a", "feat_z", "fin_a"]
    assert c.columns(Frame, "M3", in_order=True) == ["fin_a", "feat_z", "feat_a"]
    assert c.columns(Frame, "G6") == [panel.CONSTANT]
    c.register("P", ["pld"])
    with pytest.raises(ValueError):
        c.columns(Frame, "P")
    assert panel.contract(Frame, ["firm_id"], {"audit": 5}) == ["audit: 1 columns, expected 5"]
    with pytest.raises(ValueError):
        panel.contract(Frame, ["missing"])


def test_scalers(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (float("nan"), 3.0), (5.0, 3.0)], "a double, b double")
    pop = {r.feature: r for r in panel.scaler(df, ["a", "b"]).collect()}
    assert pop["a"].mean == 1.5 and pop["a"].sd == pytest.approx(np.std([1, 0, 0, 5]) + 1e-6)
    samp = {r.feature: r for r in panel.scaler(df, ["a", "b"], population=False).collect()}
    assert samp["a"].mean == 3 and samp["a"].sd == pytest.approx(np.std([1, 5], ddof=1)) and samp["b"].sd == 1.0
    assert panel.standardized(df, df, ["a"]).agg(F.avg("a")).first()[0] == pytest.approx(0, abs=1e-9)


def test_keep_first_and_audit(spark):
    df = spark.createDataFrame([("1", 2000, "b"), ("1", 2000, "a"), ("2", 2000, "c")], "firm_id string, year int, node_id string")
    assert sorted(r.node_id for r in panel.keep_first(df, ["firm_id", "year"], ["node_id"]).collect()) == ["a", "c"]
    assert sorted(r.node_id for r in panel.keep_last(df, ["firm_id", "year"], ["node_id"]).collect()) == ["b", "c"]
    a = panel.audit(spark.createDataFrame([("x",), (None,)], "node_id string")).first()
    assert (a.n_rows, a.n_unmatched, a.unmatched_rate) == (2, 1, 0.5)


def test_dense_index(spark):
    ids = [f"{c}:{i:06d}" for c in "CIP" for i in range(50)]
    df = spark.createDataFrame([(x,) for x in ids], "node_id string")
    got = {r.node_id: r.node_idx for r in graph.dense_index(df, "node_id", 7, buckets=5).collect()}
    assert got == {x: i + 7 for i, x in enumerate(sorted(ids))}
    assert graph.dense_index(df.where("false"), "node_id").count() == 0


def messages(spark):
    rng = np.random.default_rng(1)
    m = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 8, 30), rng.integers(0, 8, 30), rng.integers(0, 2, 30), strict=True)]
    x = rng.normal(size=(10, 3))
    f = [(i, k, float(x[i, k])) for i in range(10) for k in range(3)]
    return m, x, spark.createDataFrame(m, "src long, dst long, rel int"), spark.createDataFrame(f, "node long, k int, v double")


def dense(df, shape=(10, 3), column="v"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.node, r.k] = r[column]
    return out


def test_kernels_against_numpy(spark):
    m, x, ms, fs = messages(spark)
    a = np.zeros((10, 10))
    for s, d, _ in m:
        a[d, s] += 1
    loops = a - np.diag(np.diag(a)) + np.eye(10)
    deg = loops.sum(1)
    assert dense(graph.gcn(ms, fs)) == pytest.approx((loops / np.sqrt(np.outer(deg, deg))) @ x)
    n = np.maximum(a.sum(1), 1)[:, None]
    assert dense(graph.sage_mean(ms, fs)) == pytest.approx(a @ x / n)
    total = x.copy()
    for rel, w in ((0, 0.5), (1, 2.0)):
        r = np.zeros((10, 10))
        for s, d, k in m:
            r[d, s] += k == rel
        total += w * (r @ x) / np.maximum(r.sum(1), 1)[:, None]
    assert dense(graph.rgcn_mean(ms, fs, {0: 0.5, 1: 2.0})) == pytest.approx(total)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    g = a / (1 + np.exp(-10 * unit @ unit.T))
    assert dense(graph.gated(ms, fs)) == pytest.approx(g @ x / np.maximum(g.sum(1), 1e-6)[:, None])
    e = x @ [1.0, 2.0, -1.0] + (x @ [0.5, 0.0, 1.0])[:, None]
    w = loops * np.exp(np.where(e > 0, e, 0.2 * e))
    assert dense(graph.gat(ms, fs, [1.0, 2.0, -1.0], [0.5, 0.0, 1.0])) == pytest.approx(w @ x / w.sum(1)[:, None])


def test_label_propagation(spark):
    m, _, ms, _ = messages(spark)
    both = ms.select("src", "dst").unionByName(ms.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    a = np.zeros((10, 10))
    for s, d, _ in m:
        a[d, s] += 1
        a[s, d] += 1
    deg = np.maximum(a.sum(1), 1)
    y = np.array([1.0, 0, 0, 1, 0, 0, 0, 0, 0, 1])
    h = y.copy()
    for _ in range(3):
        h = np.clip(0.9 * (a / np.sqrt(np.outer(deg, deg))) @ h + 0.1 * y, 0, 1)
    got = {r.node: r.h for r in graph.label_propagation(both, spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "node long, y int")).collect()}
    assert [got[i] for i in range(10)] == pytest.approx(list(h))


def test_relations(spark):
    df = spark.createDataFrame([("E3_MANAGER",), ("odd",)], "t string")
    assert [r[0] for r in df.select(graph.relation(F.col("t"), lenient=True)).collect()] == [2, 0]
    with pytest.raises(Exception, match="unknown edge type"):
        df.select(graph.relation(F.col("t"))).collect()
    e = spark.createDataFrame([(1, 2, "a", 2000), (1, 2, "a", 2001), (3, 3, "b", 2000)], "src_idx long, dst_idx long, edge_type string, year long")
    assert graph.both_ways(e).count() == 6 and graph.simple_undirected(e).count() == 1 and graph.without_type(e, "a").count() == 1
    assert [(r.edge_type, r.n) for r in graph.type_counts(e).collect()] == [("a", 2), ("b", 1)]


def test_walks(spark):
    g = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 2)], "src long, dst long")
    starts = spark.createDataFrame([(1, 0), (3, 0), (9, 0)], "start long, walk int")
    out = {r.start: r.path for r in graph.walks(g, starts, 4, graph.random_steps(1)).collect()}
    assert out[9] == [9] and len(out[1]) == 5 and all(abs(a - b) == 1 for a, b in zip(out[1], out[1][1:], strict=False))
    assert out == {r.start: r.path for r in graph.walks(g, starts, 4, graph.random_steps(1)).collect()}


def test_logistic_solves_its_objective(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2))
    y = (x[:, 0] + rng.normal(size=200) > 0.5).astype(int)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for (a, b), c in zip(x, y, strict=True)], "a double, b double, y int")
    m = learners.logistic(df, ["a", "b"], "y")
    w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum())))
    p = 1 / (1 + np.exp(-(x @ m.coefficients.toArray() + m.intercept)))
    assert m.coefficients.toArray() + x.T @ (w * (p - y)) == pytest.approx(np.zeros(2), abs=1e-2)


def test_reporting(spark):
    res = spark.createDataFrame([("A", "M5", 1, 0.5), ("A", "M5", 2, float("nan")), ("A", "M11", 1, 0.7), ("A", "M11", 2, 0.8), ("A", "M11", 3, 0.9)], "model string, modal string, seed int, test_auc double")
    agg = {r.modal: r for r in reporting.seed_agg(res, ["model", "modal"]).collect()}
    assert agg["M5"].n == 1 and agg["M5"].sd is None and agg["M11"].mean == 0.8 and agg["M11"].sd == 0.1
    assert [r.modal for r in reporting.seed_agg_having(res, ["model", "modal"]).collect()] == ["M11"]
    assert [r.modal for r in reporting.presented(res.select("modal").distinct(), "modal", ["M11", "M5"]).collect()] == ["M11", "M5"]


def test_documents_round_trip(spark, tmp_path):
    row = {"model": "MLP", "modal": "M5", "label": "x", "seed": 1, "test_auc": 0.7}
    sinks.write_document(str(tmp_path / "a.json"), "run", summary=[row])
    (tmp_path / "b.json").write_text(json.dumps({"rows": [row | {"test_auc": None, "metrics": {"auc": 0.6}}]}))
    (tmp_path / "c.json").write_text("{broken")
    (tmp_path / "d.json").write_text(json.dumps([{k: v for k, v in row.items() if k != "test_auc"}]))
    got = {r.file: r.test_auc for r in tables.results(spark, str(tmp_path / "*.json")).collect()}
    assert got["a.json"] == 0.7 and got["b.json"] == 0.6 and got["d.json"] != got["d.json"] and "c.json" not in got
    assert "MLP" in sinks.latex(tables.results(spark, str(tmp_path / "a.json")).select("model", "test_auc"), "t")


def test_tables(spark, sf, tmp_path):
    assert tables.table(spark, f"{sf}/nation.parquet", ["n_name"]).columns == ["n_name"]
    with pytest.raises(FileNotFoundError):
        tables.table(spark, f"{tmp_path}/none.parquet")
    assert tables.optional(spark, f"{tmp_path}/none.parquet", tables.EDGE_INDEX).count() == 0
    assert tables.Paths.of("/r", None)("x") == "/r/x.parquet"
    s = tables.synthetic(spark, 50, {"feat_a": {"dtype": "int8", "min": 0, "max": 3, "mean": 1, "std": 5}, "fin_b": {"dtype": "float64", "min": -1.0, "max": 1.0, "mean": 0.0}}, labels=("y",))
    r = s.agg(F.min("feat_a").alias("a"), F.max("feat_a").alias("b"), F.min("year").alias("c"), F.max("year").alias("d"), F.max("y").alias("y")).first()
    assert 0 <= r.a <= r.b <= 3 and 2010 <= r.c <= r.d <= 2024 and r.y == 0
    sinks.write_table(s, str(tmp_path / "p"), ["year"])
    sinks.write_csv(s.limit(3), str(tmp_path / "c"))
    assert tables.table(spark, str(tmp_path / "p")).count() == 50
    (tmp_path / "d.json").write_text(json.dumps({"feat_a": {"dtype": "int8", "min": 0, "max": 1, "mean": 0.5, "std": 0.1}}))
    assert tables.dictionary(spark, str(tmp_path / "d.json")).first().feature == "feat_a"


def test_streams(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf}/events.parquet").write.mode("overwrite").parquet(str(tmp_path / "in" / "e"))
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "e"))
    q = snapshots.score_stream(rows, lambda df: df.select("event_id", (F.col("value") * 2).alias("s")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(str(tmp_path / "in" / "e")).count()
    w = snapshots.windowed_counts(spark.read.parquet(f"{sf}/events.parquet"))
    assert w.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_synthetic_rows_depend_on_seed_and_row_alone(spark):
    columns = {"feat_a": {"dtype": "float64", "min": -3.0, "max": 9.0, "mean": 2.0, "std": 1.5}, "fin_b": {"dtype": "int32", "min": 0, "max": 20, "mean": 10, "std": 3.0}, "fin_c": {"dtype": "float32", "min": -1e9, "max": 1e9, "mean": 0.0, "std": 1.0}}
    one, three, many = (tables.synthetic(spark, 20_000, columns, partitions=k).collect() for k in (1, 3, 16))
    assert sorted(one) == sorted(three) == sorted(many)
    assert sorted(tables.synthetic(spark, 50, columns).collect()) == sorted(one)[:50]
    assert sorted(tables.synthetic(spark, 50, columns, seed=7).collect()) != sorted(one)[:50]
    a, b, c = (np.array([r[k] for r in one], float) for k in columns)
    assert a.mean() == pytest.approx(2.0, abs=0.05) and a.std() == pytest.approx(1.5, abs=0.05) and -3.0 <= a.min() and a.max() <= 9.0
    assert b.mean() == pytest.approx(10.0, abs=0.1) and b.min() >= 0 and b.max() <= 20 and (b == b.round()).all()
    assert abs(np.corrcoef(a, c)[0, 1]) < 0.03 and abs(c.mean()) < 0.03 and c.std() == pytest.approx(1.0, abs=0.03)
    years = np.bincount([r.year - 2010 for r in one], minlength=15)
    assert len(years) == 15 and years.min() > 20_000 / 15 * 0.9


def test_synthetic_without_rows_or_features(spark):
    assert tables.synthetic(spark, 0, {}).collect() == []
    assert [tuple(r)[0] for r in tables.synthetic(spark, 2, {}, labels=("y",)).collect()] == ["SYN00000", "SYN00001"]
