"""How rows are dealt into buckets: it decides the work of a task, never a result."""

import bisect

import pytest
from pyspark.sql import functions as F

from gridlark.functions import metrics
from gridlark.operators import graph
from gridlark.sources import steps


@pytest.mark.parametrize("n", [0, 1, 31, 33, 100, 1023])
def test_place_is_a_bisection(spark, n):
    points = [3.0 * i for i in range(n)]
    rows = spark.range(-5, 3 * n + 5).select(F.col("id").cast("double").alias("s"))
    for s, k in rows.select("s", metrics.place(points, "double", F.col("s")).alias("k")).collect():
        assert k == bisect.bisect_right(points, s)


def test_split_points_follow_the_rows(spark, monkeypatch):
    rows = spark.range(1000).select(F.col("id").cast("double").alias("s"))
    assert metrics.split_points(rows, "s") == []
    monkeypatch.setattr(metrics, "BUCKET_ROWS", 100)
    points = metrics.split_points(rows, "s")
    assert len(points) == 9
    assert all(abs(p - 100 * i) < 10 for i, p in enumerate(points, 1))
    assert metrics.split_points(rows.where("false"), "s") == []


def test_key_points_estimate_the_rows(spark, monkeypatch):
    rows = spark.range(20_000).select(F.format_string("K%08d", "id").alias("key"))
    monkeypatch.setattr(graph, "SAMPLE", 2000)
    monkeypatch.setattr(graph, "BUCKET_ROWS", 1000)
    points = graph.key_points(rows, "key")
    assert 17 <= len(points) <= 23
    numbered = graph.dense_index(rows.unionByName(spark.createDataFrame([(None,)], "key string")), "key")
    got = [r.key for r in numbered.orderBy("node_idx").collect()]
    assert got == [None, *sorted(got[1:])] and numbered.select("node_idx").distinct().count() == 20_001


def test_written_steps_lie_in_the_shared_folder(spark):
    df = steps.written(spark.range(3), "step")
    assert sorted(r.id for r in df.collect()) == [0, 1, 2]
    assert all(f.startswith(("file:" + steps.shared_folder(spark), "file://" + steps.shared_folder(spark))) for f in df.inputFiles())
