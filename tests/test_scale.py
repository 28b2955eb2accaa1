"""What queries do as tables grow: nothing that grows is broadcast, rows aren't multiplied, and partitions follow the rows."""

import pytest
from pyspark.sql import functions as F

from gridlark.functions import expressions as ex, metrics
from gridlark.operators import graph
from gridlark.plans import fixtures as fx, queries


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def small(spark):
    m = spark.createDataFrame([(i, (i * 7 + 3) % 40, i % 3) for i in range(40)] * 3, "src long, dst long, rel int")
    f = spark.range(40).select(F.col("id").alias("node"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("v", (F.col("node") % 5 + F.col("k") + 1) / 7.0)
    return m, f


@pytest.mark.parametrize("kernel", [graph.gcn, graph.sage_mean, lambda m, f, n: graph.rgcn_mean(m, f, {0: 1.0}, n), lambda m, f, n: graph.gated(m, f, parts=n), lambda m, f, n: graph.gat(m, f, [0.1, 0.2], [0.3, 0.1], parts=n)])
def test_kernels_broadcast_no_nodes_and_deal_messages_to_the_parts_asked_for(spark, small, kernel):
    out = kernel(*small, 13)
    text = plan(out)
    assert "BroadcastHashJoin" not in text and "13), REPARTITION_BY_NUM" in text


def test_parts_follow_the_rows(spark, sf, monkeypatch):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    monkeypatch.setattr(graph, "PART_ROWS", lines.count() // 20)
    assert fx.line_parts(spark, sf) in (20, 21)
    assert fx.party_edges(spark, sf).rdd.getNumPartitions() in (20, 21)


def test_edges_broadcast_no_relation_with_string_keys(spark, sf):
    text = plan(fx.edges(spark, sf))
    sent = [line for line in text.splitlines() if "HashedRelationBroadcastMode" in line]
    assert sent and not any("string" in line for line in sent)


def test_distinct_counts_multiply_no_rows(spark, sf):
    assert "Expand" not in plan(fx.features(spark, sf))


def test_panel_is_computed_once(spark, sf):
    assert "lineitem" not in fx.panel(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_propagation_writes_messages_once_and_gives_each_node_one_row(spark, sf):
    rows = queries.QUERIES["label_propagation"](spark, sf)
    assert rows.count() == rows.select("node").distinct().count()
    assert "lineitem" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_codes(spark):
    df = spark.createDataFrame([("600000",), ("1",), ("1234567",), ("812345",), ("",), (None,), ("x",)], "c string")
    assert [r[0] for r in df.select(ex.ts_code(F.col("c"))).collect()] == ["600000.SH", "000001.SZ", "1234567.SZ", "812345.BJ", "000000.SZ", None, "00000x.SZ"]


def test_pooled_pairs_are_written_once_and_means_over_seeds_shuffle_nothing_more(spark, sf):
    assert "lineitem" not in queries.pooled_pairs(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    rows = spark.createDataFrame([("a", i, i % 2, i / 7.0) for i in range(40)], "cell string, id long, y int, s_a double")
    means = metrics.pooled(fx.seed_scores(spark, sf, rows), ["cell"], len(fx.SEEDS))
    assert plan(means).split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1 and means.count() == 40


def test_scores_of_penalty_paths_are_rounded_and_written_once(spark, sf):
    text = queries.QUERIES["penalty_paths"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "gridlark-panel" not in text and "round(" not in text
