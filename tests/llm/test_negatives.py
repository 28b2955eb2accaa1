import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm import negatives, queries
from tests.compare import connect, rows_of_spark, rows_of_sql

SCHEMA = "vec_id long, embedding array<float>, label int, cell int, d string, anchor string"


def brute(rows, every, k, m):
    held = {}
    for i, v, label, *_ in rows:
        if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v):
            new = (label, [int(np.floor(256 * float(np.float32(x)))) for x in v])
            held[i] = min(held.get(i, new), new)
    out = []
    for a, (label, v) in held.items():
        if a % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j, other) for j, (other, w) in held.items() if j != a)
            for s, j, other in [x for x in scored if x[2] == label][:k]:
                wanted = [x for x in scored if x[2] != label and 30 * -s <= 100 * -x[0] <= 90 * -s][:m]
                out += [(a, j, r, x[1], -s, -x[0]) for r, x in enumerate(wanted, 1)]
    return sorted(out)


def made(seed, n=500, dim=8, labels=4):
    """Vectors in clusters of different norms, a third of them the same one, some opposite or zero, a rare label, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(6, dim))
    x = centre[rng.integers(0, 6, n)] * rng.uniform(0.2, 2.0, (n, 1)) + 0.3 * rng.normal(size=(n, dim))
    x[::3] = x[0]
    x[7], x[20], x[21] = -x[0], 0, 0
    label = rng.integers(0, labels, n)
    label[[40, 41]] = 99
    rest = [None, "x", "y"]
    rows = [(i, v.tolist(), int(c), *rest) for i, (v, c) in enumerate(zip(x.astype(np.float32), label, strict=True))]
    nan, inf = float("nan"), float("inf")
    odd = [(n, None, 1), (n + 20, [], 1), (n + 40, [None] * dim, 1), (n + 60, [nan] * dim, 1), (n + 80, [inf] + [0.0] * (dim - 1), 1), (n + 100, x[1].tolist(), None), (None, x[1].tolist(), 1), (20, x[3].tolist(), 1)]
    return rows + rows[:30] + [(*r, *rest) for r in odd]


@pytest.mark.parametrize(("pivots", "block_rows", "seed"), [(64, 2048, 1), (5, 16, 2), (1, 7, 3)])
def test_against_brute_force(spark, pivots, block_rows, seed):
    rows = made(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, F.col("label"), pivots=pivots, block_rows=block_rows)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 20, 5, 10)


def test_cells_out_of_reach_are_not_compared(spark):
    """Two far clusters: the positives of one need no block of the other."""
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(size=(200, 4)) * 0.01 + [9, 0, 0, 0], rng.normal(size=(200, 4)) * 0.01 - [9, 0, 0, 0]]
    most = float((np.floor(256 * x) ** 2).sum(1).max())
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    held = negatives.usable(df, "vec_id", "embedding", F.col("label"), F.col("vec_id") % 20 == 0, 256)
    points = negatives.spread_pivots(negatives.augmented(np.floor(256 * x).astype(np.int64), most), 2)
    cells = negatives.blocks(negatives.assigned(held, points, most, False), 64)
    chosen = negatives.assigned(held.where("anchor"), points, most, True)
    wide = negatives.reach(spark, chosen, negatives.nearest_of(cells, points, most, 5), points, 5, 1)
    got = wide.join(cells, ["cell", "label"]).where("d_max >= near and d_min <= far").groupBy("g", "cell").count().collect()
    assert {(r.g, r.cell) for r in got} == {(0, 0), (1, 1)}


def test_empty_tables(spark):
    for rows in ([], [(1, [1.0], 1, None, "x", "y")]):
        assert negatives.hard_negatives(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0, F.col("label")).collect() == []


def test_different_lengths_are_an_error(spark):
    df = spark.createDataFrame([(1, [1.0], 1, None, "x", "y"), (2, [1.0, 2.0], 1, None, "x", "y")], SCHEMA)
    with pytest.raises(ValueError, match="lengths"):
        negatives.hard_negatives(df, F.col("vec_id") == 1, F.col("label"))


def test_query_equals_sql(spark, sf):
    assert rows_of_spark(queries.op12_hard_negatives(spark, sf)) == rows_of_sql(connect(sf), queries.ORACLE_SQL["op12_hard_negatives"])
