import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.operators import boosting
from gridlark.operators.boosting import Booster

SCHEMA = "id string, y int, a double, b double, c double"
COLUMNS = ["a", "b", "c"]


def rows_of(n=240, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 20, (n, 3)) / 4.0
    y = ((x[:, 0] > 2) ^ (x[:, 1] > 3) ^ (rng.random(n) < 0.1)).astype(int)
    return [(f"r{i}", int(v), *map(float, r)) for i, (v, r) in enumerate(zip(y, x, strict=True))]


def exact(x, y, weight, ids, b):
    """Margins by trees grown one node after another over all values; leaf-wise by the highest gain first."""
    margin = np.zeros(len(y))
    for tree in range(b.trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        use = boosting.uniform(ids, b.seed, tree) < b.rows
        columns = boosting.drawn_columns(b, tree, x.shape[1])

        def best(at):
            on, found = at[use[at]], (0.0, None)
            G, H = g[on].sum(), h[on].sum()
            for c in columns:
                for v in np.unique(x[:, c])[:-1]:
                    left = on[x[on, c] <= v]
                    gl, hl = g[left].sum(), h[left].sum()
                    if hl >= b.least_weight and H - hl >= b.least_weight:
                        gain = round(gl**2 / (hl + b.l2) + (G - gl) ** 2 / (H - hl + b.l2) - G**2 / (H + b.l2), 9)
                        if gain > found[0] + 1e-12:
                            found = (gain, (c, v))
            return found, -b.rate * G / (H + b.l2)

        leaves = [(np.arange(len(y)), 0, *best(np.arange(len(y))))]
        while True:
            able = [i for i, (_, d, (gain, _), _) in enumerate(leaves) if d < b.depth and gain > 1e-9]
            if not able or b.leaves and len(leaves) >= b.leaves:
                break
            i = max(able, key=lambda i: leaves[i][2][0])
            at, d, (_, (c, v)), _ = leaves.pop(i)
            for side in (at[x[at, c] <= v], at[x[at, c] > v]):
                leaves.append((side, d + 1, *best(side)))
        for at, _, _, value in leaves:
            margin[at] += value
    return margin


@pytest.mark.parametrize("b", [Booster(depth=3, trees=3), Booster("leaf", depth=5, trees=3, leaves=5, seed=7, rate=0.3), Booster(depth=2, trees=2, rows=1.0, columns=1.0)], ids=["depth", "leaf", "all"])
@pytest.mark.parametrize("partitions", [1, 5])
def test_trees_equal_exact_ones(spark, b, partitions):
    rows = rows_of()
    df = spark.createDataFrame(rows, SCHEMA)
    ids = np.array([r.h for r in df.select(F.xxhash64("id").alias("h")).collect()], np.int64)
    x, y = np.array([r[2:] for r in rows]), np.array([r[1] for r in rows], float)
    fit = boosting.boost(df.repartition(partitions), COLUMNS, [b, Booster(depth=1, trees=1)])
    got = {r.id: r.s for r in boosting.scored(df, fit, ["id"], [(0, b.trees)]).collect()}
    wanted = 1 / (1 + np.exp(-exact(x, y, np.where(y == 1, (y == 0).sum() / (y == 1).sum(), 1.0), ids, b)))
    assert max(abs(got[r[0]] - w) for r, w in zip(rows, wanted, strict=True)) < 1e-9


def test_fewer_trees_are_the_first_of_more(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    more, fewer = boosting.boost(df, COLUMNS, [Booster(depth=2, trees=4)]), boosting.boost(df, COLUMNS, [Booster(depth=2, trees=2)])
    s = lambda fit: sorted((r.id, round(r.s, 12)) for r in boosting.scored(df, fit, ["id"], [(0, 2)]).collect())
    assert s(more) == s(fewer)


def test_grid_picks_by_validation(spark):
    part = [spark.createDataFrame(rows_of(300, k), SCHEMA) for k in range(3)]
    got = boosting.best_of_grid(*part, COLUMNS, boosting.grid("depth", (1, 3), 6, (1, 2)) + boosting.grid("leaf", (4,), 6, (1, 2), leaves=6), (3, 6)).collect()
    assert {(r.name, r.seed) for r in got} == {(n, s) for n in ("depth", "leaf") for s in (1, 2)} and len(got) == 1200
    for key in {(r.name, r.seed) for r in got}:
        mine = [r for r in got if (r.name, r.seed) == key]
        pos, neg = [r.s for r in mine if r.y], [r.s for r in mine if not r.y]
        assert np.mean([p > n for p in pos for n in neg]) > 0.75 and len({(r.depth, r.rate, r.trees) for r in mine}) == 1


def test_one_class_and_no_rows(spark):
    for rows in ([], [(f"r{i}", 1, 1.0, 2.0, float(i)) for i in range(9)]):
        fit = boosting.boost(spark.createDataFrame(rows, SCHEMA), COLUMNS, [Booster(depth=2, trees=1)])
        assert [len(t.value) for t in fit.trees[0]] == [1]


def test_boosters_of_one_seed_draw_a_blocks_rows_once(monkeypatch):
    import pyarrow as pa

    class Blocks:
        def mapInArrow(self, run, schema):  # noqa: N802
            self.run = run
            return self

    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 99, 50), rng.integers(0, 2, 50).astype(float), rng.integers(0, 4, (50, 3)).astype(np.uint8), rng.normal(size=(50, 6))]
    batch = pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], names=boosting.BLOCK_NAMES)
    drawn, uniform = [], boosting.uniform
    monkeypatch.setattr(boosting, "uniform", lambda rows, *salt: (drawn.append(len(rows)) if len(salt) == 2 else None, uniform(rows, *salt))[1])
    monkeypatch.setattr(boosting, "summed", lambda blocks, partitions: [{"cell": c, "g": g} for x in blocks.run([batch]) for c, g in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True)])
    boosters = boosting.grid("depth", (2, 3, 4), 1, (1,), (0.1, 0.2))
    found = boosting.level(Blocks(), boosters, {m: boosting.Tree() for m in range(6)}, {m: [0] for m in range(6)}, 0, 1.0, 3, 1)
    assert len(found) == 6 and drawn == [50]


def test_rows_dealt_to_tasks_give_the_trees_of_boosters_in_tasks(spark, monkeypatch):
    df = spark.createDataFrame(rows_of(400, 2), SCHEMA).repartition(3)
    boosters = boosting.grid("depth", (3,), 5, (1, 2)) + boosting.grid("leaf", (6,), 4, (1,), leaves=5)
    found = []
    for rows in (1_000, 0):
        monkeypatch.setattr(boosting, "HELD_ROWS", rows)
        monkeypatch.setattr(boosting, "CUT", 2)
        found.append(boosting.boost(df, COLUMNS, boosters).trees)
    assert [len(t) for t in found[0]] == [5, 5, 5, 5, 4, 4]
    for a, b in zip(*found, strict=True):
        for t, u in zip(a, b, strict=True):
            assert (t.feature, t.bin, t.left, t.right) == (u.feature, u.bin, u.left, u.right) and np.allclose(t.value, u.value, atol=1e-12)


def test_a_leafwise_tree_opens_only_nodes_its_leaves_can_come_from():
    t = boosting.Tree()
    for gain, node in ((9.0, 0), (5.0, 1), (1.0, 2)):
        t.gain[node], t.left[node], t.right[node] = gain, t.child(0.0), t.child(0.0)
    assert t.chosen(3) == {0, 1} and t.chosen(4) == {0, 1, 2} and t.chosen(1) == set()
