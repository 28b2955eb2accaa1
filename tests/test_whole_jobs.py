"""The learner queries train as long and as wide as the reference does."""

import pytest

from gridlark.operators import attention, gated, networks
from gridlark.plans import queries


class Trained(Exception):
    pass


def given(spark, monkeypatch, module, name):
    """The network that a query has trained."""

    def train(nodes, messages, net, *_):
        raise Trained(net)

    nodes = spark.createDataFrame([], "year long, node long, y double, split string, v array<double>")
    monkeypatch.setattr(queries.fx, "snapshots", lambda *_: (nodes, spark.createDataFrame([], "year long, src long, dst long, rel int")))
    monkeypatch.setattr(queries, "written", lambda df, *_: df)
    monkeypatch.setattr(module, "train", train)
    with pytest.raises(Trained) as e:
        queries.QUERIES[name](spark, "")
    return e.value.args[0]


@pytest.mark.parametrize("module, name", [(networks, "gcn_trained"), (networks, "sage_trained"), (networks, "rgcn_trained"), (attention, "gat_trained"), (gated, "gated_trained")])
def test_networks_learn_for_a_hundred_epochs_with_64_units(spark, monkeypatch, module, name):
    net = given(spark, monkeypatch, module, name)
    assert (net.epochs, net.hidden) == (100, 64)


@pytest.mark.parametrize("name, depths, leaves", [("gbt_grid", {4, 6}, None), ("leafwise_grid", {8, 6}, 31)])
def test_boosters_grow_400_and_800_trees(spark, monkeypatch, name, depths, leaves):
    rows = spark.createDataFrame([], "firm_id string, year int, label int, split string, " + ", ".join(f"{c} double" for c in queries.COLUMNS))

    def best_of_grid(train, val, test, columns, boosters, counts):
        raise Trained(boosters, counts)

    monkeypatch.setattr(queries, "learned", lambda *_: rows)
    monkeypatch.setattr(queries, "written", lambda df, *_: df)
    monkeypatch.setattr(queries.boosting, "best_of_grid", best_of_grid)
    with pytest.raises(Trained) as e:
        queries.QUERIES[name](spark, "")
    boosters, counts = e.value.args
    assert counts == (400, 800) and {(b.depth, b.rate, b.seed) for b in boosters} == {(d, r, s) for d in depths for r in (0.05, 0.1) for s in queries.CELL_SEEDS}
    assert {(b.trees, b.leaves) for b in boosters} == {(800, leaves)}
