"""Every registered query of the engine against its SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from compare import connect, rows_of_spark, rows_of_sql

from gridlark.plans.oracle import SQL
from gridlark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, sf, con, name):
    columns, rows = rows_of_spark(QUERIES[name](spark, sf))
    wanted_columns, wanted = rows_of_sql(con, SQL[name])
    assert columns == wanted_columns
    assert rows == wanted
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_learners_give_scores(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert rows
    if name in ("mlp_cell", "mlp_sweep"):
        assert {r.status for r in rows} == {"ok"} and len({(r.modal, r.seed, r.lr, r.hidden) for r in rows}) == (10 if name == "mlp_cell" else 4)
    elif name == "penalty_paths":
        assert len(rows) == 40 and all(0 <= r.val_auc <= 1 and 0 <= r.test_auc <= 1 for r in rows)
        assert [r.feat_n_orders == r.rpt_n_parts == 0 for r in rows if r.kind == "lasso" and r.step == 0] == [True]
    else:
        assert all(0 <= r.s <= 1 and r.y in (0, 1) for r in rows)


def test_node2vec_scores_every_test_row(spark, sf):
    from gridlark.plans import fixtures as fx

    wanted = fx.panel(spark, sf).where("split = 'test'").select("firm_id", "year").collect()
    assert sorted(QUERIES["node2vec_lr"](spark, sf).select("firm_id", "year").collect()) == sorted(wanted)


def test_mlp_cell_trains_past_ten_epochs(spark, sf):
    assert max(r.best_epoch for r in QUERIES["mlp_cell"](spark, sf).select("best_epoch").distinct().collect()) > 10


def test_entry():
    import __spark_entry__ as e

    assert set(SQL) <= set(e.oracle_sql()) and set(QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
