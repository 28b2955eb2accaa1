import numpy as np
import pytest

from gridlark.llm import topk


def brute(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            usable.setdefault(i, []).append([int(np.floor(256 * float(np.float32(x)))) for x in v])
    flat = [(i, v) for i, vs in usable.items() for v in vs]
    out = set()
    for i, v in flat:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in flat if j != i and len(w) == len(v))[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize("block_rows", [64, 4096])
def test_against_brute_force(spark, block_rows):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[100:120] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, []), (550, [None] * 16), (551, [float("nan")] * 16), (552, [float("inf")] * 16), (None, x[0].tolist()), (600, [1.0, 2.0]), (601, [1.0, 3.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    got = {tuple(r) for r in topk.top_k(df.where("vec_id % 50 = 0"), df, block_rows=block_rows).collect()}
    assert got == brute(rows, 5)
    assert topk.top_k(df.where("false"), df).count() == topk.top_k(df.where("vec_id = 0"), df.where("false")).count() == 0


def test_bounds_hold_at_each_level():
    rng = np.random.default_rng(5)
    q, x = rng.normal(size=(20, 64)), rng.normal(size=(300, 64))
    last = None
    for parts in (*topk.LEVELS, 64):
        bound = topk.statistics(q, parts) @ topk.statistics(x, parts).T
        assert (bound >= q @ x.T - 1e-9).all()
        assert last is None or (bound <= last + 1e-9).all()
        last = bound
    assert last == pytest.approx(q @ x.T)


@pytest.mark.parametrize("block_rows", [2, 4096])
def test_a_repeated_query_id_is_answered_for_each_of_its_vectors(spark, block_rows):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (100, [1.0, 1.0]), *[(i, [float(i), -float(i)]) for i in range(1, 9)]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = sorted(tuple(r)[1:] for r in topk.top_k(df.where("vec_id = 50"), df, block_rows=block_rows).collect())
    first = [(r, 9 - r, 65536 * (9 - r)) for r in range(1, 6)]
    other = [(1, 100, 65536), *[(r, r - 1, -65536 * (r - 1)) for r in range(2, 6)]]
    assert out == sorted(first + other * 2)


def test_wide_components(spark):
    rows = [(0, [2.0**20, 1.0]), (1, [2.0**21, 3.0]), (2, [1.0, 1.0]), (3, [-(2.0**21), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = [tuple(r) for r in topk.top_k(df.where("vec_id = 0"), df).orderBy("rank").collect()]
    assert out == [(0, 1, 1, 2**57 + 3 * 65536), (0, 2, 2, 2**36 + 65536), (0, 3, 3, -(2**57))]
    huge = spark.createDataFrame([(0, [1e300]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        topk.top_k(huge.where("vec_id = 0"), huge).collect()
