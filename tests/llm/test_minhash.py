import math

import numpy as np
import pytest

from gridlark.llm import minhash, queries
from gridlark.llm.shingles import Shingler, overlap
from tests.compare import connect, rows_of_spark, rows_of_sql
from tests.llm import test_jaccard
from tests.llm.test_jaccard import corpus, shingles


def brute(rows, monkeypatch):
    monkeypatch.setattr(test_jaccard, "shingles", lambda t: shingles(t, 2))
    return {i: (n, c, i == c) for i, (n, c) in test_jaccard.brute(rows).items()}


@pytest.mark.parametrize(("seed", "common_at", "region_pairs", "crowd", "short"), [(5, 8, 2_000, 64, 32), (6, 4, 0, 3, 1)])
def test_components_against_brute_force(spark, monkeypatch, seed, common_at, region_pairs, crowd, short):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, i, True) for i, t in rows], "doc_id long, text string, sig long, kept boolean").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, common_at=common_at, region_pairs=region_pairs, crowd=crowd, short=short).collect()}
    assert got == brute(rows, monkeypatch)


def test_agreement_follows_similarity():
    """The share of coordinates that agree is the similarity, within four deviations; links at the threshold stay far above the number asked for."""
    rng = np.random.default_rng(3)
    signer, fewest = minhash.Signer(), []
    for _ in range(200):
        n = int(rng.integers(5, 400))
        both = int(np.ceil(8 * n / 9))
        rest = n - both
        s = rng.integers(0, 2**63, n + rest, dtype=np.uint64)
        a, b = np.unique(s[:n]), np.unique(np.r_[s[:both], s[n:]])
        j = overlap(a, b) / (len(a) + len(b) - overlap(a, b))
        agree = int((signer.values(a) == signer.values(b)).sum())
        assert abs(agree - 128 * j) <= 4.5 * math.sqrt(128 * j * (1 - j)) + 1
        if j >= 0.8:
            fewest.append(agree)
    assert min(fewest) > minhash.MATCHES + 8


def test_signatures_that_agree_meet_in_a_prefix():
    """Any order: of 128 pairs, two signatures that agree in 76 share one of the first 53 of either."""
    rng = np.random.default_rng(4)
    for _ in range(50):
        a = rng.permutation(300)[:128]
        b = np.r_[rng.permutation(a)[:76], 1000 + np.arange(52)]
        order = rng.permutation(2000)
        first = lambda x: set(sorted(x, key=lambda v: order[v])[:53])
        assert first(a) & first(b)


def test_null_keys_repeated_keys_and_no_rows(spark):
    schema = "doc_id long, text string"
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "x y z"), (9, "x y z"), (2, None)], schema)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(2, 0, 2, True), (4, 2, 4, True), (4, 2, 4, True), (9, 2, 4, False)]
    assert [(r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is None] == [(2, None, True)]
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []


def test_long_text(spark):
    text = " ".join(f"w{i % 7919}x{i % 101}" for i in range(150_000))
    got = minhash.near_duplicates(spark.createDataFrame([(1, text), (2, text + " end"), (3, "short one")], "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: r.n_shingles for r in got}[1] == len(np.unique(Shingler(2).sets([text])[0]))


def test_query_equals_sql(spark, sf):
    assert rows_of_spark(queries.op13_minhash(spark, sf)) == rows_of_sql(connect(sf), queries.ORACLE_SQL["op13_minhash"])
