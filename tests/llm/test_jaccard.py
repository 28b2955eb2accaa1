import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlark.llm import jaccard
from gridlark.llm.components import connected
from gridlark.llm.shingles import Shingler, overlap


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingles(t, k=5):
    w = words_of(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    """Documents on their own, copies, near copies, chains of them, and a passage that most share."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    passage = " ".join(word() for _ in range(40))
    docs = []
    for _ in range(12):
        base = [word() for _ in range(rnd.randint(3, 90))]
        for _ in range(rnd.randint(1, 9)):
            w = list(base)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = word()
            docs.append(" ".join(w))
        chain = list(base)
        for _ in range(4):
            chain = chain[max(1, len(chain) // 12) :] + [word() for _ in range(max(1, len(chain) // 12))]
            docs.append(" ".join(chain))
    docs += [f"{passage} {' '.join(word() for _ in range(rnd.randint(1, 60)))}" for _ in range(30)]
    docs += [None, "", " \t\n", "one", "One", "a b c d", "A  b\tc D", "a b c d e"]
    rnd.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("seed", "common_at", "region_pairs", "crowd", "short"), [(1, 64, 2_000, 64, 32), (2, 4, 0, 3, 1), (2, 4, 0, 3, 4)])
def test_components_against_brute_force(spark, seed, common_at, region_pairs, crowd, short):
    """The second case makes every region recursive and ties crowds of three."""
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, i, "x") for i, t in rows], "doc_id long, text string, doc int, n string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, common_at=common_at, region_pairs=region_pairs, crowd=crowd, short=short).collect()}
    assert got == brute(rows)


def test_very_long_texts(spark):
    """Sets of more shingles than the coarse parities have parts, near the threshold on either side."""
    rnd = random.Random(9)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(3_000)]
    rows = [(1, " ".join(base))]
    for i, share in enumerate((0.01, 0.02, 0.022, 0.024, 0.03, 0.2)):
        w = list(base)
        for k in rnd.sample(range(len(w)), int(share * len(w))):
            w[k] = f"x{rnd.randrange(10**6)}"
        rows.append((i + 2, " ".join(w)))
    rows += [(20, " ".join(base[:2_450])), (21, " ".join(base[:2_300])), (22, " ".join(base[1_000:] + base[:500]))]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows)


def test_repeated_keys_keep_every_link(spark):
    """Key 1 has two texts, and links with a near copy of each."""
    a, b = (" ".join(f"{c}{i}" for i in range(40)) for c in "ab")
    rows = [(1, a), (1, b), (2, a + " z"), (3, b + " z"), (4, "q r s t u v"), (4, "q r s t u v"), (5, None), (5, "x y z")]
    got = sorted((r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (5, 5)]


def test_empty_table_and_null_keys(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, None)], "doc_id long, text string")
    rows = sorted((r.doc_id is None, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect())
    assert rows == [(False, 0, 1), (True, 2, None)]
    assert jaccard.jaccard_components(df.where("false")).count() == 0


def test_shingler():
    texts = [t for _, t in corpus(3)]
    sets = Shingler().sets(texts)
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    for i in range(0, len(texts), 3):
        for j in range(0, len(texts), 5):
            assert overlap(sets[i], sets[j]) == len(shingles(texts[i]) & shingles(texts[j]))


def test_connected(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (22, 21), (22, 20), (5, 5), (None, 1)] + [(100 + i, 101 + i) for i in range(40)]
    got = {r.node: r.component for r in connected(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20} | {100 + i: 100 for i in range(41)}
    assert connected(spark, spark.createDataFrame([], "a long, b long")).count() == 0


def test_known_components_are_merged(spark):
    known = connected(spark, spark.createDataFrame([(1, 2), (5, 6), (8, 9)], "a long, b long"))
    got = {r.node: r.component for r in connected(spark, spark.createDataFrame([(6, 2), (7, 9)], "a long, b long"), known=known).collect()}
    assert got == {1: 1, 2: 1, 5: 1, 6: 1, 7: 7, 8: 7, 9: 7}


def test_other_columns_are_not_read(spark):
    df = spark.createDataFrame([(1, "a b c d e", 2)], "doc_id long, text string, component_id int")
    assert jaccard.jaccard_components(df).columns == ["doc_id", "n_shingles", "component_id"]
    assert jaccard.jaccard_components(df.withColumn("n", F.lit(1))).first().component_id == 1


def test_pairs_come_once_however_many_tasks_there_are(spark):
    """Near copies share most of their shingles, which many tasks hold; their pairs come from the task of their home alone, but for the few that have none in common."""
    rnd = random.Random(11)
    docs = []
    for g in range(20):
        base = [f"w{g}x{i}" for i in range(200)]
        for k in range(6):
            w = list(base)
            w[rnd.randrange(len(w))] = f"y{g}x{k}"
            docs.append((len(docs), " ".join(w)))
    df = spark.createDataFrame(docs, "doc long, text string").repartition(3)
    rows = jaccard.assigned(df, 5, jaccard.by_shingles(80), np.zeros(0, np.uint64), 32).repartitionById(32, F.col("bucket"))
    got = [(r.pivot, r.doc) for r in jaccard.pivots(rows, 80).where("pair").collect()]
    assert set(got) == {(a, b) for a in range(120) for b in range(a + 1, 120) if a // 6 == b // 6}
    assert len(got) < 5 * len(set(got))


def test_pairs_of_a_large_group_of_near_copies(spark):
    """2,000 near copies: short lists of words that a few of them share must not pair them over and over, as the long lists hold them all."""
    rnd = random.Random(12)
    base = [f"w{i}" for i in range(120)]
    docs = []
    for i in range(2_000):
        w = list(base)
        for _ in range(3):
            w[rnd.randrange(len(w))] = f"y{rnd.randrange(3)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc long, text string").repartition(3)
    counts = {}
    for _, t in docs:
        for h in Shingler(5).sets([t])[0].tolist():
            counts[h] = counts.get(h, 0) + 1
    common = np.sort(np.array([h for h, n in counts.items() if n >= jaccard.COMMON_AT], np.uint64))
    rows = jaccard.assigned(df, 5, jaccard.by_shingles(80), common, 32).repartitionById(32, F.col("bucket"))
    assert jaccard.pivots(rows, 80).where("pair").select("pivot", "doc").distinct().count() < 12 * len(docs)


def test_components_are_joined_to_regions_once(spark, monkeypatch):
    plans, write = [], jaccard.materialize

    def told(spark, df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(spark, df, name)

    monkeypatch.setattr(jaccard, "materialize", told)
    texts = corpus(3)
    jaccard.jaccard_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), common_at=2, region_pairs=0, crowd=3, short=1).collect()
    mixed = [p for name, p in plans if name == "mixed"]
    assert mixed and not any("Join LeftOuter" in p for p in mixed)
