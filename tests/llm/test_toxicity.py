import pytest

from gridlark.llm import queries, toxicity


def test_fold():
    assert toxicity.fold("Ѕсum ІDІОТ 1d10t cl0wn! l​oser 2024 mоrоn") == ["scum", "idiot", "idiot", "clown", "loser", "2024", "moron"]


def test_signs_at_the_head_and_tail_of_words():
    assert toxicity.fold("$cum @ss. a-b $tupid @$$hole a$$ cost $5, 2024!") == ["scum", "ass", "a", "b", "stupid", "asshole", "ass", "cost", "5", "2024"]
    lexicon = toxicity.Lexicon({"scum": 2.0, "stupid": 1.0, "idiot": 4.0, "asshole": 8.0}, ("idiot savant",), 1.0, -3.0)
    m = toxicity.Matcher(lexicon)
    for text, hits in (("$cum", 1), ("you $tupid @sshole", 2), ("@idiot you", 1), ("idiot$ $tupid", 2), ("stupid!!idiot", 2), ("stupid$$idiot", 2), ("@idiot savant", 0), ("$tupid @idiot scum", 3), ("@friend idiot", 1)):
        assert m.score(text)[1] == hits, text
        assert m.score(text)[0] > m.score("nice")[0] or not hits


def brute(lexicon, words):
    import math

    found = []
    for kind, phrases in ((1, lexicon.weights), (0, lexicon.exceptions)):
        for p in phrases:
            k = p.split(" ")
            found += [(kind, i, i + len(k), p) for i in range(len(words) - len(k) + 1) if words[i : i + len(k)] == k]
    free = [(a, b) for kind, a, b, _ in found if not kind]
    hits = [lexicon.weights[p] for kind, a, b, p in found if kind and not any(c <= a and b <= d for c, d in free)]
    return sum(hits) / (1 + math.log2(1 + len(words) / 100)), len(hits)


def test_matches_against_brute_force():
    lexicon = toxicity.Lexicon({"scum": 2.0, "trash": 1.0, "you clown": 3.0}, ("trash can", "the trash can"), 1.0, -3.0)
    m = toxicity.Matcher(lexicon)
    for text in ("", "scum scum scum", "the trash can trash", "you clown you", "scummy untrash", "trash " * 300):
        words = toxicity.fold(text)
        assert m.weight(words) == pytest.approx(brute(lexicon, words))


def test_learned_words_and_edges(spark):
    bad = [(i, f"plain words here you Idiot number {i} see", 1) for i in range(20)]
    good = [(100 + i, f"plain words here number {i} see idiot savant talent" if i < 6 else f"plain words here number {i} see", 0) for i in range(60)]
    rows = bad + good
    docs = spark.createDataFrame([(i, t, "zz") for i, t, _ in rows] + [(900, None, "zz"), (901, "", "zz")], "doc_id long, text string, y string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (900, 1), (5, 0), (901, None)], "doc_id long, toxic int")
    lexicon = toxicity.learn(spark, docs, labels)
    assert "idiot savant" in lexicon.exceptions
    out = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    assert out[0].predicted == 1 and out[100].predicted == 0 and out[100].n_hits == 0 and out[900].predicted == out[901].predicted == 0
    assert all(0 <= r.score <= 1 for r in out.values()) and out[0].y == "zz"
    empty = toxicity.learn(spark, docs, labels.where("toxic = 0"))
    assert empty.weights == {} and toxicity.score(docs, empty).where("predicted = 1").count() == 0
    none = toxicity.learn(spark, docs.where("false"), labels.where("false"))
    assert toxicity.score(docs.where("false"), none).count() == 0


def test_clean_uses_in_exceptions_do_not_count_against_a_word(spark):
    bad = [(i, f"plain words here you Idiot number {i} see", 1) for i in range(20)]
    good = [(100 + i, f"plain words here number {i} see idiot savant talent" if i < 8 else f"plain words here number {i} see", 0) for i in range(60)]
    docs, labels = spark.createDataFrame([r[:2] for r in bad + good], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in bad + good] + [(5, 0)], "doc_id long, toxic int")
    lexicon = toxicity.learn(spark, docs, labels)
    assert "idiot" in lexicon.weights and "idiot savant" in lexicon.exceptions and "plain" not in lexicon.weights
    out = {r.doc_id: r for r in toxicity.score(docs, lexicon).collect()}
    assert out[0].predicted == 1 and out[100].predicted == 0 and out[100].n_hits == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op5_toxicity(spark, sf).join(queries.table(spark, sf, "labels"), "doc_id").where("held_out").collect()
    assert len(out) > 50 and sum(r.predicted == r.toxic for r in out) / len(out) > 0.85
