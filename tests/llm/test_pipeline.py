import pytest

from gridlark.llm import queries
from gridlark.llm.common import shared_dir

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    sf = "/root/testdata/sf0.001"
    path = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    key = "f4263ddb94c4e535f394d37397b31071c0a45f5c"
    story = "once upon a time there was a very long road that led over hills and rivers to the sea"
    more = [(900001, story), (900002, story), (900003, f'some words of its own token = "{key}" come here'), (900004, None), (900005, "")]
    extra = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in more], docs.schema)
    docs.unionByName(extra).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path), key


def test_stages(spark, made):
    path, key = made
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "jaccard", "secrets", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = docs
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in out.collect()} if name != "packing" else before
        out = stage(spark, out, path)
        target = f"{shared_dir(spark)}/test-{name}"
        out.write.mode("overwrite").parquet(target)
        out = spark.read.parquet(target)
        if name == "packing":
            break
        assert sorted(out.columns) == sorted(docs.columns)
        after = {r.doc_id: r.text for r in out.collect()}
        if name == "toxicity":
            scored = {r.doc_id: r.predicted for r in queries.op5_toxicity(spark, path).collect()}
            assert set(after) == {d for d, p in scored.items() if not p} and {900001, 900004, 900005} <= set(after)
        elif name == "jaccard":
            from test_jaccard import brute

            assert set(after) == {d for d, (_, c) in brute(list(before.items())).items() if c == d} and 900002 not in after
        else:
            assert set(after) == set(before) and key not in after[900003] and "[SECRET]" in after[900003]
            assert all(after[d] == before[d] for d in after if "[SECRET]" not in (after[d] or ""))
            before = after
    assert {r.doc_id for r in out.collect()} == set(before)


def test_registered(spark):
    import __spark_entry__ as e

    ops = {int(n[2:].split("_")[0]) for n in e.queries() if n.startswith("op")}
    assert ops == set(range(1, 11)) and "pipeline" in e.queries()
