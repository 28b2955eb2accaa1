import os
import time

import pytest
from pyspark.sql import functions as F

from gridlark.sources import scores


def rows_of(spark, n=200, shift=0.0, seeds=(1, 2), model="MLP"):
    seed = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    x = spark.range(0, n, 1, 4).select("id", seed)
    return x.select(F.lit(model).alias("model"), F.lit("M1/=x").alias("modal"), F.lit("y").alias("label"), "seed", F.col("id").cast("string").alias("id"), (F.col("id") % 2).cast("int").alias("y"), (F.col("id") / 7.0 + F.col("seed") + shift).alias("s"))


def content(df):
    return sorted(map(tuple, df.collect()))


def files(path):
    return sorted(os.listdir(f"{path}/files"))


def test_round_trip_and_choice_of_sets(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    wanted = rows_of(spark)
    scores.save(wanted, path)
    assert content(scores.load(spark, path)) == content(wanted)
    assert content(scores.load(spark, path, seed=2)) == content(wanted.where("seed = 2"))
    assert content(scores.load(spark, path, model="GCN")) == []
    parts = lambda **wanted: [len(p.files) for p in scores.Reader(path, wanted).partitions()]
    assert parts(seed="2") == [4] and parts() == [8]
    monkeypatch.setattr(scores, "PART_ROWS", 100)
    assert parts(seed="2") == [2, 2]
    monkeypatch.setattr(scores, "PART_ROWS", 10)
    assert parts(seed="2") == [1, 1, 1, 1] and content(scores.load(spark, path)) == content(wanted)
    with pytest.raises(ValueError, match="no fold"):
        scores.load(spark, path, fold=1)


def test_overwrite_replaces_its_own_sets_and_append_adds(spark, tmp_path):
    path = "file:" + str(tmp_path / "store")
    scores.save(rows_of(spark), path)
    scores.save(rows_of(spark, 50, 3.0, seeds=(2, 3)), path)
    wanted = content(rows_of(spark, seeds=(1,))) + content(rows_of(spark, 50, 3.0, seeds=(2, 3)))
    assert content(scores.load(spark, path)) == sorted(wanted)
    more = rows_of(spark, 3, 9.0, seeds=(3,))
    scores.save(more, path, "append")
    wanted = sorted(wanted + content(more))
    assert content(scores.load(spark, path)) == wanted
    assert scores.vacuum(path) == 4 and scores.vacuum(path) == 0
    assert content(scores.load(spark, path)) == wanted


def test_a_failed_task_leaves_the_old_set(spark, tmp_path):
    path = str(tmp_path / "store")
    old = rows_of(spark)
    scores.save(old, path)
    before, held = content(scores.load(spark, path)), files(path)
    late = F.when(F.col("id") == "150", F.raise_error(F.lit("lost"))).otherwise(F.col("s"))
    with pytest.raises(Exception, match="lost"):
        scores.save(rows_of(spark, shift=5.0).withColumn("s", late.cast("double")), path)
    assert content(scores.load(spark, path)) == before and set(held) <= set(files(path))
    for _ in range(40):  # tasks that were at work when another failed may end later; what they leave is never named
        scores.vacuum(path)
        if not spark.sparkContext.statusTracker().getActiveJobsIds():
            break
        time.sleep(0.5)
    time.sleep(2)
    scores.vacuum(path)
    assert files(path) == held and content(scores.load(spark, path)) == before


def test_files_of_tasks_that_ended_go_when_another_fails(spark, tmp_path):
    path = str(tmp_path / "store")
    scores.save(rows_of(spark), path)
    held = files(path)
    w = scores.Writer(path, True)
    done = w.write(rows_of(spark, shift=1.0).toArrow().to_batches())
    assert len(files(path)) > len(held)
    w.abort([done, None])
    assert files(path) == held and content(scores.load(spark, path)) == content(rows_of(spark))


def test_unsorted_rows_null_names_and_empty_tables(spark, tmp_path):
    path = str(tmp_path / "store")
    w = scores.Writer(path, True)
    w.commit([w.write(rows_of(spark, 20).orderBy("id", "seed").toArrow().to_batches())])
    assert content(scores.load(spark, path)) == content(rows_of(spark, 20))
    scores.save(rows_of(spark, 0), path)
    assert content(scores.load(spark, path)) == content(rows_of(spark, 20))
    with pytest.raises(Exception, match="a row without"):
        scores.save(rows_of(spark, 4).withColumn("modal", F.lit(None).cast("string")), path)
    assert content(scores.load(spark, str(tmp_path / "none"))) == []
    odd = rows_of(spark, 1, seeds=(7,)).withColumn("y", F.lit(None).cast("int")).withColumn("s", F.lit(None).cast("double")).withColumn("extra", F.lit(1))
    scores.save(odd, path)
    assert content(scores.load(spark, path, seed=7)) == content(odd.drop("extra"))
