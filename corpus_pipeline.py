"""A corpus pipeline: toxic documents go, one of each group of near duplicates stays, secrets are masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlark.llm import jaccard, packing, queries, secrets, toxicity
from gridlark.llm.common import discard, materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5. The lexicon is learned from labelled documents that aren't held out. Null and empty texts have no match and get the
    lexicon's offset; repeated rows and null keys are judged each; an empty table stays empty. Columns other than those of documents are dropped."""
    lexicon = queries.toxicity_lexicon(spark, docs, sf_dir)
    discard(spark)
    return toxicity.score(docs.select(*COLUMNS), lexicon).where("predicted = 0").select(*COLUMNS)


def drop_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each component of near duplicates. Documents without words are no duplicates; a null doc_id stays, and so do all rows
    of a doc_id that stays. Only the ids of those that go are kept on disk."""
    grouped = jaccard.jaccard_components(docs.select("doc_id", "text"))
    found = materialize(spark, grouped.where("doc_id <> component_id").select("doc_id").distinct(), "duplicates")
    discard(spark, *grouped.needs)
    return docs.select(*COLUMNS).join(found, "doc_id", "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked and n_chars counted anew where that changed the text. Null and empty texts and rows without secrets stay as they are,
    also repeated ones; a row with a null key is masked by its own findings; an empty table stays empty."""
    discard(spark)
    clean = secrets.redact(docs.select(*COLUMNS), queries.secret_model(spark))
    return clean.withColumn("n_chars", F.when(F.col("n_secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents. A null text counts as empty; repeated rows and null keys are packed each; an empty table gives no piece."""
    discard(spark)
    return packing.pack(docs.select("doc_id", "text"), queries.vocabulary(queries.BYTE_BPE)).drop("ids")


STAGES = [("toxicity", drop_toxic), ("jaccard", drop_duplicates), ("secrets", mask_secrets), ("packing", pack)]

# A learned lexicon, a forest and a tokenizer aren't SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(spark, stage(spark, docs, sf_dir), name)
        discard(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
