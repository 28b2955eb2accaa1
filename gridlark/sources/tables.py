"""Readers: Parquet tables with a contract, result documents, feature dictionaries and a synthetic panel."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

DOUBLE, LONG, STRING = T.DoubleType(), T.LongType(), T.StringType()
NODE_INDEX = "node_idx long, node_id string, node_type string, ts_code string"
EDGE_INDEX = "src_idx long, dst_idx long, edge_type string, year long"
PARTY_EDGES = "src_node_id string, dst_node_id string, edge_type string, year long"
SCORES = "model string, modal string, label string, seed int, id string, year int, y int, s double"
RESULT = "model string, modal string, label string, seed int, best_epoch int, val_auc double, test_auc double, metrics struct<auc: double>, ap double, p_at_5pct double, r_at_10fpr double, f1_best double"


@dataclass(frozen=True)
class Paths:
    """Where the tables are: given, or from the environment, or under a root."""

    root: str = ""
    edges: str = ""

    @classmethod
    def of(cls, root: str | None = None, edges: str | None = None) -> Paths:
        root = root or os.environ.get("PROJECT_ROOT", ".")
        return cls(root, edges or os.environ.get("EDGE_PATH", f"{root}/global_edge_index.parquet"))

    def __call__(self, name: str) -> str:
        return self.edges if name == "edges" else f"{self.root}/{name}.parquet"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def table(spark: SparkSession, path: str, columns: list[str] | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """A Parquet table; only `columns` are read. A path that isn't there and a column that is missing are errors that name it."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if missing := [c for c in columns or [] if c not in df.columns]:
        raise ValueError(f"{path}: missing columns {missing}")
    return df.select(*columns) if columns else df


def optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table that may be absent: then one without rows."""
    return table(spark, path, schema=schema) if exists(spark, path) else spark.createDataFrame([], schema)


def results(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows of result documents: a `summary` list, a `rows` list, or a list at the top. Files that can't be parsed give no rows. `test_auc` falls back to
    metrics.auc and then to NaN; `file` is the document's name."""
    row = T.StructType.fromDDL(RESULT)
    schema = T.StructType([T.StructField("summary", T.ArrayType(row)), T.StructField("rows", T.ArrayType(row)), *row.fields, T.StructField("_corrupt_record", STRING)])
    docs = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(pattern).withColumn("file", F.col("_metadata.file_name"))
    docs = docs.where("_corrupt_record is null")
    top = F.when(F.col("model").isNotNull(), F.array(F.struct(*[F.col(f.name) for f in row.fields])))
    rows = docs.select("file", F.explode(F.coalesce("summary", "rows", top)).alias("r")).select("file", "r.*")
    return rows.withColumn("test_auc", F.coalesce("test_auc", "metrics.auc", F.lit(float("nan")))).drop("metrics")


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(feature, dtype, min, max, mean, std) of a feature dictionary document."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,struct<dtype:string,min:double,max:double,mean:double,std:double>>")
    return text.select(F.explode(entries).alias("feature", "d")).select("feature", "d.*")


def drawn(row: Column, stream: int, seed: int) -> Column:
    """A number above 0 and below 1 that depends on (seed, row, stream) alone."""
    return (F.shiftrightunsigned(F.xxhash64(row, F.lit(stream), F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(2**53))


def normal(row: Column, stream: int, seed: int) -> Column:
    """A standard normal number from two drawn ones."""
    return F.sqrt(F.log(drawn(row, 2 * stream, seed)) * -2.0) * F.cos(drawn(row, 2 * stream + 1, seed) * (2 * math.pi))


def synthetic(spark: SparkSession, n: int, features: dict[str, dict], seed: int = 42, years: tuple[int, int] = (2010, 2024), labels: tuple[str, ...] = (), partitions: int | None = None) -> DataFrame:
    """n rows with ids SYN00000 on, even years, labels 0, and each feature normal around its mean, clipped to its range and typed. Of a missing deviation
    a quarter of the range is taken, of one of 0 or less 1e-6. Each value depends on seed, row and the column's place alone: rows are the same for any number of partitions, and the first
    rows are those of a shorter table."""
    kinds = {"float32": "float", "float64": "double"}
    row = F.col("id")

    def feature(name: str, d: dict, k: int) -> Column:
        std = d.get("std")
        std = (d["max"] - d["min"]) / 4 if std is None else std
        x = F.lit(float(d.get("mean", 0.0))) + F.lit(float(std) if std > 0 else 1e-6) * normal(row, k + 1, seed)
        x = F.least(F.lit(float(d["max"])), F.greatest(F.lit(float(d["min"])), x))
        return (F.round(x) if d["dtype"].startswith("int") else x).cast(kinds.get(d["dtype"], "int")).alias(name)

    year = (F.floor(drawn(row, 0, seed) * (years[1] - years[0] + 1)) + years[0]).cast("int")
    made = [feature(c, d, k) for k, (c, d) in enumerate(features.items())]
    return spark.range(0, n, 1, partitions).select(F.format_string("SYN%05d", "id").alias("firm_id"), year.alias("year"), *[F.lit(0).cast("byte").alias(c) for c in labels], *made)
