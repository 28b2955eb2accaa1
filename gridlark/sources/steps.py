"""Steps of a job written down: they cut the lineage and survive lost executors."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset a local session gets a temporary one; a cluster gives an error."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gridlark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df as a Parquet table of the shared folder, which goes when the driver ends. by: columns that make its folders."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/gridlark-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    atexit.register(drop, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.kept_at = path
    return back


def drop(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended before
        return


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
