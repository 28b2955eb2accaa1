"""Helpers the training-data operators share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import os
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SLICE_BYTES = 2 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ship(spark: SparkSession) -> None:
    """Let the Python workers import this package when it isn't installed on them."""
    env = spark.sparkContext.environment
    paths = [p for p in (env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir. Only a local session, whose executors are in the driver's process, gets a temporary
    one where none is set; on a cluster that is an error."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="gridlark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back. The files go by discard(), or when the driver ends."""
    path = f"{shared_dir(spark)}/gridlark-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(remove, spark, path)
    back = spark.read.schema(df.schema).parquet(path)
    back.kept_at = path
    return back


def discard(spark: SparkSession, *frames: DataFrame | None) -> None:
    """Delete what materialize() wrote for these frames, and let the cleaner drop shuffle files nobody refers to any more."""
    for df in frames:
        if df is not None:
            remove(spark, df.kept_at)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system; one that is gone already, or a session that has ended, is no error."""
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have ended before the driver's Python
        return


def releasing(run):
    """A task's function that gives the memory it took back to the system when it ends; workers are used again by other tasks and would keep it."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return

    return wrapped


def slices(texts: list, limit: int = SLICE_BYTES):
    """(from, to) of consecutive texts of about `limit` characters, at least one text each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "") + 1
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + _MIX
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
