"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlark.llm.common import discard, materialize

WAYS = 4


def spread_join(many: DataFrame, one: DataFrame, on: list[str], by: str, how: str = "inner") -> DataFrame:
    """Equi-join with a frame that has one row per key. The keys are salted by a column of the other side, so that a hot key is WAYS tasks'
    work, and both sides are shuffled for the join, so that AQE can split it further (it can't where a side comes from an aggregate on the same key)."""
    salts = F.explode(F.array(*[F.lit(i) for i in range(WAYS)]))
    return many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(WAYS)).cast("int")).join(one.withColumn("_salt", salts), [*on, "_salt"], how).drop("_salt")


def connected(spark: SparkSession, edges: DataFrame, a: str = "a", b: str = "b", known: DataFrame | None = None) -> DataFrame:
    """(node, component) for each node of an edge: component is the smallest node that can be reached.

    Each round links every node's larger neighbours to its smallest one, then its smaller ones (large star, small star),
    until every node has one edge, to a node without one; the number of rounds grows with the logarithm of the longest path. Per
    round two aggregates that combine before the shuffle and two joins in which a node that is in very many edges is spread. Null ends and loops are
    dropped; repeated edges count once; no edges give no rows. known: an earlier result, whose components are merged by the edges: only the
    edges between components go through the rounds.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    if known is not None:
        for end in ("u", "v"):
            root = known.select(F.col("node").alias(end), F.col("component").alias("_c"))
            e = e.join(root, end, "left").withColumn(end, F.coalesce("_c", end)).drop("_c")
    e = materialize(spark, e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not is_stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = spread_join(both, low, ["u"], "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, ["u"], "v").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, e = e, materialize(spark, small, "edges")
        discard(spark, before)
    # every edge now leads to a root, the smallest node of its component
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    found = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    if known is not None:
        moved = found.select(F.col("node").alias("component"), F.col("component").alias("to"))
        old = known.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        found = old.unionByName(found.join(known, "node", "left_anti"))
    out = materialize(spark, found, "components")
    discard(spark, e)
    return out


def is_stars(e: DataFrame) -> bool:
    """Whether each u has one edge only and no v is a u."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into")))
    per = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("into").alias("into"))
    return not per.agg(F.coalesce(F.max(F.col("out") + F.col("into")), F.lit(0)).alias("most")).first().most > 1
