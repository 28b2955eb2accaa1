"""Typed yearly graphs: node index, edge tables, snapshots, one-layer kernels, propagation and walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlark.functions.expressions import RELATIONS, party_type
from gridlark.functions.metrics import BUCKET_ROWS, MOST_BUCKETS, place
from gridlark.sources.steps import written


SAMPLE = 32_768
PART_ROWS = 500_000


def parts_for(table: DataFrame) -> int:
    """How many partitions a shuffle of a stored table has, so that a task's rows stay the same however many there are: one for PART_ROWS rows, and no fewer than there are cores."""
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // PART_ROWS))


def spread(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df dealt by keys to a number of partitions, or to as many as the session says."""
    return df.repartition(parts, *keys) if parts else df.repartition(*keys)


def key_points(df: DataFrame, key: str, buckets: int | None = None) -> list[str]:
    """Keys that cut a string column into about even parts, from the SAMPLE rows with the smallest hashes of their keys. How far these hashes reach tells
    how many rows there are, so that a part has about BUCKET_ROWS of them."""
    rows = df.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(key).alias("k")).orderBy("h").limit(SAMPLE).collect()
    if not rows:
        return []
    n = len(rows) if len(rows) < SAMPLE else SAMPLE * 2**64 // (rows[-1].h + 2**63 + 1)
    parts = min(MOST_BUCKETS, max(1, -(-n // BUCKET_ROWS)) if buckets is None else buckets)
    keys = sorted({r.k for r in rows})
    return sorted({keys[i * len(keys) // parts] for i in range(1, parts)})


def dense_index(df: DataFrame, key: str, start: int = 0, buckets: int | None = None, out: str = "node_idx") -> DataFrame:
    """df with dense numbers from `start` in the order of a string key. Rows fall into buckets between sampled keys, so that no task sorts
    more than a bucket; the buckets' sizes are carried over. Rows of equal keys are numbered in any order."""
    bucket = F.coalesce(place(key_points(df, key, buckets), "string", F.col(key)), F.lit(0))
    rows = df.withColumn("_b", bucket)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    w = Window.partitionBy("_b").orderBy(key)
    return rows.withColumn("_r", F.row_number().over(w)).join(sizes.select("_b", "_before"), "_b").withColumn(out, (F.col("_before") + F.col("_r") - 1 + start).cast("long")).drop("_b", "_r", "_before")


def extended_index(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes and the edges' unknown ends: typed by their prefix, numbered from the largest index on, in the order of their ids."""
    ends = edges.select(F.col("dst_node_id").alias("node_id")).where("node_id is not null").distinct()
    new = ends.join(nodes.select("node_id"), "node_id", "left_anti")
    start = nodes.agg(F.max("node_idx")).first()[0]
    new = dense_index(new, "node_id", 0 if start is None else start + 1)
    typed = new.select("node_idx", "node_id", party_type(F.col("node_id")).alias("node_type"), F.lit(None).cast("string").alias("ts_code"))
    return nodes.select("node_idx", "node_id", "node_type", "ts_code").unionByName(typed)


def encoded(edges: DataFrame, nodes: DataFrame, prefix: str = "E7_TRADE_", parts: int | None = None) -> DataFrame:
    """(src_idx, dst_idx, edge_type, year) of edges whose both ends are in the index; a node id that comes twice has its largest index."""
    ids = spread(nodes.select("node_id", "node_idx"), parts, "node_id").groupBy("node_id").agg(F.max("node_idx").alias("idx")).hint("merge")
    src = ids.select(F.col("node_id").alias("src_node_id"), F.col("idx").alias("src_idx"))
    dst = ids.select(F.col("node_id").alias("dst_node_id"), F.col("idx").alias("dst_idx"))
    found = spread(edges, parts, "src_node_id").join(src, "src_node_id").drop("src_node_id")
    return spread(found, parts, "dst_node_id").join(dst, "dst_node_id").select(F.col("src_idx").cast("long").alias("src_idx"), F.col("dst_idx").cast("long").alias("dst_idx"), F.concat(F.lit(prefix), "edge_type").alias("edge_type"), F.col("year").cast("long").alias("year"))


def type_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("edge_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "edge_type")


def type_codes(edges: DataFrame) -> DataFrame:
    """(edge_type, rel): numbers from 0 in the order of the names. The window runs over the distinct types only."""
    return edges.select("edge_type").distinct().select("edge_type", (F.row_number().over(Window.orderBy("edge_type")) - 1).cast("int").alias("rel"))


def relation(edge_type: Column, lenient: bool = False) -> Column:
    """The fixed code of a type. An unknown one is an error, or, if lenient, 0."""
    out = F.lit(0) if lenient else F.raise_error(F.concat(F.lit("unknown edge type "), F.coalesce(edge_type, F.lit("null")))).cast("int")
    for code, name in enumerate(RELATIONS):
        out = F.when(edge_type == name, code).otherwise(out)
    return out


def both_ways(edges: DataFrame) -> DataFrame:
    """Every edge and its reverse, duplicates kept, in one scan."""
    ends = F.array(F.struct(F.col("src_idx").alias("s"), F.col("dst_idx").alias("d")), F.struct(F.col("dst_idx").alias("s"), F.col("src_idx").alias("d")))
    rest = [c for c in edges.columns if c not in ("src_idx", "dst_idx")]
    return edges.select(F.explode(ends).alias("e"), *rest).select(F.col("e.s").alias("src_idx"), F.col("e.d").alias("dst_idx"), *rest)


def simple_undirected(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct unordered pairs, without loops."""
    pairs = edges.where("src_idx <> dst_idx").select(F.least("src_idx", "dst_idx").alias("u"), F.greatest("src_idx", "dst_idx").alias("v"))
    return spread(pairs, parts, "u", "v").distinct()


def without_type(edges: DataFrame, edge_type: str) -> DataFrame:
    return edges.where(F.col("edge_type") != edge_type)


def snapshot(panel: DataFrame, nodes: DataFrame, edges: DataFrame, year: int | None = None, lenient: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, messages) of one year, or of all, keyed by year. Nodes without a panel row are left out: they are zero vectors that aren't valid. Messages
    are edges both ways with their relation's code."""
    if year is not None:
        panel, edges = panel.where(F.col("year") == year), edges.where(F.col("year") == year)
    companies = nodes.where("node_type = 'company'").select("ts_code", "node_idx")
    valid = panel.join(companies, "ts_code")
    return valid, both_ways(edges).select("year", "src_idx", "dst_idx", relation(F.col("edge_type"), lenient).alias("rel"))


def self_loops(messages: DataFrame, features: DataFrame, parts: int | None = None) -> DataFrame:
    """Messages with one loop on each node in place of those there are."""
    loops = spread(features.select("node"), parts, "node").distinct().select(F.col("node").alias("src"), F.col("node").alias("dst"))
    return messages.where("src <> dst").select("src", "dst").unionByName(loops)


def vectors(features: DataFrame, parts: int | None = None) -> DataFrame:
    """(node, x): a node's (k, v) in the order of k. They are never broadcast: their size isn't known before."""
    return spread(features, parts, "node").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("x")).hint("merge")


def gathered(messages: DataFrame, features: DataFrame, parts: int | None = None) -> DataFrame:
    """Per message and feature: the message's columns but src, and k, v of the source, at the message's end. A node's features travel as one row. features: node, k, v."""
    rows = spread(messages, parts, "src").join(vectors(features, parts).withColumnRenamed("node", "src"), "src").drop("src")
    return spread(rows, parts, "dst").withColumn("x", F.explode("x")).select(*[c for c in rows.columns if c != "x"], "x.k", "x.v")


def gcn(messages: DataFrame, features: DataFrame, parts: int | None = None) -> DataFrame:
    """Symmetrically normalised sum over neighbours and the node itself: node, k, v."""
    m = self_loops(messages, features, parts)
    degree = spread(m, parts, "dst").groupBy("dst").agg(F.sqrt(F.count("*").cast("double")).alias("deg")).hint("merge")
    # a source's degree divides its features and an end's the sum, so that no message carries a weight
    own = spread(features, parts, "node").join(degree.select(F.col("dst").alias("node"), "deg"), "node").select("node", "k", (F.col("v") / F.col("deg")).alias("v"))
    total = gathered(m, own, parts).groupBy("dst", "k").agg(F.sum("v").alias("v"))
    return total.join(degree, "dst").select(F.col("dst").alias("node"), "k", (F.col("v") / F.col("deg")).alias("v"))


def sage_mean(messages: DataFrame, features: DataFrame, parts: int | None = None) -> DataFrame:
    """Root value and mean of the in-neighbours' values (0 without any): node, k, root, v."""
    mean = gathered(messages.select("src", "dst"), features, parts).groupBy(F.col("dst").alias("node"), "k").agg(F.avg("v").alias("m"))
    return spread(features, parts, "node", "k").join(mean.hint("merge"), ["node", "k"], "left").select("node", "k", F.col("v").alias("root"), F.coalesce("m", F.lit(0.0)).alias("v"))


def rgcn_mean(messages: DataFrame, features: DataFrame, weights: dict[int, float], parts: int | None = None) -> DataFrame:
    """Root value plus, for each relation, its weight times the mean over neighbours by it: node, k, v."""
    per = gathered(messages.select("src", "dst", "rel"), features, parts).groupBy("dst", "k", "rel").agg(F.avg("v").alias("m"))
    w = F.lit(0.0)
    for rel, x in weights.items():
        w = F.when(F.col("rel") == rel, F.lit(x)).otherwise(w)
    total = per.groupBy(F.col("dst").alias("node"), "k").agg(F.sum(w * F.col("m")).alias("m"))
    return spread(features, parts, "node", "k").join(total.hint("merge"), ["node", "k"], "left").select("node", "k", (F.col("v") + F.coalesce("m", F.lit(0.0))).alias("v"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def values(x: str) -> Column:
    return F.transform(x, lambda s: s["v"])


def gated(messages: DataFrame, features: DataFrame, scale: float = 10.0, parts: int | None = None) -> DataFrame:
    """Sum over neighbours weighted by a gate, the logistic of `scale` times the cosine of both ends, over the sum of gates (1e-6 at
    least): node, k, v."""
    x = vectors(features, parts).withColumn("x", values("x"))
    ends = spread(messages.select("src", "dst"), parts, "src").join(x.select(F.col("node").alias("src"), F.col("x").alias("xs")), "src").drop("src")
    ends = spread(ends, parts, "dst").join(x.select(F.col("node").alias("dst"), F.col("x").alias("xd")), "dst")
    cosine = dot(F.col("xs"), F.col("xd")) / F.greatest(F.sqrt(dot(F.col("xs"), F.col("xs"))) * F.sqrt(dot(F.col("xd"), F.col("xd"))), F.lit(1e-8))
    g = ends.select("dst", "xs", (1.0 / (1.0 + F.exp(-scale * cosine))).alias("g"))
    each = g.select("dst", "g", F.posexplode("xs").alias("k", "v"))
    return each.groupBy(F.col("dst").alias("node"), "k").agg((F.sum(F.col("g") * F.col("v")) / F.greatest(F.sum("g"), F.lit(1e-6))).alias("v"))


def gat(messages: DataFrame, features: DataFrame, a_src: list[float], a_dst: list[float], slope: float = 0.2, parts: int | None = None) -> DataFrame:
    """Sum over neighbours and the node itself weighted by the softmax of a leaky linear score of both ends: node, k, v."""
    x = vectors(features, parts).withColumn("x", values("x"))
    weights = lambda a: F.array(*[F.lit(w) for w in a])
    m = spread(self_loops(messages, features, parts), parts, "src").join(x.select(F.col("node").alias("src"), F.col("x").alias("xs"), dot(F.col("x"), weights(a_src)).alias("es")), "src").drop("src")
    m = spread(m, parts, "dst").join(x.select(F.col("node").alias("dst"), dot(F.col("x"), weights(a_dst)).alias("ed")), "dst")
    e = F.col("es") + F.col("ed")
    m = m.withColumn("e", F.when(e > 0, e).otherwise(slope * e))
    m = m.select("dst", "xs", F.exp(F.col("e") - F.max("e").over(Window.partitionBy("dst"))).alias("w"))
    each = m.select("dst", "w", F.posexplode("xs").alias("k", "v"))
    return each.groupBy(F.col("dst").alias("node"), "k").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def label_propagation(messages: DataFrame, labels: DataFrame, steps: int = 3, alpha: float = 0.9, parts: int | None = None) -> DataFrame:
    """(node, h) after `steps` rounds of clamp(alpha S h + (1 - alpha) y) over a multigraph, S normalised symmetrically by degree; labels: node, y. Nodes
    of messages without a label start at 0."""
    sent = spread(messages.select("src", "dst"), parts, "src").groupBy("src", "dst").agg(F.count("*").alias("n"))
    degree = spread(messages.select("dst"), parts, "dst").groupBy(F.col("dst").alias("node")).agg(F.sqrt(F.count("*").cast("double")).alias("deg"))
    rows = degree.join(spread(labels.select("node", F.col("y").cast("double").alias("y")), parts, "node").hint("merge"), "node", "full")
    start = written(rows.select("node", "deg", F.coalesce("y", F.lit(0.0)).alias("y")), "labels").hint("merge")
    h = start.select("node", "deg", F.col("y").alias("h"))
    for _ in range(steps):
        # a source's degree divides its value and an end's the sum, so that no message carries a weight
        value = h.where("h <> 0").select(F.col("node").alias("src"), (F.col("h") / F.col("deg")).alias("h")).hint("merge")
        came = spread(sent.join(value, "src").select(F.col("dst").alias("node"), (F.col("n") * F.col("h")).alias("c")), parts, "node").groupBy("node").agg(F.sum("c").alias("c"))
        value = alpha * F.coalesce(F.col("c") / F.col("deg"), F.lit(0.0)) + (1 - alpha) * F.col("y")
        h = spread(start, parts, "node").join(came.hint("merge"), "node", "left").select("node", "deg", F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("h"))
    return h.select("node", "h")


CUT_STEPS = 5


def walks(graph: DataFrame, starts: DataFrame, steps: int, step_of) -> DataFrame:
    """(start, walk, path): from each start, `steps` moves over a simple graph (src, dst both ways). step_of(start, walk, step, node, degree) is a
    column in 0 .. degree - 1 that picks from the neighbours in order. Numbered neighbours make a move an equi-join on (node, place), so
    that no neighbour list has to fit in a row. Walks that reach a node without neighbours end there."""
    w = Window.partitionBy("src").orderBy("dst")
    numbered = graph.select("src", "dst").distinct().select("src", "dst", (F.row_number().over(w) - 1).alias("place"))
    degree = numbered.groupBy("src").agg(F.count("*").alias("deg"))
    # Every step reads the moves, and the plan of all steps would be longer than the work: both are computed once.
    moves = numbered.select(F.col("src").alias("node"), "place", F.col("dst").alias("next")).join(degree.select(F.col("src").alias("next"), F.col("deg").alias("next_deg")), "next", "left").persist()
    at = starts.select("start", "walk", F.col("start").alias("node"), F.array("start").alias("path")).join(degree.withColumnRenamed("src", "node"), "node", "left")
    for i in range(steps):
        at = at.withColumn("place", F.when(F.col("deg").isNotNull(), step_of(F.col("start"), F.col("walk"), i, F.col("node"), F.col("deg"))).cast("int")).join(moves, ["node", "place"], "left")
        path = F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path")
        at = at.select("start", "walk", F.coalesce("next", "node").alias("node"), path, F.when(F.col("next").isNotNull(), F.col("next_deg")).otherwise(F.col("deg")).alias("deg"))
        if i % CUT_STEPS == CUT_STEPS - 1:
            at = written(at, "walks")
    return at.select("start", "walk", "path")


def random_steps(seed: int):
    """Uniform moves from a hash of the walk and the step: the same on each run."""
    return lambda start, walk, i, node, degree: F.pmod(F.xxhash64(start, walk, F.lit(i), F.lit(seed)), degree)
