"""Hard negatives by a k-nearest-neighbour join over Voronoi cells of norm-augmented vectors."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlark.llm.common import discard, materialize, ship

PIVOTS = 64
SAMPLE = 4096
BLOCK_ROWS = 2048
GROUP_ROWS = 256
SLACK = 1e-6


def usable(rows: DataFrame, key: str, vec: str, label: Column, anchors: Column, scale: int) -> DataFrame:
    """(id, anchor, label, v, norm2) with components floor(scale * x), without rows that take no part; of rows with one id the smallest."""
    df = rows.select(F.col(key).cast("long").alias("id"), F.coalesce(anchors, F.lit(False)).alias("anchor"), label.cast("long").alias("label"), F.col(vec).cast("array<double>").alias("v"))
    df = df.where("id is not null and label is not null and v is not null and size(v) > 0").where(F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    df = df.withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("long")))
    if df.groupBy("id").count().where("count > 1").limit(1).count():
        df = df.groupBy("id").agg(F.max("anchor").alias("anchor"), F.min(F.struct("label", "v")).alias("r")).select("id", "anchor", "r.*")
    return df.withColumn("norm2", squares("v"))


def squares(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    lists = batch.column(name)
    return lists.flatten().to_numpy().reshape(batch.num_rows, -1)


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    """The vectors with one more component that brings each to the norm sqrt(most): then the nearest to (q, 0) has the highest product with q."""
    x = x.astype(np.float64)
    return np.c_[x, np.sqrt(np.maximum(most - (x * x).sum(1), 0.0))]


def spread_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """n rows of a sample, each the farthest from those before."""
    out, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(out) < min(n, len(x)) and far.max() > 0:
        out.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[out[-1]]) ** 2).sum(1))
    return x[out]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d2 = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(d2, 0.0))


def assigned(rows: DataFrame, pivots: np.ndarray, most: float, anchors: bool) -> DataFrame:
    """Each row with the nearest pivot (cell) and its distance (d). anchors: as (q, 0)."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, "v")
                d = distances(np.c_[x.astype(np.float64), np.zeros(len(x))] if anchors else augmented(x, most), pivots)
                cell = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell])], names=["id", "label", "v", "cell", "d"])

    return rows.select("id", "label", "v").mapInArrow(run, "id long, label long, v array<long>, cell int, d double")


def blocks(rows: DataFrame, size: int) -> DataFrame:
    """Blocks of up to `size` rows of one cell and label, of distances d_min to d_max from the pivot. Ranges of (cell, label, d, id) deal them out, so that a large cell is many
    tasks' work and a block's distances are close together."""
    schema = "block long, cell int, label long, n int, d_min double, d_max double, width int, ids binary, data binary"

    def run(batches):
        held, number = [], 0

        def block():
            part = pa.Table.from_batches(held).combine_chunks()
            d, x = part.column("d").to_numpy(), np.concatenate([matrix(b, "v") for b in held])
            ids = part.column("id").to_numpy().astype("<i8").tobytes()
            width = next(w for w in (2, 4, 8) if np.abs(x).max() < 2.0 ** (8 * w - 1))
            row = (part.column("id")[0].as_py(), part.column("cell")[0].as_py(), part.column("label")[0].as_py(), len(x), float(d.min()), float(d.max()), width, ids, x.astype(f"<i{width}").tobytes())
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=["block", "cell", "label", "n", "d_min", "d_max", "width", "ids", "data"])

        key = None
        for batch in batches:
            cell, label = batch.column("cell").to_numpy(), batch.column("label").to_numpy()
            cuts = np.flatnonzero((cell[1:] != cell[:-1]) | (label[1:] != label[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                while a < b:
                    if held and (key != (cell[a], label[a]) or number >= size):
                        yield block()
                        held, number = [], 0
                    take = min(b - a, size - number)
                    key = (cell[a], label[a])
                    held.append(batch.slice(a, take))
                    number, a = number + take, a + take
        if held:
            yield block()

    order = ["cell", "label", "d", "id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def unpacked(data: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{width}").astype(np.int64).reshape(n, -1)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of all rows of two blocks."""
    bound = q.shape[1] * float(np.abs(q).max()) * float(np.abs(x).max())
    if bound >= 2.0**63:
        raise ValueError("inner products don't fit 64-bit integers")
    if bound < 2.0**52:  # exact in doubles
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def batch_of(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def best(q_id: np.ndarray, x_id: np.ndarray, s: np.ndarray, k: int) -> list[tuple]:
    """(anchor, row, score) of each anchor's k rows of highest score, not itself, ties to smaller ids."""
    s = np.where(q_id[:, None] == x_id[None, :], np.iinfo(np.int64).min, s)
    out = []
    for i, row in enumerate(s):
        near = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
        near = near[row[near] > np.iinfo(np.int64).min]
        out += [(int(q_id[i]), int(x_id[j]), int(row[j])) for j in near[np.lexsort((x_id[near], -row[near]))[:k]]]
    return out


def in_window(x_id: np.ndarray, row: np.ndarray, wanted: list[tuple[int, int, int]], k: int, low: int, high: int) -> list[tuple]:
    """For each (positive, its score, least) the first k rows of one anchor with low * score <= 100 * row <= high * score and row >= least: (positive, score, id, row)."""
    floor = min(max(-(-low * p // 100), least) for _, p, least in wanted)
    at = np.flatnonzero((row >= floor) & (100 * row <= high * max(p for _, p, _ in wanted)))
    at = at[np.lexsort((x_id[at], -row[at]))]
    score, out = row[at], []
    for positive, p, least in wanted:
        a = int(np.searchsorted(-100 * score, -high * p))
        b = int(np.searchsorted(-score, -max(-(-low * p // 100), least), side="right"))
        out += [(positive, p, int(x_id[at[j]]), int(score[j])) for j in range(a, min(b, a + k))]
    return out


def first_k(found: DataFrame, query: list[str], k: int, shares: int) -> DataFrame:
    """The k best (score, id) of each query, merged in two levels, so that no list is longer than k times the root of the number of shares."""
    top = lambda c: F.slice(F.array_sort(c), 1, k).alias("best")
    part = F.pmod(F.xxhash64("share"), F.lit(math.isqrt(max(shares, 1)) + 1)).alias("part")
    some = found.groupBy(*query, part).agg(top(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("id").alias("i")))))
    merged = some.groupBy(*query).agg(top(F.flatten(F.collect_list("best"))))
    return merged.select(*query, F.posexplode("best").alias("place", "b")).select(*query, (F.col("place") + 1).cast("int").alias("rank"), F.col("b.i").alias("id"), (-F.col("b.s")).alias("score"))


def smallest(df: DataFrame, keys: list[str], array: str, k: int, shares: int) -> DataFrame:
    """The k smallest elements of a key's arrays, merged in two levels."""
    top = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k).alias(array)
    part = F.pmod(F.xxhash64(array), F.lit(math.isqrt(max(shares, 1)) + 1)).alias("part")
    return df.groupBy(*keys, part).agg(top(array)).groupBy(*keys).agg(top(array))


def reach(spark: SparkSession, anchors: DataFrame, near: DataFrame, pivots: np.ndarray, k: int, shares: int) -> DataFrame:
    """(g, label, cell, near, far): the cells that may hold one of the k nearest rows of the same label of an anchor of group g, and the distances from the cell's pivot at which.

    A group is the anchors of a pivot; its radius the largest distance of one from it. Each cell's k + 1 nearest rows of a label to their pivot bound what an anchor
    finds at most (one may be the anchor): the (k + 1)-th smallest of radius + distance of the pivots + distance of the row. Where a label has fewer rows, all are in reach.
    """
    radius = anchors.groupBy(F.col("cell").alias("g"), "label").agg(F.max("d").alias("radius"))
    ranked = smallest(near, ["cell", "label"], "nearest", k + 1, shares)
    each = radius.join(ranked, "label").join(F.broadcast(between(spark, pivots)), ["g", "cell"])
    bound = each.select("g", "label", F.transform("nearest", lambda x: F.col("radius") + F.col("gap") + x).alias("bound"))
    limit = smallest(bound, ["g", "label"], "bound", k + 1, len(pivots)).select("g", "label", F.when(F.size("bound") > k, F.element_at("bound", k + 1)).otherwise(float("inf")).alias("limit"))
    within = F.col("radius") + F.col("limit") + SLACK * (1 + F.col("radius") + F.col("limit") + F.col("gap"))
    return each.join(limit, ["g", "label"]).select("g", "label", "cell", (F.col("gap") - within).alias("near"), (F.col("gap") + within).alias("far"))


def between(spark: SparkSession, pivots: np.ndarray) -> DataFrame:
    """(g, cell, gap): the distances of all pairs of pivots."""
    d = distances(pivots, pivots)
    return spark.createDataFrame([(i, j, float(d[i, j])) for i in range(len(d)) for j in range(len(d))], "g int, cell int, gap double")


def hard_negatives(rows: DataFrame, anchors: Column, label: Column, key: str = "vec_id", vec: str = "embedding", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its `positives` rows of its label with the highest inner product, the
    first `negatives` rows of other labels whose product is low to high hundredths of the positive's.

    anchors: a condition on the rows; label: their label. Components count as floor(scale * x). Ties go to the smaller id. Rows with a null key, label or vector, with an empty vector, or
    a null or non-finite component take no part; of rows with the same key the smallest by (label, vector) counts. Vectors of different lengths are an error. A positive
    score under 0 has no negatives, one of 0 those of product 0. No anchors, or an empty table, give no rows. Other columns aren't read.

    1. Vectors get a component that brings them to the same norm, so that the highest product is the smallest distance. Pivots are spread over a sample of SAMPLE rows; each row
       belongs to the cell of its nearest pivot, and stands in blocks of one cell and label, in the order of its distance from the pivot. Anchors form groups by their pivots.
    2. Positives: the nearest rows of each cell bound the distance at which an anchor of a group finds its own (see reach). A cell's blocks go to a group only where the triangle inequality leaves
       them within it; in a pair of blocks products are exact.
    3. Negatives: first the rows of the anchor's own cell. The score of the last of `negatives` rows found there, or low hundredths of the positive's score where there are
       fewer, is the least that can matter. Then the blocks of all cells that may hold a product between the least and the highest wanted of a group.

    Any cell may hold most rows: ranges deal its rows into blocks, and a pair of blocks is a row of work. Broadcast are pivots and their distances, of a fixed number.
    """
    spark = rows.sparkSession
    ship(spark)
    held = materialize(spark, usable(rows, key, vec, label, anchors, scale), "vectors")
    told = held.agg(F.max("norm2").alias("most"), F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b"), F.count("*").alias("n"), F.count_if("anchor").alias("asked")).first()
    if told.a != told.b:
        raise ValueError("vectors of different lengths")
    most, shares, deals = told.most or 0.0, -(-told.n // block_rows) + pivots, -(-told.asked // GROUP_ROWS)
    sample = held.select("v", F.xxhash64("id").alias("h"), "id").orderBy("h", "id").limit(SAMPLE).collect()
    points = spread_pivots(augmented(np.array([r.v for r in sample], np.int64), most), pivots) if sample else np.zeros((1, 2))

    cells = materialize(spark, blocks(assigned(held, points, most, False), block_rows), "cells")
    near = nearest_of(cells, points, most, positives)
    chosen = materialize(spark, assigned(held.where("anchor"), points, most, True), "anchors")
    groups = blocks(chosen, GROUP_ROWS).select(F.col("cell").alias("g"), "label", F.struct("ids", "data", "width").alias("q"))

    wide = reach(spark, chosen, near, points, positives, shares)
    pairs = groups.join(wide, ["g", "label"]).join(cells, ["cell", "label"]).where("d_max >= near and d_min <= far").select("q", F.struct("ids", "data", "width").alias("x"), F.col("block").alias("share"))

    def nearest(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                q_id, x_id = (np.frombuffer(r[c]["ids"], "<i8") for c in "qx")
                s = products(*(unpacked(r[c]["data"], r[c]["width"], len(ids)) for c, ids in (("q", q_id), ("x", x_id))))
                yield batch_of([(*x, r["share"]) for x in best(q_id, x_id, s, positives)], ["anchor", "id", "score", "share"])

    found = first_k(pairs.mapInArrow(nearest, "anchor long, id long, score long, share long"), ["anchor"], positives, shares)
    own = materialize(spark, found.where("score >= 0").select("anchor", F.col("id").alias("positive"), F.col("score").alias("p")), "positives")

    # what each anchor wants, beside its vector: its positives with their scores, and the least score that matters
    place = chosen.select(F.col("id").alias("anchor"), "cell", "d", "v", F.col("label").alias("q_label"))
    wanted = place.join(own.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("positive", "p"))).alias("w")), "anchor")
    wanted = wanted.withColumn("w", F.transform("w", lambda x: F.struct(x["positive"].alias("positive"), x["p"].alias("p"), F.lit(0).cast("long").alias("least"))))
    home = packed(wanted, deals).join(cells, "cell").select("q", "n", "ids", "data", "width", F.col("block").alias("share"), F.col("label").alias("x_label"))
    query = ["anchor", "positive", "p"]
    first = first_k(searched(home, negatives, low, high), query, negatives, shares)
    least = materialize(spark, first.where(F.col("rank") == negatives).select("anchor", "positive", F.col("score").alias("least")), "least")

    each = own.join(least, ["anchor", "positive"], "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long")))
    wanted = place.join(each.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("positive", "p", "least"))).alias("w")), "anchor")
    span = lambda s: F.sqrt(F.greatest(F.lit(0.0), squares("v") + most - 2 * s))
    lowest = F.array_min(F.transform("w", lambda x: F.greatest(low * x["p"] / 100.0, x["least"].cast("double"))))
    highest = F.array_max(F.transform("w", lambda x: high * x["p"] / 100.0))
    wanted = wanted.withColumns({"outer": span(lowest), "inner": span(highest)})
    ring = wanted.groupBy(F.col("cell").alias("g")).agg(F.max("d").alias("radius"), F.max("outer").alias("outer"), F.min("inner").alias("inner"))
    slack = SLACK * (1 + F.col("radius") + F.col("gap") + F.col("outer"))
    ring = ring.join(F.broadcast(between(spark, points)), "g").select("g", "cell", (F.col("gap") - F.col("radius") - F.col("outer") - slack).alias("near"), (F.col("gap") + F.col("radius") + F.col("outer") + slack).alias("far"), (F.col("inner") - F.col("gap") - F.col("radius") - slack).alias("past"))
    asked = packed(wanted, deals).withColumnRenamed("cell", "g").join(ring, "g")
    pairs = asked.join(cells, "cell").where("d_max >= near and d_min <= far and d_max >= past").select("q", "n", "ids", "data", "width", F.col("block").alias("share"), F.col("label").alias("x_label"))
    out = materialize(spark, first_k(searched(pairs, negatives, low, high), query, negatives, shares), "negatives")
    discard(spark, held, cells, chosen, own, least)
    return out.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))


def nearest_of(cells: DataFrame, pivots: np.ndarray, most: float, k: int) -> DataFrame:
    """(cell, label, nearest): the k + 1 smallest distances from the pivot of each block."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                x = unpacked(r["data"], r["width"], r["n"])
                d = np.sort(distances(augmented(x, most), pivots[r["cell"] : r["cell"] + 1])[:, 0])[: k + 1]
                yield pa.RecordBatch.from_arrays([pa.array([r["cell"]], pa.int32()), pa.array([r["label"]]), pa.array([d.tolist()])], names=["cell", "label", "nearest"])

    return cells.select("cell", "label", "n", "width", "data").mapInArrow(run, "cell int, label long, nearest array<double>")


def packed(wanted: DataFrame, deals: int) -> DataFrame:
    """(cell, q): anchors of a cell with what they want, about GROUP_ROWS in a row at most."""
    dealt = F.pmod(F.xxhash64("anchor"), F.lit(max(deals, 1))).alias("deal")
    return wanted.groupBy("cell", dealt).agg(F.collect_list(F.struct("anchor", "q_label", "v", "w")).alias("q")).drop("deal")


def searched(pairs: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """(anchor, positive, p, id, score, share) of each pair of anchors and a block: the first k rows of other labels within the window of each positive."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                anchor, q_label, v, w = row.column("q").flatten().flatten()
                other = np.flatnonzero(q_label.to_numpy() != row.column("x_label")[0].as_py())
                out = []
                if len(other):
                    n, width, ids, data, share = (row.column(c)[0].as_py() for c in ("n", "width", "ids", "data", "share"))
                    x_id = np.frombuffer(ids, "<i8")
                    q = v.flatten().to_numpy().reshape(len(anchor), -1)[other]
                    names, wants = anchor.to_numpy()[other].tolist(), w.take(pa.array(other)).to_pylist()
                    for name, want, s in zip(names, wants, products(q, unpacked(data, width, n)), strict=True):
                        out += [(name, *x, share) for x in in_window(x_id, s, [(y["positive"], y["p"], y["least"]) for y in want], k, low, high)]
                yield batch_of(out, ["anchor", "positive", "p", "id", "score", "share"])

    return pairs.mapInArrow(run, "anchor long, positive long, p long, id long, score long, share long")
