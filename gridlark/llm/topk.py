"""Exact top-k inner products by multi-resolution segment statistics."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from gridlark.llm.common import ship

LEVELS = (1, 4, 16)
BLOCK_ROWS = 4096
SLACK = 1e-6


def statistics(x: np.ndarray, parts: int) -> np.ndarray:
    """For each of `parts` segments, its mean and its deviation, both times the root of its length: the inner product of two
    such rows is at least that of the vectors (means meet exactly, what is left by Cauchy-Schwarz)."""
    cut = np.linspace(0, x.shape[1], parts + 1).astype(int)
    cols = []
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b > a:
            s = x[:, a:b]
            mean = s.mean(axis=1)
            cols += [mean * (b - a) ** 0.5, np.sqrt(((s - mean[:, None]) ** 2).sum(axis=1))]
    return np.stack(cols, axis=1)


def nearest(q: np.ndarray, q_id: np.ndarray, x: np.ndarray, x_id: np.ndarray, k: int, levels: tuple = LEVELS):
    """For each query its k rows with the highest inner product, not itself: (place of the query, id, score), ties to smaller ids.

    A query's distance to a row is |q|^2 + |x|^2 - 2 q.x; with the norms known, a lower bound of the distance is an upper bound
    of q.x. Coarse levels rule rows out for a query when their bound is under its k-th best exact score so
    far; finer ones look at what is left; the survivors get exact integer products.
    """
    stats_q = [statistics(q.astype(np.float64), p) for p in levels]
    stats_x = [statistics(x.astype(np.float64), p) for p in levels]
    out = []
    for i in range(len(q)):
        bound = stats_x[0] @ stats_q[0][i]
        bound += SLACK * (1 + np.abs(bound))
        other = x_id != q_id[i]
        start = np.flatnonzero(other)
        if len(start) > 4 * k:
            start = start[np.argpartition(-bound[start], 4 * k)[: 4 * k]]
        best = x[start] @ q[i]
        least = np.partition(best, len(best) - k)[len(best) - k] if len(best) >= k else None
        left = np.flatnonzero(other if least is None else other & (bound >= least))
        for sq, sx in zip(stats_q[1:], stats_x[1:], strict=True):
            if least is None or not len(left):
                break
            b = sx[left] @ sq[i]
            left = left[b + SLACK * (1 + np.abs(b)) >= least]
        score = x[left] @ q[i]
        top = left[np.lexsort((x_id[left], -score))[:k]]
        out += [(i, x_id[j], int(x[j] @ q[i])) for j in top]
    return out


def blocks(df: DataFrame, vec: str, key: str, rows: int, scale: int) -> DataFrame:
    """df's usable vectors as blocks (dim, width, ids, data) of up to `rows` rows of integers floor(scale * component), of the fewest bytes (2, 4 or 8) that hold a block."""
    usable = df.select(F.col(key).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v"))
    usable = usable.where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))
    schema = "dim int, width int, ids binary, data binary"

    def run(batches):
        held: dict[int, list] = {}

        def packed(dim: int):
            ids, data = (np.concatenate([p[i] for p in held[dim]]) for i in (0, 1))
            held[dim] = []
            most = np.abs(data).max()
            if most >= 2.0**62:
                raise ValueError(f"a vector's component times {scale} doesn't fit 64-bit integers")
            width = next(w for w in (2, 4, 8) if most < 2.0 ** (8 * w - 1))
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([width], pa.int32()), pa.array([ids.tobytes()]), pa.array([data.astype(f"<i{width}").tobytes()])], names=["dim", "width", "ids", "data"])

        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                part = batch.slice(a, rows)
                lists = part.column(1)
                size = np.diff(lists.offsets.to_numpy())
                flat, ids = lists.flatten().to_numpy(), part.column(0).to_numpy()
                ends = np.cumsum(size)
                for dim in np.unique(size).tolist():
                    mine = np.flatnonzero(size == dim)
                    at = (ends[mine] - dim)[:, None] + np.arange(dim)
                    held.setdefault(dim, []).append((ids[mine].astype("<i8"), np.floor(flat[at] * scale)))
                    if sum(len(p[0]) for p in held[dim]) >= rows:
                        yield packed(dim)
        for dim in [d for d in held if held[d]]:
            yield packed(dim)

    return usable.mapInArrow(run, schema)


def top_k(queries: DataFrame, rows: DataFrame, k: int = 5, key: str = "vec_id", vec: str = "embedding", scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k rows of highest integer inner product for each query: query_id, rank (from 1), vec_id, score.

    Components count as floor(scale * component). Ties go to the smaller id; a row isn't its own neighbour: rows with a query's id are
    left out for it. Vectors that are null, empty, or hold a null or non-finite component take no part on either side; nor does a null id.
    Vectors of different lengths aren't compared. A query with fewer than k rows gets all of them. Repeated rows are candidates
    each, and a repeated query id is answered as often, each time for its own vector. Components or products that don't fit 64-bit integers are an error.

    Fragment and replicate: queries are dealt into groups and rows into shares of a few blocks; every block of queries goes
    to each share and every block of rows to each group, so the work is even whatever the data. Within a pair of blocks,
    segment statistics rule most rows out (see nearest). Only k rows per query leave a pair; they are merged in two levels, so that no list is longer than k times
    the root of the number of shares.
    Two counts (of one column) set the number of groups and shares.
    """
    spark = queries.sparkSession
    ship(spark)
    groups = max(1, -(-queries.count() // block_rows))
    shares = max(1, -(-rows.count() // block_rows))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = blocks(queries, vec, key, block_rows, scale).select("dim", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("width").alias("q_width"), dealt("ids", groups).alias("g"))
    q = q.withColumn("block", F.monotonically_increasing_id()).withColumn("share", every(shares))
    x = blocks(rows, vec, key, block_rows, scale).withColumn("share", dealt("ids", shares)).withColumn("g", every(groups))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                mine, theirs = (np.frombuffer(r[c], f"<i{r[w]}").astype(np.int64).reshape(-1, r["dim"]) for c, w in (("q_data", "q_width"), ("data", "width")))
                if r["dim"] * float(np.abs(mine).max()) * float(np.abs(theirs).max()) >= 2.0**63:
                    raise ValueError("inner products don't fit 64-bit integers")
                q_id = np.frombuffer(r["q_ids"], "<i8")
                found = nearest(mine, q_id, theirs, np.frombuffer(r["ids"], "<i8"), k)
                at, ids, scores = (np.array(c, np.int64) for c in (list(zip(*found, strict=True)) or [(), (), ()]))
                same = lambda c: pa.array(np.full(len(at), r[c], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(q_id[at]), same("block"), pa.array(at), same("share"), pa.array(ids), pa.array(scores)], names=["query_id", "block", "place", "share", "vec_id", "score"])

    pairs = x.join(q, ["g", "share", "dim"])
    found = pairs.mapInArrow(run, "query_id long, block long, place long, share long, vec_id long, score long")
    query = ["query_id", "block", "place"]
    top = lambda c: F.slice(F.array_sort(c), 1, k).alias("best")
    part = F.pmod("share", F.lit(math.isqrt(shares) + 1)).alias("part")
    some = found.groupBy(*query, part).agg(top(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))))
    best = some.groupBy(*query).agg(top(F.flatten(F.collect_list("best"))))
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
