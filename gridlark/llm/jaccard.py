"""Exact Jaccard join of documents by pivots, Voronoi regions and triangle-inequality windows in the metric space of shingle sets."""

from __future__ import annotations

import contextlib
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridlark.llm.common import discard, materialize, releasing, ship, slices
from gridlark.llm.components import connected, spread_join
from gridlark.llm.shingles import WORDS, Shingler, overlap

PERCENT = 80
COMMON_AT = 8
MAX_COMMON = 500_000
CROWD = 64
SHORT = 32
CHUNK = 1_000_000
SKETCH, AGREE = 16, 4
MARKED = 1 << 20
SLICE = 512 << 10
REGION_PAIRS = 2_000
PARTS = 512
PARITIES = [f"p{k}" for k in range(PARTS // 64)]
_SLACK = 1e-9


@dataclass(frozen=True)
class Posting:
    """What documents meet under: the tokens of a set, in order, and a mark of them that pairs are told by (or none); under how many of n tokens, common ones last, two
    documents that link are sure to meet; the same for a set of size n, as a column; from how many sets on a token counts as common; and what keeps of pairs (x, y) those that may link by their marks."""

    tokens: Callable[[np.ndarray], tuple[np.ndarray, bytes | None]]
    prefix: Callable[[int], int]
    posted: Column
    common_at: int = COMMON_AT
    keep: Callable[[DataFrame, str, str, DataFrame], DataFrame] = lambda pairs, x, y, points: pairs


def by_shingles(percent: int) -> Posting:
    """A partner shares at least ceil(percent * n / 100) of a set's n shingles, so, in any order of all shingles, the first one both hold is among the
    first n - that + 1 of either."""
    return Posting(lambda s: (s, None), lambda n: n - -(-percent * n // 100) + 1, F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Arrow batches of at most `rows` rows while a job runs whose rows hold whole texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def describe(docs: DataFrame, words: int, posting: Posting) -> DataFrame:
    """(doc, n, s1, s2, p0 .. p7, fine, sig) for each document: the size of its set, two sums that tell it, and for each of PARTS parts of all shingles, dealt by
    hash, the parity of how many it holds (two sets differ in one shingle at least for each parity that differs); fine: for sets of more than PARTS shingles the
    same for as many parts, the next power of two; sig: the posting's mark; (null, count, token, null, ...)
    for tokens that several different sets of a chunk hold."""
    schema = "doc long, n long, s1 long, s2 long, " + ", ".join(f"{c} long" for c in PARITIES) + ", fine array<long>, sig binary"

    tokens_of, least = posting.tokens, max(2, posting.common_at // 16)

    def run(batches):
        shingler, seen, sets, held = Shingler(words), set(), [], 0

        def batch_of(doc, n, s1, s2, sig, parity, fine):
            cols = [pa.array(x, pa.int64()) for x in (doc, n, s1, s2)] + [pa.array(x, pa.int64()) for x in parity] + [pa.array(fine, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["doc", "n", "s1", "s2", *PARITIES, "fine", "sig"])

        def parities(s, parts):
            return np.bincount((s >> np.uint64(24)).astype(np.int64) & (parts - 1), minlength=parts) & 1

        def frequent():
            values, counts = np.unique(np.concatenate(sets), return_counts=True)
            often = counts >= least
            none = [None] * int(often.sum())
            return batch_of(none, counts[often], values[often].view(np.int64), none, none, [none] * len(PARITIES), none)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE):
                rows, parity, fine = [], np.zeros((b - a, PARTS), np.uint8), [None] * (b - a)
                for i, (doc, s) in enumerate(zip(ids[a:b], shingler.sets(texts[a:b]), strict=True)):
                    sig = signature(s)
                    tokens, mark = tokens_of(s)
                    rows.append((doc, len(s), *sig, mark))
                    parity[i] = parities(s, PARTS)
                    if len(s) > PARTS:
                        fine[i] = np.packbits(parities(s, 1 << (len(s) - 1).bit_length()).astype(np.uint8)).view("<i8")
                    if len(s) and sig not in seen:
                        seen.add(sig)
                        sets.append(tokens)
                        held += len(tokens)
                yield batch_of(*zip(*rows, strict=True), np.packbits(parity, axis=1).view("<i8").T, fine)
                if held >= CHUNK:
                    yield frequent()
                    sets, held = [], 0
                if len(seen) > 200_000:
                    seen.clear()
        if sets:
            yield frequent()

    return docs.mapInArrow(releasing(run), schema)


def signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a set from others: two sums of differently mixed hashes."""
    with np.errstate(over="ignore"):
        a = s.sum(dtype=np.uint64)
        b = ((s ^ (s >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(7)).sum(dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return int(a.view(np.int64)), int(b.view(np.int64))


def assigned(docs: DataFrame, words: int, posting: Posting, common: np.ndarray, buckets: int, crowd: int = CROWD) -> DataFrame:
    """(bucket, shingles, docs, sizes, marks, homes, crowd, long): each set under the tokens by which it can meet a partner, common ones last. Below a token is called a shingle.

    A set that comes again in the same task is left out, its documents being linked
    by their signature. Under a shingle that `crowd` sets or more of a flush hold only the first of them goes on; the others are tied to it
    in `crowd`, so that a shingle of very many documents is a few rows of each task. Rows travel as arrays: shingles as 64-bit numbers, docs as compressed differences, sizes of the sets, the first SKETCH bytes of their marks, their homes (see home_of),
    crowd as triples (first, other, mask), long as the shingles that have a crowd.
    """
    tokens_of, prefix = posting.tokens, posting.prefix

    def run(batches):
        shingler, seen, held, size = Shingler(words), set(), [], 0
        pack = zstandard.ZstdCompressor(level=1).compress

        def bucket_of(shingle):
            return ((shingle & np.uint64(0xFFFFFFFF)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

        def flush():
            shingle, doc, many, marks, homes = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            values, at, counts = np.unique(shingle, return_inverse=True, return_counts=True)
            crowded = counts[at] >= crowd
            ties = np.zeros((0, 3), np.int64)
            if crowded.any():
                first = np.full(len(values), np.iinfo(np.int64).max)
                np.minimum.at(first, at[crowded], doc[crowded])
                ties = united(first[at[crowded]], doc[crowded], bits(shingle[crowded]))
                stay = ~crowded | (doc == first[at])
                shingle, doc, many, marks, homes = shingle[stay], doc[stay], many[stay], marks[stay], homes[stay]
            long = values[counts >= crowd]
            rows = by_bucket(bucket_of(shingle), buckets)
            crowds = by_bucket(bucket_of(long), buckets)
            tied = by_bucket(ties[:, 1] % buckets, buckets)
            out = [(b, shingle[i].tobytes(), pack(np.diff(doc[i], prepend=0).astype("<i8").tobytes()), pack(many[i].tobytes()), pack(marks[i].tobytes()), pack(homes[i].tobytes()), pack(ties[j].astype("<i8").tobytes()), long[k].tobytes()) for b, (i, j, k) in enumerate(zip(rows, tied, crowds, strict=True)) if len(i) or len(j)]
            cols = list(zip(*out, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "shingles", "docs", "sizes", "marks", "homes", "crowd", "long"])

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE):
                for doc, s in zip(ids[a:b], shingler.sets(texts[a:b]), strict=True):
                    n = len(s)
                    if not n or (sig := signature(s)) in seen:
                        continue
                    seen.add(sig)
                    s, mark = tokens_of(s)
                    mark = np.frombuffer((mark or b"")[:SKETCH], np.uint8)
                    k = min(len(s), prefix(n))
                    rare = len(s)
                    if len(common):
                        often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
                        rare = len(s) - int(often.sum())
                        s = np.concatenate([s[~often], s[often]])
                    s = s[:k].copy()
                    held.append((s, np.full(k, doc), np.full(k, n, np.int32), np.broadcast_to(mark, (k, len(mark))), np.full(k, home_of(s, rare))))
                    size += k
                if size >= CHUNK:
                    yield flush()
                    size = 0
                if len(seen) > 200_000:
                    seen.clear()
        if held:
            yield flush()

    return docs.mapInArrow(releasing(run), "bucket int, shingles binary, docs binary, sizes binary, marks binary, homes binary, crowd binary, long binary")


def home_of(posted: np.ndarray, rare: int) -> np.uint64:
    """The one of a set's posted shingles under which it meets all that have the same home: the first, or, where most are common, the first common one, which
    near copies of a large group share."""
    return posted[rare] if 2 * rare < len(posted) else posted[0]


def bits(shingle: np.ndarray) -> np.ndarray:
    """For each shingle one bit of 64, by its hash."""
    return (np.uint64(1) << (shingle >> np.uint64(32) & np.uint64(63))).view(np.int64)


def united(pivot: np.ndarray, doc: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """(pivot, doc, mask) rows: each pair of different documents once, with the bits of all its rows."""
    order = np.lexsort((doc, pivot))
    order = order[(pivot != doc)[order]]
    if not len(order):
        return np.zeros((0, 3), np.int64)
    pivot, doc, mask = pivot[order], doc[order], mask[order]
    start = np.flatnonzero(np.r_[True, (pivot[1:] != pivot[:-1]) | (doc[1:] != doc[:-1])])
    return np.stack([pivot[start], doc[start], np.bitwise_or.reduceat(mask, start)], axis=1)


def by_bucket(bucket: np.ndarray, buckets: int) -> list[np.ndarray]:
    """The places of each bucket's rows, in their order."""
    order = np.argsort(bucket, kind="stable")
    return np.split(order, np.searchsorted(bucket[order], np.arange(1, buckets)))


def pivots(rows: DataFrame, percent: int, short: int = SHORT) -> DataFrame:
    """(pivot, doc, crowd, pair, mask) from assigned(): the documents that meet under a shingle each with the first of them, their pivot. Under a shingle of no more than `short` documents
    all that may link by their sizes are paired instead (pair), and have no pivot; where sets have marks, at least AGREE of their first SKETCH bytes agree (at a similarity of 0.8
    fewer do with a probability under 3e-7). Two documents of one home are paired there only: both are posted under it, so it is a list of both, and if it is long it
    gives both its pivot. crowd: the pivot is that of a
    crowd and may itself have one for the same shingle. mask has the bits of the shingles under which the two meet: documents that meet there too have
    one of them in common. Pairs come once a task."""
    names = ["pivot", "doc", "crowd", "pair", "mask"]

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        shingles, docs, sizes, marks, homes, ties, longs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [], [np.zeros(0, np.uint64)], [np.zeros((0, 3), np.int64)], [np.zeros(0, np.uint64)]
        for batch in batches:
            for shingle, doc, size, mark, home, tie, long in zip(*[batch.column(k).to_pylist() for k in range(1, 8)], strict=True):
                shingles.append(np.frombuffer(shingle, np.uint64))
                docs.append(np.cumsum(np.frombuffer(unpack(doc), "<i8")))
                sizes.append(np.frombuffer(unpack(size), "<i4"))
                marks.append(np.frombuffer(unpack(mark), np.uint8))
                homes.append(np.frombuffer(unpack(home), np.uint64))
                ties.append(np.frombuffer(unpack(tie), "<i8").reshape(-1, 3))
                longs.append(np.frombuffer(long, np.uint64))
        shingle, doc, size, home, tie, long = (np.concatenate(x) for x in (shingles, docs, sizes, homes, ties, longs))
        mark = np.concatenate(marks).reshape(len(doc), -1) if len(doc) else np.zeros((0, 0), np.uint8)
        del shingles, docs, sizes, marks, homes, ties, longs
        order = np.lexsort((doc, shingle))
        shingle, doc, size, home = shingle[order], doc[order], size[order], home[order]
        start = np.flatnonzero(np.r_[len(shingle) > 0, shingle[1:] != shingle[:-1]][: len(shingle)])
        length = np.diff(np.r_[start, len(doc)])
        few = np.repeat((length <= short) & ~np.isin(shingle[start], long), length)
        lead = np.repeat(doc[start], length)
        pairs = [np.zeros((0, 3), np.int64)]
        for d in range(1, short):
            i = np.flatnonzero(few[d:] & (shingle[d:] == shingle[:-d]))
            if not len(i):
                break
            i = i[(home[i] != home[i + d]) | (home[i] == shingle[i])]
            if mark.shape[1]:
                i = i[(mark[order[i]] == mark[order[i + d]]).sum(axis=1) >= AGREE]
            i = i[100 * np.minimum(size[i], size[i + d]).astype(np.int64) >= percent * np.maximum(size[i], size[i + d]).astype(np.int64)]
            pairs.append(united(doc[i], doc[i + d], np.zeros(len(i), np.int64)))
        found = [(united(*np.concatenate(pairs).T), False, True), (united(lead[~few], doc[~few], bits(shingle[~few])), False, False), (united(*tie.T), True, False)]
        del shingle, doc, size, mark, home, lead, few, pairs
        for rows, crowd, pair in found:
            for a in range(0, len(rows), 50_000):
                x = rows[a : a + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(np.full(len(x), crowd)), pa.array(np.full(len(x), pair)), pa.array(x[:, 2])], names=names)

    return rows.mapInArrow(releasing(run), "pivot long, doc long, crowd boolean, pair boolean, mask long")


def compressed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, text) of about the documents in wanted, with the texts as compressed UTF-8, which a shuffle and the shared folder hold in less than half the space. Others are left out by a
    bit for each of MARKED hashes of their keys, a bound for what is sent to tasks; some pass it."""
    hashed = lambda c: F.pmod(F.xxhash64(c), F.lit(MARKED)).cast("int").alias("at")
    marks = np.zeros(MARKED, bool)
    marks[wanted.select(hashed("doc")).distinct().toArrow().column(0).to_numpy()] = True
    bits_of = np.packbits(marks)

    def run(batches):
        pack, marks = zstandard.ZstdCompressor(level=3).compress, np.unpackbits(bits_of).astype(bool)
        for batch in batches:
            batch = batch.filter(pa.array(marks[batch.column("at").to_numpy()]))
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [pack((t or "").encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.binary())], names=["doc", "text"])

    return docs.select("doc", "text", hashed("doc")).mapInArrow(releasing(run), "doc long, text binary")


def least_difference(x: str, y: str) -> Column:
    """How many shingles at least only one of two sets holds, by their sizes and parities."""
    return F.expr("greatest(cast(" + " + ".join(f"bit_count({x}.{c} ^ {y}.{c})" for c in PARITIES) + f" as long), abs({x}.n - {y}.n))")


def may_link(differ: Column, nx: Column, ny: Column, percent: int) -> Column:
    """At the threshold two sets differ in at most (100 - percent) / (100 + percent) of the sum of their sizes."""
    return (100 + percent) * differ <= (100 - percent) * (nx + ny)


def closer(pairs: DataFrame, x: str, y: str, points: DataFrame, percent: int) -> DataFrame:
    """The pairs of documents x and y that may link by their fine parities too, where both have them. Of sets that may link by size one has as many parts as the other or
    twice as many; then its halves are laid over each other."""
    for end, name in ((x, "fx"), (y, "fy")):
        pairs = pairs.join(points.where("fine is not null").select(F.col("doc").alias(end), F.struct("n", "fine").alias(name)), end, "left")
    half = lambda u, v: f"if(size({u}) > size({v}), zip_with(slice({u}, 1, size({v})), slice({u}, size({v}) + 1, size({v})), (i, j) -> i ^ j), {u})"
    u, v = half("fx.fine", "fy.fine"), half("fy.fine", "fx.fine")
    differ = F.expr(f"aggregate(zip_with({u}, {v}, (i, j) -> bit_count(i ^ j)), 0L, (s, i) -> s + i)")
    return pairs.where(F.coalesce(may_link(differ, F.col("fx.n"), F.col("fy.n"), percent), F.lit(True))).drop("fx", "fy")


def distance(differ: Column, nx: Column, ny: Column) -> Column:
    """The Jaccard distance of sets of these sizes that differ in so many shingles."""
    return 2 * differ / (nx + ny + differ)


def verified(spark: SparkSession, pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, differ, linked) of distinct pairs (a, b): in how many shingles their sets differ and whether they link, exactly. Only the texts that
    a pair names are joined."""
    pairs = materialize(spark, pairs.select("a", "b"), "pairs")
    named = pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct()
    texts = materialize(spark, compressed(docs, named).join(named, "doc", "left_semi"), "texts")
    x = texts.select(F.col("doc").alias("a"), F.col("text").alias("ta"))
    y = texts.select(F.col("doc").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(y, "b").join(x, "a").select("a", "b", "ta", "tb")

    def run(batches):
        shingler, last = Shingler(words), (None, None)
        unpack = zstandard.ZstdDecompressor().decompress
        text = lambda x: unpack(x).decode("utf-8", "surrogatepass")
        for batch in batches:
            a, b, ta, tb = batch.columns
            ids, tb, differ, linked = a.to_pylist(), tb.to_pylist(), [], []
            for i, j in slices(tb, 64 << 10):
                for k, s in zip(range(i, j), shingler.sets([text(t) for t in tb[i:j]]), strict=True):
                    if last[0] != ids[k]:
                        last = (ids[k], shingler.sets([text(ta[k].as_py())])[0])
                    both, total = overlap(last[1], s), len(s) + len(last[1])
                    differ.append(total - 2 * both)
                    linked.append(100 * both >= percent * (total - both))
            yield pa.RecordBatch.from_arrays([a, b, pa.array(differ, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "differ", "linked"])

    with small_batches(spark, 500):
        out = materialize(spark, joined.mapInArrow(releasing(run), "a long, b long, differ long, linked boolean"), "verified")
    discard(spark, pairs, texts)
    return out


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT, common_at: int | None = None, region_pairs: int = REGION_PAIRS, crowd: int = CROWD, short: int = SHORT, posting: Posting | None = None) -> DataFrame:
    """(key, n_shingles, component_id) for each document: the connected components of all links of
    Jaccard similarity of percent / 100 or more between sets of distinct `words`-word shingles, exactly.

    A document with fewer words has its whole sequence as one shingle; one without words, or with a null text, has an
    empty set, links with nothing and is its own component. Keys are integers; rows with a null key come back with a null component.
    Rows with the same key are one node of the graph, each with its own set: a key is linked with all that one of its rows links with. Other columns aren't
    read. An empty table gives no rows.

    1. Equal sets are one class, found by a 128-bit signature (an aggregate); the smallest key of each stands for it.
    2. Pivots are documents. Two unrelated documents are at distance 1 from almost any pivot, where no triangle inequality can tell them apart;
       so the pivots a document is measured against are those it meets under a shingle of its own (see assigned), the first document there. Any two
       documents that link meet under one shingle and so have a pivot in common. Common shingles, counted over all documents, come last in the order,
       so that passages many documents share make no region but for sets made of them. At most MAX_COMMON count as common, a bound for
       what is sent to tasks; it changes only the work, not the result.
    3. Distances to pivots are exact where a lower bound (sizes, and parities of parts of the sets) doesn't rule a link out, else that bound up to 1. Documents
       that link with a pivot are in one component and need not be compared among one another.
    4. A pivot's region holds all documents that meet it, also those of a crowd tied to it through another pivot, whose distance the triangle inequality
       bounds. Regions that still hold several components go on. One with more than region_pairs pairs to compare gets a
       second pivot, the smallest document outside the first one's component, and is cut into the two Voronoi cells; a document is copied to a cell too whose pivot is at most
       2 * eps farther from it than its own (eps the distance of a link), and so on recursively while this makes less work.
    5. In what is left, pairs of different components are compared whose distances to the pivot differ by eps at most and that the lower bound
       allows: for each document and component the nearest by that bound first, then all that are still in different components.

    All steps are aggregates and equi-joins that AQE can split; what a task holds is bounded by its share of a shuffle. Steps are
    written to the shared folder, so that lost executors cost the current step only, and deleted once the next is written.
    """
    spark = docs.sparkSession
    ship(spark)
    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    usable = source.where("doc is not null")
    posting = by_shingles(percent) if posting is None else posting
    posting = posting if common_at is None else replace(posting, common_at=common_at)
    if usable.groupBy("doc").count().where("count > 1").limit(1).count():
        found, needs = with_repeated_keys(spark, usable, words, percent, region_pairs, crowd, short, posting)
    else:
        found, needs = of_unique_keys(spark, usable, words, percent, region_pairs, crowd, short, posting)
    out = found.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id")).unionByName(without_key(source, words, key, posting))
    out.needs = needs
    return out


def of_unique_keys(spark: SparkSession, usable: DataFrame, words: int, percent: int, region_pairs: int, crowd: int, short: int, posting: Posting) -> tuple[DataFrame, list[DataFrame]]:
    """(doc, n, component) of documents with keys of their own, and the written steps it reads."""
    told = materialize(spark, describe(usable, words, posting), "sets")
    sets = told.where("doc is not null")
    often = told.where("doc is null").groupBy("s1").agg(F.sum("n").alias("n")).where(F.col("n") >= posting.common_at)
    common = np.sort(often.orderBy(F.desc("n"), "s1").limit(MAX_COMMON).select("s1").toArrow().column(0).to_numpy().view(np.uint64))
    total = sets.agg(F.coalesce(F.sum(posting.posted), F.lit(0)).alias("rows")).first().rows
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // CHUNK))
    rows = assigned(usable, words, posting, common, partitions, crowd).repartitionById(partitions, F.col("bucket"))
    met = materialize(spark, pivots(rows, percent, short).groupBy("pivot", "doc", "crowd", "pair").agg(F.bit_or("mask").alias("mask")), "pivots")

    classes = materialize(spark, sets.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("class"), *[F.first(c).alias(c) for c in [*PARITIES, "fine", "sig"]]), "classes")
    member = spread_join(sets.select("doc", "n", "s1", "s2"), classes.select("n", "s1", "s2", "class"), ["n", "s1", "s2"], "doc", "left")
    member = materialize(spark, member.select("doc", "n", F.coalesce("class", "doc").alias("class")), "members")
    discard(spark, told)
    points = classes.select(F.col("class").alias("doc"), "n", *PARITIES, "fine", "sig")
    star = stars(spark, met, member, points, percent)
    discard(spark, met)

    near = star.where("near").select(F.least("pivot", "doc").alias("a"), F.greatest("pivot", "doc").alias("b")).distinct()
    checked = verified(spark, posting.keep(closer(near, "a", "b", points, percent), "a", "b", points), usable, words, percent)
    component = connected(spark, checked.where("linked"))
    regions = materialize(spark, measured(star, checked, percent), "regions")
    discard(spark, star)

    mixed, work = several(spark, regions, component, points, region_pairs, percent)
    while work.large:
        cells, more = divided(spark, mixed, checked, points, usable, words, percent, posting)
        merged = connected(spark, more.where("linked"), known=component)
        both = materialize(spark, checked.unionByName(more), "verified")
        discard(spark, regions, mixed, component, checked, more)
        regions, component, checked, before = cells, merged, both, work
        mixed, work = several(spark, regions, component, points, region_pairs, percent)
        if work.pairs > 0.75 * before.pairs:
            break
    found = crossing(spark, mixed, checked, points, percent, posting)
    discard(spark, regions, mixed, checked)
    nearest = verified(spark, found.groupBy("x", "other").agg(F.min_by("y", F.struct("differ", "y")).alias("y")).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), usable, words, percent)
    merged = connected(spark, nearest.where("linked"), known=component)
    discard(spark, component)
    rest = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(nearest, ["a", "b"], "left_anti")
    for end in ("a", "b"):
        rest = rest.join(merged.select(F.col("node").alias(end), F.col("component").alias(f"c{end}")), end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    last = verified(spark, rest.where("ca <> cb"), usable, words, percent)
    component = connected(spark, last.where("linked"), known=merged)
    discard(spark, found, nearest, merged, last, classes)
    out = member.join(component.withColumnRenamed("node", "class"), "class", "left").select("doc", "n", F.coalesce("component", "class").alias("component"))
    return out, [member, component]


def stars(spark: SparkSession, met: DataFrame, member: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """(pivot, doc, crowd, pair, mask, differ, np, nd, near) of the classes of the documents that met: a lower bound of how much their sets differ, and whether it allows
    a link."""
    for end in ("pivot", "doc"):
        other = member.where("doc <> class").select(F.col("doc").alias(end), "class")
        met = met.join(other, end, "left").withColumn(end, F.coalesce("class", end)).drop("class")
    met = met.where("pivot <> doc").groupBy("pivot", "doc", "crowd", "pair").agg(F.bit_or("mask").alias("mask"))
    p, d = (points.select(F.col("doc").alias(end), F.struct("n", *PARITIES).alias(name)) for end, name in (("pivot", "p"), ("doc", "d")))
    rows = met.join(p, "pivot").join(d, "doc").select("pivot", "doc", "crowd", "pair", "mask", least_difference("p", "d").alias("differ"), F.col("p.n").alias("np"), F.col("d.n").alias("nd"))
    return materialize(spark, rows.withColumn("near", may_link(F.col("differ"), F.col("np"), F.col("nd"), percent)).where("near or not pair"), "stars")


def measured(star: DataFrame, checked: DataFrame, percent: int) -> DataFrame:
    """(region, pivot, doc, mask, lo, hi): all documents of the region of each pivot, with bounds of their distance from it. The region is named by its pivot. Documents that surely link
    with the pivot and are farther than a link from all that may not, are left out: they are in its component and meet no other one."""
    told = star.where("not pair").alias("s").join(checked.alias("c"), F.expr("least(s.pivot, s.doc) = c.a and greatest(s.pivot, s.doc) = c.b"), "left")
    lo = distance(F.coalesce("c.differ", "s.differ"), F.col("np"), F.col("nd"))
    own = told.select("pivot", "s.doc", "crowd", "mask", lo.alias("lo"), F.when(F.col("c.differ").isNotNull(), lo).otherwise(1.0).alias("hi"))
    tied = own.where("crowd").select(F.col("pivot").alias("first"), "doc", F.col("mask").alias("mask2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    far = own.select("pivot", F.col("doc").alias("first"), "mask", "lo", "hi").join(tied, "first").where("pivot <> doc and mask & mask2 <> 0")
    far = far.select("pivot", "doc", F.expr("mask & mask2").alias("mask"), F.greatest(F.col("lo") - F.col("hi2"), F.col("lo2") - F.col("hi"), F.lit(0.0)).alias("lo"), F.least(F.lit(1.0), F.col("hi") + F.col("hi2")).alias("hi"))
    rows = own.drop("crowd").unionByName(far).groupBy("pivot", "doc").agg(F.bit_or("mask").alias("mask"), F.max("lo").alias("lo"), F.min("hi").alias("hi"))
    itself = own.select("pivot", F.col("pivot").alias("doc"), F.lit(-1).cast("long").alias("mask"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")).distinct()
    rows = rows.unionByName(itself).select(F.col("pivot").cast("string").alias("region"), "*")
    eps = (100 - percent) / 100
    other = F.col("hi") > eps - _SLACK
    nearest = rows.where(other).groupBy("region").agg(F.min("lo").alias("nearest"))
    return spread_join(rows, nearest, ["region"], "doc").where(other | (F.col("hi") + eps + _SLACK >= F.col("nearest"))).drop("nearest")


def several(spark: SparkSession, regions: DataFrame, component: DataFrame, points: DataFrame, region_pairs: int, percent: int):
    """The rows of regions that may link with one of another component there, by their distances from the pivot, each with its component, whether it is the pivot's (main), its size and parities, and whether the region has
    more than region_pairs pairs to compare (large); and how many pairs that makes, and whether there are large ones."""
    rows = regions.join(component.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    of_pivot = component.select(F.col("node").alias("pivot"), F.col("component").alias("of_pivot"))
    # written, as the bounds of the regions, their sizes and the rows themselves are all read from it
    placed = rows = materialize(spark, rows.join(of_pivot, "pivot", "left").withColumn("main", F.col("component") == F.coalesce("of_pivot", "pivot")).drop("of_pivot"), "placed")
    other = lambda c: F.when(~F.col("main"), F.col(c))
    per = rows.groupBy("region").agg(F.min(other("lo")).alias("nearest"), F.max(F.when(F.col("main"), F.col("hi"))).alias("farthest"), (F.min(other("component")) < F.max(other("component"))).alias("many")).where("nearest is not null")
    # a document goes on if its distance lets it link with one of another component
    eps = (100 - percent) / 100 + _SLACK
    meets = F.when(F.col("main"), F.col("hi") + eps >= F.col("nearest")).otherwise(F.col("many") | (F.col("lo") - eps <= F.col("farthest")))
    rows = spread_join(rows, per, ["region"], "doc").where(F.coalesce(meets, F.lit(False))).drop("nearest", "farthest", "many")
    size = rows.groupBy("region").agg((F.count("*") * F.count_if(~F.col("main"))).alias("pairs")).select("region", "pairs", (F.col("pairs") > region_pairs).alias("large"))
    rows = spread_join(rows, size, ["region"], "doc").drop("pairs").join(points.drop("fine", "sig"), "doc")
    mixed = materialize(spark, rows.select("region", "pivot", "doc", "mask", "lo", "hi", "component", "main", "large", "n", *PARITIES), "mixed")
    discard(spark, placed)
    per = mixed.groupBy("region").agg((F.count("*") * F.count_if(~F.col("main"))).alias("pairs"), F.first("large").alias("large"))
    return mixed, per.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.max("large"), F.lit(False)).alias("large")).first()


def divided(spark: SparkSession, mixed: DataFrame, checked: DataFrame, points: DataFrame, docs: DataFrame, words: int, percent: int, posting: Posting) -> tuple[DataFrame, DataFrame]:
    """The regions anew, large ones cut into the cells of their pivot and of the smallest document outside its component; and the pairs that were verified for that.

    eps is a link's distance. If a document's nearer pivot is p, a partner is at most 2 * eps farther from p than from the other one; each document
    goes to all cells where that may hold by the bounds of its distances.
    """
    large = mixed.where("large")
    second = large.where("not main").groupBy("region").agg(F.min("doc").alias("second"))
    of = points.join(second.select(F.col("second").alias("doc")).distinct(), "doc", "left_semi").select(F.col("doc").alias("second"), F.struct("n", *PARITIES).alias("q"))
    # many regions can have the same second pivot, and a region many documents
    second = spread_join(second, of, ["second"], "region")
    rows = spread_join(large.withColumn("d", F.struct("n", *PARITIES)), second, ["region"], "doc")
    written = rows = materialize(spark, rows.withColumn("differ", least_difference("d", "q")).withColumn("nq", F.col("q.n")).drop("d", "q", *PARITIES), "seconds")
    pair = [F.least("second", "doc").alias("a"), F.greatest("second", "doc").alias("b")]
    near = rows.where(may_link(F.col("differ"), F.col("n"), F.col("nq"), percent) & F.expr("second <> doc")).select(*pair).distinct()
    more = verified(spark, posting.keep(closer(near.join(checked, ["a", "b"], "left_anti"), "a", "b", points, percent), "a", "b", points), docs, words, percent)
    exact = checked.unionByName(more).select("a", "b", F.col("differ").alias("exact"))
    rows = rows.withColumns({"a": pair[0], "b": pair[1]}).join(exact, ["a", "b"], "left")
    lo = distance(F.coalesce("exact", "differ"), F.col("n"), F.col("nq"))
    rows = rows.withColumn("lo2", F.when(F.expr("second = doc"), 0.0).otherwise(lo)).withColumn("hi2", F.when(F.expr("second = doc"), 0.0).when(F.col("exact").isNotNull(), lo).otherwise(1.0))
    twice = 2 * (100 - percent) / 100 + _SLACK
    # the first pivot stays in its cell, the second in its own
    first = rows.where((F.col("lo") <= F.col("hi2") + twice) | (F.col("doc") == F.col("pivot"))).select(F.concat_ws("/", "region", F.lit("0")).alias("region"), "pivot", "doc", "mask", "lo", "hi")
    other = rows.where((F.col("lo2") <= F.col("hi") + twice) | (F.col("doc") == F.col("second"))).select(F.concat_ws("/", "region", F.lit("1")).alias("region"), F.col("second").alias("pivot"), "doc", "mask", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"))
    small = mixed.where("not large").select("region", "pivot", "doc", "mask", "lo", "hi")
    cells = materialize(spark, small.unionByName(first).unionByName(other), "regions")
    discard(spark, written)
    return cells, more


def crossing(spark: SparkSession, mixed: DataFrame, checked: DataFrame, points: DataFrame, percent: int, posting: Posting) -> DataFrame:
    """(x, y, other, differ) of pairs of different components in a region, x outside the pivot's, that meet under a shingle (a bit of their masks), aren't
    verified yet, may link by the lower bound, and whose distances to the pivot differ by eps at most. other: y's component."""
    side = lambda name: F.struct("doc", "mask", "component", "main", "lo", "hi", "n", *PARITIES).alias(name)
    x, y = mixed.where("not main").select("region", side("x")), mixed.select("region", side("y"))
    eps = (100 - percent) / 100 + _SLACK
    meets = (F.col("x.component") != F.col("y.component")) & (F.col("y.main") | (F.col("x.doc") < F.col("y.doc")))
    window = F.expr("x.mask & y.mask <> 0") & (F.col("x.lo") - F.col("y.hi") <= eps) & (F.col("y.lo") - F.col("x.hi") <= eps)
    differ = least_difference("x", "y")
    found = x.join(y, (x.region == y.region) & meets & window & may_link(differ, F.col("x.n"), F.col("y.n"), percent))
    found = found.groupBy(F.col("x.doc").alias("x"), F.col("y.doc").alias("y")).agg(F.first("y.component").alias("other"), F.first(differ).alias("differ"))
    done = checked.select("a", "b")
    found = found.join(done, F.expr("least(x, y) = a and greatest(x, y) = b"), "left_anti")
    coarse = materialize(spark, found, "crossing")  # written, as the optimizer would fold the two bounds into one very large condition
    found = materialize(spark, posting.keep(closer(coarse, "x", "y", points, percent), "x", "y", points), "crossing")
    discard(spark, coarse)
    return found


def with_repeated_keys(spark: SparkSession, usable: DataFrame, words: int, percent: int, region_pairs: int, crowd: int, short: int, posting: Posting) -> tuple[DataFrame, list[DataFrame]]:
    """As of_unique_keys: each row is a document of its own first, then the components that share a key are one."""
    numbered = materialize(spark, usable.withColumn("row", F.monotonically_increasing_id()), "numbered")
    rows, needs = of_unique_keys(spark, numbered.select(F.col("row").alias("doc"), "text"), words, percent, region_pairs, crowd, short, posting)
    rows = materialize(spark, rows.withColumnRenamed("doc", "row").join(numbered.select("row", "doc"), "row").select("doc", "n", "component"), "rows")
    low = rows.groupBy("doc").agg(F.min("component").alias("low"))
    discard(spark, numbered, *needs)
    written = rows
    merged = connected(spark, spread_join(rows, low, ["doc"], "component").select("component", "low").distinct(), "component", "low")
    rows = rows.join(merged.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left").withColumn("root", F.coalesce("root", "component"))
    smallest = rows.groupBy("root").agg(F.min("doc").alias("component"))
    return spread_join(rows.drop("component"), smallest, ["root"], "doc").select("doc", "n", "component"), [written, merged]


def without_key(source: DataFrame, words: int, key: str, posting: Posting) -> DataFrame:
    told = describe(source.where("doc is null").select(F.lit(0).cast("long").alias("doc"), "text"), words, posting).where("doc is not null")
    null = F.lit(None).cast("long")
    return told.select(null.alias(key), F.col("n").alias("n_shingles"), null.alias("component_id"))
