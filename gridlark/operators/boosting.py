"""Histogram gradient boosting over partitions: all boosters of a grid grow a level from one pass over the rows."""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, functions as F

from gridlark.functions import metrics
from gridlark.operators.training import DIRECT, mixed
from gridlark.sources.steps import drop, written

BINS = 64
BLOCK_ROWS = 16_384
CUT = 25
HELD_ROWS = 2**19
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class Booster:
    """Trees of `depth` levels, or, with `leaves`, the leaf-wise ones of at most so many leaves within these levels; shares of rows and columns drawn for each tree."""

    name: str = "depth"
    depth: int = 6
    rate: float = 0.1
    trees: int = 20
    seed: int = 42
    rows: float = 0.8
    columns: float = 0.8
    l2: float = 1.0
    least_weight: float = 1.0
    leaves: int | None = None


@dataclass
class Tree:
    """Nodes in the order they were made; a node without a left child is a leaf. Rows with a bin up to `bin` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def child(self, value: float) -> int:
        for x, v in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.right, -1), (self.value, value), (self.gain, 0.0)):
            x.append(v)
        return len(self.value) - 1

    def table(self) -> Table:
        return Table.of(self)

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        return self.table().places(bins)

    def chosen(self, leaves: int) -> set[int]:
        """The splits that growth by the highest gain makes until there are so many leaves. Splits that are found later come beside or between these, so one that isn't among them now never will be."""
        keep, heap, n = set(), [(-self.gain[0], 0)] if self.left[0] >= 0 else [], 1
        while heap and n < leaves:
            _, node = heapq.heappop(heap)
            keep.add(node)
            n += 1
            for child in (self.left[node], self.right[node]):
                if self.left[child] >= 0:
                    heapq.heappush(heap, (-self.gain[child], child))
        return keep

    def best_first(self, leaves: int) -> None:
        """Keep the chosen splits; a split's gain doesn't depend on the order of splits."""
        keep = self.chosen(leaves)
        for node in range(len(self.left)):
            if node not in keep:
                self.left[node] = self.right[node] = -1


@dataclass
class Table:
    """A tree's nodes as arrays: the column and bin of each, and both children one after another; a leaf's are itself."""

    feature: np.ndarray
    bin: np.ndarray
    child: np.ndarray
    value: np.ndarray
    depth: int

    @staticmethod
    def of(t: Tree) -> Table:
        left, right, own = np.array(t.left), np.array(t.right), np.arange(len(t.left))
        leaf = left < 0
        depth = np.zeros(len(left), int)
        for node in np.flatnonzero(~leaf):  # children come after their parents
            depth[[left[node], right[node]]] = depth[node] + 1
        reached = np.zeros(len(left), bool)
        reached[0] = True
        for node in np.flatnonzero(~leaf):
            reached[[left[node], right[node]]] |= reached[node]
        child = np.stack([np.where(leaf, own, left), np.where(leaf, own, right)], axis=1).ravel().astype(np.int32)
        return Table(np.where(leaf, 0, np.array(t.feature)).astype(np.int32), np.array(t.bin, np.int32), child, np.array(t.value), int(depth[reached].max()))

    def places(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at, flat = np.zeros(len(bins), np.int64), bins.ravel()
        start = np.arange(len(bins)) * bins.shape[1]
        for _ in range(self.depth):
            at = self.child.take(2 * at + (flat.take(start + self.feature.take(at)) > self.bin.take(at)))
        return at


def uniform(rows: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in 0 to 1 that depend on (row, salt) alone."""
    x = rows.view(np.uint64)
    with np.errstate(over="ignore"):
        for s in salt:
            x = mixed(x + np.uint64(s + 1) * np.uint64(0x9E3779B97F4A7C15))
    return (x >> np.uint64(11)) / 2.0**53


def drawn_columns(b: Booster, tree: int, n: int) -> np.ndarray:
    take = max(1, round(b.columns * n))
    return np.sort(np.argsort(uniform(np.arange(n, dtype=np.int64), b.seed, tree, 7), kind="stable")[:take])


def edges_of(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """For each column up to bins - 1 points that cut it into about even parts, at values it takes: a bounded summary."""
    at = [i / bins for i in range(1, bins)]
    found = rows.agg(*[F.percentile_approx(F.col(c).cast("double"), at, 10_000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(found[i] or [0.0])) for i in range(len(columns))]


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """A value's bin: how many edges lie below it."""
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8) if edges else np.zeros((len(x), 0), np.uint8)


BLOCK = "row binary, y binary, bins binary, margins binary"
BLOCK_NAMES = ["row", "y", "bins", "margins"]


def packed(rows: DataFrame, columns: list[str], edges: list[np.ndarray], models: int) -> DataFrame:
    source = rows.select(F.xxhash64("id").alias("row"), F.col("y").cast("double").alias("y"), *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(columns)])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                x = np.stack([part.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(len(columns))], axis=1)
                values = (part.column("row").to_numpy().tobytes(), part.column("y").to_numpy().tobytes(), binned(x, edges).tobytes(), np.zeros((len(x), models)).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=BLOCK_NAMES)

    return source.mapInArrow(run, BLOCK)


class Held:
    """Blocks kept by the executors from tree to tree, as an RDD: a pass over them needs no plan, and there are thousands of passes."""

    def __init__(self, rdd: RDD, partitions: int) -> None:
        self.rdd, self.partitions = rdd, partitions

    @staticmethod
    def of(table: DataFrame) -> Held:
        rdd = table.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        out = Held(rdd, rdd.getNumPartitions())
        out.table = table
        return out

    def mapInArrow(self, run, schema: str) -> RDD:  # noqa: N802
        def batches(rows):
            for values in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=BLOCK_NAMES)

        return self.rdd.mapPartitions(lambda rows: run(batches(rows)))

    def moved(self, run) -> Held:
        """The blocks after run, kept once they are read."""
        rows = self.mapInArrow(run, BLOCK).map(lambda batch: tuple(c[0].as_py() for c in batch.columns))
        return Held(rows.persist(StorageLevel.MEMORY_AND_DISK), self.partitions)


class Here(Held):
    """Blocks in one task."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        self.batches, self.partitions = batches, 1

    def mapInArrow(self, run, schema: str) -> list[pa.RecordBatch]:  # noqa: N802
        return list(run(iter(self.batches)))

    def moved(self, run) -> Here:
        return Here(self.mapInArrow(run, BLOCK))


def summed(parts: RDD | list[pa.RecordBatch], partitions: int) -> list[dict]:
    """(cell, g): the sums of all tasks' histograms of each cell. Those of more than DIRECT tasks are added up by a shuffle first."""
    if isinstance(parts, list):
        return parts[0].to_pylist()
    rows = parts.flatMap(lambda batch: zip(batch.column("cell").to_pylist(), (np.frombuffer(g, "<f8") for g in batch.column("g").to_pylist()), strict=True))
    if partitions > DIRECT:
        rows = rows.reduceByKey(np.add, DIRECT)
    total: dict[int, np.ndarray] = {}
    for cell, g in rows.collect():
        total[cell] = total[cell] + g if cell in total else g
    return [{"cell": cell, "g": g.tobytes()} for cell, g in total.items()]


def opened(batch: pa.RecordBatch, i: int, width: int, models: int):
    row, y, bins, margins = (batch.column(c)[i].as_buffer() for c in BLOCK_NAMES)
    return np.frombuffer(row, "<i8"), np.frombuffer(y, "<f8"), np.frombuffer(bins, np.uint8).reshape(-1, width), np.frombuffer(margins, "<f8").reshape(-1, models)


def histogram(bins: np.ndarray, place: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, columns: np.ndarray) -> np.ndarray:
    """(2, nodes, columns, BINS): sums of g and h of the rows of each node (place; under 0: none) and bin."""
    on = place >= 0
    bins, place, out = bins[on], place[on], np.zeros((2, nodes, len(columns), BINS))
    for j, c in enumerate(columns):
        at = place * BINS + bins[:, c]
        for k, v in enumerate((g[on], h[on])):
            out[k, :, j] = np.bincount(at, weights=v, minlength=nodes * BINS).reshape(nodes, BINS)
    return out


def level(blocks: Held, boosters: list[Booster], trees: dict[int, Tree], fronts: dict[int, list[int]], tree: int, pos_weight: float, width: int, partitions: int) -> dict[int, np.ndarray]:
    """The histograms of the open nodes of all boosters, from one pass over the blocks."""
    live = [(m, boosters[m], trees[m].table(), front, drawn_columns(boosters[m], tree, width)) for m, front in fronts.items() if front]
    models = len(boosters)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row, y, bins, margins = opened(batch, i, width, models)
                weight, drawn = np.where(y == 1, pos_weight, 1.0), {}
                for m, b, t, front, columns in live:
                    if (b.seed, b.rows) not in drawn:  # boosters of one seed draw the same rows
                        on = np.flatnonzero(uniform(row, b.seed, tree) < b.rows)
                        drawn[b.seed, b.rows] = on, bins[on], y[on], weight[on]
                    on, x, label, w = drawn[b.seed, b.rows]
                    p = 1 / (1 + np.exp(-margins[on, m]))
                    index = np.full(len(t.value), -1)
                    index[front] = np.arange(len(front))
                    found = histogram(x, index.take(t.places(x)), w * (p - label), w * p * (1 - p), len(front), columns)
                    total[m] = found if m not in total else total[m] + found
        cols = [list(total), [v.tobytes() for v in total.values()], [None] * len(total)]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.string()), strict=True)], names=["cell", "g", "error"])

    sums = {r["cell"]: r["g"] for r in summed(blocks.mapInArrow(run, "cell int, g binary, error string"), partitions)}
    return {m: np.frombuffer(sums[m], "<f8").reshape(2, len(front), len(columns), BINS) for m, _, _, front, columns in live if m in sums}


def split(b: Booster, t: Tree, front: list[int], sums: np.ndarray, columns: np.ndarray) -> list[int]:
    """Split each open node at its best column and bin (ties: the first); the new nodes. A node's value is its Newton step."""
    made = []
    for i, node in enumerate(front):
        g, h = sums[0, i], sums[1, i]
        all_g, all_h = float(g[0].sum()), float(h[0].sum())
        if node == 0:
            t.value[0] = -b.rate * all_g / (all_h + b.l2)
        gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
        gr, hr = all_g - gl, all_h - hl
        gain = gl**2 / (hl + b.l2) + gr**2 / (hr + b.l2) - all_g**2 / (all_h + b.l2)
        gain = np.where((hl >= b.least_weight) & (hr >= b.least_weight), gain, -np.inf)
        gain = np.round(gain, 9)  # sums of tasks differ in the last places
        j, cut = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[j, cut] > LEAST_GAIN:
            t.feature[node], t.bin[node], t.gain[node] = int(columns[j]), int(cut), float(gain[j, cut])
            t.left[node] = t.child(float(-b.rate * gl[j, cut] / (hl[j, cut] + b.l2)))
            t.right[node] = t.child(float(-b.rate * gr[j, cut] / (hr[j, cut] + b.l2)))
            made += [t.left[node], t.right[node]]
    return made


def opened_next(b: Booster, t: Tree, front: list[int], sums: np.ndarray, columns: np.ndarray) -> list[int]:
    """The nodes to open after the splits of a front: of a leaf-wise tree only those that its leaves can come from."""
    made = split(b, t, front, sums, columns)
    if not b.leaves:
        return made
    keep = t.chosen(b.leaves)
    return [child for node in front if node in keep for child in (t.left[node], t.right[node])]


def advanced(blocks: Held, trees: dict[int, Tree], width: int, models: int) -> Held:
    """The blocks with the margins after one more tree of each booster."""
    tables = {m: t.table() for m, t in trees.items()}

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                _, _, bins, margins = opened(batch, i, width, models)
                margins = margins.copy()
                for m, t in tables.items():
                    margins[:, m] += t.value.take(t.places(bins))
                values = [batch.column(c)[i].as_py() for c in BLOCK_NAMES[:3]] + [margins.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], names=BLOCK_NAMES)

    return blocks.moved(run)


@dataclass
class Boosted:
    columns: list[str]
    edges: list[np.ndarray]
    boosters: list[Booster]
    trees: list[list[Tree]]


def grown(blocks: Held, boosters: list[Booster], pos_weight: float, width: int, turn=lambda blocks, number: blocks) -> list[list[Tree]]:
    """The trees of the boosters. turn(blocks, number) gives the blocks to go on with after that many trees."""
    out: list[list[Tree]] = [[] for _ in boosters]
    for number in range(max((b.trees for b in boosters), default=0)):
        trees = {m: Tree() for m, b in enumerate(boosters) if number < b.trees}
        fronts = {m: [0] for m in trees}
        for depth in range(max(boosters[m].depth for m in trees)):
            fronts = {m: f for m, f in fronts.items() if f and depth < boosters[m].depth}
            if not fronts:
                break
            sums = level(blocks, boosters, trees, fronts, number, pos_weight, width, blocks.partitions)
            fronts = {m: opened_next(boosters[m], trees[m], fronts[m], s, drawn_columns(boosters[m], number, width)) for m, s in sums.items()}
        for m, t in trees.items():
            if boosters[m].leaves:
                t.best_first(boosters[m].leaves)
            out[m].append(t)
        blocks = turn(advanced(blocks, trees, width, len(boosters)), number + 1)
    return out


def grown_by_rows(rows: DataFrame, columns: list[str], edges: list[np.ndarray], boosters: list[Booster], pos_weight: float) -> list[list[Tree]]:
    """All boosters from the same passes over blocks that are dealt to tasks. Margins are kept by the executors and written down after every CUT trees."""
    spark = rows.sparkSession
    held = [Held.of(written(packed(rows, columns, edges, len(boosters)), "boosting"))]
    tables = [held[0].table]

    def turn(blocks: Held, number: int) -> Held:
        if number % CUT == 0:
            tables.append(written(spark.createDataFrame(blocks.rdd, BLOCK), "boosting"))
            for b in (*held, blocks):
                b.rdd.unpersist()
            drop(spark, tables.pop(0).kept_at)
            held[:] = [Held.of(tables[0])]
            return held[0]
        held.append(blocks)  # the last blocks but one have been read, and these are made of the last
        if len(held) > 2:
            held.pop(0).rdd.unpersist()
        return blocks

    out = grown(held[0], boosters, pos_weight, len(columns), turn)
    for b in held:
        b.rdd.unpersist()
    drop(spark, tables[0].kept_at)
    return out


def grown_by_booster(rows: DataFrame, columns: list[str], edges: list[np.ndarray], boosters: list[Booster], pos_weight: float) -> list[list[Tree]]:
    """Each booster in a task of its own, which has all blocks: HELD_ROWS rows at most, 16 bytes and one a column each, and the margins of one booster."""
    spark, width = rows.sparkSession, len(columns)
    table = written(packed(rows, columns, edges, 1), "boosting")
    models = spark.createDataFrame([(m,) for m in range(len(boosters))], "model int")
    dealt = table.crossJoin(F.broadcast(models)).repartition(8 * len(boosters), "model")

    def grow(blocks: pa.Table) -> pa.Table:
        m = blocks.column("model")[0].as_py()
        whole = [pa.array([b"".join(blocks.column(c).to_pylist())], pa.binary()) for c in BLOCK_NAMES]
        trees = grown(Here([pa.RecordBatch.from_arrays(whole, names=BLOCK_NAMES)]), [boosters[m]], pos_weight, width)[0]
        return pa.table({"model": pa.array([m], pa.int32()), "trees": pa.array([pickle.dumps(trees)], pa.binary())})

    found = {r.model: pickle.loads(r.trees) for r in dealt.groupBy("model").applyInArrow(grow, "model int, trees binary").collect()}  # noqa: S301
    drop(spark, table.kept_at)
    return [found[m] if m in found else [Tree() for _ in range(b.trees)] for m, b in enumerate(boosters)]


def boost(rows: DataFrame, columns: list[str], boosters: list[Booster], bins: int = BINS) -> Boosted:
    """Boosters learned from rows (id, y, columns) on weighted logistic loss; columns without missing values.

    Columns are cut into `bins` parts. A tree takes one pass over the rows for each level and one to move the margins: tasks add up a
    histogram (node, column, bin), the driver gets their sums, of a size bounded by levels and bins, and picks the splits. A leaf-wise tree is chosen from its levels by the
    order of gains; a node that can't be among its leaves isn't opened. Which rows and columns a tree draws depends on (seed, tree, row or column) alone, so that the trees don't depend on how rows are
    dealt. Tables of more than HELD_ROWS rows are dealt to tasks, which serve all boosters in one pass; of smaller ones a pass is too little work for a job, so each booster is a task. No rows, or one class, give
    trees of one leaf.
    """
    edges = edges_of(rows, columns, bins)
    told = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("y").cast("double")), F.lit(0.0)).alias("p")).first()
    grow = grown_by_booster if told.n <= HELD_ROWS else grown_by_rows
    return Boosted(columns, edges, boosters, grow(rows, columns, edges, boosters, (told.n - told.p) / max(told.p, 1)))


def scored(rows: DataFrame, fit: Boosted, keep: list[str], wanted: list[tuple[int, int]]) -> DataFrame:
    """keep, model, trees and s (a probability) of each row under the first so many trees of each wanted (booster, number of trees)."""
    source = rows.select(*keep, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(fit.columns)])
    schema = source.select(*keep, F.lit(0).alias("model"), F.lit(0).alias("trees"), F.lit(0.0).alias("s")).schema
    width, edges = len(fit.columns), fit.edges
    tables = {m: [t.table() for t in fit.trees[m][: max(n for k, n in wanted if k == m)]] for m in sorted({m for m, _ in wanted})}

    def run(batches):
        for batch in batches:
            bins = binned(np.stack([batch.column(f"_x{i}").to_numpy(zero_copy_only=False) for i in range(width)], axis=1), edges)
            head = batch.select(keep)
            for m in tables:
                counts, margin, done = sorted(n for k, n in wanted if k == m), np.zeros(len(bins)), 0
                for n in counts:
                    for t in tables[m][done:n]:
                        margin += t.value.take(t.places(bins))
                    done = n
                    more = [pa.array(np.full(len(bins), m), pa.int32()), pa.array(np.full(len(bins), n), pa.int32()), pa.array(1 / (1 + np.exp(-margin)))]
                    yield pa.RecordBatch.from_arrays([*head.columns, *more], names=[*keep, "model", "trees", "s"])

    return source.mapInArrow(run, schema)


def grid(name: str, depths: tuple[int, ...], trees: int, seeds: tuple[int, ...], rates: tuple[float, ...] = (0.05, 0.1), leaves: int | None = None) -> list[Booster]:
    return [replace(Booster(name), depth=d, rate=r, trees=trees, seed=s, leaves=leaves) for d in depths for r in rates for s in seeds]


def best_of_grid(train: DataFrame, val: DataFrame, test: DataFrame, columns: list[str], boosters: list[Booster], counts: tuple[int, ...]) -> DataFrame:
    """For each name and seed the grid point (depth, rate, number of trees) of the highest validation AUC (the first of equals), and its scores of the test rows: name, seed, depth, rate,
    trees, val_auc, id, y, s. counts: the numbers of trees to try; fewer trees are the first of more."""
    fit = boost(train, columns, boosters)
    every = [(m, n) for m in range(len(boosters)) for n in counts if n <= boosters[m].trees]
    tested = scored(val, fit, ["y"], every)
    aucs = {(r.model, r.trees): r.auc for r in metrics.grouped(metrics.curve(tested, ["model", "trees"]), ["model", "trees"], metrics.auc_of().alias("auc")).collect()}
    best: dict = {}
    for m, n in every:
        key, auc = (boosters[m].name, boosters[m].seed), aucs.get((m, n), float("nan"))
        if key not in best or auc > best[key][0]:
            best[key] = (auc, m, n)
    told = train.sparkSession.createDataFrame([(m, n, boosters[m].name, boosters[m].seed, boosters[m].depth, boosters[m].rate, auc) for auc, m, n in best.values()], "model int, trees int, name string, seed int, depth int, rate double, val_auc double")
    found = scored(test, fit, ["id", "y"], [(m, n) for _, m, n in best.values()])
    return found.join(F.broadcast(told), ["model", "trees"]).select("name", "seed", "depth", "rate", "trees", "val_auc", "id", "y", "s")
