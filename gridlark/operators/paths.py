"""Ridge and lasso for a whole path of penalties from one pass over the rows.

One weighted table of moments (means, centred products) holds all that a linear fit needs. Tasks make it per partition, it is merged, and the driver, which holds p x p numbers and no
rows, solves every penalty: ridge by an eigen-decomposition, lasso by coordinate descent that starts from the last penalty's weights.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

DIRECT = 64
SWEEPS = 20_000
TOLERANCE = 1e-13


@dataclass
class Moments:
    """Weighted sums over rows: their number and weight, the means of (columns, y) and the products of what is centred on them."""

    rows: int
    weight: float
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        if not other.weight or not self.weight:
            return other if not self.weight else self
        w = self.weight + other.weight
        d = other.mean - self.mean
        products = self.products + other.products + np.outer(d, d) * (self.weight * other.weight / w)
        return Moments(self.rows + other.rows, w, self.mean + d * (other.weight / w), products)

    def bytes(self) -> bytes:
        return np.concatenate([[self.rows, self.weight], self.mean, self.products.ravel()]).astype("<f8").tobytes()


def unpacked(data: bytes, width: int) -> Moments:
    v = np.frombuffer(data, "<f8")
    return Moments(int(v[0]), float(v[1]), v[2 : 2 + width].copy(), v[2 + width :].reshape(width, width).copy())


def moments_of(x: np.ndarray, w: np.ndarray) -> Moments:
    total = float(w.sum())
    if not total:
        return Moments(0, 0.0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1])))
    mean = w @ x / total
    centred = x - mean
    return Moments(int((w > 0).sum()), total, mean, (centred * w[:, None]).T @ centred)


def moments(rows: DataFrame, columns: list[str], y: str, weight: Column | None = None) -> Moments:
    """The moments of columns and y. Rows with a null or NaN in y, or with a weight that isn't above 0, take no part; null and NaN in a column count as 0.

    One pass: a task keeps one table of moments whatever number of rows it reads. More than DIRECT partitions are merged by a shuffle of these tables first, so the
    driver gets DIRECT tables at most. Merging centred products loses no digits to large means.
    """
    width = len(columns) + 1
    w = F.lit(1.0) if weight is None else weight.cast("double")
    number = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None))
    source = rows.select(*[F.coalesce(number(c), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(columns)], number(y).alias(f"x{width - 1}"), w.alias("w")).where(f"x{width - 1} is not null and w > 0")

    def told(m: Moments):
        return pa.RecordBatch.from_arrays([pa.array([m.bytes()], pa.binary())], names=["m"])

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.stack([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(width)], axis=1)
                part = moments_of(x, batch.column("w").to_numpy(zero_copy_only=False))
                total = part if total is None else total + part
        if total is not None:
            yield told(total)

    def add(batches):
        total = None
        for batch in batches:
            for data in batch.column("m").to_pylist():
                total = unpacked(data, width) if total is None else total + unpacked(data, width)
        if total is not None:
            yield told(total)

    parts = source.mapInArrow(run, "m binary")
    if source.rdd.getNumPartitions() > DIRECT:
        parts = parts.withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(DIRECT))).repartition(DIRECT, "deal").drop("deal").mapInArrow(add, "m binary")
    total = Moments(0, 0.0, np.zeros(width), np.zeros((width, width)))
    for data in sorted(parts.toArrow().column("m").to_pylist()):
        total = total + unpacked(data, width)
    return total


@dataclass
class Point:
    """A fit of the path: weights and intercept in the units of the columns."""

    kind: str
    step: int
    penalty: float
    weights: np.ndarray
    intercept: float


def scaled(m: Moments) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Correlations of the columns among each other and covariances of scaled columns with y, and the columns' deviations. Constant columns are zeros with a deviation of 1."""
    sd = np.sqrt(np.diag(m.products)[:-1] / m.weight)
    still = sd <= 1e-12 * np.maximum(1.0, np.abs(m.mean[:-1]))
    sd = np.where(still, 1.0, sd)
    gram, target = m.products[:-1, :-1] / m.weight / np.outer(sd, sd), m.products[:-1, -1] / m.weight / sd
    gram[still, :], gram[:, still], target[still] = 0.0, 0.0, 0.0
    return gram, target, sd


def ladder(m: Moments, n: int = 20, ratio: float = 1e-3) -> list[float]:
    """Penalties evenly spaced in their logarithm, from the smallest at which every lasso weight is 0 down to `ratio` of it."""
    top = float(np.abs(scaled(m)[1]).max(initial=0.0)) if m.weight else 0.0
    return [top * ratio ** (i / max(n - 1, 1)) for i in range(n)] if top else [0.0] * n


def descent(gram: np.ndarray, target: np.ndarray, penalty: float, b: np.ndarray) -> np.ndarray:
    """Coordinate descent to the minimum of b' gram b / 2 - target' b + penalty |b|, from b."""
    b = b.copy()
    slope = target - gram @ b
    for _ in range(SWEEPS):
        moved = 0.0
        for j in np.flatnonzero(np.diag(gram)):
            at = slope[j] + gram[j, j] * b[j]
            new = np.sign(at) * max(abs(at) - penalty, 0.0) / gram[j, j]
            if (d := new - b[j]) != 0.0:
                b[j] = new
                slope -= gram[:, j] * d
                moved = max(moved, abs(d))
        if moved <= TOLERANCE * max(1.0, np.abs(b).max(initial=0.0)):
            break
    return b


def path(m: Moments, kind: str, penalties: list[float]) -> list[Point]:
    """Fits of "ridge" or "lasso", one per penalty: the mean weighted squared error, halved, plus penalty * sum |b| (lasso) or penalty / 2 * sum b^2 (ridge), over columns scaled
    to a deviation of 1. The intercept is free. Constant columns get 0. Without rows every weight is 0. A ridge without penalty is the least-squares fit of least norm.
    """
    width = len(m.mean) - 1
    if not m.weight:
        return [Point(kind, i, p, np.zeros(width), 0.0) for i, p in enumerate(penalties)]
    gram, target, sd = scaled(m)
    out, b = [], np.zeros(width)
    if kind == "ridge":
        values, vectors = np.linalg.eigh(gram)
        along = vectors.T @ target
        floor = 1e-12 * max(values.max(initial=0.0), 1e-300)
    for i, p in enumerate(penalties):
        if kind == "ridge":
            b = vectors @ np.where(values + p > floor, along / np.where(values + p > floor, values + p, 1.0), 0.0)
        elif kind == "lasso":
            b = descent(gram, target, p, b)
        else:
            raise ValueError(f"unknown kind: {kind}")
        weights = b / sd + 0.0
        out.append(Point(kind, i, p, weights, float(m.mean[-1] - weights @ m.mean[:-1])))
    return out


def coefficients(spark, columns: list[str], points: list[Point]) -> DataFrame:
    """(kind, step, penalty, feature, weight) with the intercept as the feature `intercept`."""
    rows = [(p.kind, p.step, p.penalty, c, float(w)) for p in points for c, w in zip([*columns, "intercept"], [*p.weights, p.intercept], strict=True)]
    return spark.createDataFrame(rows, "kind string, step int, penalty double, feature string, weight double")


def scored(rows: DataFrame, columns: list[str], points: list[Point], keep: list[str]) -> DataFrame:
    """keep, kind, step and s for each row and fit: one pass for the whole path, sums in columns. Null and NaN count as 0."""
    x = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(0.0)) for c in columns]

    def line(p: Point) -> Column:
        s = F.lit(p.intercept)
        for c, w in zip(x, p.weights, strict=True):
            if w:
                s = s + c * float(w)
        return F.struct(F.lit(p.kind).alias("kind"), F.lit(p.step).alias("step"), s.alias("s"))

    return rows.select(*keep, F.explode(F.array(*[line(p) for p in points])).alias("_fit")).select(*keep, "_fit.*")
