"""Aggregates over result rows: seeds, sweeps, differences and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def finite(c: str) -> Column:
    return F.nanvl(F.col(c).cast("double"), F.lit(None))


def seed_agg(results: DataFrame, by: list[str], value: str = "test_auc", sample: bool = True, digits: int = 4) -> DataFrame:
    """Mean, deviation (of the sample or the population) and number of a value over seeds; NaN is left out."""
    v = finite(value)
    sd = F.stddev_samp(v) if sample else F.stddev_pop(v)
    return results.groupBy(*by).agg(F.round(F.avg(v), digits).alias("mean"), F.round(sd, digits).alias("sd"), F.count(v).alias("n"))


def seed_agg_having(results: DataFrame, by: list[str], value: str = "test_auc", least: int = 3, digits: int = 4) -> DataFrame:
    return seed_agg(results, by, value, sample=False, digits=digits).where(F.col("n") >= least)


def sweep_pivot(sweep: DataFrame, configs: list[str], value: str = "test_auc") -> DataFrame:
    """model x `lr_hidden`; the names are given, so that no job has to find them."""
    return sweep.withColumn("config", F.concat_ws("_", F.col("lr").cast("string"), F.col("hidden_dim").cast("string"))).groupBy("model").pivot("config", configs).agg(F.first(value))


def best_config(sweep: DataFrame) -> DataFrame:
    """Per model its best row, the canonical row's value and the gain over it. Ties go to the smaller lr, then hidden_dim."""
    best = F.max_by(F.struct("lr", "hidden_dim", "test_auc"), F.struct("test_auc", -F.col("lr"), -F.col("hidden_dim")))
    canonical = F.max(F.when(F.col("canonical"), F.col("test_auc")))
    out = sweep.groupBy("model").agg(best.alias("b"), canonical.alias("canonical_auc"))
    return out.select("model", F.col("b.lr").alias("lr"), F.col("b.hidden_dim").alias("hidden_dim"), F.col("b.test_auc").alias("best_auc"), "canonical_auc", (F.col("b.test_auc") - F.col("canonical_auc")).alias("gain"))


def beats_baseline(sweep: DataFrame, baseline: str) -> DataFrame:
    """Per configuration and other model whether its value is above the baseline's with the same configuration."""
    base = sweep.where(F.col("model") == baseline).select("lr", "hidden_dim", F.col("test_auc").alias("base_auc"))
    return sweep.where(F.col("model") != baseline).join(base, ["lr", "hidden_dim"]).select("model", "lr", "hidden_dim", "test_auc", "base_auc", (F.col("test_auc") > F.col("base_auc")).alias("beats"))


def delta_vs_base(results: DataFrame, base: str, value: str = "mean") -> DataFrame:
    b = results.where(F.col("modal") == base).select("model", F.col(value).alias("base"))
    return results.where(F.col("modal") != base).join(b, "model").select("model", "modal", value, "base", (F.col(value) - F.col("base")).alias("delta"))


def gain_decomposition(results: DataFrame, low: str, middle: str, high: str, value: str = "mean") -> DataFrame:
    """Per model: high - middle and middle - low."""
    p = results.groupBy("model").pivot("modal", [low, middle, high]).agg(F.first(value))
    return p.select("model", (F.col(high) - F.col(middle)).alias("audit_gain"), (F.col(middle) - F.col(low)).alias("nonaudit_gain"))


def spread(results: DataFrame, by: list[str], value: str = "mean") -> DataFrame:
    """Largest minus smallest value; 0 for groups with fewer than two."""
    v = finite(value)
    return results.groupBy(*by).agg(F.count(v).alias("n"), F.when(F.count(v) >= 2, F.max(v) - F.min(v)).otherwise(F.lit(0.0)).alias("spread"))


def best_epoch(history: DataFrame, by: list[str]) -> DataFrame:
    """The first epoch of the highest validation value."""
    return history.groupBy(*by).agg(F.max_by("epoch", F.struct("val_auc", -F.col("epoch"))).alias("best_epoch"), F.max("val_auc").alias("val_auc"))


def compared(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Cells side by side for pairs (a, b) of modals of the same model."""
    a = cells.select("model", F.col("modal").alias("a"), F.col("test_auc").alias("auc_a"))
    b = cells.select("model", F.col("modal").alias("b"), F.col("test_auc").alias("auc_b"))
    return a.join(F.broadcast(pairs), "a").join(b, ["model", "b"]).select("model", "a", "b", "auc_a", "auc_b", (F.col("auc_b") - F.col("auc_a")).alias("delta"))


def presented(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Rows in a fixed order of a column's values, others after them by name."""
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return df.orderBy(F.when(place > 0, place).otherwise(len(order) + 1), column)


def top_rows(df: DataFrame, n: int, *order: Column | str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def ranked(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
