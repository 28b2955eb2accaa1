"""Entity-year panels: keys, joins with an audit, splits, scalers and feature groups."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from gridlark.functions.expressions import filled, firm_of, number, zfill

# Prefixes of the feature groups, the columns each should have, and the named sets of groups.
GROUPS = {"feat": 17, "fin": 18, "fini": 69, "audit": 5, "pld": 6, "ctrl": 7, "rpt": 7}
BASE = ["feat", "fin", "fini"]
MODALITIES = {
    "M1": ["feat"], "M2": ["fin", "fini"], "M3": ["feat", "fin"], "M4": ["feat", "fini"], "M5": BASE, "M6": [*BASE, "audit"], "M7": [*BASE, "pld"], "M8": [*BASE, "ctrl"], "M9": [*BASE, "rpt"],
    "M10": [*BASE, "audit", "pld", "ctrl"], "M11": [*BASE, "audit", "pld", "ctrl", "rpt"], "M11_no_audit": [*BASE, "pld", "ctrl", "rpt"], "G6": [], "G7": ["fin", "fini"], "G8": BASE,
}
CONSTANT = "_dummy_const"


@dataclass
class Catalogue:
    """Named sets of column prefixes; register() adds one."""

    sets: dict[str, list[str]] = field(default_factory=lambda: dict(MODALITIES))

    def register(self, name: str, prefixes: list[str]) -> None:
        self.sets[name] = list(prefixes)

    def columns(self, df: DataFrame, name: str, in_order: bool = False) -> list[str]:
        """A set's columns in df, sorted (or as they stand). A set without prefixes is the constant column; one that matches nothing an error."""
        prefixes = self.sets[name]
        if not prefixes:
            return [CONSTANT]
        found = [c for c in df.columns if any(c.startswith(f"{p}_") for p in prefixes)]
        if not found:
            raise ValueError(f"no column for {name} {prefixes}")
        return found if in_order else sorted(found)

    def project(self, df: DataFrame, name: str, keys: list[str], in_order: bool = False) -> DataFrame:
        return df.select(*keys, *[F.lit(1.0).alias(c) if c == CONSTANT else F.col(c) for c in self.columns(df, name, in_order)])


CATALOGUE = Catalogue()


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """One row per key, the first in a total order: what dropDuplicates leaves to chance."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return keep_first(df, keys, [F.desc(c) for c in order])


def metadata(nodes: DataFrame) -> DataFrame:
    """(firm_id, year, node_id, ts_code) of node rows, one per firm and year."""
    rows = nodes.select(firm_of(F.col("ts_code")).alias("firm_id"), F.col("year").cast("int").alias("year"), "node_id", "ts_code")
    return keep_first(rows, ["firm_id", "year"], ["node_id"])


def matched(features: DataFrame, meta: DataFrame, keys: tuple[str, ...] = ("firm_id", "year")) -> DataFrame:
    """Every feature row with its metadata; null where there is none."""
    rows = features.withColumn("firm_id", zfill(F.col("firm_id"))) if "firm_id" in features.columns else features
    return rows.join(meta, list(keys), "left")


def audit(joined: DataFrame, column: str = "node_id") -> DataFrame:
    """One row: rows, those without a match, and their share."""
    missing = F.count_if(F.col(column).isNull())
    return joined.agg(F.count("*").alias("n_rows"), missing.alias("n_unmatched"), F.round(missing / F.greatest(F.count("*"), F.lit(1)), 4).alias("unmatched_rate"))


def contract(df: DataFrame, required: list[str], counts: dict[str, int] | None = None) -> list[str]:
    """Raises for missing columns; gives a warning for each feature group of another size than expected."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    sizes = {g: sum(c.startswith(f"{g}_") for c in df.columns) for g in counts or {}}
    return [f"{g}: {sizes[g]} columns, expected {n}" for g, n in (counts or {}).items() if sizes[g] != n]


def ordered(df: DataFrame, meta: list[str], labels: list[str], groups: list[str] | None = None) -> DataFrame:
    """Metadata, labels, then features, sorted within each group."""
    features = [c for g in groups or list(GROUPS) for c in sorted(c for c in df.columns if c.startswith(f"{g}_"))]
    return df.select(*meta, *labels, *features)


def typed(df: DataFrame, labels: list[str], features: list[str]) -> DataFrame:
    """year as short, labels as byte (what isn't 0 or 1 counts as 0), features as float (what isn't a number as null)."""
    casts = {c: F.when(number(F.col(c)).isin(0.0, 1.0), number(F.col(c))).otherwise(0.0).cast("byte") for c in labels} | {c: number(F.col(c), "float") for c in features}
    return df.withColumns({"year": F.col("year").cast("short")} | casts)


def split_of(year: Column, train: tuple[int, int], val: tuple[int, int], test: tuple[int, int]) -> Column:
    out = F.when(year.between(*train), "train")
    return out.when(year.between(*val), "val").when(year.between(*test), "test")


def split_stats(df: DataFrame, split: Column, labels: list[str]) -> DataFrame:
    """(split, label, n, positives, rate) of rows that are in a split."""
    rows = df.withColumn("split", split).where("split is not null").select("split", F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("long").alias("y")) for c in labels])).alias("l"))
    return rows.groupBy("split", F.col("l.label").alias("label")).agg(F.count("*").alias("n"), F.coalesce(F.sum("l.y"), F.lit(0)).alias("positives")).withColumn("rate", F.round(F.col("positives") / F.greatest("n", F.lit(1)), 4))


def scaler(train: DataFrame, columns: list[str], population: bool = True) -> DataFrame:
    """One row per column: mean and sd. Population: missing values count as 0, sd is the population's plus 1e-6. Otherwise
    missing values are left out, sd is the sample's, and 0 counts as 1."""
    rows = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])).alias("f")).select("f.*")
    if population:
        v = filled(F.col("v"))
        return rows.groupBy("feature").agg(F.avg(v).alias("mean"), (F.stddev_pop(v) + 1e-6).alias("sd"))
    v = F.nanvl("v", F.lit(None))
    sd = F.coalesce(F.stddev_samp(v), F.lit(0.0))
    return rows.groupBy("feature").agg(F.avg(v).alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("sd"))


def standardized(df: DataFrame, train: DataFrame, columns: list[str], population: bool = True) -> DataFrame:
    """df with its columns filled and scaled by the training rows. The scaler is one pair per column: a projection with literals, no join."""
    fit = {r.feature: (r.mean, r.sd) for r in scaler(train, columns, population).collect()}
    scale = lambda c: (filled(F.col(c)) - F.lit(fit[c][0] or 0.0)) / F.lit(fit[c][1]) if c in fit else F.lit(None).cast("double")
    return df.withColumns({c: scale(c) for c in columns})


def class_weight(train: DataFrame, label: str) -> DataFrame:
    pos = F.coalesce(F.sum(F.col(label).cast("long")), F.lit(0))
    return train.agg(pos.alias("pos"), (F.count(label) - pos).alias("neg"), ((F.count(label) - pos) / F.greatest(pos, F.lit(1))).alias("pos_weight"))


def lagged(df: DataFrame, keys: list[str], year: str, columns: list[str], back: int = 1) -> DataFrame:
    """df with `<column>_t<back>`: the column's value `back` years earlier, null where the panel has no row of exactly that year, whatever row came before.

    A self-join on (keys, year), not a window over a firm, so that a firm with very many rows isn't one task's. Of several rows of one firm and year the maximum of each
    column counts (NaN as null), found before the join; rows with a null key or year get nulls. Rows and their number stay as they are.
    """
    now = df.select(*keys, (F.col(year).cast("int") + back).alias("_year"), *[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"{c}_t{back}") for c in columns])
    before = now.dropna(subset=[*keys, "_year"]).groupBy(*keys, "_year").agg(*[F.max(f"{c}_t{back}").alias(f"{c}_t{back}") for c in columns])
    return df.withColumn("_year", F.col(year).cast("int")).join(before, [*keys, "_year"], "left").drop("_year").select(*df.columns, *[f"{c}_t{back}" for c in columns])


def group_standardized(df: DataFrame, groups: list[str], columns: list[str], suffix: str = "_zind") -> DataFrame:
    """df with `<column><suffix>`: the z-score within its group, such as an industry in a year, by the sample's deviation.

    Null and NaN take no part in the moments and stay null; a group with one value, or with equal ones, gives 0. A null in a group's key is a group of its own. Moments are partial
    aggregates, so a group of any size sends one row a task; they are joined back by an equi-join that AQE can split.
    """
    value = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    rows = df.withColumns({f"_v{i}": v for i, v in enumerate(value.values())})
    told = rows.groupBy(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)]).agg(*[f(f"_v{i}").alias(f"_{n}{i}") for i in range(len(columns)) for n, f in (("m", F.avg), ("d", F.stddev_samp))])
    on = F.lit(True)
    for i, g in enumerate(groups):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    z = lambda i: F.when(F.col(f"_v{i}").isNotNull(), F.when(F.col(f"_d{i}") > 0, (F.col(f"_v{i}") - F.col(f"_m{i}")) / F.col(f"_d{i}")).otherwise(F.lit(0.0)))
    return rows.join(told, on, "left").select(*df.columns, *[z(i).alias(f"{c}{suffix}") for i, c in enumerate(columns)])
