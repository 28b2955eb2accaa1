"""Exact ranking metrics from one cumulative table per cell.

scores: columns of `by` (the cells), id, y (0 or 1) and s (the score, higher is likelier). Rows with a null in y or s, or a NaN score, take
no part. All metrics come from curve(): distinct scores with their counts and running counts, so ties count half and no result depends on
the order of rows. Running counts are two-level: scores fall into buckets by split points, sums per bucket are carried
over, and only rows of one bucket are sorted in one task; a cell with all rows doesn't end in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 1024
F1_STEPS = 60


def usable(scores: DataFrame) -> DataFrame:
    # 0.0 is added so that both zeros are one score
    return scores.withColumn("s", F.nanvl(F.col("s").cast("double"), F.lit(None)) + F.lit(0.0)).where("y is not null and s is not null")


def split_points(df: DataFrame, column: str, buckets: int | None = None) -> list[float]:
    """Points that cut a column into about even parts, of BUCKET_ROWS rows unless `buckets` says how many, MOST_BUCKETS at most: a bounded summary, only
    used to deal out work."""
    grid = F.expr("array(" + ", ".join(f"{i / MOST_BUCKETS!r}D" for i in range(1, MOST_BUCKETS)) + ")")
    told = df.agg(F.percentile_approx(column, grid, F.lit(4 * MOST_BUCKETS)).alias("q"), F.count(column).alias("n")).first()
    n = min(MOST_BUCKETS, max(1, -(-told.n // BUCKET_ROWS) if buckets is None else buckets))
    return sorted({told.q[i * MOST_BUCKETS // n - 1] for i in range(1, n)}) if told.n else []


def place(points: list, kind: str, c: Column) -> Column:
    """How many of the sorted points are c or less. Many points are searched in two steps, of about the root of their number each."""
    array = lambda xs: F.array(*[F.lit(x) for x in xs]).cast(f"array<{kind}>")
    below = lambda xs: F.size(F.filter(xs, lambda p: p <= c))
    if len(points) <= 32:
        return below(array(points))
    step = math.isqrt(len(points))
    whole = below(array(points[step - 1 :: step])) * step
    return whole + below(F.slice(array(points), whole + 1, F.lit(step)))


def curve(scores: DataFrame, by: list[str], buckets: int | None = None) -> DataFrame:
    """Per cell and distinct score: pos, neg (rows with it), tp, fp (rows with it or a higher one), n_pos, n_neg (of the cell)."""
    rows = usable(scores)
    bucket = place(split_points(rows, "s", buckets), "double", F.col("s"))
    each = rows.groupBy(*by, "s").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg")).withColumn("bucket", bucket)
    per = each.groupBy(*by, "bucket").agg(F.sum("pos").alias("bp"), F.sum("neg").alias("bn"))
    cell = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    above = cell.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    carried = per.select(*by, "bucket", F.coalesce(F.sum("bp").over(above), F.lit(0)).alias("cp"), F.coalesce(F.sum("bn").over(above), F.lit(0)).alias("cn"), F.sum("bp").over(cell).alias("n_pos"), F.sum("bn").over(cell).alias("n_neg"))
    inside = Window.partitionBy(*by, "bucket").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    on = [*by, "bucket"]
    return each.withColumns({"ip": F.sum("pos").over(inside), "in": F.sum("neg").over(inside)}).join(carried, on).select(*by, "s", "pos", "neg", (F.col("ip") + F.col("cp")).alias("tp"), (F.col("in") + F.col("cn")).alias("fp"), "n_pos", "n_neg")


def midranks(scores: DataFrame, by: list[str], buckets: int | None = None) -> DataFrame:
    """scores with midrank: the average rank, from 1, of its score in its cell."""
    c = curve(scores, by, buckets).select(*by, "s", (F.col("n_pos") + F.col("n_neg") - F.col("tp") - F.col("fp") + (F.col("pos") + F.col("neg") + 1) / F.lit(2.0)).alias("midrank"))
    return usable(scores).join(c, [*by, "s"])


def two_classes(value: Column) -> Column:
    """NaN where a cell has one class only."""
    return F.when((F.max("n_pos") > 0) & (F.max("n_neg") > 0), value).otherwise(F.lit(float("nan")))


def auc_of() -> Column:
    # whole numbers up to the one division
    return two_classes(F.try_divide(F.sum((2 * F.col("tp") - F.col("pos")) * F.col("neg")).cast("double"), 2.0 * F.max("n_pos").cast("double") * F.max("n_neg")))


def ap_of() -> Column:
    """Sum of recall steps times precision over distinct thresholds, without interpolation."""
    return two_classes(F.sum(F.try_divide("pos", "n_pos") * F.col("tp") / (F.col("tp") + F.col("fp"))))


def recall_at_fpr_of(limit: float = 0.10) -> Column:
    return two_classes(F.coalesce(F.max(F.when(F.try_divide("fp", "n_neg") <= limit, F.try_divide("tp", "n_pos"))), F.lit(0.0)))


def f1_of() -> Column:
    precision, recall = F.col("tp") / (F.col("tp") + F.col("fp")), F.try_divide("tp", "n_pos")
    return two_classes(F.max(2 * precision * recall / (precision + recall + 1e-10)))


def grouped(c: DataFrame, by: list[str], *columns: Column) -> DataFrame:
    return c.groupBy(*by).agg(*columns) if by else c.agg(*columns)


def precision_at(scores: DataFrame, by: list[str], share: float = 0.05, rounded: bool = False, buckets: int | None = None, c: DataFrame | None = None) -> DataFrame:
    """Per cell k and p_at_k: the share of positives among the k best rows, k = max(1, floor(share n)), or with `rounded` the nearest whole number,
    halves to even. Of rows tied at the k-th place, those with smaller ids count; only they are ranked by id."""
    c = curve(scores, by, buckets) if c is None else c
    n = F.col("n_pos") + F.col("n_neg")
    k = F.greatest(F.lit(1), (F.bround(n * share, 0) if rounded else F.floor(F.round(n * share, 9))).cast("long"))
    c = c.withColumn("k", k)
    before = c.withColumns({"n_above": F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg"), "tp_above": F.col("tp") - F.col("pos")})
    edge = before.where("n_above < k and tp + fp >= k").select(*by, "s", "k", "n_above", "tp_above")
    tied = usable(scores).join(edge, [*by, "s"])
    w = Window.partitionBy(*by, "s").orderBy("id")
    picked = tied.withColumn("r", F.row_number().over(w)).where("r <= k - n_above")
    return grouped(picked, by, F.first("k").alias("k"), ((F.first("tp_above") + F.sum(F.col("y").cast("long"))) / F.first("k")).alias("p_at_k"))


def ranking_metrics(scores: DataFrame, by: list[str], buckets: int | None = None) -> DataFrame:
    """Per cell: n, n_pos, auc, ap, p_at_k, recall_at_fpr and f1_best. NaN for what needs both classes in a cell with one."""
    c = curve(scores, by, buckets)
    main = grouped(c, by, F.max(F.col("n_pos") + F.col("n_neg")).alias("n"), F.max("n_pos").alias("n_pos"), auc_of().alias("auc"), ap_of().alias("ap"), recall_at_fpr_of().alias("recall_at_fpr"), f1_of().alias("f1_best"))
    top = precision_at(scores, by, buckets=buckets, c=c)
    return main.join(top, by) if by else main.crossJoin(top)


def quantiles(scores: DataFrame, probabilities: list[float], buckets: int | None = None) -> list[float]:
    """Exact quantiles of s with linear interpolation: only the rows that hold one of the wanted ranks reach the driver."""
    c = curve(scores, [], buckets).select("s", (F.col("n_pos") + F.col("n_neg")).alias("n"), (F.col("n_pos") + F.col("n_neg") - F.col("tp") - F.col("fp")).alias("below"), (F.col("pos") + F.col("neg")).alias("here"))
    n = c.agg(F.max("n")).first()[0] or 0
    if not n:
        return []
    at = [(n - 1) * p for p in probabilities]
    wanted = sorted({f(x) for x in at for f in (math.floor, math.ceil)})
    holds = F.exists(F.array(*[F.lit(int(r)) for r in wanted]), lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("here")))
    rows = sorted((r.below, r.below + r.here, r.s) for r in c.where(holds).collect())
    value = lambda rank: next(s for a, b, s in rows if a <= rank < b)
    return [value(math.floor(x)) + (x - math.floor(x)) * (value(math.ceil(x)) - value(math.floor(x))) for x in at]


def f1_val_best(val: DataFrame, test: DataFrame, steps: int = F1_STEPS, low: float = 0.5, high: float = 0.999) -> DataFrame:
    """One row: the threshold with the best F1 on val among `steps` quantiles of its scores (the smallest of equals), and the F1 on test with
    it. NaN where val has one class only, 0.5 as the threshold if no candidate is above -1."""
    spark = val.sparkSession
    points = sorted(set(quantiles(val, [low + (high - low) * i / (steps - 1) for i in range(steps)])))

    def counted(df: DataFrame, ts: list[float]):
        sums = [F.sum(F.when(F.col("s") >= t, F.col("y").cast("long")).otherwise(0)).alias(f"tp{i}") for i, t in enumerate(ts)] + [F.count_if(F.col("s") >= t).alias(f"n{i}") for i, t in enumerate(ts)]
        return usable(df).agg(F.sum(F.col("y").cast("long")).alias("p"), F.count("*").alias("n"), *sums).first()

    def f1(tp: int, n: int, p: int) -> float:
        return 2.0 * tp / (n + p) if tp else 0.0

    v = counted(val, points)
    if not v.n or v.p in (None, 0, v.n):
        return spark.createDataFrame([(float("nan"), float("nan"), float("nan"))], "threshold double, f1_val double, f1_test double")
    best, threshold = -1.0, 0.5
    for i, t in enumerate(points):
        if (f := f1(v[f"tp{i}"], v[f"n{i}"], v.p)) > best:
            best, threshold = f, t
    t = counted(test, [threshold])
    return spark.createDataFrame([(threshold, best, f1(t.tp0 or 0, t.n0, t.p or 0))], "threshold double, f1_val double, f1_test double")


STEP = 0.5
SERIES_TO = 0.5


def two_sided_p(z: Column | str) -> Column:
    """erfc(|z| / sqrt 2), the two-sided p of a normal statistic, in columns; relative error under 1e-13 up to |z| = 37. Null gives null, NaN gives NaN, infinity 0.

    With x = |z| / sqrt 2: below SERIES_TO one minus the power series of erf. Above, erfc(x) = 2 x exp(-x^2) / pi times the integral of exp(-t^2) / (x^2 + t^2) over
    t > 0, by the trapezoidal rule with steps h, whose error is exp(-(pi / h)^2) once the residue 2 / (1 - exp(2 pi x / h)) of the pole at t = i x is taken into account
    (for x < pi / h). exp(-x^2) is split at a sixteenth below x, whose square is exact, so that no digits go with large x.
    """
    a = F.abs(F.col(z) if isinstance(z, str) else z).cast("double")
    x = a / math.sqrt(2)
    xx = x * x
    series = F.lit(0.0)
    for k in range(14, 0, -1):
        series = (series + 1.0) * (xx * (2.0 / (2 * k + 1)))
    small = 1.0 - (series + 1.0) * x * F.exp(-xx) * (2 / math.sqrt(math.pi))
    high = F.floor(x * 16.0) / 16.0
    tail = F.exp(-high * high) * F.exp(-(x - high) * (x + high))
    total = F.lit(0.0)
    for n in range(13, 0, -1):
        total = total + F.lit(2 * math.exp(-((n * STEP) ** 2))) / (xx + (n * STEP) ** 2)
    pole = F.when(x < math.pi / STEP, 2.0 / (1.0 - F.exp(x * (2 * math.pi / STEP)))).otherwise(0.0)
    large = tail * x * (total + 1.0 / xx) * (STEP / math.pi) + pole
    return F.when(F.isnan(a), a).when(x < SERIES_TO, small).when(a > 40.0, 0.0).otherwise(large)


def delong(pairs: DataFrame, by: list[str], buckets: int | None = None, with_p: bool = True) -> DataFrame:
    """DeLong's paired test per cell. pairs: by, id, y, s_a, s_b. Columns auc_a, auc_b, delta (b - a), z (of a - b) and p.

    A variance of 0 or below gives z 0 and p 1; a cell with one class zeros and p 1. Rows lacking one of the scores take no part.
    """
    rows = pairs.where("y is not null")
    for c in ("s_a", "s_b"):
        rows = rows.withColumn(c, F.nanvl(F.col(c).cast("double"), F.lit(None)) + F.lit(0.0)).where(F.col(c).isNotNull())
    for m in ("a", "b"):
        c = curve(rows.select(*by, "y", F.col(f"s_{m}").alias("s")), by, buckets)
        below_neg, below_pos = F.col("n_neg") - F.col("fp"), F.col("tp") - F.col("pos")
        c = c.select(*by, F.col("s").alias(f"s_{m}"), F.try_divide(below_neg + F.col("neg") / F.lit(2.0), F.col("n_neg")).alias(f"v_{m}"), F.try_divide(below_pos + F.col("pos") / F.lit(2.0), F.col("n_pos")).alias(f"w_{m}"), *(["n_pos", "n_neg"] if m == "a" else []))
        rows = rows.join(c, [*by, f"s_{m}"])
    pos, neg = F.col("y") == 1, F.col("y") == 0
    when = lambda cond, c: F.when(cond, F.col(c))
    told = grouped(
        rows, by, F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), F.avg(when(pos, "v_a")).alias("auc_a"), F.avg(when(pos, "v_b")).alias("auc_b"),
        *[f(when(k, f"{x}_a")).alias(f"{x}a") for x, k in (("v", pos), ("w", neg)) for f in (F.var_samp,)], *[F.var_samp(when(k, f"{x}_b")).alias(f"{x}b") for x, k in (("v", pos), ("w", neg))],
        *[F.covar_samp(when(k, f"{x}_a"), when(k, f"{x}_b")).alias(f"{x}c") for x, k in (("v", pos), ("w", neg))],
    )
    variance = F.try_divide(F.col("va") + F.col("vb") - 2 * F.col("vc"), F.col("n_pos")) + F.try_divide(F.col("wa") + F.col("wb") - 2 * F.col("wc"), F.col("n_neg"))
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    told = told.withColumn("var", variance)
    zero = lambda c: F.when(both, c).otherwise(F.lit(0.0))
    z = F.when(both & (F.col("var") > 0), (F.col("auc_a") - F.col("auc_b")) / F.sqrt("var")).otherwise(F.lit(0.0))
    out = told.select(*by, zero(F.col("auc_a")).alias("auc_a"), zero(F.col("auc_b")).alias("auc_b"), zero(F.col("auc_b") - F.col("auc_a")).alias("delta"), z.alias("z"))
    return out.withColumn("p", F.when(F.col("z") == 0, F.lit(1.0)).otherwise(two_sided_p("z"))) if with_p else out


def pooled(seed_scores: DataFrame, by: list[str], seeds: int) -> DataFrame:
    """Scores averaged over seeds per row, for rows that all the seeds have: by, id, y, s. The mean is rounded to 10 places: in what order seeds are
    summed up must not tell equal means apart."""
    mean = seed_scores.groupBy(*by, "id").agg(F.first("y").alias("y"), F.round(F.avg("s"), 10).alias("s"), F.count_distinct("seed").alias("k"))
    return mean.where(F.col("k") == seeds).drop("k")
