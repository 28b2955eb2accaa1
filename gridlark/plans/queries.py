"""Registered queries: each applies one operator to the analogues."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlark.functions import expressions as ex, metrics
from gridlark.operators import attention, boosting, gated, graph, learners, networks, panel as ops, paths, reporting, training
from gridlark.plans import fixtures as fx
from gridlark.sources import scores as store
from gridlark.sources.steps import drop, shared_folder, written

QUERIES: dict = {}
D = 8
LAGGED = ["fin_total", "fini_avg_discount", "fini_max_qty"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def r(c, digits: int = D):
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def rounded(df: DataFrame, columns: list[str], digits: int = D) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


@query
def flagship(spark: SparkSession, d: str) -> DataFrame:
    """A linear score of the standardized panel, and its ranking metrics by split."""
    p = fx.panel(spark, d).where("split is not null")
    columns = ["feat_n_orders", "fini_avg_discount", "fini_max_qty", "pld_n_suppliers"]
    x = ops.standardized(p, p.where("split = 'train'"), columns)
    s = F.round(F.col("fini_max_qty") - 0.5 * F.col("pld_n_suppliers") + 0.25 * F.col("feat_n_orders") + 0.1 * F.col("fini_avg_discount"), 5)
    scores = x.select("split", F.concat_ws("-", "firm_id", "year").alias("id"), F.col("label").alias("y"), s.alias("s"))
    out = metrics.ranking_metrics(scores, ["split"])
    return rounded(out, ["auc", "ap", "p_at_k", "recall_at_fpr", "f1_best"], 4).drop("k")


@query
def panel_build(spark: SparkSession, d: str) -> DataFrame:
    out = ops.matched(fx.features(spark, d), ops.metadata(fx.metadata(spark, d))).where("node_id is not null")
    out = ops.ordered(out, ["firm_id", "ts_code", "node_id", "year"], ["label"])
    return rounded(rounded(out, ["fin_total", "fin_avg_price"], 6), ["fini_avg_discount", "feat_urgent_share", "audit_return_share"])


@query
def panel_unmatched_audit(spark: SparkSession, d: str) -> DataFrame:
    return ops.audit(ops.matched(fx.features(spark, d), ops.metadata(fx.metadata(spark, d))))


@query
def panel_unmatched_rows(spark: SparkSession, d: str) -> DataFrame:
    f, m = fx.features(spark, d), ops.metadata(fx.metadata(spark, d))
    return f.join(m, ["firm_id", "year"], "left_anti").select("firm_id", "year", "label")


@query
def coerce_fill(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.read(spark, d, "events", "event_id", F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 7 == 1, "NaN").otherwise(F.col("value").cast("string")).alias("raw"), F.col("event_type").alias("kind"))
    return rows.select("event_id", r(ex.filled(ex.number(F.col("raw"))), 6).alias("value"), ex.number(F.col("raw")).isNull().alias("missing"))


@query
def typed_panel(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.features(spark, d).select("firm_id", "year", F.when(F.col("label") == 1, "1").when(F.col("year") == 1999, "x").otherwise("0").alias("label"), F.col("feat_n_orders").cast("string").alias("feat_n_orders"))
    t = ops.typed(rows, ["label"], ["feat_n_orders"])
    return t.select("firm_id", F.col("year").cast("int").alias("year"), F.col("label").cast("int").alias("label"), F.col("feat_n_orders").cast("double").alias("feat_n_orders"))


@query
def split_stats(spark: SparkSession, d: str) -> DataFrame:
    p = fx.features(spark, d).withColumn("label_loose", F.when(F.coalesce("audit_return_share", F.lit(0.0)) > 0.25, 1).otherwise(0))
    return ops.split_stats(p, ops.split_of(F.col("year"), fx.TRAIN, fx.VAL, fx.TEST), ["label", "label_loose"])


@query
def yearly_valid_pos(spark: SparkSession, d: str) -> DataFrame:
    return fx.features(spark, d).groupBy("year").agg(F.count("*").alias("n_valid"), F.sum(F.col("label").cast("long")).alias("n_pos"), r(F.avg("label"), 4).alias("rate"))


def train_rows(spark: SparkSession, d: str) -> DataFrame:
    return fx.panel(spark, d).where("split = 'train'")


@query
def scaler_train_pop(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ops.scaler(train_rows(spark, d), fx.FEATURES), ["mean", "sd"], 4)


@query
def scaler_train_samp(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ops.scaler(train_rows(spark, d), fx.FEATURES, population=False), ["mean", "sd"], 4)


@query
def standardized_panel(spark: SparkSession, d: str) -> DataFrame:
    p = fx.panel(spark, d)
    x = ops.standardized(p, p.where("split = 'train'"), fx.FEATURES)
    return rounded(x.select("firm_id", "year", *fx.FEATURES), fx.FEATURES, 5)


@query
def class_weight(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ops.class_weight(train_rows(spark, d), "label"), ["pos_weight"])


@query
def modal_projection(spark: SparkSession, d: str) -> DataFrame:
    out = ops.CATALOGUE.project(fx.features(spark, d), "M7", ["firm_id", "year"])
    return rounded(rounded(out, ["fin_total", "fin_avg_price"], 6), ["fini_avg_discount", "feat_urgent_share"])


@query
def modal_constant(spark: SparkSession, d: str) -> DataFrame:
    return ops.CATALOGUE.project(fx.features(spark, d), "G6", ["firm_id", "year"])


@query
def exchange_suffix(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.read(spark, d, "orders", "o_orderkey", ex.zfill((F.col("o_orderkey") * 37 % 1_300_000).cast("string")).alias("firm_id"))
    return rows.select("o_orderkey", "firm_id", F.concat("firm_id", ex.exchange_suffix(F.col("firm_id"))).alias("ts_code"))


@query
def node_index_extend(spark: SparkSession, d: str) -> DataFrame:
    return graph.extended_index(fx.nodes(spark, d), fx.party_edges(spark, d))


@query
def edge_encode(spark: SparkSession, d: str) -> DataFrame:
    e = written(fx.party_edges(spark, d), "trades")
    return graph.encoded(e, graph.extended_index(fx.nodes(spark, d), e), parts=fx.line_parts(spark, d))


@query
def edge_semi(spark: SparkSession, d: str) -> DataFrame:
    known = fx.nodes(spark, d).select(F.col("node_id").alias("src_node_id")).hint("merge")
    rows = fx.party_trades(spark, d).groupBy("custkey", "edge_type", "year").agg(F.count("*").alias("n"))
    rows = graph.spread(rows.select(fx.party_source().alias("src_node_id"), "edge_type", "year", "n"), fx.line_parts(spark, d), "src_node_id")
    return rows.join(known, "src_node_id", "left_semi").groupBy("edge_type", "year").agg(F.sum("n").alias("n"))


@query
def edge_union_bidirect(spark: SparkSession, d: str) -> DataFrame:
    index, party = fx.nodes(spark, d), written(fx.party_edges(spark, d), "trades")
    new = graph.encoded(party, graph.extended_index(index, party), parts=fx.line_parts(spark, d))
    both = graph.both_ways(fx.edges(spark, d, index).unionByName(new))
    return both.groupBy("edge_type", "year").agg(F.count("*").alias("n"), F.sum(F.col("src_idx") * 3 + F.col("dst_idx")).cast("double").alias("checksum"))


@query
def edge_type_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.type_counts(fx.named_edges(spark, d))


@query
def edge_type_code(spark: SparkSession, d: str) -> DataFrame:
    return graph.type_codes(fx.named_edges(spark, d))


@query
def simple_undirected(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_undirected(fx.edges(spark, d), fx.line_parts(spark, d))


@query
def yearly_snapshot(spark: SparkSession, d: str) -> DataFrame:
    index = fx.nodes(spark, d)
    valid, m = graph.snapshot(fx.panel(spark, d), index, fx.edges(spark, d, index))
    n = valid.groupBy("year").agg(F.count("*").alias("n_valid"), F.sum(F.col("label").cast("long")).alias("n_pos"), F.sum("node_idx").cast("double").alias("idx_sum"))
    k = m.groupBy("year").agg(F.count("*").alias("n_messages"), F.sum(F.col("rel").cast("long")).alias("rel_sum"))
    return n.join(k, "year")


@query
def loo_edge_type(spark: SparkSession, d: str) -> DataFrame:
    return graph.without_type(fx.named_edges(spark, d), "E2_LEGAL_REP").groupBy("edge_type", "year").agg(F.count("*").alias("n"))


def scored(spark: SparkSession, d: str, s: str) -> DataFrame:
    return fx.scores(spark, d).select("cell", "id", "y", F.col(s).alias("s"))


def models(spark: SparkSession, d: str) -> DataFrame:
    """The three scores as three models in long form."""
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("model"), F.col(s).alias("s")) for s in ("s_a", "s_b", "s_u")]))
    return fx.scores(spark, d).select("id", "y", each.alias("m")).select("m.model", "id", "y", "m.s")


@query
def midrank(spark: SparkSession, d: str) -> DataFrame:
    return metrics.midranks(models(spark, d), ["model"]).select("model", "id", "midrank")


@query
def auc(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.curve(models(spark, d), ["model"])
    return rounded(metrics.grouped(c, ["model"], metrics.auc_of().alias("auc")), ["auc"])


@query
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.curve(models(spark, d), ["model"])
    return rounded(metrics.grouped(c, ["model"], metrics.ap_of().alias("ap")), ["ap"])


@query
def precision_at_k(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.precision_at(models(spark, d), ["model"]), ["p_at_k"])


@query
def precision_at_k_round(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.precision_at(models(spark, d), ["model"], 0.0333, rounded=True), ["p_at_k"])


@query
def recall_at_fpr(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.curve(models(spark, d), ["model"])
    return rounded(metrics.grouped(c, ["model"], metrics.recall_at_fpr_of().alias("recall_at_fpr")), ["recall_at_fpr"])


@query
def f1_best(spark: SparkSession, d: str) -> DataFrame:
    c = metrics.curve(models(spark, d), ["model"])
    return rounded(metrics.grouped(c, ["model"], metrics.f1_of().alias("f1")), ["f1"])


@query
def f1_val_best(spark: SparkSession, d: str) -> DataFrame:
    s = fx.scores(spark, d).select("id", "y", F.col("s_b").alias("s"), "year")
    return rounded(metrics.f1_val_best(s.where("year = 1999"), s.where("year >= 2000")), ["threshold", "f1_val", "f1_test"])


@query
def metrics_by_cell(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.ranking_metrics(scored(spark, d, "s_b"), ["cell"])
    return rounded(out, ["auc", "ap", "p_at_k", "recall_at_fpr", "f1_best"])


@query
def delong_paired(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.delong(fx.scores(spark, d).select("cell", "id", "y", "s_a", "s_b"), ["cell"], with_p=False)
    return rounded(out, ["auc_a", "auc_b", "delta", "z"])


def pooled_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Scores pooled over seeds beside those of another model, written down: DeLong's test ranks them several times."""
    rows = written(fx.scores(spark, d), "scores")
    pooled = metrics.pooled(fx.seed_scores(spark, d, rows), ["cell"], len(fx.SEEDS)).withColumnRenamed("s", "s_a")
    return written(pooled.join(rows.select("cell", "id", F.col("s_u").alias("s_b")).hint("merge"), ["cell", "id"]), "pairs")


@query
def delong_pooled(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.delong(pooled_pairs(spark, d), ["cell"], with_p=False)
    return rounded(out, ["auc_a", "auc_b", "delta", "z"])


@query
def delong_paired_p(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.delong(fx.scores(spark, d).select("cell", "id", "y", "s_a", "s_b"), ["cell"])
    return rounded(out, ["auc_a", "auc_b", "delta", "z", "p"])


@query
def delong_pooled_p(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.delong(pooled_pairs(spark, d), ["cell"])
    return rounded(out, ["auc_a", "auc_b", "delta", "z", "p"]).withColumn("stars", ex.stars(F.col("p")))


@query
def delong_pooled_stored(spark: SparkSession, d: str) -> DataFrame:
    """delong_pooled_p from a score store: each priority and seed is a set of it, and so is the model that they are compared with."""
    path = f"{shared_folder(spark)}/gridlark-scores-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    row = lambda model, seed, s: [F.lit(model).alias("model"), F.col("cell").alias("modal"), F.lit("y").alias("label"), seed.alias("seed"), F.col("id").cast("string").alias("id"), "y", F.col(s).alias("s")]
    store.save(fx.seed_scores(spark, d).select(*row("a", F.col("seed"), "s")), path)
    store.save(fx.scores(spark, d).select(*row("u", F.lit(0), "s_u")), path)
    of = lambda model: store.load(spark, path, model=model).select(F.col("modal").alias("cell"), "seed", F.col("id").cast("long").alias("id"), "y", "s")
    pooled = metrics.pooled(of("a"), ["cell"], len(fx.SEEDS)).withColumnRenamed("s", "s_a")
    pairs = written(pooled.join(of("u").select("cell", "id", F.col("s").alias("s_b")), ["cell", "id"]), "pairs")
    out = metrics.delong(pairs, ["cell"])
    return rounded(out, ["auc_a", "auc_b", "delta", "z", "p"]).withColumn("stars", ex.stars(F.col("p")))


@query
def lagged_panel(spark: SparkSession, d: str) -> DataFrame:
    """Each firm's features of exactly the year before; firms without orders in a year leave gaps."""
    out = ops.lagged(fx.features(spark, d).select("firm_id", "year", *LAGGED), ["firm_id"], "year", LAGGED)
    return rounded(rounded(out, [c for c in out.columns if c.startswith("fin_")], 6), ["fini_avg_discount", "fini_avg_discount_t1"])


@query
def industry_zscores(spark: SparkSession, d: str) -> DataFrame:
    """Features standardised within each nation (the industry) and year; small tables have nations with one firm in a year."""
    home = fx.read(spark, d, "customer", fx.firm("c_custkey").alias("firm_id"), F.col("c_nationkey").alias("industry"))
    rows = fx.features(spark, d).select("firm_id", "year", *LAGGED).join(home, "firm_id")
    out = ops.group_standardized(rows, ["industry", "year"], LAGGED)
    return rounded(out.select("firm_id", "year", "industry", *[f"{c}_zind" for c in LAGGED]), [f"{c}_zind" for c in LAGGED], 6)


@query
def gcn_agg(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.gcn(*fx.messages(spark, d)), ["v"])


@query
def sage_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.sage_mean(*fx.messages(spark, d)), ["root", "v"])


@query
def rgcn_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.rgcn_mean(*fx.messages(spark, d), {0: 0.5, 1: -0.25, 2: 1.5}), ["v"])


@query
def pcgnn_gate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.gated(*fx.messages(spark, d)), ["v"])


@query
def gat_softmax(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.gat(*fx.messages(spark, d), [0.7, -0.3, 0.2], [0.1, 0.4, -0.6]), ["v"])


def by_year(df: DataFrame, *columns: str) -> DataFrame:
    """Results of messages_by_year keyed by year and node."""
    year = F.floor(F.col("node") / fx.YEAR_STEP)
    return rounded(df.select(year.cast("long").alias("year"), (F.col("node") % fx.YEAR_STEP).alias("node"), "k", *columns), list(columns))


def years(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int]:
    m, f = fx.messages_by_year(spark, d)
    return m, f, graph.parts_for(m)


@query
def gcn_years(spark: SparkSession, d: str) -> DataFrame:
    m, f, parts = years(spark, d)
    return by_year(graph.gcn(m, f, parts), "v")


@query
def sage_years(spark: SparkSession, d: str) -> DataFrame:
    m, f, parts = years(spark, d)
    return by_year(graph.sage_mean(m, f, parts), "root", "v")


@query
def rgcn_years(spark: SparkSession, d: str) -> DataFrame:
    m, f, parts = years(spark, d)
    return by_year(graph.rgcn_mean(m, f, {0: 0.5, 1: -0.25, 2: 1.5}, parts), "v")


@query
def gated_years(spark: SparkSession, d: str) -> DataFrame:
    m, f, parts = years(spark, d)
    return by_year(graph.gated(m, f, parts=parts), "v")


@query
def gat_years(spark: SparkSession, d: str) -> DataFrame:
    m, f, parts = years(spark, d)
    return by_year(graph.gat(m, f, [0.7, -0.3, 0.2], [0.1, 0.4, -0.6], parts=parts), "v")


@query
def label_propagation(spark: SparkSession, d: str) -> DataFrame:
    index = fx.nodes(spark, d)
    m = written(graph.both_ways(fx.edges(spark, d, index)).select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst")), "messages")
    last = ops.keep_last(train_rows(spark, d), ["ts_code"], ["year"])
    y = last.join(index.where("node_type = 'company'").select("ts_code", F.col("node_idx").alias("node")), "ts_code").select("node", F.col("label").alias("y"))
    return rounded(graph.label_propagation(m, y, parts=graph.parts_for(m)), ["h"])


def undirected(spark: SparkSession, d: str) -> DataFrame:
    return graph.simple_undirected(fx.edges(spark, d).where(F.col("year") == fx.GRAPH_YEAR))


@query
def walks_deterministic(spark: SparkSession, d: str) -> DataFrame:
    e = undirected(spark, d)
    g = e.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(e.select(F.col("v").alias("src"), F.col("u").alias("dst")))
    starts = g.select(F.col("src").alias("start")).distinct().withColumn("walk", F.lit(0))
    out = graph.walks(g, starts, 3, lambda start, walk, i, node, degree: (start * 31 + i * 17 + node) % degree)
    return out.select("start", F.concat_ws("-", F.transform("path", lambda x: x.cast("string"))).alias("path"))


@query
def node2vec_lr(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings of the graph of all years, and a balanced logistic regression on them: scores of the test rows."""
    vectors = learners.node2vec(graph.simple_undirected(fx.edges(spark, d)))
    index = fx.nodes(spark, d).select("ts_code", F.col("node_idx").alias("node"))
    rows = fx.panel(spark, d).where("split is not null").select("firm_id", "year", "ts_code", "label", "split").join(index, "ts_code").join(vectors, "node")
    rows = rows.select("firm_id", "year", "label", "split", *[F.col("x")[i].alias(f"x{i}") for i in range(64)])
    columns = [f"x{i}" for i in range(64)]
    model = learners.logistic(rows.where("split = 'train'"), columns, "label")
    return learners.scored(model, learners.assembled(rows.where("split = 'test'"), columns), ["firm_id", "year"], "label")


CELL_SEEDS = (42, 123, 456, 789, 1024)
COLUMNS = ["feat_n_orders", "fini_avg_discount", "fini_max_qty", "pld_n_suppliers", "rpt_n_parts"]


def learned(spark: SparkSession, d: str) -> DataFrame:
    p = fx.panel(spark, d).where("split is not null")
    return ops.standardized(p, p.where("split = 'train'"), COLUMNS, population=False).select("firm_id", "year", "split", "label", *COLUMNS)


@query
def logreg_balanced(spark: SparkSession, d: str) -> DataFrame:
    rows = learned(spark, d)
    model = learners.logistic(rows.where("split = 'train'"), COLUMNS, "label")
    return learners.scored(model, learners.assembled(rows.where("split = 'test'"), COLUMNS), ["firm_id", "year"], "label")


def moment_table(spark: SparkSession, d: str) -> tuple[DataFrame, paths.Moments]:
    """Panel rows in a split, and the moments of the training rows under balanced weights."""
    rows = fx.panel(spark, d).where("split is not null").select("firm_id", "year", "split", "label", *COLUMNS)
    return rows, paths.moments(learners.balanced(rows.where("split = 'train'"), "label"), COLUMNS, "label", F.col(learners.WEIGHT))


@query
def weighted_correlations(spark: SparkSession, d: str) -> DataFrame:
    """What the paths of penalties are solved from: correlations of all pairs of columns and the label under balanced weights."""
    _, m = moment_table(spark, d)
    names = [*COLUMNS, "label"]
    sd = [m.products[i, i] ** 0.5 or 1.0 for i in range(len(names))]
    told = [(a, b, float(m.mean[i]), float(m.products[i, j] / (sd[i] * sd[j]))) for i, a in enumerate(names) for j, b in enumerate(names)]
    return rounded(spark.createDataFrame(told, "a string, b string, mean_a double, r double"), ["mean_a", "r"], 6)


@query
def penalty_paths(spark: SparkSession, d: str) -> DataFrame:
    """Ridge and lasso at 20 penalties each, and the AUC of each fit on the validation and the test rows."""
    rows, m = moment_table(spark, d)
    fits = paths.path(m, "ridge", paths.ladder(m)) + paths.path(m, "lasso", paths.ladder(m))
    s = paths.scored(rows.where("split <> 'train'"), COLUMNS, fits, ["split", "label"]).withColumnRenamed("label", "y").withColumn("s", r("s", 12))
    s = written(s, "path")  # read for the split points and for the counts
    by = ["kind", "step", "split"]
    auc = metrics.grouped(metrics.curve(s, by), by, metrics.auc_of().alias("auc")).groupBy("kind", "step").pivot("split", ["val", "test"]).agg(F.first("auc"))
    weights = paths.coefficients(spark, COLUMNS, fits).groupBy("kind", "step", "penalty").pivot("feature", [*COLUMNS, "intercept"]).agg(F.first("weight"))
    return weights.join(auc.withColumnsRenamed({"val": "val_auc", "test": "test_auc"}), ["kind", "step"])


TREES = (400, 800)


def grid_cell(spark: SparkSession, d: str, boosters: list[boosting.Booster]) -> DataFrame:
    rows = learned(spark, d).select(F.concat_ws("-", "firm_id", "year").alias("id"), F.col("label").cast("int").alias("y"), "split", *COLUMNS)
    rows = written(rows, "grid")
    return boosting.best_of_grid(*[rows.where(F.col("split") == k) for k in ("train", "val", "test")], COLUMNS, boosters, TREES)


@query
def gbt_grid(spark: SparkSession, d: str) -> DataFrame:
    """Depth-wise trees: two depths by two rates by two numbers of trees for five seeds, grown together."""
    return grid_cell(spark, d, boosting.grid("depth", (4, 6), max(TREES), CELL_SEEDS))


@query
def leafwise_grid(spark: SparkSession, d: str) -> DataFrame:
    """Leaf-wise trees of 31 leaves at most, with 8 levels in place of no bound, or 6."""
    return grid_cell(spark, d, boosting.grid("leaf", (8, 6), max(TREES), CELL_SEEDS, leaves=31))


MODALS = {"M1": ("feat_n_orders", "feat_urgent_share"), "M4": ("feat_n_orders", "feat_urgent_share", "fini_avg_discount", "fini_max_qty")}


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return fx.panel(spark, d).where("split is not null").select(F.concat_ws("-", "firm_id", "year").alias("id"), F.col("label").alias("y"), "split", *MODALS["M4"])


@query
def mlp_cell(spark: SparkSession, d: str) -> DataFrame:
    """Five seeds of two modalities, all trained from one pass over the rows an epoch."""
    return training.run_networks(labelled(spark, d), list(MODALS["M4"]), [training.Cell("MLP", m, c, seed=s) for m, c in MODALS.items() for s in CELL_SEEDS])


@query
def mlp_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Two learning rates by two widths, in the same passes."""
    return training.run_networks(labelled(spark, d), list(MODALS["M4"]), training.sweep(training.Cell("MLP", "M4", MODALS["M4"])))


def network_cell(spark: SparkSession, d: str, net: networks.Network) -> DataFrame:
    """A network trained on the snapshots of all training years: scores of the test rows under the weights of the best epoch."""
    n, m = (written(x, name) for x, name in zip(fx.snapshots(spark, d, COLUMNS), ("snapshot", "messages"), strict=True))
    years = F.col("year").between(*fx.TRAIN)
    fit = networks.train(n.where(years), m.where(years), net, len(COLUMNS))
    years = F.col("year").between(*fx.VAL)
    epoch, _ = networks.best_epoch(networks.scored(n.where(years), m.where(years), net, len(COLUMNS), fit.kept))
    years = F.col("year").between(*fx.TEST)
    out = networks.scored(n.where(years), m.where(years), net, len(COLUMNS), {epoch: fit.kept[epoch]})
    return out.select(F.lit(net.kind).alias("model"), "year", "node", F.col("y").cast("int").alias("y"), (1 / (1 + F.exp(-F.col("s")))).alias("s"), F.col("epoch").alias("best_epoch"))


@query
def gcn_trained(spark: SparkSession, d: str) -> DataFrame:
    return network_cell(spark, d, networks.Network("GCN"))


@query
def sage_trained(spark: SparkSession, d: str) -> DataFrame:
    return network_cell(spark, d, networks.Network("SAGE"))


@query
def rgcn_trained(spark: SparkSession, d: str) -> DataFrame:
    return network_cell(spark, d, networks.Network("RGCN", relations=3))


@query
def gat_trained(spark: SparkSession, d: str) -> DataFrame:
    """The attention network, four heads and then one: scores of the test rows under the weights of the best epoch."""
    n, m = (written(x, name) for x, name in zip(fx.snapshots(spark, d, COLUMNS), ("snapshot", "messages"), strict=True))
    train, val, test = ((n.where(y), m.where(y)) for y in (F.col("year").between(*s) for s in (fx.TRAIN, fx.VAL, fx.TEST)))
    net = attention.Attention()
    fit = attention.train(*train, net, len(COLUMNS))
    epoch, _ = networks.best_epoch(attention.scored(*val, net, fit.kept))
    out = attention.scored(*test, net, {epoch: fit.kept[epoch]})
    return out.select(F.lit("GAT").alias("model"), "year", "node", F.col("y").cast("int").alias("y"), (1 / (1 + F.exp(-F.col("s")))).alias("s"), F.col("epoch").alias("best_epoch"))


@query
def gated_trained(spark: SparkSession, d: str) -> DataFrame:
    """The gated network with a look at the validation years every fifth epoch: scores of the test rows under the weights of the best look."""
    n, m = (written(x, name) for x, name in zip(fx.snapshots(spark, d, COLUMNS), ("snapshot", "messages"), strict=True))
    train, val, test = ((n.where(y), m.where(y)) for y in (F.col("year").between(*s) for s in (fx.TRAIN, fx.VAL, fx.TEST)))
    net = gated.Gated(lr=1e-2)
    fit = gated.train(*train, net, len(COLUMNS), val)
    out = gated.scored(gated.graphs(*test, net, len(COLUMNS)), net, fit.best)
    return out.select(F.lit("gated").alias("model"), "year", "node", F.col("y").cast("int").alias("y"), (1 / (1 + F.exp(-F.col("s")))).alias("s"), F.lit(fit.best_epoch).alias("best_epoch"))


@query
def seed_agg(spark: SparkSession, d: str) -> DataFrame:
    return reporting.seed_agg(fx.result_rows(spark, d), ["model", "modal"])


@query
def seed_agg_having3(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.result_rows(spark, d).withColumn("test_auc", F.when((F.col("modal") == "M5") & (F.col("seed") > 2), float("nan")).otherwise(F.col("test_auc")))
    return reporting.seed_agg_having(rows, ["model", "modal"])


@query
def sweep_pivot(spark: SparkSession, d: str) -> DataFrame:
    out = reporting.sweep_pivot(fx.sweep_rows(spark, d).withColumn("lr", F.when(F.col("lr") < 0.0007, "5e-4").otherwise("1e-3")), ["5e-4_64", "5e-4_128", "1e-3_64", "1e-3_128"])
    out = out.select("model", *[F.col(f"`{c}`").alias(c.replace("-", "").replace("_", "_h")) for c in out.columns if c != "model"])
    return rounded(out, [c for c in out.columns if c != "model"])


@query
def best_config(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reporting.best_config(fx.sweep_rows(spark, d)), ["best_auc", "canonical_auc", "gain"])


@query
def beats_baseline(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reporting.beats_baseline(fx.sweep_rows(spark, d), "1-URGENT"), ["test_auc", "base_auc"])


def means(spark: SparkSession, d: str) -> DataFrame:
    return fx.result_rows(spark, d).groupBy("model", "modal").agg(F.avg("test_auc").alias("mean"))


@query
def delta_vs_base(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reporting.delta_vs_base(means(spark, d), "M5"), ["mean", "base", "delta"])


@query
def gain_decomposition(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reporting.gain_decomposition(means(spark, d), "M5", "M11_no_audit", "M11"), ["audit_gain", "nonaudit_gain"])


@query
def label_range(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reporting.spread(means(spark, d), ["model"]), ["spread"])


@query
def seed_spread(spark: SparkSession, d: str) -> DataFrame:
    return rounded(reporting.spread(fx.result_rows(spark, d), ["model", "seed"], "test_auc"), ["spread"])


@query
def best_epoch(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.result_rows(spark, d).select("model", "modal", (F.col("seed") * 5).alias("epoch"), r("test_auc", 2).alias("val_auc"))
    return reporting.best_epoch(rows, ["model", "modal"])


@query
def compared_cells(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([("M5", "M11"), ("M11_no_audit", "M11")], "a string, b string")
    return rounded(reporting.compared(means(spark, d).withColumnRenamed("mean", "test_auc"), pairs), ["auc_a", "auc_b", "delta"])


@query
def auc_band_case(spark: SparkSession, d: str) -> DataFrame:
    rows = fx.result_rows(spark, d).withColumn("test_auc", r(F.col("test_auc") * 1.15, 6))
    return rows.select("model", "modal", "seed", "test_auc", ex.banded(F.col("test_auc")).alias("band"))


@query
def sig_stars(spark: SparkSession, d: str) -> DataFrame:
    p = F.pmod(F.col("o_orderkey") * 7, F.lit(1000)) / 10000.0
    return fx.read(spark, d, "orders", "o_orderkey", p.alias("p"), ex.stars(p).alias("stars"))
