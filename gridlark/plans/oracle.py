"""The registered queries in SQL, written on their own from the definitions."""

from __future__ import annotations

ORDERS = "o AS (SELECT o_custkey AS custkey, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, o_totalprice, o_orderpriority FROM orders)"
FEATURES = f"""{ORDERS},
po AS (SELECT custkey, year, count(*) AS feat_n_orders, avg(CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END) AS feat_urgent_share, sum(o_totalprice) AS fin_total, avg(o_totalprice) AS fin_avg_price FROM o GROUP BY custkey, year),
pl AS (SELECT custkey, year, avg(l_discount) AS fini_avg_discount, max(l_quantity) AS fini_max_qty, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS audit_return_share, count(DISTINCT l_suppkey) AS pld_n_suppliers, count(DISTINCT l_partkey) AS rpt_n_parts FROM lineitem JOIN o ON l_orderkey = o_orderkey GROUP BY custkey, year),
features AS (SELECT lpad(CAST(po.custkey AS VARCHAR), 6, '0') AS firm_id, po.year, feat_n_orders, feat_urgent_share, fin_total, fin_avg_price, fini_avg_discount, fini_max_qty, audit_return_share, pld_n_suppliers, rpt_n_parts, c_acctbal AS ctrl_acctbal, CASE WHEN coalesce(audit_return_share, 0) > 0.4 THEN 1 ELSE 0 END AS label
  FROM po LEFT JOIN pl USING (custkey, year) JOIN customer ON c_custkey = po.custkey)"""


def suffix(c: str) -> str:
    return f"CASE substr({c}, 1, 1) WHEN '6' THEN '.SH' WHEN '4' THEN '.BJ' WHEN '8' THEN '.BJ' ELSE '.SZ' END"


def code(key: str) -> str:
    f = f"lpad(CAST({key} AS VARCHAR), 6, '0')"
    return f"({f} || {suffix(f)})"


META = f"""meta AS (SELECT lpad(split_part(ts_code, '.', 1), 6, '0') AS firm_id, year, min(node_id) AS node_id, min(ts_code) AS ts_code
  FROM (SELECT DISTINCT {code("custkey")} AS ts_code, year, p || {code("custkey")} AS node_id FROM o JOIN customer ON c_custkey = custkey, (VALUES ('C:'), ('D:')) v(p) WHERE c_mktsegment <> 'MACHINERY') GROUP BY 1, 2)"""
SPLIT = "CASE WHEN year BETWEEN 1995 AND 1998 THEN 'train' WHEN year = 1999 THEN 'val' WHEN year BETWEEN 2000 AND 2001 THEN 'test' END"
NAMES = ["audit_return_share", "ctrl_acctbal", "feat_n_orders", "feat_urgent_share", "fin_avg_price", "fin_total", "fini_avg_discount", "fini_max_qty", "pld_n_suppliers", "rpt_n_parts"]
NODES = f"""nodes AS (SELECT row_number() OVER (ORDER BY node_id) - 1 AS node_idx, node_id, node_type, ts_code FROM (
  SELECT 'C:' || {code("c_custkey")} AS node_id, 'company' AS node_type, {code("c_custkey")} AS ts_code FROM customer
  UNION ALL SELECT 'I:' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0'), 'institution', NULL FROM supplier
  UNION ALL SELECT 'P:' || n_name, 'person', NULL FROM nation))"""
NAMED = f"""{ORDERS},
cs AS (SELECT DISTINCT custkey, l_suppkey, year FROM lineitem JOIN o ON l_orderkey = o_orderkey),
named AS (SELECT 'C:' || {code("custkey")} AS src, 'I:' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS dst, 'E1_HOLDS_BY' AS edge_type, year FROM cs
  UNION ALL SELECT 'C:' || {code("custkey")}, 'P:' || n_name, 'E2_LEGAL_REP', year FROM (SELECT DISTINCT custkey, year FROM o) x JOIN customer ON c_custkey = custkey JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'I:' || lpad(CAST(l_suppkey AS VARCHAR), 6, '0'), 'P:' || n_name, 'E3_MANAGER', year FROM (SELECT DISTINCT l_suppkey, year FROM cs) x JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey)"""
EDGES = f"{NODES}, {NAMED}, edges AS (SELECT a.node_idx AS src_idx, b.node_idx AS dst_idx, edge_type, CAST(year AS BIGINT) AS year FROM named JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst)"
PARTY = f"""party AS (SELECT DISTINCT CASE WHEN o_custkey % 50 = 0 THEN 'X:' || CAST(o_custkey AS VARCHAR) ELSE 'C:' || {code("o_custkey")} END AS src_node_id,
  CASE WHEN l_partkey % 2 = 0 THEN 'PID:' ELSE 'NM:' END || CAST(l_partkey AS VARCHAR) AS dst_node_id,
  CASE WHEN l_returnflag = 'R' THEN 'FUND' WHEN l_returnflag = 'A' THEN 'GUARANTEE' WHEN l_linestatus = 'O' THEN 'COMMERCIAL' ELSE 'OTHER' END AS edge_type, CAST(year(o_orderdate) AS BIGINT) AS year
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
EXTENDED = f"""{NODES}, {PARTY},
new AS (SELECT DISTINCT dst_node_id AS node_id FROM party WHERE dst_node_id NOT IN (SELECT node_id FROM nodes)),
extended AS (SELECT node_idx, node_id, node_type, ts_code FROM nodes UNION ALL
  SELECT (SELECT max(node_idx) FROM nodes) + row_number() OVER (ORDER BY node_id), node_id, CASE WHEN starts_with(node_id, 'PID:') THEN 'related_party' WHEN starts_with(node_id, 'NM:') THEN 'related_party_named' ELSE 'unknown' END, NULL FROM new),
encoded AS (SELECT a.node_idx AS src_idx, b.node_idx AS dst_idx, 'E7_TRADE_' || edge_type AS edge_type, year FROM party JOIN extended a ON a.node_id = src_node_id JOIN extended b ON b.node_id = dst_node_id)"""
MESSAGES = f"""{EDGES},
coded AS (SELECT src_idx, dst_idx, CASE edge_type WHEN 'E1_HOLDS_BY' THEN 0 WHEN 'E2_LEGAL_REP' THEN 1 WHEN 'E3_MANAGER' THEN 2 END AS rel, year FROM edges),
m AS (SELECT src_idx AS src, dst_idx AS dst, rel FROM coded WHERE year = 1998 UNION ALL SELECT dst_idx, src_idx, rel FROM coded WHERE year = 1998),
f AS (SELECT node_idx AS node, CAST(k AS INTEGER) AS k, ((node_idx * 7 + k * 13) % 101) / CAST(101 AS DOUBLE) AS v FROM nodes, range(3) t(k))"""
LOOPED = f"{MESSAGES}, ml AS (SELECT src, dst FROM m WHERE src <> dst UNION ALL SELECT node_idx, node_idx FROM nodes)"
MESSAGES_BY_YEAR = f"""{EDGES},
coded AS (SELECT src_idx + year * 1000000000 AS src, dst_idx + year * 1000000000 AS dst, CASE edge_type WHEN 'E1_HOLDS_BY' THEN 0 WHEN 'E2_LEGAL_REP' THEN 1 WHEN 'E3_MANAGER' THEN 2 END AS rel FROM edges),
m AS (SELECT src, dst, rel FROM coded UNION ALL SELECT dst, src, rel FROM coded), ny AS (SELECT node_idx + y * 1000000000 AS node, node_idx FROM nodes, range(1995, 2002) t(y)),
f AS (SELECT node, CAST(k AS INTEGER) AS k, ((node_idx * 7 + k * 13) % 101) / CAST(101 AS DOUBLE) AS v FROM ny, range(3) t(k)), ml AS (SELECT src, dst FROM m WHERE src <> dst UNION ALL SELECT node, node FROM ny)"""
SCORES = """li AS (SELECT l_orderkey AS id, CAST(count(*) AS DOUBLE) AS s_a, ((sum(CAST(round(l_discount * 100) AS BIGINT)) * 10) // count(*)) / CAST(1000 AS DOUBLE) AS s_b FROM lineitem GROUP BY 1),
sc AS (SELECT o_orderkey AS id, o_orderpriority AS cell, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, s_a, s_b, o_totalprice AS s_u, year(o_orderdate) AS year FROM orders JOIN li ON id = o_orderkey)"""
LONG = f"{SCORES}, x AS (SELECT 's_a' AS model, id, y, s_a AS s FROM sc UNION ALL SELECT 's_b', id, y, s_b FROM sc UNION ALL SELECT 's_u', id, y, s_u FROM sc)"


def curve(source: str, cell: str) -> str:
    """Running counts over distinct scores, from the highest."""
    return f"""g AS (SELECT {cell}, s, sum(y) AS pos, sum(1 - y) AS neg FROM {source} GROUP BY {cell}, s),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY {cell}) AS p, sum(neg) OVER (PARTITION BY {cell}) AS n FROM g WINDOW w AS (PARTITION BY {cell} ORDER BY s DESC))"""


AUC = "sum((2 * tp - pos) * neg) / (CAST(2 AS DOUBLE) * max(p) * max(n))"
AP = "sum(pos / p * (tp / (tp + fp)))"
RECALL = "coalesce(max(CASE WHEN fp / n <= 0.1 THEN tp / p END), 0)"
F1 = "max(2 * (tp / (tp + fp)) * (tp / p) / (tp / (tp + fp) + tp / p + 1e-10))"


def top(source: str, cell: str, k: str) -> str:
    return f"""t AS (SELECT {cell}, y, row_number() OVER (PARTITION BY {cell} ORDER BY s DESC, id) AS r, {k} AS k FROM (SELECT *, count(*) OVER (PARTITION BY {cell}) AS n FROM {source})),
pk AS (SELECT {cell}, CAST(max(k) AS BIGINT) AS k, sum(y) / CAST(max(k) AS DOUBLE) AS p_at_k FROM t WHERE r <= k GROUP BY {cell})"""


FLOOR_K = "greatest(1, CAST(floor(round(n * 0.05, 9)) AS BIGINT))"


def delong(source: str) -> str:
    """Structural components by counting windows: of each row, the other class below its score, ties half."""
    parts = []
    for m in ("a", "b"):
        parts.append(f"""r{m} AS (SELECT cell, id, y, rank() OVER (PARTITION BY cell ORDER BY s_{m}) + (count(*) OVER (PARTITION BY cell, s_{m}) - 1) / CAST(2 AS DOUBLE) AS r,
  rank() OVER (PARTITION BY cell, y ORDER BY s_{m}) + (count(*) OVER (PARTITION BY cell, y, s_{m}) - 1) / CAST(2 AS DOUBLE) AS rr,
  sum(y) OVER (PARTITION BY cell) AS p, sum(1 - y) OVER (PARTITION BY cell) AS n FROM {source}),
v{m} AS (SELECT cell, id, y, p, n, CASE WHEN y = 1 THEN (r - rr) / n END AS v, CASE WHEN y = 0 THEN 1 - (r - rr) / p END AS w FROM r{m})""")
    return ",\n".join(parts) + """,
j AS (SELECT va.cell, va.p, va.n, va.v AS v1, vb.v AS v2, va.w AS w1, vb.w AS w2 FROM va JOIN vb USING (cell, id)),
q AS (SELECT cell, avg(v1) AS auc_a, avg(v2) AS auc_b, (var_samp(v1) + var_samp(v2) - 2 * covar_samp(v1, v2)) / max(p) + (var_samp(w1) + var_samp(w2) - 2 * covar_samp(w1, w2)) / max(n) AS var FROM j GROUP BY cell)
SELECT cell, round(auc_a, 8) AS auc_a, round(auc_b, 8) AS auc_b, round(auc_b - auc_a, 8) AS delta, round(CASE WHEN var > 0 THEN (auc_a - auc_b) / sqrt(var) ELSE 0 END, 8) AS z FROM q"""


RESULTS = """res AS (SELECT o_orderpriority AS model, CASE o_orderstatus WHEN 'F' THEN 'M5' WHEN 'O' THEN 'M11' ELSE 'M11_no_audit' END AS modal, CAST(seed AS INTEGER) AS seed,
  sum((o_orderkey * 13 + seed * 5) % 97) / (count(*) * CAST(97 AS DOUBLE)) AS test_auc FROM orders, range(1, 6) t(seed) GROUP BY 1, 2, 3),
mean AS (SELECT model, modal, avg(test_auc) AS mean FROM res GROUP BY 1, 2)"""
SWEEP = """sw AS (SELECT o_orderpriority AS model, CASE WHEN o_orderkey % 4 < 2 THEN CAST(0.0005 AS DOUBLE) ELSE CAST(0.001 AS DOUBLE) END AS lr, CASE WHEN o_orderkey % 2 = 0 THEN 64 ELSE 128 END AS hidden_dim,
  sum((o_orderkey * 31) % 89) / (count(*) * CAST(89 AS DOUBLE)) AS test_auc FROM orders GROUP BY 1, 2, 3)"""
LONG_TRAIN = f"{FEATURES}, t AS (SELECT * FROM features WHERE year BETWEEN 1995 AND 1998), tl AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM t" for c in NAMES) + ")"
Z4 = "round((coalesce(CAST({c} AS DOUBLE), 0) - avg(coalesce(CAST({c} AS DOUBLE), 0)) FILTER (year BETWEEN 1995 AND 1998) OVER ()) / (stddev_pop(coalesce(CAST({c} AS DOUBLE), 0)) FILTER (year BETWEEN 1995 AND 1998) OVER () + 1e-6), {n})"
FLAG = "round(z2 - 0.5 * z3 + 0.25 * z0 + 0.1 * z1, 5)"
SHARES = {"fin_total": 6, "fin_avg_price": 6, "fini_avg_discount": 8, "feat_urgent_share": 8, "audit_return_share": 8}

SQL = {
    "flagship": f"""WITH {FEATURES},
z AS (SELECT {SPLIT} AS split, firm_id || '-' || year AS id, label AS y, {", ".join(Z4.format(c=c, n=15) + f" AS z{i}" for i, c in enumerate(["feat_n_orders", "fini_avg_discount", "fini_max_qty", "pld_n_suppliers"]))}, year FROM features),
x AS (SELECT split, id, y, {FLAG} AS s FROM z WHERE split IS NOT NULL), {curve("x", "split")}, {top("x", "split", FLOOR_K)}
SELECT split, CAST(max(p + n) AS BIGINT) AS n, CAST(max(p) AS BIGINT) AS n_pos, round({AUC}, 4) AS auc, round({AP}, 4) AS ap, round({RECALL}, 4) AS recall_at_fpr, round({F1}, 4) AS f1_best, round(max(p_at_k), 4) AS p_at_k FROM c JOIN pk USING (split) GROUP BY split""",
    "panel_build": f"WITH {FEATURES}, {META} SELECT firm_id, ts_code, node_id, year, label, " + ", ".join(f"round({c}, {SHARES[c]}) AS {c}" if c in SHARES else c for c in NAMES) + " FROM features JOIN meta USING (firm_id, year)",
    "panel_unmatched_audit": f"WITH {FEATURES}, {META} SELECT count(*) AS n_rows, count(*) FILTER (node_id IS NULL) AS n_unmatched, round(count(*) FILTER (node_id IS NULL) / greatest(count(*), 1), 4) AS unmatched_rate FROM features LEFT JOIN meta USING (firm_id, year)",
    "panel_unmatched_rows": f"WITH {FEATURES}, {META} SELECT firm_id, year, label FROM features WHERE NOT EXISTS (SELECT 1 FROM meta WHERE meta.firm_id = features.firm_id AND meta.year = features.year)",
    "coerce_fill": "SELECT event_id, CASE WHEN event_id % 7 IN (0, 1) THEN 0.0 ELSE round(coalesce(value, 0), 6) END AS value, (event_id % 7 IN (0, 1) OR value IS NULL) AS missing FROM events",
    "typed_panel": f"WITH {FEATURES} SELECT firm_id, year, CASE WHEN label = 1 THEN 1 ELSE 0 END AS label, CAST(feat_n_orders AS DOUBLE) AS feat_n_orders FROM features",
    "split_stats": f"""WITH {FEATURES}, s AS (SELECT {SPLIT} AS split, label AS a, CASE WHEN coalesce(audit_return_share, 0) > 0.25 THEN 1 ELSE 0 END AS b FROM features),
l AS (SELECT split, 'label' AS label, a AS y FROM s UNION ALL SELECT split, 'label_loose', b FROM s)
SELECT split, label, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(sum(y) / greatest(count(*), 1), 4) AS rate FROM l WHERE split IS NOT NULL GROUP BY split, label""",
    "yearly_valid_pos": f"WITH {FEATURES} SELECT year, count(*) AS n_valid, CAST(sum(label) AS BIGINT) AS n_pos, round(avg(label), 4) AS rate FROM features GROUP BY year",
    "scaler_train_pop": f"WITH {LONG_TRAIN} SELECT feature, round(avg(coalesce(v, 0)), 4) AS mean, round(stddev_pop(coalesce(v, 0)) + 1e-6, 4) AS sd FROM tl GROUP BY feature",
    "scaler_train_samp": f"WITH {LONG_TRAIN} SELECT feature, round(avg(v), 4) AS mean, round(CASE WHEN coalesce(stddev_samp(v), 0) = 0 THEN 1 ELSE stddev_samp(v) END, 4) AS sd FROM tl GROUP BY feature",
    "standardized_panel": f"WITH {FEATURES} SELECT firm_id, year, {', '.join(Z4.format(c=c, n=5) + f' AS {c}' for c in NAMES)} FROM features",
    "class_weight": f"WITH {FEATURES} SELECT CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg, round(sum(1 - label) / greatest(sum(label), 1), 8) AS pos_weight FROM features WHERE year BETWEEN 1995 AND 1998",
    "modal_projection": f"WITH {FEATURES} SELECT firm_id, year, feat_n_orders, round(feat_urgent_share, 8) AS feat_urgent_share, round(fin_avg_price, 6) AS fin_avg_price, round(fin_total, 6) AS fin_total, round(fini_avg_discount, 8) AS fini_avg_discount, fini_max_qty, pld_n_suppliers FROM features",
    "modal_constant": f"WITH {FEATURES} SELECT firm_id, year, CAST(1.0 AS DOUBLE) AS _dummy_const FROM features",
    "exchange_suffix": f"WITH k AS (SELECT o_orderkey, CAST(o_orderkey * 37 % 1300000 AS VARCHAR) AS f FROM orders), z AS (SELECT o_orderkey, CASE WHEN length(f) >= 6 THEN f ELSE lpad(f, 6, '0') END AS firm_id FROM k) SELECT o_orderkey, firm_id, firm_id || {suffix('firm_id')} AS ts_code FROM z",
    "node_index_extend": f"WITH {EXTENDED} SELECT node_idx, node_id, node_type, ts_code FROM extended",
    "edge_encode": f"WITH {EXTENDED} SELECT src_idx, dst_idx, edge_type, year FROM encoded",
    "edge_semi": f"WITH {NODES}, {PARTY} SELECT edge_type, year, count(*) AS n FROM party WHERE src_node_id IN (SELECT node_id FROM nodes) GROUP BY edge_type, year",
    "edge_union_bidirect": f"""WITH {EXTENDED}, {NAMED}, e AS (SELECT a.node_idx AS s, b.node_idx AS d, edge_type, CAST(year AS BIGINT) AS year FROM named JOIN nodes a ON a.node_id = src JOIN nodes b ON b.node_id = dst UNION ALL SELECT src_idx, dst_idx, edge_type, year FROM encoded),
b AS (SELECT s, d, edge_type, year FROM e UNION ALL SELECT d, s, edge_type, year FROM e) SELECT edge_type, year, count(*) AS n, CAST(sum(s * 3 + d) AS DOUBLE) AS checksum FROM b GROUP BY edge_type, year""",
    "edge_type_counts": f"WITH {NAMED} SELECT edge_type, count(*) AS n FROM named GROUP BY edge_type",
    "edge_type_code": f"WITH {NAMED} SELECT edge_type, CAST(row_number() OVER (ORDER BY edge_type) - 1 AS INTEGER) AS rel FROM (SELECT DISTINCT edge_type FROM named)",
    "simple_undirected": f"WITH {EDGES} SELECT DISTINCT least(src_idx, dst_idx) AS u, greatest(src_idx, dst_idx) AS v FROM edges WHERE src_idx <> dst_idx",
    "yearly_snapshot": f"""WITH {FEATURES}, {EDGES.replace(ORDERS + ',', '')},
v AS (SELECT features.year, label, node_idx FROM features JOIN nodes ON ts_code = firm_id || {suffix('firm_id')} WHERE node_type = 'company'),
vn AS (SELECT year, count(*) AS n_valid, CAST(sum(label) AS BIGINT) AS n_pos, CAST(sum(node_idx) AS DOUBLE) AS idx_sum FROM v GROUP BY year),
ms AS (SELECT year, 2 * count(*) AS n_messages, CAST(2 * sum(CASE edge_type WHEN 'E1_HOLDS_BY' THEN 0 WHEN 'E2_LEGAL_REP' THEN 1 ELSE 2 END) AS BIGINT) AS rel_sum FROM edges GROUP BY year)
SELECT year, n_valid, n_pos, idx_sum, n_messages, rel_sum FROM vn JOIN ms USING (year)""",
    "loo_edge_type": f"WITH {NAMED} SELECT edge_type, year, count(*) AS n FROM named WHERE edge_type <> 'E2_LEGAL_REP' GROUP BY edge_type, year",
    "midrank": f"WITH {LONG} SELECT model, id, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / CAST(2 AS DOUBLE) AS midrank FROM x",
    "auc": f"""WITH {LONG}, k AS (SELECT model, y, rank() OVER (PARTITION BY model ORDER BY s) + (count(*) OVER (PARTITION BY model, s) - 1) / CAST(2 AS DOUBLE) AS r FROM x)
SELECT model, round((sum(r) FILTER (y = 1) / sum(y) - (sum(y) + 1) / 2) / sum(1 - y), 8) AS auc FROM k GROUP BY model""",
    "average_precision": f"WITH {LONG}, {curve('x', 'model')} SELECT model, round({AP}, 8) AS ap FROM c GROUP BY model",
    "precision_at_k": f"WITH {LONG}, {top('x', 'model', FLOOR_K)} SELECT model, k, round(p_at_k, 8) AS p_at_k FROM pk",
    "precision_at_k_round": f"WITH {LONG}, {top('x', 'model', 'greatest(1, CAST(round_even(n * 0.0333, 0) AS BIGINT))')} SELECT model, k, round(p_at_k, 8) AS p_at_k FROM pk",
    "recall_at_fpr": f"WITH {LONG}, {curve('x', 'model')} SELECT model, round({RECALL}, 8) AS recall_at_fpr FROM c GROUP BY model",
    "f1_best": f"WITH {LONG}, {curve('x', 'model')} SELECT model, round({F1}, 8) AS f1 FROM c GROUP BY model",
    "f1_val_best": f"""WITH {SCORES}, val AS (SELECT y, s_b AS s FROM sc WHERE year = 1999), test AS (SELECT y, s_b AS s FROM sc WHERE year >= 2000),
ts AS (SELECT DISTINCT unnest(quantile_cont(s, [{", ".join(repr(0.5 + 0.499 * i / 59) for i in range(60))}])) AS t FROM val),
fv AS (SELECT t, 2.0 * sum(CASE WHEN s >= t THEN y ELSE 0 END) / (count(*) FILTER (s >= t) + sum(y)) AS f FROM val, ts GROUP BY t),
best AS (SELECT t, f FROM fv ORDER BY f DESC, t LIMIT 1)
SELECT round(any_value(t), 8) AS threshold, round(any_value(f), 8) AS f1_val, round(2.0 * sum(CASE WHEN s >= t THEN y ELSE 0 END) / (count(*) FILTER (s >= t) + sum(y)), 8) AS f1_test FROM test, best""",
    "metrics_by_cell": f"""WITH {SCORES}, x AS (SELECT cell, id, y, s_b AS s FROM sc), {curve('x', 'cell')}, {top('x', 'cell', FLOOR_K)}
SELECT cell, CAST(max(p + n) AS BIGINT) AS n, CAST(max(p) AS BIGINT) AS n_pos, round({AUC}, 8) AS auc, round({AP}, 8) AS ap, round({RECALL}, 8) AS recall_at_fpr, round({F1}, 8) AS f1_best, max(k) AS k, round(max(p_at_k), 8) AS p_at_k FROM c JOIN pk USING (cell) GROUP BY cell""",
    "delong_paired": f"WITH {SCORES}, {delong('sc')}",
    "delong_pooled": f"WITH {SCORES}, po AS (SELECT cell, id, y, round(sum(s_a + ((id * 7 + k) % 11) / CAST(10 AS DOUBLE)) / 5, 10) AS s_a, any_value(s_u) AS s_b FROM sc, range(1, 6) t(k) GROUP BY cell, id, y), {delong('po')}",
    "gcn_agg": f"""WITH {LOOPED}, dg AS (SELECT dst AS node, count(*) AS deg FROM ml GROUP BY dst)
SELECT ml.dst AS node, k, round(sum(v / sqrt(CAST(a.deg AS DOUBLE) * b.deg)), 8) AS v FROM ml JOIN dg a ON a.node = src JOIN dg b ON b.node = dst JOIN f ON f.node = src GROUP BY ml.dst, k""",
    "sage_mean": f"WITH {MESSAGES}, mm AS (SELECT dst AS node, k, avg(v) AS a FROM m JOIN f ON f.node = src GROUP BY 1, 2) SELECT node, k, round(v, 8) AS root, round(coalesce(a, 0), 8) AS v FROM f LEFT JOIN mm USING (node, k)",
    "rgcn_mean": f"""WITH {MESSAGES}, pr AS (SELECT dst AS node, k, rel, avg(v) AS a FROM m JOIN f ON f.node = src GROUP BY 1, 2, 3), tr AS (SELECT node, k, sum(a * CASE rel WHEN 0 THEN 0.5 WHEN 1 THEN -0.25 ELSE 1.5 END) AS s FROM pr GROUP BY 1, 2)
SELECT node, k, round(v + coalesce(s, 0), 8) AS v FROM f LEFT JOIN tr USING (node, k)""",
    "pcgnn_gate": f"""WITH {MESSAGES}, wide AS (SELECT node, max(v) FILTER (k = 0) AS a, max(v) FILTER (k = 1) AS b, max(v) FILTER (k = 2) AS c FROM f GROUP BY node),
gt AS (SELECT src, dst, 1 / (1 + exp(-10 * (x.a * y.a + x.b * y.b + x.c * y.c) / greatest(sqrt(x.a * x.a + x.b * x.b + x.c * x.c) * sqrt(y.a * y.a + y.b * y.b + y.c * y.c), 1e-8))) AS g FROM m JOIN wide x ON x.node = src JOIN wide y ON y.node = dst)
SELECT dst AS node, k, round(sum(g * v) / greatest(sum(g), 1e-6), 8) AS v FROM gt JOIN f ON f.node = src GROUP BY 1, 2""",
    "gat_softmax": f"""WITH {LOOPED}, wide AS (SELECT node, max(v) FILTER (k = 0) AS a, max(v) FILTER (k = 1) AS b, max(v) FILTER (k = 2) AS c FROM f GROUP BY node),
e0 AS (SELECT src, dst, 0.7 * x.a - 0.3 * x.b + 0.2 * x.c + 0.1 * y.a + 0.4 * y.b - 0.6 * y.c AS e FROM ml JOIN wide x ON x.node = src JOIN wide y ON y.node = dst),
e1 AS (SELECT src, dst, CASE WHEN e > 0 THEN e ELSE 0.2 * e END AS e FROM e0), w AS (SELECT src, dst, exp(e - max(e) OVER (PARTITION BY dst)) AS w FROM e1)
SELECT dst AS node, k, round(sum(w * v) / sum(w), 8) AS v FROM w JOIN f ON f.node = src GROUP BY 1, 2""",
    "label_propagation": f"""WITH {FEATURES}, {EDGES.replace(ORDERS + ',', '')},
m AS (SELECT src_idx AS src, dst_idx AS dst FROM edges UNION ALL SELECT dst_idx, src_idx FROM edges), dg AS (SELECT dst AS node, count(*) AS deg FROM m GROUP BY 1),
w AS (SELECT src, dst, count(*) / sqrt(CAST(max(a.deg) AS DOUBLE) * max(b.deg)) AS w FROM m JOIN dg a ON a.node = src JOIN dg b ON b.node = dst GROUP BY src, dst),
yl AS (SELECT node_idx AS node, arg_max(label, features.year) AS y FROM features JOIN nodes ON ts_code = firm_id || {suffix('firm_id')} WHERE features.year BETWEEN 1995 AND 1998 GROUP BY 1),
h0 AS (SELECT node, CAST(coalesce(y, 0) AS DOUBLE) AS y, CAST(coalesce(y, 0) AS DOUBLE) AS h FROM (SELECT node FROM dg UNION SELECT node FROM yl) LEFT JOIN yl USING (node)),
""" + ",\n".join(f"h{i + 1} AS (SELECT h0.node, h0.y, greatest(0, least(1, 0.9 * coalesce(c, 0) + (1 - 0.9) * h0.y)) AS h FROM h0 LEFT JOIN (SELECT dst AS node, sum(w * h) AS c FROM w JOIN h{i} ON h{i}.node = src GROUP BY 1) USING (node))" for i in range(3)) + "\nSELECT node, round(CAST(h AS DOUBLE), 8) AS h FROM h3",
    "walks_deterministic": f"""WITH {EDGES}, e AS (SELECT DISTINCT least(src_idx, dst_idx) AS u, greatest(src_idx, dst_idx) AS v FROM edges WHERE src_idx <> dst_idx AND year = 1998),
g AS (SELECT u AS src, v AS dst FROM e UNION ALL SELECT v, u FROM e), nb AS (SELECT src, list(dst ORDER BY dst) AS ns, count(*) AS deg FROM g GROUP BY src),
p0 AS (SELECT src AS start, src AS node, CAST(src AS VARCHAR) AS path FROM nb),
""" + ",\n".join(f"p{i + 1} AS (SELECT start, ns[(start * 31 + {i} * 17 + node) % deg + 1] AS node, path || '-' || ns[(start * 31 + {i} * 17 + node) % deg + 1] AS path FROM p{i} JOIN nb ON src = node)" for i in range(3)) + "\nSELECT start, path FROM p3",
    "seed_agg": f"WITH {RESULTS} SELECT model, modal, round(avg(test_auc), 4) AS mean, round(stddev_samp(test_auc), 4) AS sd, count(*) AS n FROM res GROUP BY model, modal",
    "seed_agg_having3": f"WITH {RESULTS} SELECT model, modal, round(avg(test_auc), 4) AS mean, round(stddev_pop(test_auc), 4) AS sd, count(*) AS n FROM res WHERE NOT (modal = 'M5' AND seed > 2) GROUP BY model, modal HAVING count(*) >= 3",
    "sweep_pivot": f"""WITH {SWEEP} SELECT model, round(max(test_auc) FILTER (lr < 0.0007 AND hidden_dim = 64), 8) AS "5e4_h64", round(max(test_auc) FILTER (lr < 0.0007 AND hidden_dim = 128), 8) AS "5e4_h128", round(max(test_auc) FILTER (lr > 0.0007 AND hidden_dim = 64), 8) AS "1e3_h64", round(max(test_auc) FILTER (lr > 0.0007 AND hidden_dim = 128), 8) AS "1e3_h128" FROM sw GROUP BY model""",
    "best_config": f"WITH {SWEEP}, k AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY test_auc DESC, lr, hidden_dim) AS r, max(test_auc) FILTER (lr < 0.0007 AND hidden_dim = 64) OVER (PARTITION BY model) AS ca FROM sw) SELECT model, lr, hidden_dim, round(test_auc, 8) AS best_auc, round(ca, 8) AS canonical_auc, round(test_auc - ca, 8) AS gain FROM k WHERE r = 1",
    "beats_baseline": f"WITH {SWEEP} SELECT a.model, a.lr, a.hidden_dim, round(a.test_auc, 8) AS test_auc, round(b.test_auc, 8) AS base_auc, a.test_auc > b.test_auc AS beats FROM sw a JOIN sw b ON a.lr = b.lr AND a.hidden_dim = b.hidden_dim WHERE a.model <> '1-URGENT' AND b.model = '1-URGENT'",
    "delta_vs_base": f"WITH {RESULTS} SELECT a.model, a.modal, round(a.mean, 8) AS mean, round(b.mean, 8) AS base, round(a.mean - b.mean, 8) AS delta FROM mean a JOIN mean b ON a.model = b.model WHERE a.modal <> 'M5' AND b.modal = 'M5'",
    "gain_decomposition": f"WITH {RESULTS}, p AS (SELECT model, max(mean) FILTER (modal = 'M5') AS a, max(mean) FILTER (modal = 'M11_no_audit') AS b, max(mean) FILTER (modal = 'M11') AS c FROM mean GROUP BY model) SELECT model, round(c - b, 8) AS audit_gain, round(b - a, 8) AS nonaudit_gain FROM p",
    "label_range": f"WITH {RESULTS} SELECT model, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN max(mean) - min(mean) ELSE 0 END, 8) AS spread FROM mean GROUP BY model",
    "seed_spread": f"WITH {RESULTS} SELECT model, seed, count(*) AS n, round(CASE WHEN count(*) >= 2 THEN max(test_auc) - min(test_auc) ELSE 0 END, 8) AS spread FROM res GROUP BY model, seed",
    "best_epoch": f"WITH {RESULTS}, h AS (SELECT model, modal, seed * 5 AS epoch, round(test_auc, 2) AS val_auc FROM res) SELECT model, modal, epoch AS best_epoch, val_auc FROM h QUALIFY row_number() OVER (PARTITION BY model, modal ORDER BY val_auc DESC, epoch) = 1",
    "compared_cells": f"WITH {RESULTS} SELECT x.model, x.modal AS a, y.modal AS b, round(x.mean, 8) AS auc_a, round(y.mean, 8) AS auc_b, round(y.mean - x.mean, 8) AS delta FROM mean x JOIN mean y ON x.model = y.model WHERE y.modal = 'M11' AND x.modal IN ('M5', 'M11_no_audit')",
    "auc_band_case": f"WITH {RESULTS}, s AS (SELECT model, modal, seed, round(test_auc * CAST(1.15 AS DOUBLE), 6) AS test_auc FROM res) SELECT model, modal, seed, test_auc, CASE WHEN test_auc < 0.55 THEN 'none' WHEN test_auc < 0.6 THEN 'weak' ELSE 'signal' END AS band FROM s",
    "sig_stars": "WITH s AS (SELECT o_orderkey, ((o_orderkey * 7) % 1000) / CAST(10000 AS DOUBLE) AS p FROM orders) SELECT o_orderkey, p, CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars FROM s",
}


def by_year(name: str, columns: str) -> str:
    """A kernel's SQL over the graph of all years, keyed by year and node."""
    body = SQL[name].removeprefix("WITH ")
    given = next(x for x in (LOOPED, MESSAGES) if body.startswith(x))
    rest = body.removeprefix(given).removeprefix(",").lstrip()
    made, select = rest.rsplit("\nSELECT ", 1) if "\nSELECT " in rest else rest.split(" SELECT node, k, round(v, 8)", 1)
    select = select if "\nSELECT " in rest else "node, k, round(v, 8)" + select
    return f"WITH {MESSAGES_BY_YEAR}, {made}, found AS (SELECT {select}) SELECT node // 1000000000 AS year, node % 1000000000 AS node, k, {columns} FROM found"


SQL |= {new: by_year(old, columns) for new, old, columns in (("gcn_years", "gcn_agg", "v"), ("sage_years", "sage_mean", "root, v"), ("rgcn_years", "rgcn_mean", "v"), ("gated_years", "pcgnn_gate", "v"), ("gat_years", "gat_softmax", "v"))}


def with_p(sql: str, stars: bool = False) -> str:
    """DeLong's rows with the two-sided p: the normal tail by Simpson's rule in 4,000 panels over |z| to |z| + 10, and 1 for a z of 0."""
    head, last = sql.rsplit("\nSELECT ", 1)
    z = "CASE WHEN var > 0 THEN (auc_a - auc_b) / sqrt(var) ELSE 0 END"
    tail = f"""{head},
zs AS (SELECT cell, {z} AS z FROM q),
pq AS (SELECT cell, CASE WHEN any_value(z) = 0 THEN 1 ELSE 2 / sqrt(2 * pi()) * sum((CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(abs(z) + i * CAST(0.0025 AS DOUBLE), 2) / 2)) * CAST(0.0025 AS DOUBLE) / 3 END AS p FROM zs, range(0, 4001) t(i) GROUP BY cell),
told AS (SELECT {last}),
out AS (SELECT told.*, round(p, 8) AS p FROM told JOIN pq USING (cell))
SELECT *"""
    marks = ", CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS stars"
    return f"{tail}{marks if stars else ''} FROM out"


def correlations() -> str:
    names = ["feat_n_orders", "fini_avg_discount", "fini_max_qty", "pld_n_suppliers", "rpt_n_parts", "label"]
    long = " UNION ALL ".join(f"SELECT firm_id, year, w, '{c}' AS c, CAST(coalesce({c}, 0) AS DOUBLE) AS v FROM t" for c in names)
    return f"""WITH {FEATURES}, n AS (SELECT sum(label) AS p, count(*) AS n FROM features WHERE year BETWEEN 1995 AND 1998),
t AS (SELECT features.*, CASE WHEN label = 1 THEN n / (CAST(2 AS DOUBLE) * p) ELSE n / (CAST(2 AS DOUBLE) * (n - p)) END AS w FROM features, n WHERE year BETWEEN 1995 AND 1998),
x AS ({long}), c AS (SELECT x.*, sum(w * v) OVER (PARTITION BY c) / sum(w) OVER (PARTITION BY c) AS mean FROM x)
SELECT a.c AS a, b.c AS b, round(any_value(a.mean), 6) AS mean_a, round(sum(a.w * (a.v - a.mean) * (b.v - b.mean)) / sqrt(sum(a.w * pow(a.v - a.mean, 2)) * sum(a.w * pow(b.v - b.mean, 2))), 6) AS r
FROM c a JOIN c b USING (firm_id, year) GROUP BY a.c, b.c"""


LAGS = {"fin_total": 6, "fini_avg_discount": 8, "fini_max_qty": 8}
SQL |= {
    "delong_paired_p": with_p(SQL["delong_paired"]),
    "delong_pooled_p": with_p(SQL["delong_pooled"], stars=True),
    "delong_pooled_stored": with_p(SQL["delong_pooled"], stars=True),
    "lagged_panel": f"WITH {FEATURES} SELECT a.firm_id, a.year, " + ", ".join(f"round(CAST(a.{c} AS DOUBLE), {k}) AS {c}, round(CAST(b.{c} AS DOUBLE), {k}) AS {c}_t1" for c, k in LAGS.items()) + " FROM features a LEFT JOIN features b ON a.firm_id = b.firm_id AND b.year = a.year - 1",
    "industry_zscores": f"""WITH {FEATURES}, x AS (SELECT features.*, c_nationkey AS industry FROM features JOIN customer ON firm_id = lpad(CAST(c_custkey AS VARCHAR), 6, '0'))
SELECT firm_id, year, industry, """ + ", ".join(f"round(CASE WHEN {c} IS NOT NULL THEN CASE WHEN stddev_samp({c}) OVER g > 0 THEN ({c} - avg({c}) OVER g) / stddev_samp({c}) OVER g ELSE 0 END END, 6) AS {c}_zind" for c in LAGS) + " FROM x WINDOW g AS (PARTITION BY industry, year)",
    "weighted_correlations": correlations(),
}
