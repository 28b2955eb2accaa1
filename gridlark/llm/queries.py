"""The queries of the training-data operators, over whole tables, and their SQL where SQL can tell the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridlark.llm import html_extract, jaccard, media, minhash, negatives, packing, secrets, sentencepiece_wfst, sessions, token_counts, topk, toxicity, url_filters

BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, vocabulary(BYTE_BPE)).drop("text")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE)).drop("ids")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_wfst.round_trip(table(spark, sf_dir, "documents"), vocabulary(PIECES))


def held_out(key: str):
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def toxicity_lexicon(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Lexicon:
    return toxicity.learn(spark, docs, table(spark, sf_dir, "labels").where(~held_out("doc_id")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity_lexicon(spark, docs, sf_dir)
    return toxicity.score(docs, lexicon).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted", "n_hits")


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows.where("vec_id % 50 = 0"), rows)


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_columns(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_media=False)
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def secret_model(spark: SparkSession):
    return secrets.train(secrets.labelled(spark))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"), secret_model(spark)).drop("candidate")


def op11_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions(table(spark, sf_dir, "clicks"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_jaccard, op2_token_counts, op3_packing, op4_sentencepiece, op5_toxicity, op6_url_filters, op7_html_extract, op8_top_k, op9_media, op10_secrets, op11_sessions, op12_hard_negatives, op13_minhash)}

ORACLE_SQL = {
    "op6_url_filters": r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h, rest FROM cut
), urls AS (
  SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^([^?#]*)', 1) AS path FROM parts
), rules(verdict, rule, rh, rp) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), fit AS (
  SELECT u.page_id, u.host, u.path, r.rule, r.verdict, length(r.rule) AS n
  FROM urls u LEFT JOIN rules r ON (u.host = r.rh OR ends_with(u.host, '.' || r.rh)) AND starts_with(u.path, r.rp)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fit
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY n DESC NULLS LAST, verdict DESC) = 1
""",
    "op8_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 5
""",
    "op11_sessions": """
WITH RECURSIVE once AS (
  SELECT DISTINCT ON (click_id) click_id, client_id, epoch_us(ts) AS us, coalesce(arrived_at - ts > INTERVAL 360 MINUTE, FALSE) AS late,
         coalesce(value >= 60 AND kind = 'error', FALSE) AS final, coalesce(CAST(floor(100 * value + 0.5) AS BIGINT), 0) AS cents
  FROM clicks WHERE click_id IS NOT NULL AND client_id IS NOT NULL AND ts IS NOT NULL
), before AS (
  SELECT *, row_number() OVER w AS rn, lag(final) OVER w AS p_final, lag(us) OVER w AS p_us FROM once WHERE NOT late WINDOW w AS (PARTITION BY client_id ORDER BY us, click_id)
), timely AS (
  SELECT *, CASE WHEN p_final THEN 'end' WHEN us - p_us >= 600000000 THEN 'gap' END AS forced FROM before
), jumps AS (
  SELECT *, least(
    coalesce(min(CASE WHEN forced IS NOT NULL THEN rn END) OVER (PARTITION BY client_id ORDER BY rn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 9223372036854775807),
    coalesce(min(rn) OVER (PARTITION BY client_id ORDER BY us RANGE BETWEEN 2400000001 FOLLOWING AND UNBOUNDED FOLLOWING), 9223372036854775807)) AS jump
  FROM timely
), starts(client_id, rn) AS (
  SELECT client_id, rn FROM jumps WHERE rn = 1
  UNION ALL SELECT j.client_id, j.jump FROM starts s JOIN jumps j ON s.client_id = j.client_id AND s.rn = j.rn WHERE j.jump < 9223372036854775807
), marked AS (
  SELECT t.*, count(s.rn) OVER (PARTITION BY t.client_id ORDER BY t.rn) AS k FROM timely t LEFT JOIN starts s ON s.client_id = t.client_id AND s.rn = t.rn
), found AS (
  SELECT client_id, k, arg_min(click_id, rn) AS session_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n_clicks, CAST(sum(cents) AS BIGINT) AS value_cents, max(rn) AS last, arg_max(final, rn) AS final,
         sha256(string_agg(CAST(click_id AS VARCHAR), ',' ORDER BY rn)) AS path_sha256 FROM marked GROUP BY client_id, k
), closed AS (
  SELECT f.*, coalesce(n.forced, CASE WHEN n.rn IS NOT NULL THEN 'length' WHEN f.final THEN 'end' ELSE 'none' END) AS closed_by, lead(f.start_us) OVER (PARTITION BY f.client_id ORDER BY f.k) AS next_us
  FROM found f LEFT JOIN timely n ON n.client_id = f.client_id AND n.rn = f.last + 1
), counted AS (
  SELECT c.client_id, c.k, count(*) AS n_late FROM closed c JOIN once l ON l.late AND l.client_id = c.client_id AND c.start_us <= l.us AND (c.next_us IS NULL OR l.us < c.next_us) GROUP BY c.client_id, c.k
)
SELECT c.client_id, session_id, start_us, end_us, n_clicks, coalesce(n_late, 0) AS n_late, value_cents, closed_by, path_sha256
FROM closed c LEFT JOIN counted USING (client_id, k)
""",
    "op12_hard_negatives": """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.id AS a, b.id AS b, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.id % 100 = 0 AND a.id <> b.id
), p AS (
  SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.b AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.a = p.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.b) QUALIFY row_number() OVER w <= 10
""",
    "op13_minhash": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) ELSE w END AS s FROM words
), classes AS (
  SELECT min(doc_id) AS class, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s
), posted AS (
  SELECT class, n, unnest(s) AS x FROM classes
), often AS (
  SELECT x, count(*) AS df FROM posted GROUP BY x
), ranked AS (
  SELECT class, n, x, row_number() OVER (PARTITION BY class ORDER BY df, x) AS place FROM posted JOIN often USING (x)
), prefix AS (
  SELECT class, n, x FROM ranked WHERE place <= n - (80 * n + 99) // 100 + 1
), met AS (
  SELECT DISTINCT a.class AS a, b.class AS b FROM prefix a JOIN prefix b ON a.x = b.x AND a.class < b.class AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
), counted AS (
  SELECT m.a, m.b, p.n AS na, q.n AS nb, len(list_intersect(p.s, q.s)) AS shared FROM met m JOIN classes p ON p.class = m.a JOIN classes q ON q.class = m.b
), links AS (
  SELECT a, b FROM counted WHERE 100 * shared >= 80 * (na + nb - shared) UNION ALL SELECT b, a FROM counted WHERE 100 * shared >= 80 * (na + nb - shared)
), reach(a, b) AS (
  SELECT class, class FROM classes UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), low AS (
  SELECT a AS class, min(b) AS component FROM reach GROUP BY a
)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(l.component, s.doc_id) AS component_id, s.doc_id = coalesce(l.component, s.doc_id) AS kept
FROM sets s LEFT JOIN classes c ON c.s = s.s LEFT JOIN low l ON l.class = c.class
""",
}
