"""The registered queries of this subpackage: thin adapters from tables to operators and contract columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, filter_audit, html_extraction, language_id, media, ordinal_quality, packing, token_alignment, token_counts, topk_search, toxicity, url_rules
from .graph import durable
from .jaccard_join import jaccard_components


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizer files lie; they come with every worker's Python."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(parts: int, which: int) -> Column:
    """Whether a row is held out; false for a null doc_id."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts)) == which, F.lit(False))


#: Grades of op1: 0 poor, 1 good but toxic, 2 good and clean.
GRADES = 3


def op1_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ratings = labels.select("doc_id", (F.col("quality") * (2 - F.col("toxic"))).alias("grade"))
    model = ordinal_quality.fit(docs, ratings.where(~fold(5, 0)), GRADES)
    graded = ordinal_quality.grade(docs, model, target=1)
    return graded.select("doc_id", fold(5, 0).alias("held_out"), "expected_grade", "tail_probability", "grade", (F.col("tail_probability") >= 0.5).alias("keep"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = media.inspected(media.stored(table(spark, sf_dir, "documents")))
    feature = F.format_string("%s:mean=%.4f:spread=%.4f:peak=%d", "kind", "mean", "spread", "peak")
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "kind", "declared", "corrected", F.size("embedded").alias("n_embedded"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~fold(3, 1)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", fold(3, 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_rules.judge(table(spark, sf_dir, "pages"), rules)


OP4_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
parts AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split),
best AS (
  SELECT p.*, (SELECT r.host || r.path FROM rules r WHERE (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) ORDER BY length(r.host || r.path) DESC LIMIT 1) AS rule
  FROM parts p)
SELECT b.page_id, b.host, b.path, b.rule, coalesce(r.verdict, 'allow') AS verdict FROM best b LEFT JOIN rules r ON b.rule = r.host || r.path
"""


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_table(durable(token_counts.length_histogram(table(spark, sf_dir, "documents"), tokenizer_path())))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


#: The main text by the one layout that the driver's pages have: what the article element holds, block by block.
OP7_SQL = r"""
WITH cut AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h[1-6]|ul|li|div)(?: [^>]*)?>') AS blocks FROM pages),
bare AS (SELECT page_id, url, list_transform(blocks, lambda b: regexp_replace(replace(b, '<br>', ' '), '<[^>]*>', '', 'g')) AS blocks FROM cut),
plain AS (SELECT page_id, url, list_transform(blocks, lambda b: trim(regexp_replace(regexp_replace(replace(replace(replace(b, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) AS blocks FROM bare),
whole AS (SELECT page_id, url, array_to_string(list_filter(blocks, lambda b: b <> ''), ' ') AS text FROM plain)
SELECT page_id, url, text, length(text) AS n_chars FROM whole
"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~fold(4, 2)))
    return language_id.identify(docs, model).select("doc_id", fold(4, 2).alias("held_out"), "lang_pred", "score")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id FROM sets s JOIN reach r ON s.doc_id = r.a GROUP BY s.doc_id, s.s
"""


def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.search(table(spark, sf_dir, "embeddings"), F.expr("id % 50 = 0"))


OP11_SQL = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
words AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM texts),
fails AS (SELECT doc_id, part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
  100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d, coalesce(least < doc_id, false) AS e FROM words),
masks AS (SELECT doc_id, part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask FROM fails),
says AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
held AS (SELECT part, mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM masks LEFT JOIN says USING (doc_id)),
tally AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM held GROUP BY part, mask),
letter(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT p.l || q.l || r.l || s.l || t.l AS filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] AS bits FROM letter p, letter q, letter r, letter s, letter t
  WHERE p.bit | q.bit | r.bit | s.bit | t.bit = 31),
steps AS (SELECT filter_order, k AS step, bits[k] AS own, coalesce(list_sum(bits[1:k - 1]), 0) AS before FROM orders, (SELECT unnest(range(1, 6)) AS k)),
found AS (SELECT part, filter_order, CAST(step AS INT) AS step, own,
  sum(CASE WHEN mask & (own | CAST(before AS INT)) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & own <> 0 AND mask & CAST(before AS INT) = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & own <> 0 AND mask & CAST(before AS INT) <> 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & own <> 0 AND mask & CAST(before AS INT) = 0 THEN good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & own <> 0 AND mask & CAST(before AS INT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM tally, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM found
"""


QUERIES = {
    "op1_ordinal_quality": op1_ordinal_quality,
    "op2_media": op2_media,
    "op3_toxicity": op3_toxicity,
    "op4_url_filter": op4_url_filter,
    "op5_decontamination": op5_decontamination,
    "op6_token_counts": op6_token_counts,
    "op7_html_extraction": op7_html_extraction,
    "op8_packing": op8_packing,
    "op9_language_id": op9_language_id,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_topk_search": op11_topk_search,
    "op12_token_alignment": op12_token_alignment,
    "op13_filter_audit": op13_filter_audit,
}
ORACLES: dict[str, str] = {"op4_url_filter": OP4_SQL, "op7_html_extraction": OP7_SQL, "op10_jaccard_join": OP10_SQL, "op11_topk_search": OP11_SQL, "op13_filter_audit": OP13_SQL}
