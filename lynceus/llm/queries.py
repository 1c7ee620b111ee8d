"""The queries of the text operators and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontamination, exact_dedup, jaccard_join, language_id, packing, pii, quality_crf, sharding, substring_dedup, toxicity, url_filter, vector_codes
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


@_query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(table(spark, sf_dir, "documents"))


ORACLES["op1_exact_dedup"] = """
WITH n AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s
  FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM n
"""


@_query
def op2_histogram_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), 8)
    return out.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@_query
def op4_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: (verdict, host, path)
URL_RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
]


@_query
def op5_redirect_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


ORACLES["op5_redirect_url_filter"] = r"""
WITH RECURSIVE rules(v, h, p) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
pg AS (SELECT page_id, url, html, row_number() OVER () AS uid FROM pages),
markup AS (
  SELECT url, regexp_replace(html, '(?is)<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)', ' ', 'g') AS html
  FROM pg WHERE regexp_matches(html, '(?i)canonical|refresh')),
tags AS (SELECT url, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\b[^>]*>')) AS t FROM markup),
content AS (
  SELECT url, t, regexp_extract(t, '(?is)\bcontent\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^"''\s>]+))', ['a', 'b', 'c']) AS v,
    regexp_extract(t, '(?is)\bhref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^"''\s>]+))', ['a', 'b', 'c']) AS h FROM tags),
target AS (
  SELECT url, t, h, regexp_extract(trim(v.a || v.b || v.c, e' \t\n\f\r'), '(?is)\burl\s*=\s*(?:"([^"]*)|''([^'']*)|([^"''].*))', ['a', 'b', 'c']) AS r FROM content),
links AS (
  SELECT url AS f, CASE
      WHEN regexp_matches(t, '(?is)^<link\b.*\brel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN trim(h.a || h.b || h.c, e' \t\n\f\r')
      WHEN regexp_matches(t, '(?is)^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b') THEN trim(r.a || r.b || r.c, e' \t\n\f\r')
    END AS t FROM target),
whole AS (
  SELECT f, CASE WHEN contains(t, '://') THEN t WHEN starts_with(t, '//') THEN regexp_extract(f, '(?s)^(.*?:)//', 1) || t
    WHEN starts_with(t, '/') THEN regexp_extract(f, '(?s)^(.*?://[^/?#]*)', 1) || t END AS t
  FROM links WHERE contains(f, '://') AND t <> ''),
urls AS (SELECT f AS u FROM whole UNION SELECT t FROM whole UNION SELECT url FROM pg WHERE contains(url, '://')),
heads AS (SELECT u, regexp_replace(u, '(?s)#.*$', '') AS x, regexp_extract(u, '(?s)^(.*?://[^/?#]*)', 1) AS hd FROM urls WHERE u IS NOT NULL),
nodes AS (
  SELECT u, translate(hd, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || substr(x, length(hd) + 1) AS n FROM heads),
edges AS (SELECT DISTINCT a.n AS a, b.n AS b FROM whole JOIN nodes a ON whole.f = a.u JOIN nodes b ON whole.t = b.u WHERE a.n <> b.n),
edge2 AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
reach(a, b) AS (SELECT a, b FROM edge2 UNION SELECT r.a, e.b FROM reach r JOIN edge2 e ON r.b = e.a),
split AS (
  SELECT u, translate(coalesce(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT DISTINCT url AS u FROM pg UNION SELECT n FROM nodes)),
best AS (
  SELECT u, arg_max(v, length(h || p)) AS v, arg_max(h || p, length(h || p)) AS r
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u),
alias AS (SELECT reach.a AS n, min(best.v) AS v FROM reach JOIN best ON reach.b = best.u GROUP BY 1)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, alias.v, 'allow') AS verdict
FROM pg LEFT JOIN split ON pg.url IS NOT DISTINCT FROM split.u LEFT JOIN best ON pg.url = best.u
  LEFT JOIN nodes ON pg.url = nodes.u LEFT JOIN alias ON nodes.n = alias.n
"""


@_query
def op3_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op3_positional_decontamination"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS uid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS s FROM b WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS k, least(len(w), 10) AS n FROM starts),
spots AS (SELECT uid, w, unnest(range(1, len(w) + 1)) AS s FROM d),
hit AS (
  SELECT DISTINCT uid, s, n, item_id
  FROM (SELECT uid, s, n AS m, array_to_string(w[s:s + n - 1], ' ') AS k FROM spots, (SELECT DISTINCT n FROM wins) WHERE s + n - 1 <= len(w)) c
  JOIN wins ON wins.k = c.k AND wins.n = c.m),
inside AS (SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(range(s, s + n)) AS p FROM hit) GROUP BY uid),
listed AS (SELECT uid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT uid, item_id::VARCHAR AS i FROM hit) GROUP BY uid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN inside USING (uid) LEFT JOIN listed USING (uid)
"""


def held_out(folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in the fold; a null id is in none."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))


@_query
def op7_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.train_profiles(docs.where(~held_out(5, 0)))
    return language_id.predict_language(docs, profiles, keep=[F.col("doc_id"), held_out(5, 0).alias("held_out")])


@_query
def op8_t_occurrence_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def _with_label(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """Documents with their label where they have one; of repeated labels the largest counts."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(label).alias(label))
    return table(spark, sf_dir, "documents").join(labels, "doc_id")


@_query
def op6_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = toxicity.train(_with_label(spark, sf_dir, "toxic").where(~held_out(5, 0)))
    return toxicity.score(table(spark, sf_dir, "documents"), model, keep=[F.col("doc_id"), held_out(5, 0).alias("held_out")])


@_query
def op10_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = quality_crf.train(_with_label(spark, sf_dir, "quality").where(~held_out(3, 1)))
    return quality_crf.score(table(spark, sf_dir, "documents"), model, keep=[F.col("doc_id"), held_out(3, 1).alias("held_out")])


@_query
def op9_compact_window_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@_query
def op11_boosted_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(table(spark, sf_dir, "documents"), held_out(5, 0))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)), F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"),
        pii.listed(F.concat("base", "added")).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )


@_query
def op12_heap_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.VectorCodes(table(spark, sf_dir, "embeddings")).report()


@_query
def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return alignment.Alignment(table(spark, sf_dir, "documents"), *paths).documents.select(*columns)
