"""The registered queries of this package: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelspark.functions.lineage import scratch
from reelspark.llm import (
    decontaminate,
    kmeans,
    language,
    likelihood,
    negatives,
    packing,
    quality,
    simhash,
    substring,
    topk,
    toxicity,
    warc,
    wrappers,
)
from reelspark.llm.common import bounded_sample, having, is_held_out, labelled_texts, table

#: Documents that the language model is learned from at most, about.
LANGUAGE_ROWS = 20_000
#: Labelled documents that the two classifiers are learned from at most, about, and their characters.
QUALITY_ROWS, TOXIC_ROWS, LEARNED_CHARS = 3_000, 5_000, 16_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.simhash_components(table(spark, folder, "documents"), shingle=4, bits=4)


@query("op9_substring_dedup", """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
dup AS (SELECT doc_id, i FROM win JOIN (SELECT s, min(doc_id) AS least FROM win GROUP BY s) USING (s)
        WHERE least < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM dup),
cut AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (
  SELECT doc_id, len(ws) AS n_words, coalesce(len(ps), 0) AS n_removed,
         CASE WHEN ps IS NULL THEN ws
              ELSE list_filter(ws, lambda x, i: NOT list_contains(ps, i)) END AS ks
  FROM w LEFT JOIN cut USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed,
       sha256(array_to_string(ks, ' ')) AS kept_sha256
FROM kept""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return substring.substring_dedup(table(spark, folder, "documents"))


@query("op7_exact_top_k", """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM e q JOIN e c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5""")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), lambda key: key % 50 == 0, k=5)


@query("op6_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, body, CAST(strlen(body) AS BIGINT) AS n FROM p),
g AS (SELECT body, max(page_id) AS newest FROM d WHERE n >= 1000 GROUP BY body)
SELECT d.page_id, d.n AS payload_bytes, sha1(d.body) AS payload_digest,
       CASE WHEN g.newest <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.newest <> d.page_id THEN g.newest END AS refers_to
FROM d LEFT JOIN g ON d.n >= 1000 AND d.body = g.body""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_pages(table(spark, folder, "pages"), path, least=1000)
    return warc.read_pages(spark, path)


@query("op8_language_id")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    known = docs.select("doc_id", "text", "lang").filter(
        F.col("lang").isNotNull() & ~is_held_out(F.col("doc_id"), 5, 0))
    model = language.fit(bounded_sample(known, "doc_id", LANGUAGE_ROWS))
    return language.predict(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


def quality_model(spark: SparkSession, docs: DataFrame, folder: str) -> quality.Model:
    labels = table(spark, folder, "labels").filter(~is_held_out(F.col("doc_id"), 4, 2))
    return quality.train(*labelled_texts(docs, labels, "quality", QUALITY_ROWS, LEARNED_CHARS))


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality_model(spark, docs, folder)).select(
        "doc_id", is_held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op5_toxicity")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = table(spark, folder, "labels").filter(~is_held_out(F.col("doc_id"), 5, 0))
    model = toxicity.train(*labelled_texts(docs, labels, "toxic", TOXIC_ROWS, LEARNED_CHARS))
    return toxicity.score(docs, model).select(
        "doc_id", is_held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op4_decontamination")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def packed(docs: DataFrame) -> DataFrame:
    """Documents packed with the byte-level tokenizer, found where the tokenizers are installed."""
    return packing.pack(
        docs, public_tokenizers.path("byte_bpe_50k.json"),
        ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


@query("op3_best_fit_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


@query("op10_html_extraction")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.extract(table(spark, folder, "pages"))


@query("op11_hard_negatives", """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (
  SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS n
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
    AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(n AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM n WHERE n <= 3""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").withColumn("label", moved)
    return negatives.hard_negatives(rows, lambda key: key % 50 == 0, positives=5, negatives=3, low=50, high=95)


@query("op12_quality_rules")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    good = table(spark, folder, "labels").filter("quality = 1").select("doc_id")
    ratio = likelihood.fit(docs, having(docs.select("doc_id", "text"), good, "doc_id"))
    return likelihood.quality_rules(docs, ratio)


def _k_means_sql(k: int, rounds: int, width: int, salt: str) -> str:
    """The rounds one after the other; whole numbers below 2**53 are held in doubles."""
    steps = [f"""
e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS cluster, v AS c
  FROM (SELECT sha256('{salt}' || CAST(vec_id AS VARCHAR)) AS h, v FROM e ORDER BY h LIMIT {k}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
a{r} AS MATERIALIZED (
  SELECT vec_id, v, cluster,
         list_inner_product(v, v) - 2 * list_inner_product(v, c) + list_inner_product(c, c) AS d
  FROM e CROSS JOIN c{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) = 1)""")
        if r < rounds:
            steps.append(f"""
s{r} AS (
  SELECT cluster, i, CAST(sum(x) AS HUGEINT) AS s, count(*) AS n
  FROM (SELECT cluster, unnest(v) AS x, unnest(range({width})) AS i FROM a{r}) GROUP BY cluster, i),
m{r} AS (
  SELECT cluster, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM s{r} GROUP BY cluster),
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.cluster, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} ON c{r}.cluster = m{r}.cluster)""")
    return f"""WITH {",".join(steps)}
SELECT vec_id, a.cluster, CAST(d AS BIGINT) AS distance,
       CAST(sum(d) OVER (PARTITION BY a.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} f ON a.cluster = f.cluster"""


@query("op13_centroid_clustering", _k_means_sql(40, 5, 64, "2:"))
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return kmeans.k_means(table(spark, folder, "embeddings"), k=40, rounds=5, width=64, salt="2:")
