"""The registered queries opN_<name> and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import (
    exact_dedup,
    fingerprints,
    hard_negatives,
    mixing,
    near_dedup,
    packing,
    pieces,
    prefix_trie,
    secrets,
    sharding,
    token_counts,
    toxicity,
    warc,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (
  SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body
)
SELECT n.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size,
       n.doc_id IS NOT DISTINCT FROM g.keep_id AND row_number() OVER (PARTITION BY n.body, n.doc_id) = 1 AS kept,
       sha256(n.body) AS text_sha256
FROM n JOIN g USING (body)
"""


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=40)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, where that package is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_domains(labels: DataFrame) -> DataFrame:
    """The labelled table of the mixing queries: low (quality 0) and high (quality 1)."""
    return labels.select(
        F.col("doc_id").alias("id"), F.when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high").alias("domain")
    )


TARGETS = {"low": 0.05, "high": 0.95}


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rates = mixing.mixing_rates(docs, quality_domains(_table(spark, sf_dir, "labels")), TARGETS)
    return rates.select(
        F.col("id").alias("doc_id"),
        F.col("tokens").alias("n_tokens"),
        *[F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(TARGETS)],
        "rate",
        "copies",
        "target_met",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digests(warc.derive(warc.responses(_table(spark, sf_dir, "pages"))))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=1024)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(_table(spark, sf_dir, "documents")).drop("found")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), size=3, percent=85)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_next(_table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), capacity=2048)


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("piece_bpe_32k.model")
    rows = pieces.decode(pieces.encode(_table(spark, sf_dir, "documents"), path), path)
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(hard_negatives.relabelled(_table(spark, sf_dir, "embeddings")))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sharding": op2_sharding,
    "op3_mixing": op3_mixing,
    "op4_warc": op4_warc,
    "op5_token_counts": op5_token_counts,
    "op6_secrets": op6_secrets,
    "op7_toxicity": op7_toxicity,
    "op8_near_dedup": op8_near_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_packing": op10_packing,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_hard_negatives": op13_hard_negatives,
}
OP13_SQL = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 100 * s.score BETWEEN 50 * p.positive_score AND 95 * p.positive_score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""

ORACLES = {"op1_exact_dedup": OP1_SQL, "op13_hard_negatives": OP13_SQL}
