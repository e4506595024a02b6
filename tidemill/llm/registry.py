"""The queries of this subpackage, for the driver's registry."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import ann, bpe, exact_topk, line_dedup, merkle, mixing, near_dedup, pii, preferences, quality, secrets, token_counts, whitening
from tidemill.llm.common import work_dir
from tidemill.session import table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(table(spark, sf_dir, "documents"))


def op3_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rank_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.exact_topk(table(spark, sf_dir, "embeddings"), k=20, query_every=20, scale=64)


def op5_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preferences.format_pairs(preferences.self_pairs(table(spark, sf_dir, "conversations")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts with an empty cache, so that each call does the whole job."""
    cache = f"{work_dir(spark)}/tidemill-{spark.sparkContext.applicationId}/token-cache-{uuid.uuid4().hex}"
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), cache, limit=1024)


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, percent=80)


def op10_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.ann_topk(table(spark, sf_dir, "embeddings"), k=20, query_every=20)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampering(table(spark, sf_dir, "documents"))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), k=32)


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.digests(line_dedup.kept_lines(docs, line_dedup.keep_bitmaps(docs, least_length=20, least_docs=3)))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources,
        op2_pii_spans,
        op3_quality_rank,
        op4_exact_topk,
        op5_preference_format,
        op6_token_counts,
        op7_bpe_round_trip,
        op8_secret_scan,
        op9_near_dedup,
        op10_ann_search,
        op11_merkle_manifest,
        op12_embedding_whitening,
        op13_line_dedup,
    )
}

OP4_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

ORACLE_SQL = {
    "op1_mix_sources": mixing.ORACLE_SQL,
    "op4_exact_topk": OP4_SQL,
    "op5_preference_format": preferences.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op13_line_dedup": line_dedup.ORACLE_SQL,
}
