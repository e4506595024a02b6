"""The corpus pipeline: quality, near-duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept;
all but the last return the columns of documents. `run` writes each stage to the shared
folder and reads it back, so that a lost executor costs no finished stage, and deletes what
the stages before have left there.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe, mixing, near_dedup, pii, quality
from tidemill.llm.common import materialise, sweep, tables
from tidemill.session import table


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    return near_dedup.drop_copies(docs, shingle_words=5, percent=80)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by its kind; n_chars follows the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by spaces) and the digests of ids and decoded text."""
    out = bpe.bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", good_documents),
    ("near_dedup", one_of_each),
    ("pii", without_personal_data),
    ("mixing", mixed_sources),
    ("bpe", encoded),
]

#: SQL can't express the classifier, the labelers' model or BPE.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, older = table(spark, sf_dir, "documents"), tables(spark)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        sweep(spark, docs, older)  # the stage's own tables, and its predecessor's result
    return docs
