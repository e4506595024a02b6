"""Token counts with a digest cache (operator 6).

The cache is a parquet table (content, tokenizer, n_tokens) at a shared path. Content
digests are SHA-256 of the normalised text (null becomes empty; nothing else may change,
or counts would), tokenizer digests SHA-256 of the vocabulary file. Counts come from a
join with the cache; only distinct digests without a stored count are encoded, and their
counts are appended. Copies meet in a map-side combine before the shuffle, so a text that
a third of all rows hold is sent once a task. On the way back a digest is hot if it has more
than one row in P, for P shuffle partitions: there can't be P of those, so their counts are
broadcast and only the other digests' rows are shuffled.

Edge cases: null and empty texts share one entry of 0 tokens; rows that repeat get a row
each; a null doc_id stays null; an empty table leaves the cache as it is; an appended entry
that a retried run repeats is counted once; very long texts are encoded whole; only doc_id
and text are read, so further columns, whatever their names, do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidemill.llm.common import materialise, pick, shuffle_partitions, small_batches

BATCH_CHARS = 1_000_000


@lru_cache(maxsize=4)
def load_tokenizer(path: str):
    """The tokenizer of a .json or .model file, once a worker; returns its batch counter."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return lambda texts: [len(x.ids) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = load_tokenizer(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            done: list[int] = []
            part: list[str] = []
            size = 0
            for x in texts:
                part.append(x.as_py())
                size += len(part[-1])
                if size >= BATCH_CHARS or len(part) >= 1000:
                    done += count(part)
                    part, size = [], 0
            done += count(part) if part else []
            yield pa.RecordBatch.from_arrays([keys, pa.array(done, pa.int64())], names=["content", "n_tokens"])

    return run


def read_cache(spark, cache_dir: str) -> DataFrame:
    """Stored counts; a cache that isn't there yet is empty, one of other columns is an error."""
    schema = "content binary, tokenizer string, n_tokens long"
    try:
        found = spark.read.parquet(cache_dir)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)
    return found.select(F.col("content").cast("binary"), F.col("tokenizer").cast("string"), F.col("n_tokens").cast("long"))


def token_counts(docs: DataFrame, tokenizer: str, cache_dir: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    small_batches(docs.sparkSession)
    version = tokenizer_digest(tokenizer)
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    keyed = docs.withColumn("content", F.unhex(F.sha2("text", 256)))
    known = read_cache(spark, cache_dir).where(F.col("tokenizer") == version)
    misses = keyed.select("content", "text").dropDuplicates(["content"]).join(known, "content", "left_anti")
    misses.mapInArrow(_count(tokenizer), "content binary, n_tokens long").withColumn("tokenizer", F.lit(version)).select("content", "tokenizer", "n_tokens").write.mode("append").parquet(cache_dir)

    counts = read_cache(spark, cache_dir).where(F.col("tokenizer") == version).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    slim = materialise(keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "content"), "digests")
    return _with_counts(slim, counts).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _with_counts(slim: DataFrame, counts: DataFrame) -> DataFrame:
    """slim joined with counts(content, n_tokens), hot digests by broadcast."""
    least = slim.count() / shuffle_partitions(slim.sparkSession)
    hot = slim.groupBy("content").agg(F.count("*").alias("rows")).where(F.col("rows") > least).select("content")
    hot = materialise(counts.join(F.broadcast(hot), "content"), "hot")
    marked = slim.join(F.broadcast(hot), "content", "left")
    rest = marked.where("n_tokens is null").drop("n_tokens").join(counts, "content")
    return marked.where("n_tokens is not null").unionByName(rest)
