"""What the two vector searches share: usable rows, padding, merging of partial lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import pick


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding: rows with an id and only finite components, one row an id.

    Rows that repeat an id count once, with the smallest of their vectors.
    """
    rows = pick(vectors, "vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~bad).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("embedding"))


def is_query(every: int) -> Column:
    return F.col("vec_id") % every == 0


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of doubles, shorter ones padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    if len(flat) == n * dim:
        lengths = np.diff(offsets)
        if (lengths == dim).all():
            return flat.reshape(n, dim)
    out = np.zeros((n, dim))
    at = offsets - offsets[0]
    for i in range(n):
        out[i, : at[i + 1] - at[i]] = flat[at[i] : at[i + 1]]
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    return np.lexsort((ids, -scores))[:k]


def ranked(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score from partial lists (query_id, vec_id, score)."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
