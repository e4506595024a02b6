"""Vectors in blocks: rows of a key packed into one row with a matrix, so that pairs of blocks are matrix products.

Vectors that are null or hold null or non-finite entries take no part; shorter ones count as
padded with zeros.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of vectors and of a block of queries.
ROWS, QUERIES = 2048, 256
#: Bytes of query blocks that are sent whole to every executor.
BROADCAST_BYTES = 64 << 20
#: Shares in which larger query sides are dealt, each to meet all vectors in tasks of its own.
SHARES = 16

PACKED = "`key` string, ids array<long>, width int, data binary"
NAMES = ["key", "ids", "width", "data"]


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def matrix(lists: pa.ListArray, width: int | None = None) -> np.ndarray:
    """A list column as rows of doubles."""
    offsets = lists.offsets.to_numpy()
    lengths = np.diff(offsets)
    width = int(lengths.max(initial=0)) if width is None else width
    flat = lists.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64)
    if (lengths == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def runs(key: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Places of rows that share a key, at most `size` at once."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(key[order][1:] != key[order][:-1]) + 1
    for part in np.split(order, cuts):
        for start in range(0, len(part), size):
            yield part[start : start + size]


def _packing(size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, x = np.array(batch["key"].to_pylist(), object), batch["id"].to_numpy(), matrix(batch["vector"])
            parts = list(runs(key.astype(str), size))
            columns = [pa.array([key[p[0]] for p in parts], pa.string()), pa.array([ids[p] for p in parts], pa.list_(pa.int64())), pa.array([x.shape[1]] * len(parts), pa.int32())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([x[p].tobytes() for p in parts], pa.binary())], NAMES)

    return run


def packed(rows: DataFrame, id_: str, vector: str, key: Column, size: int) -> DataFrame:
    """Blocks (key, ids, width, data) of the usable rows that have a key."""
    rows = rows.where(usable(F.col(vector)) & F.col(id_).isNotNull()).select(key.cast("string").alias("key"), F.col(id_).cast("long").alias("id"), F.col(vector).alias("vector"))
    return rows.where("key IS NOT NULL").mapInArrow(_packing(size), PACKED)


def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows that hold a block or two each: a worker has one of them unpacked at a time, however many a batch brings."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def unpacked(data: bytes, n: int, width: int, to: int | None = None) -> np.ndarray:
    x = np.frombuffer(data, np.float64).reshape(n, width)
    return x if to is None or to == width else np.pad(x, ((0, 0), (0, to - width)))


def paired(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The similarity of each row of q with the row of v at its place, as cosines has it."""
    norms = np.sqrt((q * q).sum(axis=1)) * np.sqrt((v * v).sum(axis=1))
    return np.round(np.clip(np.divide((q * v).sum(axis=1), norms, out=np.zeros(len(q)), where=norms > 0), 0, 1), 9)


def cosines(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Similarities within 0 and 1 to nine digits; 0 for zero vectors."""
    norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))[None]
    return np.round(np.clip(np.divide(q @ v.T, norms, out=np.zeros(norms.shape), where=norms > 0), 0, 1), 9)


#: Error of a single-precision product of unit vectors, for each dimension; cells that a query may leave open, times n.
SINGLE, OPEN = 2.0**-23, 8
#: Scores that a task remembers; it forgets them all beyond, which costs time only.
REMEMBERED = 4 << 20


def _units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in single precision; zero vectors as they are."""
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0).astype(np.float32)


def _reaching(q: np.ndarray, v: np.ndarray, own: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Cells of q x v that may be among a query's n best so far, by products in single precision; none if they are no help."""
    n, slack = best.shape[1], SINGLE * (q.shape[1] + 2) + 1e-9
    rough = _units(q) @ _units(v).T
    rough[own] = -2
    floor = best.min(axis=1)
    if (floor < 0).any() and len(v) > n:
        floor = np.maximum(floor, np.partition(rough, len(v) - n, axis=1)[:, len(v) - n] - slack)
    # A score of 0 stands for all below it.
    i, j = np.nonzero(rough >= np.where(floor > 2 * slack, floor - slack, -1.5).astype(np.float32)[:, None])
    return (i, j) if len(i) <= OPEN * n * len(q) and np.isfinite(rough).all() else None


def _each(scores: np.ndarray, qi: np.ndarray, vi: np.ndarray, floor: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's n best cells that reach its floor, best first."""
    rows = []
    for at, s in enumerate(scores):
        there = np.flatnonzero((vi != qi[at]) & (s >= floor[at]))
        if len(there) > n:  # all that reach the n-th score, so that ties are cut by id
            there = there[s[there] >= np.partition(s[there], len(there) - n)[len(there) - n]]
        rows.append(there[np.lexsort((vi[there], -s[there]))[:n]])
    i, j = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    return i, j, scores[i, j]


def _nearest(n: int) -> Callable:
    """Pairs of blocks to the rows of each pair that may be among a query's n best, n a query at most.

    A task remembers the n best scores of each query it has met, so that what it gives back
    hardly grows with the blocks, and exact scores are for the cells that reach them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        so_far: dict[tuple, np.ndarray] = {}
        for row in one_by_one(batches):
            qi, vi = np.array(row["q_ids"], np.int64), np.array(row["ids"], np.int64)
            width = max(row["q_width"], row["width"])
            q, v = unpacked(row["q_data"], len(qi), row["q_width"], width), unpacked(row["data"], len(vi), row["width"], width)
            if len(so_far) * len(qi) * n > REMEMBERED:
                so_far.clear()
            best = so_far.setdefault((row["key"], qi.tobytes()), np.full((len(qi), n), -1.0))
            cells = _reaching(q, v, qi[:, None] == vi, best)
            floor = best.min(axis=1)
            if cells is None:
                i, j, s = _each(cosines(q, v), qi, vi, floor, n)
            else:
                i, j = cells
                s = paired(q[i], v[j])
                there = s >= floor[i]
                i, j, s = i[there], j[there], s[there]
                order = np.lexsort((vi[j], -s, i))
                i, j, s = i[order], j[order], s[order]
            place = np.arange(len(i)) - np.searchsorted(i, np.arange(len(qi)))[i]
            i, j, s, place = (x[place < n] for x in (i, j, s, place))
            if len(i):
                fresh = np.full((len(qi), n), -1.0)
                fresh[i, place] = s
                met = np.unique(i)
                best[met] = -np.sort(-np.concatenate([best[met], fresh[met]], axis=1), axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays([pa.array([row["key"]] * len(i), pa.string()), pa.array(qi[i]), pa.array(vi[j]), pa.array(s)], ["key", "query_id", "vec_id", "score"])

    return run


def top(found: DataFrame, n: int, *by: str) -> DataFrame:
    """The n best of each query (and `by`) with their place, pos; ties to smaller ids."""
    best = Window.partitionBy("query_id", *by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("pos", F.row_number().over(best)).where(F.col("pos") <= n)


def nearest(queries: DataFrame, vectors: DataFrame, n: int) -> DataFrame:
    """key, query_id, pos, vec_id, score: the n nearest of each query(query_id, vector, key) among vectors(vec_id, embedding, key) of its key.

    Vectors stay where they are if the queries' blocks are small enough to be sent to them.
    Else queries are dealt in shares, and every block of vectors goes to each share.
    """
    q = packed(queries, "query_id", "vector", F.col("key"), QUERIES).select(F.col("key").alias("q_key"), F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("data").alias("q_data"))
    v = packed(vectors, "vec_id", "embedding", F.col("key"), ROWS)
    count, width = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    if count * 8 * max(width or 0, 1) <= BROADCAST_BYTES:
        pairs = v.join(F.broadcast(q), F.col("key") == F.col("q_key"))
    else:
        q = q.withColumn("q_share", F.pmod(F.xxhash64("q_ids"), F.lit(SHARES)).cast("int"))
        v = v.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        pairs = v.join(q, (F.col("key") == F.col("q_key")) & (F.col("share") == F.col("q_share")))
    found = pairs.select("key", "q_ids", "q_width", "q_data", "ids", "width", "data").mapInArrow(_nearest(n), "`key` string, query_id long, vec_id long, score double")
    return top(found, n, "key").select("key", "query_id", "pos", "vec_id", "score")
