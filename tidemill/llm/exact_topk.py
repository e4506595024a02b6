"""Exact top-k search by aggregation without random access (operator 4).

Each block of candidates has a sorted list for every dimension and sign: contributions of a
positive query component fall along the descending list, of a negative one along the
ascending list. All lists are read in rounds, each to the same depth; nothing else of a
candidate is looked at before reading stops:

* What a candidate has shown so far, with the lists' fronts in its unseen places, is its upper
  bound; with the lists' last values there, its lower bound. Both come from tables that are
  filled from the lists as they are read.
* The floor of a query is the k-th best lower bound, or the k-th score that a pilot block of
  other candidates has reached, if that is higher.
* A candidate that no list has shown can have the fronts at most. Once that is below the floor,
  no outsider can qualify. If at most LEFT of the block still can by their upper bounds, reading
  stops, and the scores of those are resolved; else it goes on, at last to the lists' ends. So
  the result is exact, and `read` says which part of the lists it took.
* A block whose heads are too low for a query isn't read for it.

Query blocks meet candidate blocks on a grid, each block small enough for one task; the
partial lists of a query, k for each candidate block, are merged by rank.

Edge cases: vectors that are null or hold null, NaN or infinite components take no part,
nor rows without id; repeated ids count once (smallest vector); shorter vectors are
padded with zeros; an empty table gives no rows; equal scores go to smaller ids, so that a
candidate whose bound equals the k-th score stays; sums beyond 2**53 are computed with whole
numbers of any size and clipped to a long; only vec_id and embedding are read, so further
columns, whatever their names, do no harm.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import materialise, shuffle_partitions
from tidemill.llm.vectors import best, is_query, matrix, ranked, usable

#: Rows of a query block; least and most rows of a candidate block; queries multiplied at once; rows of the pilot block.
QUERY_BLOCK, LEAST_BLOCK, MOST_BLOCK, STRIP, PILOT = 8192, 512, 8192, 256, 4096
#: Shares of the lists that the rounds read to; share of a block whose scores are resolved without reading on.
DEPTHS, LEFT = (0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.9, 1.0), 0.1


def quantise(x: np.ndarray, scale: int) -> np.ndarray:
    return np.floor(scale * x)


def _exact_type(q: np.ndarray, x: np.ndarray) -> type | str:
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else object


def _whole(a: np.ndarray) -> np.ndarray:
    return np.array([[int(v) for v in row] for row in a], object).reshape(a.shape)


class Lists:
    """The sorted lists of a block of rows: descending ones first, then ascending ones."""

    def __init__(self, x: np.ndarray):
        self.order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, self.order, axis=0)
        self.n = len(x)
        self.heads, self.ends = (np.hstack([self.sorted[i], self.sorted[-1 - i]]) for i in (-1, 0))

    def depth(self, share: float) -> int:
        return max(int(np.ceil(share * self.n)), 1)

    def fronts(self, share: float) -> np.ndarray:
        """The last values read."""
        m = self.depth(share)
        return np.hstack([self.sorted[self.n - m], self.sorted[m - 1]])

    def read(self, share: float, unseen: np.ndarray) -> np.ndarray:
        """What the lists have shown of each row down to a depth, with `unseen` in the other places."""
        m, d = self.depth(share), self.sorted.shape[1]
        out = np.repeat(unseen[None], self.n, axis=0)
        np.put_along_axis(out[:, :d], self.order[self.n - m :], self.sorted[self.n - m :], axis=0)
        np.put_along_axis(out[:, d:], self.order[:m], self.sorted[:m], axis=0)
        return out


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest of each row; minus infinity if there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def search_block(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray, float]]:
    """(query place, candidate places, scores, share of the lists read): each query's k best of this block.

    floors: scores that k other candidates of the query have reached; what is lower may be left out.
    """
    kind = _exact_type(q, x)
    floors = np.full(len(q), -np.inf) if floors is None else floors
    if kind is object:
        q, x = _whole(q), _whole(x)
        out = []
        for i in range(len(q)):
            ok = np.flatnonzero(x_ids != q_ids[i])
            s = np.array([sum(a * b for a, b in zip(q[i], x[j], strict=True)) for j in ok], object)
            order = sorted(range(len(ok)), key=lambda j: (-s[j], x_ids[ok[j]]))[:k]
            out.append((i, ok[order], np.array([min(max(s[j], -(2**63)), 2**63 - 1) for j in order], np.int64), 1.0))
        return out
    q, x = q.astype(kind), x.astype(kind)
    n = len(x)
    lists = Lists(x)
    split = np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
    out = []
    todo = np.flatnonzero(split @ lists.heads >= floors)
    floors = floors.copy()
    for share in DEPTHS:
        if not len(todo):
            break
        fronts = lists.fronts(share)
        lower, upper = (lists.read(share, unseen).T.copy() for unseen in (lists.ends, fronts))
        going = []
        for at in range(0, len(todo), STRIP):
            part = todo[at : at + STRIP]
            outsider = split[part] @ fronts
            own = q_ids[part, None] == x_ids[None, :]
            open_ = np.flatnonzero((outsider >= floors[part]) & (share < 1))
            if len(open_):
                least = split[part[open_]] @ lower
                least[own[open_]] = -np.inf
                floors[part[open_]] = np.maximum(floors[part[open_]], _kth(least, k))
            closed = np.flatnonzero((outsider < floors[part]) | (share == 1))
            most = split[part[closed]] @ upper
            most[own[closed]] = -np.inf
            if share == 1:  # all is seen, so bounds are scores
                floors[part[closed]] = np.maximum(floors[part[closed]], _kth(most, k))
            alive = (most >= floors[part[closed], None]) & (most > -np.inf)
            done = (alive.sum(axis=1) <= max(LEFT * n, 2 * k)) | (share == 1)
            for r in np.flatnonzero(done):
                places = np.flatnonzero(alive[r])
                exact = (q[part[closed[r]]] * x[places]).sum(axis=1, dtype=np.float64)
                top = best(exact, x_ids[places], k)
                out.append((int(part[closed[r]]), places[top], exact[top].astype(np.int64), share))
            going.append(np.setdiff1d(part, part[closed[done]]))
        todo = np.concatenate(going)
    return out


def _grid(asked: DataFrame, given: DataFrame, sizes: tuple[int, int], dim: int, scale: int, k: int) -> DataFrame:
    """query_id, vec_id, score: each query's k best of each candidate block; asked(vec_id, embedding, floor)."""
    qb, cb = sizes
    spread = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    asked = asked.select(spread(qb).alias("q"), every(cb).alias("c"), "vec_id", "embedding", "floor", F.lit(True).alias("asked"))
    given = given.select(every(qb).alias("q"), spread(cb).alias("c"), "vec_id", "embedding", F.lit(None).cast("double").alias("floor"), F.lit(False).alias("asked"))

    def run(table: pa.Table) -> pa.Table:
        side = table.column("asked").to_numpy()
        ids = table.column("vec_id").to_numpy()
        values = quantise(matrix(table.column("embedding"), dim), scale)
        floors = table.column("floor").to_pandas().fillna(-np.inf).to_numpy()
        q_ids, x_ids = ids[side], ids[~side]
        found = search_block(values[side], q_ids, values[~side], x_ids, k, floors[side]) if len(q_ids) and len(x_ids) else []
        sizes = [len(f[1]) for f in found]
        none = [np.empty(0, np.int64)]
        return pa.table(
            {
                "query_id": np.repeat(q_ids[[f[0] for f in found]], sizes) if found else none[0],
                "vec_id": np.concatenate([x_ids[f[1]] for f in found] or none),
                "score": np.concatenate([f[2] for f in found] or none),
            }
        )

    return asked.unionByName(given).groupBy("q", "c").applyInArrow(run, "query_id long, vec_id long, score long")


def exact_topk(vectors: DataFrame, k: int = 20, query_every: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query."""
    spark = vectors.sparkSession
    rows = materialise(usable(vectors), "vectors")
    n, nq, dim = rows.agg(F.count("*"), F.count_if(is_query(query_every)), F.max(F.size("embedding"))).first()
    dim = max(dim or 0, 1)
    cb = max(-(-n // MOST_BLOCK), min(-(-n // LEAST_BLOCK), 2 * shuffle_partitions(spark)), 1)
    qb = max(-(-nq // QUERY_BLOCK), 1)
    asked = rows.where(is_query(query_every)).withColumn("floor", F.lit(None).cast("double"))
    if n > 2 * PILOT:
        pilot = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PILOT)
        few = max(-(-nq // (STRIP * 4)), 1)  # more tasks: each has one small candidate block
        first = ranked(_grid(asked, pilot, (few, 1), dim, scale, k), k).where(F.col("rank") == k)
        first = first.select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
        asked = materialise(asked.drop("floor").join(first, "vec_id", "left"), "asked")
    return ranked(_grid(asked, rows, (qb, cb), dim, scale, k), k)
