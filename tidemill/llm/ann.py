"""Approximate nearest neighbours by multiprobe p-stable hashing (operator 10).

Nearness is the inner product, so candidates get one more coordinate that lifts all of
them to the largest norm, and queries are scaled to it; then the nearest in distance are
the largest in inner product. A table has some functions floor((a.v + b) / width) with
normal a; their number grows with the logarithm of the rows, so that buckets stay small.
For a query the probability that a neighbour falls into a bucket is estimated
from where the query's projections lie between the bucket's walls and from the distance
of near neighbours in a bounded sample; buckets are visited in falling order of it until
the visited ones hold TARGET of the probability. Candidates of a visited bucket are
reranked by the exact inner product in double precision, and the tables' lists merged.

The first few functions of a table, more with more rows, deal rows and queries to tasks; a
query goes once to each coarse cell that holds buckets it visits, with their keys, and meets only rows of those
buckets there. What a task gives back is bounded by k rows a query, and by the score and id of
the k-th row that the query has in a part of the sample.

A query whose near rows lie beyond FAR times the fitted distance has no bucket to visit; it
and any other query with fewer than k rows, if there are more, are compared with all rows,
in blocks.

Buckets of any size are whole: a cell with many rows is dealt into chunks, each of which all
queries that visit the cell see, so nothing is capped.

The sample (SAMPLE rows, by hash of the id) fits only the neighbour distance; all rows are
indexed. Recall is measured against brute force in tests/llm and the README.

Edge cases: vectors that are null, all zeros, or hold null, NaN or infinite components take
no part, nor rows without id; repeated ids count once (smallest vector); shorter vectors
are padded with zeros; an empty table gives no rows; equal scores go to smaller ids; hashing
works on components scaled by the largest of all, so that no norm overflows, and pairs whose
product does and is no number are left out; only vec_id
and embedding are read, so further columns, whatever their names, do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import light, materialise, shuffle_partitions
from tidemill.llm.vectors import best, is_query, matrix, ranked, usable

TABLES, TARGET, SAMPLE = 10, 0.25, 2048
#: Functions of a table, within these, for each doubling of the rows; cell width in radii.
LEAST_HASHES, MOST_HASHES, SLOPE, WIDTH = 2, 14, 0.75, 2.0
#: Buckets of a table that a query visits at most, and cells on either side of its own that are considered.
PROBES, REACH = 1024, 1
LEAST_CHUNK, MOST_CHUNK, STRIP = 1024, 8192, 512
#: Rows for each one of the sample that bounds a query's k-th score.
ROWS_A_BOUND = 8
#: Near rows are this share of all, or k if that is more; a query that has them only beyond FAR radii is searched exactly.
SHARE, FAR = 0.004, 1.25
#: In large tables the distance is carried on to k rows from the share and TIMES the share, to LEAST_PART of it at least.
TIMES, LEAST_PART = 8, 0.85


@dataclass
class Index:
    dim: int
    top: float  # largest norm
    radius: float
    share: float  # of the other rows that count as near
    n: int  # rows
    sample: np.ndarray  # lifted rows
    sample_ids: np.ndarray
    scale: float = 1.0  # largest component; what is hashed is in its units
    rows: np.ndarray | None = None  # the sample as it came

    def __post_init__(self):
        rng = np.random.default_rng(20260101)
        self.hashes = min(max(round(SLOPE * math.log2(max(self.n, 1)) - 0.5), LEAST_HASHES), MOST_HASHES)
        # A function halves its rows and a little more; coarse cells are to hold a chunk.
        self.coarse = min(max(round(math.log2(max(self.n / MOST_CHUNK, 1)) / 1.3), 1), self.hashes)
        self.a = rng.standard_normal((self.dim + 1, TABLES * self.hashes))
        self.width = WIDTH * self.radius
        self.b = rng.uniform(0, self.width, TABLES * self.hashes)

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top**2 - (x**2).sum(axis=1, keepdims=True), 0))
        return np.hstack([x, rest])

    def scaled(self, q: np.ndarray) -> np.ndarray:
        q = q * (self.top / np.sqrt((q**2).sum(axis=1, keepdims=True)))
        return np.hstack([q, np.zeros((len(q), 1))])

    def own_radius(self, v: np.ndarray, ids: np.ndarray, times: float = 1) -> np.ndarray:
        """By scaled query, the distance within which it has its share (some times that) of the sample's other rows."""
        d2 = np.maximum((v**2).sum(axis=1)[:, None] + (self.sample**2).sum(axis=1)[None, :] - 2 * v @ self.sample.T, 0)
        d2[ids[:, None] == self.sample_ids[None, :]] = np.inf
        at = min(math.ceil(times * self.share * len(self.sample)), max(len(self.sample) - 2, 0))
        return np.sqrt(np.partition(d2, at, axis=1)[:, at])

    def place(self, v: np.ndarray) -> np.ndarray:
        """Projections in cell widths: rows x TABLES x functions."""
        return ((v @ self.a + self.b) / self.width).reshape(-1, TABLES, self.hashes)

    def keys(self, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the coarse cell and of the bucket, for the cells of a table's functions."""
        out = np.zeros(cells.shape[:-1], np.int64)
        coarse = out
        for i in range(self.hashes):
            with np.errstate(over="ignore"):
                out = out * 1_000_003 + np.clip(cells[..., i], -50_000, 50_000).astype(np.int64)
            if i == self.coarse - 1:
                coarse = out
        return coarse, out

    def visits(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query places and the cells of the buckets to visit, for projections of one table.

        The cells of one function after the other are multiplied in, and the PROBES best
        beginnings kept: the best buckets begin with the best beginnings.
        """
        cell = np.floor(place)
        steps = np.arange(-REACH, REACH + 1)
        wall = (cell[:, :, None] + np.append(steps, REACH + 1) - place[:, :, None]) * (self.width / self.radius)
        mass = np.diff(normal(wall), axis=2)  # queries x functions x steps
        joint, chosen = np.ones((len(place), 1)), np.zeros((len(place), 1, 0), np.int8)
        for i in range(self.hashes):
            joint = (joint[:, :, None] * mass[:, i, None, :]).reshape(len(place), -1)
            m = min(joint.shape[1], PROBES)
            best_ = np.argpartition(-joint, m - 1, axis=1)[:, :m]
            joint = np.take_along_axis(joint, best_, axis=1)
            before = np.take_along_axis(chosen, (best_ // len(steps))[:, :, None], axis=1)
            chosen = np.concatenate([before, steps[best_ % len(steps)][:, :, None].astype(np.int8)], axis=2)
        order = np.argsort(-joint, axis=1, kind="stable")
        joint = np.take_along_axis(joint, order, axis=1)
        who, which = np.nonzero(np.cumsum(joint, axis=1) - joint < TARGET)
        return who, cell[who] + chosen[who, order[who, which]]

    def floor(self, q: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Score and id of the k-th row that queries have in a part of the sample; minus infinity if there are fewer.

        The part is small beside the table: what is as good as this bound is many times k rows.
        """
        part = slice(min(len(self.sample), self.n // ROWS_A_BOUND))
        x, x_ids = self.rows[part], self.sample_ids[part]
        score, at = np.full(len(q), -np.inf), np.full(len(q), np.iinfo(np.int64).max)
        if len(x) <= k:
            return score, at
        i, j = _rerank(q, ids, x, x_ids, score, k)
        for one in np.unique(i):
            places = j[i == one]
            exact = (q[one] * x[places]).sum(axis=1)
            top = best(exact, x_ids[places], k)
            if len(top) == k:
                score[one], at[one] = exact[top[-1]], x_ids[places[top[-1]]]
        return score, at


_GRID = np.linspace(-8, 8, 16_001)
_NORMAL = np.array([0.5 * (1 + math.erf(z / math.sqrt(2))) for z in _GRID])


def normal(z: np.ndarray) -> np.ndarray:
    """The normal distribution function, good to 1e-7."""
    return np.interp(z, _GRID, _NORMAL, 0, 1)


def fit(rows: DataFrame, k: int) -> Index | None:
    """The largest norm of all rows, and the distance of near neighbours in a bounded sample.

    Nine in ten of the sampled rows have their share of rows within the radius, so that groups
    of copies, however many rows they hold, leave it to the other rows if these are a tenth.
    """
    n, dim, scale = rows.agg(F.count("*"), F.max(F.size("embedding")), F.max(F.array_max(F.transform("embedding", lambda x: F.abs(x.cast("double")))))).first()
    if not dim:
        return None
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.pow(x.cast("double") / F.lit(scale), F.lit(2.0)))
    top = rows.agg(F.max(F.sqrt(square))).first()[0]
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vec_id", "embedding").toArrow()
    return fitted(some.column(0).to_numpy(), matrix(some.column(1), dim), top, n, k, scale)


def fitted(ids: np.ndarray, x: np.ndarray, top: float, n: int, k: int, scale: float = 1.0) -> Index:
    """The index of n rows, of which x are a sample; top is the largest norm in units of scale."""
    index = Index(x.shape[1], top, top, min(max(SHARE, k / max(n - 1, 1)), 1), n, np.empty(0), ids, scale, x)
    x = x / scale
    index.sample = index.lifted(x)
    v = index.scaled(x[:512])
    own = index.own_radius(v, ids[:512])
    wanted = k / max(n - 1, 1)
    if wanted < index.share:  # so near that the sample shows none: carried on from two shares that it shows
        z, z_more, z_wanted = (-np.interp(p, _NORMAL, _GRID) for p in (index.share, TIMES * index.share, wanted))
        fall = (index.own_radius(v, ids[:512], TIMES) - own) / (z - z_more)
        own = np.maximum(own - fall * (z_wanted - z), LEAST_PART * own)
    own = own[np.isfinite(own)]
    return replace(index, radius=max(float(np.quantile(own, 0.9)), 1e-3 * top) if len(own) else top)


def _given(index: Index):
    """Rows with their coarse cell and bucket in each table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                part = batch.slice(at, STRIP)
                place = index.place(index.lifted(matrix(part.column(1), index.dim) / index.scale))
                for t in range(TABLES):
                    coarse, fine = index.keys(np.floor(place[:, t]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(fine), t, np.int32)), pa.array(coarse), pa.array(fine), part.column(0), part.column(1)], names=["t", "cell", "bucket", "vec_id", "embedding"]
                    )

    return run


def _asked(index: Index, k: int):
    """Queries with the coarse cells they visit in each table, the buckets there, and a bound of their k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, STRIP):
                part = batch.slice(at, STRIP)
                x, ids = matrix(part.column(1), index.dim), part.column(0).to_numpy()
                v = index.scaled(x / index.scale)
                near = np.flatnonzero(index.own_radius(v, ids) <= FAR * index.radius)
                part, place = part.take(pa.array(near)), index.place(v[near])
                floor, floor_id = index.floor(x[near], ids[near], k)
                for t in range(TABLES if len(near) else 0):
                    who, cells = index.visits(place[:, t])
                    coarse, fine = index.keys(cells)
                    order = np.lexsort((fine, coarse, who))
                    who, coarse, fine = who[order], coarse[order], fine[order]
                    first = np.flatnonzero((np.diff(who, prepend=-1) != 0) | (np.diff(coarse, prepend=coarse[0] - 1) != 0))
                    take = pa.array(who[first])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(len(first), t, np.int32)), pa.array(coarse[first]), pa.ListArray.from_arrays(pa.array(np.append(first, len(fine)), pa.int32()), pa.array(fine)),
                            pa.array(floor[who[first]]), pa.array(floor_id[who[first]]), part.column(0).take(take), part.column(1).take(take),
                        ],
                        names=["t", "cell", "buckets", "floor", "floor_id", "vec_id", "embedding"],
                    )

    return run


def _rerank(q: np.ndarray, q_ids: np.ndarray, x: np.ndarray, x_ids: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of queries and of rows among which the k best of each query are; few if floors are good."""
    out_q, out_x = [], []
    for at in range(0, len(q), STRIP):
        with np.errstate(over="ignore", invalid="ignore"):
            rough = q[at : at + STRIP] @ x.T
        rough[np.isnan(rough) | (q_ids[at : at + STRIP, None] == x_ids[None, :])] = -np.inf
        least = floor[at : at + STRIP]
        if len(x) > 4 * k:
            least = np.maximum(least, np.partition(rough, len(x) - k, axis=1)[:, len(x) - k])
        slack = 1e-12 * (1 + np.abs(rough).max(axis=1, where=np.isfinite(rough), initial=0))
        keep = (rough >= (least - slack)[:, None]) & (rough > -np.inf)
        for i in np.flatnonzero(keep.sum(axis=1) > 4 * k):  # many equal scores
            places = np.flatnonzero(keep[i])
            keep[i] = False
            keep[i, places[best((q[at + i] * x[places]).sum(axis=1), x_ids[places], k)]] = True
        i, j = np.nonzero(keep)
        out_q.append(i + at)
        out_x.append(j)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_q]), np.concatenate([none, *out_x])


def search_cell(
    q: np.ndarray, q_ids: np.ndarray, visits: list[np.ndarray], floor: np.ndarray, floor_id: np.ndarray, x: np.ndarray, x_ids: np.ndarray, bucket: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query ids, row ids and scores: each query's k best among the rows of the buckets it visits, but none behind its floor."""
    order = np.argsort(bucket, kind="stable")
    x, x_ids, bucket = x[order], x_ids[order], bucket[order]
    keys, starts = np.unique(bucket, return_index=True)
    ends = np.append(starts[1:], len(bucket))
    who = np.repeat(np.arange(len(q)), list(map(len, visits)))
    asked = np.concatenate([np.empty(0, np.int64), *visits])
    place = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    hit = keys[place] == asked
    who, place = who[hit], place[hit]
    order = np.argsort(place, kind="stable")
    who, place = who[order], place[order]
    pairs = []
    for group in np.split(np.arange(len(who)), np.flatnonzero(np.diff(place)) + 1) if len(who) else []:
        qs, rows = who[group], slice(starts[place[group[0]]], ends[place[group[0]]])
        i, j = _rerank(q[qs], q_ids[qs], x[rows], x_ids[rows], floor[qs], k)
        pairs.append((qs[i], j + rows.start))
    none = np.empty(0, np.int64)
    i, j = (np.concatenate([none, *[p[side] for p in pairs]]) for side in (0, 1))
    score = np.empty(len(i))
    for at in range(0, len(i), 65_536):
        with np.errstate(over="ignore", invalid="ignore"):
            score[at : at + 65_536] = (q[i[at : at + 65_536]] * x[j[at : at + 65_536]]).sum(axis=1)
    within = (score > floor[i]) | ((score == floor[i]) & (x_ids[j] <= floor_id[i]))
    i, j, score = i[within], j[within], score[within]
    order = np.lexsort((x_ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    first = np.searchsorted(i, i)
    top = np.arange(len(i)) - first < k
    return q_ids[i[top]], x_ids[j[top]], score[top]


def ann_topk(vectors: DataFrame, k: int = 20, query_every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query."""
    spark = vectors.sparkSession
    rows = materialise(usable(vectors).where(F.exists("embedding", lambda x: x != 0)), "vectors")
    index = fit(rows, k)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = dict(rows.dtypes)["embedding"]
    given = materialise(rows.mapInArrow(_given(index), f"t int, cell long, bucket long, vec_id long, embedding {kind}"), "buckets")
    asked = rows.where(is_query(query_every)).mapInArrow(_asked(index, k), f"t int, cell long, buckets array<long>, floor double, floor_id long, vec_id long, embedding {kind}")

    chunk = min(MOST_CHUNK, max(LEAST_CHUNK, index.n * TABLES // (4 * shuffle_partitions(spark))))
    sizes = light(materialise(given.groupBy("t", "cell").agg(F.ceil(F.count("*") / chunk).alias("chunks")), "sizes"))
    given = given.join(sizes, ["t", "cell"]).withColumn("chunk", F.expr("pmod(xxhash64(vec_id), chunks)"))
    asked = asked.join(sizes, ["t", "cell"]).withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)")))
    open_ = {"floor": F.lit(float("-inf")), "floor_id": F.lit((1 << 63) - 1)}
    given = given.withColumns(open_ | {"buckets": F.array("bucket"), "asked": F.lit(False)})
    dim = index.dim

    def run(table: pa.Table) -> pa.Table:
        side = table.column("asked").to_numpy()
        ids = table.column("vec_id").to_numpy()
        x = matrix(table.column("embedding"), dim)
        lists = table.column("buckets").combine_chunks()
        keys, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        visits = [keys[offsets[i] : offsets[i + 1]] for i in np.flatnonzero(side)]
        floor, floor_id = (table.column(c).to_numpy()[side] for c in ("floor", "floor_id"))
        out = search_cell(x[side], ids[side], visits, floor, floor_id, x[~side], ids[~side], keys[offsets[:-1][~side]], k) if side.any() and not side.all() else ([], [], [])
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    def meet(asked: DataFrame, given: DataFrame) -> DataFrame:
        names = ["t", "cell", "chunk", "buckets", "floor", "floor_id", "vec_id", "embedding", "asked"]
        found = asked.withColumn("asked", F.lit(True)).select(names).unionByName(given.select(names)).groupBy("t", "cell", "chunk").applyInArrow(run, "query_id long, vec_id long, score double")
        return ranked(found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), k)

    found = materialise(meet(asked, given), "found")
    whole = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, index.n - 1)).select(F.col("query_id").alias("vec_id"))
    short = materialise(rows.where(is_query(query_every)).join(whole, "vec_id", "left_anti"), "short")
    left = short.count()
    if not left:
        return found
    blocks, chunks = math.ceil(left / MOST_CHUNK), math.ceil(index.n / chunk)
    part = lambda n: F.expr(f"pmod(xxhash64(vec_id), {n}L)")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>"))
    plain = open_ | {"cell": F.lit(0).cast("long"), "buckets": F.array(F.lit(0).cast("long"))}
    rest = short.withColumns(plain | {"t": part(blocks), "chunk": every(chunks)})
    all_rows = rows.withColumns(plain | {"t": every(blocks), "chunk": part(chunks), "asked": F.lit(False)})
    done = light(short.select(F.col("vec_id").alias("query_id")))
    return found.join(done, "query_id", "left_anti").unionByName(meet(rest, all_rows))
