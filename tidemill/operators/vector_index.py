"""A stored nearest-neighbour index: inverted lists with coded residuals, in keyed tables.

Vectors are scaled to length 1 and dealt to the nearest of some coarse centroids; what is left
of them is coded by product quantisation, one byte for each group of dimensions. A row holds
the codes and how far the decoded vector is from the real one. Codes lie in a table bucketed
by list, and each id's list in a table bucketed by id, so that writes by id touch their
buckets only (keyed_table), and a search reads the buckets of the lists it visits.

A search has three steps:
1. Queries go to their nearest lists, where blocks of queries meet blocks of codes; the best
   rows by decoded score are scored again on the real vectors.
2. Exact searches then visit all other lists that can still matter: a row's score is at most
   its decoded score plus its error, a list's at most the centroid's score plus the list's
   radius. Rows that can reach the k-th score found so far are scored on the real vectors, so
   the result is that of a full scan, while the scan reads bytes instead of floats.
3. Approximate searches stop after step 1. `probes_for` measures on the fitting sample how
   many lists a recall takes.

Centroids and code books are fitted on at most SAMPLE rows, chosen by a hash of the id; every
row is indexed. Null vectors and ones with null or non-finite entries aren't indexed; a zero
vector has score 0 with everything; shorter vectors are padded with zeros, longer ones than
the index's are an error. A filter compares labels; null labels match nothing then.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import blocks
from tidemill.operators.keyed_table import KeyedTable
from tidemill.session import shuffled

#: Rows that centroids and code books are fitted on, at most some; lists at most; values of a code.
SAMPLE, MAX_LISTS, VALUES = 20_000, 4096, 256
#: Rows scored on real vectors in the first step, times k; slack for sums in another order.
DEEPER, SLACK = 4, 1e-6
#: Recall, on the sample, that the number of lists is chosen for.
RECALL = 0.98
BUCKETS = 32


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = closest(x, centres)
        counts = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)])
    return centres


#: Numbers that a product of rows and centres may hold at once, so that it doesn't grow with the lists.
PRODUCT = 1 << 20


def shares(rows: int, centres: int) -> Iterator[slice]:
    """Runs of rows that meet all centres at once."""
    step = max(1, PRODUCT // max(centres, 1))
    return (slice(at, at + step) for at in range(0, rows, step))


def closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres * centres).sum(axis=1) / 2
    found = [(x[s] @ centres.T - half).argmax(axis=1) for s in shares(len(x), len(centres))]
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def units(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


@dataclass
class Model:
    """Coarse centroids (lists x width) and, for each group of dimensions, its code book."""

    coarse: np.ndarray
    books: list[np.ndarray]
    width: int

    @classmethod
    def fit(cls, x: np.ndarray, lists: int, code_bytes: int, seed: int = 7) -> Model:
        rng, x = np.random.default_rng(seed), units(x)
        coarse = k_means(x, min(lists, len(x)), rng)
        rest = x - coarse[closest(x, coarse)]
        books = []
        for columns in np.array_split(np.arange(x.shape[1]), min(code_bytes, x.shape[1])):
            part = rest[:, columns]
            if len(columns) == 1:  # quantiles start better than random rows in one dimension
                books.append(np.quantile(part[:, 0], np.linspace(0, 1, VALUES))[:, None])
            else:
                books.append(k_means(part, min(VALUES, len(x)), rng))
        return cls(coarse, books, x.shape[1])

    @property
    def columns(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.width), len(self.books))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each row's list, codes, the decoded row's error and the row's distance from the centroid."""
        if x.shape[1] > self.width:
            raise ValueError(f"vectors of {x.shape[1]} dimensions in an index of {self.width}")
        x = units(np.pad(x, ((0, 0), (0, self.width - x.shape[1]))))
        lists = closest(x, self.coarse)
        rest = x - self.coarse[lists]
        codes = np.stack([closest(rest[:, c], b) for c, b in zip(self.columns, self.books, strict=True)], axis=1).astype(np.uint8)
        errors = np.sqrt(((x - self.decode(lists, codes)) ** 2).sum(axis=1))
        return lists, codes, errors, np.sqrt((rest * rest).sum(axis=1))

    def decode(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return self.coarse[lists] + np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)


ENTRY = "list int, vec_id long, label string, code binary, error double, radius double"


def _encoding(model: Model) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists, codes, errors, radii = model.encode(blocks.matrix(batch["embedding"]))
                columns = [pa.array(lists.astype(np.int32)), batch["vec_id"], batch["label"], pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(errors), pa.array(radii)]
                yield pa.RecordBatch.from_arrays(columns, ["list", "vec_id", "label", "code", "error", "radius"])

    return run


def _visiting(model: Model, probes: int) -> Callable:
    """Queries to the lists they visit first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = units(blocks.matrix(batch["vector"], model.width))
                for s in shares(len(x), len(model.coarse)):
                    near = np.argsort(-(x[s] @ model.coarse.T), axis=1, kind="stable")[:, :probes].astype(np.int32)
                    part = batch.slice(s.start, len(near))
                    yield pa.RecordBatch.from_arrays([part["query_id"], part["vector"], part["label"], pa.array(list(near), pa.list_(pa.int32()))], ["query_id", "vector", "label", "lists"])

    return run


def _code_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries to blocks of one key each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        key, ids, lists, errors = np.array(batch["key"].to_pylist(), object), batch["vec_id"].to_numpy(), batch["list"].to_numpy(), batch["error"].to_numpy()
        codes = batch["code"].to_pylist()
        parts = list(blocks.runs(key.astype(str), blocks.ROWS))
        columns = [[key[p[0]] for p in parts], [int(lists[p[0]]) for p in parts], [ids[p].tobytes() for p in parts], [b"".join(codes[i] for i in p) for p in parts], [errors[p].tobytes() for p in parts]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary()], strict=True)], ["key", "list", "ids", "codes", "errors"])


def _decoded(model: Model, best: int | None) -> Callable:
    """Blocks of queries and codes to candidates: the `best` of each query by decoded score, or all that reach its floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in blocks.one_by_one(batches):
            out = []
            ids, errors = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["errors"], np.float64)
            codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
            qi = np.array(row["q_ids"], np.int64)
            q = units(blocks.unpacked(row["q_data"], len(qi), row["q_width"], model.width))
            floor = q[:, :0] if best else None
            scores = q @ model.decode(np.full(len(ids), row["list"]), codes).T
            for j, i in enumerate(qi):
                there = np.flatnonzero(ids != i)
                if floor is None:
                    # A score of 0 stands for all below it, so a floor of 0 keeps every row.
                    there = there[(scores[j, there] + errors[there] >= row["floors"][j] - SLACK) | (row["floors"][j] <= 0)]
                elif len(there) > best:
                    there = there[np.argpartition(-scores[j, there], best - 1)[:best]]
                out.append((np.full(len(there), i), ids[there], scores[j, there]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def _real(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates with both vectors to their scores, by blocks.paired."""
    for batch in batches:
        if batch.num_rows:
            q, v = (blocks.matrix(batch[c]) for c in ("vector", "embedding"))
            width = max(q.shape[1], v.shape[1])
            q, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, v))
            yield pa.RecordBatch.from_arrays([batch["query_id"], batch["vec_id"], pa.array(blocks.paired(q, v))], ["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.entries, self.places = KeyedTable(spark, f"{path}/entries"), KeyedTable(spark, f"{path}/places")

    # Building and upkeep --------------------------------------------------------

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None, code_bytes: int | None = None) -> VectorIndex:
        """Index all usable rows of vectors(vec_id, embedding, label); one byte a dimension unless told otherwise."""
        index, rows = cls(vectors.sparkSession, path), _usable(vectors)
        n = rows.count()
        every = max(1, math.ceil(n / SAMPLE))
        drawn = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).select("embedding").toArrow()["embedding"].combine_chunks()
        sample = blocks.matrix(drawn) if len(drawn) else np.zeros((1, 1))
        lists = lists or max(1, min(MAX_LISTS, round(math.sqrt(n)), len(sample) // 8))
        model = Model.fit(sample, lists, code_bytes or sample.shape[1])
        size = "coarse binary, books array<binary>, width int"
        index.spark.createDataFrame([(model.coarse.tobytes(), [b.tobytes() for b in model.books], model.width)], size).write.parquet(f"{path}/model")
        index._sample(sample)
        coded = rows.mapInArrow(_encoding(model), ENTRY)
        index.entries.create(coded, ["list", "vec_id"], bucket_by=["list"], n_buckets=min(BUCKETS, lists))
        index.places.create(index.entries.read().select("vec_id", "list"), ["vec_id"], n_buckets=BUCKETS)
        return index

    def _sample(self, sample: np.ndarray) -> None:
        """Some of the sample, for probes_for."""
        rows = [(x.tolist(),) for x in sample[:: max(1, len(sample) // 2000)]]
        self.spark.createDataFrame(rows, "vector array<double>").write.parquet(f"{self.path}/sample")

    def model(self) -> Model:
        row = self.spark.read.parquet(f"{self.path}/model").first()
        widths = [len(c) for c in np.array_split(np.arange(row.width), len(row.books))]
        return Model(np.frombuffer(row.coarse).reshape(-1, row.width), [np.frombuffer(b).reshape(-1, w) for b, w in zip(row.books, widths, strict=True)], row.width)

    def upsert(self, vectors: DataFrame) -> None:
        """Add rows, or replace those with the same vec_id, which may move to another list."""
        coded = _stored(_usable(vectors).mapInArrow(_encoding(self.model()), ENTRY), f"{self.path}/writes")
        self._leave(coded, stay=coded)
        self.entries.upsert(coded)
        self.places.upsert(coded.select("vec_id", "list"))

    def delete(self, ids: DataFrame) -> None:
        self._leave(ids)
        self.places.delete(ids.select("vec_id"))

    def _leave(self, ids: DataFrame, stay: DataFrame | None = None) -> None:
        """Take ids out of the lists they are in, but for those that keep their list."""
        version = self.places.version()
        held = self.places._read(version, self.places._hit(ids, version) & set(version.buckets))
        old = held.join(shuffled(ids.select("vec_id").distinct()), "vec_id", "left_semi")
        if stay is not None:
            old = old.join(shuffled(stay.select("vec_id", "list")), ["vec_id", "list"], "left_anti")
        self.entries.delete(_stored(old.select("list", "vec_id"), f"{self.path}/writes"))

    # Searching -------------------------------------------------------------------

    def probes_for(self, recall: float, k: int = 15, asked: int = 200) -> int:
        """Lists to visit for this recall of the k nearest, as measured on part of the fitting sample."""
        model = self.model()
        x = units(blocks.matrix(self.spark.read.parquet(f"{self.path}/sample").toArrow()["vector"].combine_chunks(), model.width))
        q, lists, k = x[:asked], closest(x, model.coarse), min(k, max(1, len(x) - 1))
        scores = q @ x.T
        scores[np.arange(len(q)), np.arange(len(q))] = -2
        best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(np.argsort(-(q @ model.coarse.T), axis=1, kind="stable"), axis=1)
        needed = np.sort(np.take_along_axis(order, lists[best], axis=1).ravel())
        return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1

    def bytes_read(self, lists: set[int] | None = None) -> int:
        """Bytes of the buckets that hold these lists (all, if none are named)."""
        files = self._of_lists(lists).inputFiles()
        return sum(int(fs.getFileStatus(p).getLen()) for p, fs in map(self.entries._hadoop, files))

    def _of_lists(self, lists: set[int] | None) -> DataFrame:
        if lists is None:
            return self.entries.read()
        v = self.entries.version()
        rows = self.spark.createDataFrame([(int(x),) for x in lists], "list int")
        return self.entries._read(v, self.entries._hit(rows, v))

    def search(self, queries: DataFrame, vectors: DataFrame, k: int = 15, same_label: bool = False, probes: int | None = None, exact: bool = True) -> DataFrame:
        """query_id, pos, vec_id, score of queries(query_id, vector, label), as retrieval.pools gives them.

        vectors(vec_id, embedding): where the real vectors of the candidates are taken from.
        """
        model, work = self.model(), f"{self.path}/searches"
        if not probes:
            # Of a query's label there are fewer rows, and the k nearest of them lie as far out as k times the labels.
            labels = self.entries.read().agg(F.approx_count_distinct("label")).first()[0] if same_label else 1
            probes = self.probes_for(RECALL, k * max(1, labels))
        probes = min(len(model.coarse), probes)
        q = queries.where(blocks.usable(F.col("vector")) & F.col("query_id").isNotNull())
        q = q.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"), F.col("label").cast("string").alias("label"))
        q = _stored(q.where("label IS NOT NULL") if same_label else q, work)
        label = F.concat(F.lit("|"), "label") if same_label else F.lit("")
        key = F.concat(F.col("list").cast("string"), label)
        visits = q.mapInArrow(_visiting(model, probes), "query_id long, vector array<double>, label string, lists array<int>")
        first = visits.select("query_id", "vector", F.explode("lists").alias("list"), "label")
        found = self._meet(first, key, model, k * DEEPER)
        found = blocks.top(found, k * DEEPER).select("query_id", "vec_id")
        found = _stored(self._scored(found, q, vectors), work)
        if not exact:
            return blocks.top(found, k).select("query_id", "pos", "vec_id", "score")
        # The k-th score so far; queries with fewer rows take whatever there is.
        floors = blocks.top(found, k).groupBy("query_id").agg(F.max(F.when(F.col("pos") == k, F.col("score"))).alias("floor"))
        asked = q.join(shuffled(floors), "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        radii = self.entries.read().groupBy("list").agg(F.max("radius").alias("radius"), F.max("error").alias("error"))
        reach = {r.list: r.radius for r in radii.collect()}  # a number for each list
        every = asked.mapInArrow(_reaching(model, reach), "query_id long, vector array<double>, label string, floor double, lists array<int>")
        second = every.select("query_id", "vector", "floor", F.explode("lists").alias("list"), "label")
        more = self._meet(second, key, model, None).select("query_id", "vec_id").distinct()
        return blocks.top(self._scored(more, q, vectors), k).select("query_id", "pos", "vec_id", "score")

    def _meet(self, visits: DataFrame, key: Column, model: Model, best: int | None) -> DataFrame:
        """Candidates among the entries of the lists that are visited; only these lists' buckets are read."""
        lists = {r[0] for r in visits.select("list").distinct().collect()}  # at most MAX_LISTS numbers
        entries = self._of_lists(lists).withColumn("key", key).where("key IS NOT NULL").select("key", "list", "vec_id", "code", "error")
        entries = entries.mapInArrow(_code_blocks, "`key` string, list int, ids binary, codes binary, errors binary")
        floor = F.col("floor") if best is None else F.lit(0.0)
        rows = visits.select("query_id", "vector", floor.alias("floor"), key.alias("key")).repartition("key").sortWithinPartitions("key")
        packed = rows.mapInArrow(_query_blocks(model.width), "q_key string, q_ids array<long>, q_width int, q_data binary, floors array<double>")
        return entries.join(shuffled(packed), F.col("key") == F.col("q_key")).drop("key", "q_key").mapInArrow(_decoded(model, best), FOUND)

    @staticmethod
    def _scored(pairs: DataFrame, q: DataFrame, vectors: DataFrame) -> DataFrame:
        real = vectors.where(blocks.usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
        return pairs.join(shuffled(real), "vec_id").join(shuffled(q.select("query_id", "vector")), "query_id").select("query_id", "vec_id", "vector", "embedding").mapInArrow(_real, FOUND)


def _query_blocks(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, floors, x = np.array(batch["key"].to_pylist(), object), batch["query_id"].to_numpy(), batch["floor"].to_numpy(), blocks.matrix(batch["vector"], width)
            parts = list(blocks.runs(key.astype(str), blocks.QUERIES))
            columns = [pa.array([key[p[0]] for p in parts]), pa.array([ids[p] for p in parts], pa.list_(pa.int64())), pa.array([width] * len(parts), pa.int32()), pa.array([x[p].tobytes() for p in parts], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([floors[p] for p in parts], pa.list_(pa.float64()))], ["q_key", "q_ids", "q_width", "q_data", "floors"])

    return run


def _reaching(model: Model, reach: dict[int, float]) -> Callable:
    """Queries to all lists in which a row may reach their floor."""
    lists = np.array(sorted(reach), np.int32)
    radii = np.array([reach[i] for i in lists.tolist()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = units(blocks.matrix(batch["vector"], model.width))
                floors = batch["floor"].to_numpy()
                for s in shares(len(x), len(lists)):
                    open_ = (x[s] @ model.coarse[lists].T + radii >= floors[s, None] - SLACK) | (floors[s, None] <= 0)
                    part = batch.slice(s.start, len(open_))
                    yield pa.RecordBatch.from_arrays([*[part[c] for c in ("query_id", "vector", "label", "floor")], pa.array([lists[o] for o in open_], pa.list_(pa.int32()))], ["query_id", "vector", "label", "floor", "lists"])

    return run


def _usable(vectors: DataFrame) -> DataFrame:
    rows = vectors.where(blocks.usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    label: Column = F.col("label").cast("string") if "label" in vectors.columns else F.lit(None).cast("string")
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", label.alias("label"))


def _stored(df: DataFrame, folder: str) -> DataFrame:
    """df written below the folder and read back."""
    path = f"{folder}/{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
