"""Embedding whitening by matrix-free block subspace iteration (operator 12).

Every entry c becomes the whole number x = floor(64 c) + 1000000. The covariance matrix is
never formed: a pass over the vectors gives X'(XQ) for a block Q of orthonormal columns.

1. One pass counts the rows and adds up each dimension, exactly.
2. Each further pass multiplies the block by the centred rows, in tasks that give back one
   block of sums; those meet by dimension, in two steps of partial sums. On the driver, whose
   share has the size of the block, a Rayleigh-Ritz step turns it to the best vectors within
   it and a QR step makes the next block. It ends when the residuals of all k components are
   below TOLERANCE of the largest eigenvalue. A block of all dimensions is exact after one
   pass, so blocks hold k + OVERSAMPLE columns if there are as many, and are widened when
   PATIENCE passes did not suffice. So it ends for eigenvalues close to each other, too.
3. The last pass projects all rows, and a pass over the result measures its covariance.

Rows are centred before anything is multiplied: whole parts of the means are subtracted as
whole numbers, and their fractions after that, so that the large common offset costs no
digits.

Edge cases: rows whose vector is null or holds null or non-finite entries are dropped;
repeated rows count as often as they occur, and rows without vec_id take part and keep their
null; vectors shorter than the longest have zeros in the missing places; entries beyond
+-2**36 count as +-2**36; directions in which all rows agree have no components, so fewer
than k may come back, and none for one row or for equal rows; deviations that no long holds
are null; an empty table gives no rows; only vec_id and embedding are read, so further
columns, whatever their names, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import materialise, pick, small_batches
from tidemill.llm.vectors import matrix

SCALE, OFFSET, LIMIT = 64, 1_000_000, 2.0**36
#: Columns of a block beyond those asked for; passes before a block is widened; residual of a component against the largest eigenvalue.
OVERSAMPLE, PATIENCE, TOLERANCE = 32, 20, 1e-13
#: Groups in which the tasks' sums of a dimension are added up first.
GROUPS = 64


@dataclass
class Whitening:
    """What the fit list says: n rows, sums by dimension, eigenvectors as columns, their eigenvalues, the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int
    residuals: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace


def whole(values: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * np.clip(values, -LIMIT, LIMIT)).astype(np.int64) + OFFSET


def centred(x: np.ndarray, sums: list[int], n: int) -> np.ndarray:
    """x - S/n to double precision: whole numbers first, then the fractions."""
    floors = np.array([s // n for s in sums], np.int64)
    fractions = np.array([s % n / n for s in sums])
    return (x - floors).astype(np.float64) - fractions


def deviations(x: np.ndarray, sums: list[int], n: int) -> list[int | None]:
    """The sum over the dimensions of (n x - S)^2, in whole numbers; null beyond a long."""
    floors = np.array([s // n for s in sums], np.int64)
    rests = np.array([s % n for s in sums], np.int64)
    whole_part = x - floors
    largest = (int(np.abs(whole_part).max(initial=0)) + 1) * n
    if largest**2 * max(x.shape[1], 1) < 2**63:
        return ((whole_part * n - rests) ** 2).sum(axis=1).tolist()
    exact = whole_part.astype(object) * n - rests.astype(object)
    return [v if v < 2**63 else None for v in (exact**2).sum(axis=1)]


def fit_list(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = pick(vectors, "vec_id", "embedding").where(F.col("embedding").isNotNull() & ~bad)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a dimension: rows that reach it, and the sum of their entries. Dimension -1: all rows."""
    counts, totals, n = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for batch in batches:
        n += batch.num_rows
        lengths = np.diff(batch["embedding"].offsets.to_numpy())
        d = int(lengths.max(initial=0))
        if d > len(totals):
            counts, totals = (np.pad(a, (0, d - len(a))) for a in (counts, totals))
        x = whole(matrix(batch["embedding"], d))
        there = np.arange(d) < lengths[:, None]
        counts[:d] += there.sum(axis=0)
        totals[:d] += np.where(there, x, 0).sum(axis=0)
    columns = [np.arange(-1, len(totals), dtype=np.int32), np.append(n, counts), np.append(0, totals)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "there", "total"])


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and each dimension's sum; missing entries are 0, so OFFSET as whole numbers."""
    parts = rows.select("embedding").mapInArrow(_sums, "i int, there long, total long")
    found = parts.groupBy("i").agg(F.sum("there").alias("there"), F.sum(F.col("total").cast("decimal(38)")).alias("total")).orderBy("i").collect()
    n = found[0].there if found else 0
    return n, [int(r.total) + (n - r.there) * OFFSET for r in found[1:]]


def _products(block: np.ndarray, sums: list[int], n: int):
    """X'(XQ) of a task's rows, one row a dimension; the last row has the sum of all squares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, squares, seen = np.zeros_like(block), 0.0, 0
        for batch in batches:
            a = centred(whole(matrix(batch["embedding"], len(block))), sums, n)
            out += a.T @ (a @ block)
            squares += float((a * a).sum())
            seen += len(a)
        if seen:
            values = [*out.tolist(), [squares]]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int32()), pa.array(values, pa.list_(pa.float64()))], ["i", "sums"])

    return run


def added(parts: DataFrame, width: int) -> dict[int, np.ndarray]:
    """The sums of the tasks' rows by i: first within groups of tasks, then over the groups."""
    cells = parts.withColumn("_group", F.spark_partition_id() % GROUPS)
    total = [F.sum(F.get("sums", F.lit(j))).alias(f"s{j}") for j in range(width)]
    grouped = cells.groupBy("i", "_group").agg(F.array(*total).alias("sums"))
    return {r.i: np.array([np.nan if v is None else v for v in r.sums]) for r in grouped.groupBy("i").agg(F.array(*total).alias("sums")).collect()}


def multiplied(rows: DataFrame, block: np.ndarray, sums: list[int], n: int) -> tuple[np.ndarray, float]:
    """The covariance times the block, and the covariance's trace: one pass over the rows."""
    d, p = block.shape
    found = added(rows.select("embedding").mapInArrow(_products(block, sums, n), "i int, sums array<double>"), p)
    return np.stack([found[i] for i in range(d)]) / n, float(found[d][0]) / n


def fit(vectors: DataFrame, k: int = 32, oversample: int | None = None, seed: int = 12) -> Whitening | None:
    """The k leading components of all usable vectors; None if there are no rows or no entries."""
    small_batches(vectors.sparkSession)
    rows = fit_list(vectors)
    n, sums = exact_sums(rows)
    d = len(sums)
    if not n or not d:
        return None
    k, passes, waited = min(k, d), 0, 0
    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.standard_normal((d, min(d, k + (OVERSAMPLE if oversample is None else oversample)))))[0]
    while True:
        image, trace = multiplied(rows, block, sums, n)
        passes, waited = passes + 1, waited + 1
        inner = block.T @ image
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = block @ turn
        residuals = np.linalg.norm(image @ turn - ritz * values, axis=0)[:k]
        if (residuals <= TOLERANCE * max(values[0], 1e-300)).all() or block.shape[1] == d:
            break
        block = image @ turn
        if waited >= PATIENCE:
            more = min(block.shape[1], d - block.shape[1])
            block, waited = np.concatenate([block, rng.standard_normal((d, more)) * values[0]], axis=1), 0
        block = np.linalg.qr(block)[0]
    real = values[:k] > trace * d * 2.0**-50
    return Whitening(n, sums, ritz[:, :k][:, real], values[:k][real], trace, passes, residuals[real])


def _projected(model: Whitening):
    scale = model.components / np.sqrt(model.eigenvalues)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = whole(matrix(batch["embedding"], len(scale)))
            out = centred(x, model.sums, model.n) @ scale
            k = out.shape[1]
            white = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * k), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(deviations(x, model.sums, model.n), pa.int64()), white], ["vec_id", "deviation", "whitened"])

    return run


def transform(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation and the whitened vector of every usable row."""
    return fit_list(vectors).mapInArrow(_projected(model), "vec_id long, deviation long, whitened array<double>")


def _spread(mean: np.ndarray | None, k: int):
    """Sums of a task's whitened rows or, given their mean, of the products of centred ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((1 if mean is None else k, k))
        for batch in batches:
            w = matrix(batch["whitened"], k)
            out += w.sum(axis=0)[None] if mean is None else (w - mean).T @ (w - mean)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out.tolist(), pa.list_(pa.float64()))], ["i", "sums"])

    return run


def identity_error(white: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, centred before multiplying."""
    rows, schema = white.select("whitened"), "i int, sums array<double>"
    mean = added(rows.mapInArrow(_spread(None, k), schema), k)[0] / n
    found = added(rows.mapInArrow(_spread(mean, k), schema), k)
    return float(np.abs(np.stack([found[i] for i in range(k)]) / n - np.eye(k)).max())


def whitened(vectors: DataFrame, k: int = 32) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    spark = vectors.sparkSession
    model = fit(vectors, k)
    if model is None or not len(model.eigenvalues):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = materialise(transform(vectors, model), "whitened")
    error = identity_error(white, model.n, len(model.eigenvalues))
    rows = white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    shares = F.array(*[F.lit(float(s)) for s in model.explained])
    return rows.select(
        "vec_id", (F.col("place") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("place")).alias("explained"), F.lit(error).alias("identity_error"),
    )
