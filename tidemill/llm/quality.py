"""Quality classifier: Bradley-Terry pairwise ranking (operator 3).

One pass turns the whole text of every labelled row whose crc32(doc_id) mod 5 is not 0 into a
short feature vector; these are written once, and the model is made of all of them. Every good
row is preferred to every bad one, and the weights maximise the Bradley-Terry likelihood of all
these pairs: logistic loss on feature differences, by Newton steps.

The pairs are never listed. A pair's probability depends on its two scores alone, so rows of a
label whose scores share a narrow bin (1 / BINS on the scale of asinh) stand for each other with
their mean score: counts and feature sums by label and bin give the gradient, and one more pass
with the bins' weights gives the curvature. What this rounds is the probability, by some 1e-6;
on sf0.1 weights differ from those of the listed pairs by 6e-5. Each step is two passes over the
vectors, and only bins and matrices reach the driver.

The threshold is the exact quantile of all these rows' raw scores at their share of bad labels,
found by counting in ever narrower ranges; scores are squashed so that this quantile lies at
0.3. Labels, lang, source and doc_id are no features. Sums are rounded to ten digits, so that
the order in which tasks end leaves no trace in the weights.

Edge cases: null text is as empty; a null doc_id is not held out; labels that repeat an id
count as the lowest; without labels of both kinds every score is 0.5 and `keep_good` keeps
all rows; repeated rows get a row each, with the same score; very long texts are read whole, one at a time; an empty table gives
no rows; only doc_id and text are read, so further columns, whatever their names, do no harm.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tidemill.llm.common import materialise, pick, small_batches

CUT = 0.3
#: Bins of scores to one unit of asinh, and of raw scores in one count of the threshold's search.
BINS, RANGES = 256, 4096
#: Newton steps end below this; the bins' rounding lies far under it.
STEP = 1e-4

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'\"-()"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
FEATURES = 16


def features(text: bytes) -> list[float]:
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * FEATURES
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(hist.sum()) - int(hist[[32, 9, 10, 11, 12, 13]].sum())
    symbols = int(hist[_SYMBOL].sum())
    letters_high = chars - symbols - int(hist[_DIGIT].sum())
    counts = Counter(words)
    repeats = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lines = text.split(b"\n")
    short = sum(len(x.split()) < 4 for x in lines) / len(lines)
    bars, bangs = int(hist[124]), int(hist[33])
    other = symbols - bars - bangs
    upper = int(hist[_UPPER].sum())
    return [
        symbols / chars,
        np.log1p(other),
        other / n,
        np.log1p(bars),
        bars / n,
        np.log1p(bangs),
        bangs / n,
        upper / max(letters_high, 1),
        np.log1p(max(upper - 0.2 * n, 0)),
        repeats / n,
        np.log1p(repeats),
        len(counts) / n,
        max(counts.values()) / n,
        1 - len(set(lines)) / len(lines),
        short,
        np.log1p(n),
    ]


@F.arrow_udf(returnType=ArrayType(DoubleType()))
def feature_column(text: pa.Array) -> pa.Array:
    return pa.array([list(map(float, features(x.as_py() or b""))) for x in text.cast(pa.binary())], pa.list_(pa.float64()))


@dataclass
class Ranker:
    mean: np.ndarray
    weight: np.ndarray  # on raw features
    cut: float
    steep: float

    def raw(self, x: Column) -> Column:
        raw = F.lit(0.0)
        for i, (m, w) in enumerate(zip(self.mean, self.weight, strict=True)):
            raw = raw + (x[i] - F.lit(float(m))) * F.lit(float(w))
        return raw

    def score(self, x: Column) -> Column:
        z = (self.raw(x) - F.lit(self.cut)) * F.lit(self.steep) + F.lit(float(np.log(CUT / (1 - CUT))))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _ten_digits(x: np.ndarray) -> np.ndarray:
    return np.array([float(f"{v:.9e}") for v in np.ravel(x)]).reshape(np.shape(x))


@dataclass
class Bins:
    """Counts and sums of standardised features of the rows of one label, by bin of their scores."""

    bin: np.ndarray
    n: np.ndarray
    total: np.ndarray


#: Bad and good rows' bins under these weights, and the sums of z z' times the weight of the row's label and bin.
Sums = Callable[[np.ndarray], tuple[Bins, Bins]]
Curvature = Callable[[np.ndarray, list[tuple[np.ndarray, np.ndarray]]], np.ndarray]


def _bins(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.floor(np.arcsinh(z @ w) * BINS).astype(np.int64)


def binned(z: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[Bins, Bins]:
    found = []
    for label in (0, 1):
        rows = z[y == label]
        bins, at = np.unique(_bins(rows, w), return_inverse=True)
        total = np.zeros((len(bins), z.shape[1]))
        np.add.at(total, at, rows)
        found.append(Bins(bins, np.bincount(at, minlength=len(bins)), total))
    return found[0], found[1]


def curved(z: np.ndarray, y: np.ndarray, w: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros((z.shape[1], z.shape[1]))
    for label, (bins, weight) in enumerate(weights):
        rows = z[y == label]
        if len(rows):
            out += (rows * weight[np.searchsorted(bins, _bins(rows, w))][:, None]).T @ rows
    return out


def likeliest(width: int, sums: Sums, curvature: Curvature) -> np.ndarray:
    """Bradley-Terry weights from the preferences of all good over all bad rows, by Newton steps."""
    w = np.zeros(width)
    for _ in range(40):
        bad, good = sums(w)
        of_bad, of_good = bad.total @ w / bad.n, good.total @ w / good.n
        slope, cross = np.zeros(width), np.zeros((width, width))
        bad_weight, good_weight = np.zeros(len(bad.n)), np.zeros(len(good.n))
        for lo in range(0, len(good.n), 512):
            part = slice(lo, lo + 512)
            p = 1 / (1 + np.exp(np.clip(of_good[part, None] - of_bad[None], -30, 30)))  # probability of the wrong order
            slope += (p @ bad.n) @ good.total[part] - (good.n[part] @ p) @ bad.total
            spread = p * (1 - p)
            cross += good.total[part].T @ spread @ bad.total
            good_weight[part] = spread @ bad.n
            bad_weight += good.n[part] @ spread
        pairs = float(bad.n.sum()) * float(good.n.sum())
        curve = (curvature(w, [(bad.bin, bad_weight), (good.bin, good_weight)]) - cross - cross.T) / pairs
        step = np.linalg.solve(curve + 1e-3 * np.eye(width), slope / pairs - 1e-3 * w)
        w = _ten_digits(w + np.clip(step, -2, 2))
        if np.abs(step).max() < STEP:
            break
    return w


def _scale(n: float, total: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of the features from shifted sums; what doesn't vary has spread 1."""
    mean = total / n
    spread = np.sqrt(np.maximum(squares / n - mean**2, 0))
    return mean, _ten_digits(np.where(spread < 1e-7, 1, spread))


def _between(low: float, high: float, n_bad: int, n: int) -> float:
    """The quantile at n_bad / n from the values at places n_bad - 1 and n_bad, as numpy takes it."""
    return low + (1 - n_bad / n) * (high - low)


def train(x: np.ndarray, y: np.ndarray) -> Ranker | None:
    """The ranker of rows at hand, by the steps that `fit` takes on rows in Spark."""
    n, n_bad = len(y), int((y == 0).sum())
    if not n_bad or n_bad == n:
        return None
    shift = _ten_digits(x.mean(axis=0))
    off, spread = _scale(n, (x - shift).sum(axis=0), ((x - shift) ** 2).sum(axis=0))
    mean = _ten_digits(shift + off)
    z = (x - mean) / spread
    weight = likeliest(x.shape[1], lambda w: binned(z, y, w), lambda w, weights: curved(z, y, w, weights)) / spread
    raw = np.sort((x - mean) @ weight)
    return Ranker(mean, weight, _between(raw[n_bad - 1], raw[n_bad], n_bad, n), float(_ten_digits(2 / max(raw.std(), 1e-9))))


def crc_mod(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            yield b.column("x").flatten().to_numpy().reshape(b.num_rows, FEATURES), b.column("y").to_numpy()


def _totals(rows: DataFrame, label: str, shift: np.ndarray | None = None) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """By label: rows, sums and sums of squares of the features less shift."""
    x = [F.col("x")[i] - F.lit(float(shift[i] if shift is not None else 0)) for i in range(FEATURES)]
    found = rows.groupBy(label).agg(F.count("*").alias("n"), F.array(*[F.sum(c) for c in x]).alias("s"), F.array(*[F.sum(c * c) for c in x]).alias("q"))
    return {r[label]: (r["n"], np.array(r["s"]), np.array(r["q"])) for r in found.collect()}


def _sums(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, w: np.ndarray) -> tuple[Bins, Bins]:
    names = [f"s{i}" for i in range(FEATURES)]

    def run(batches):
        for x, y in _blocks(batches):
            for label, b in enumerate(binned((x - mean) / spread, y, w)):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.n), label)), pa.array(b.bin), pa.array(b.n), *map(pa.array, b.total.T.copy())], ["y", "bin", "n", *names])

    parts = rows.mapInArrow(run, ", ".join(["y long", "bin long", "n long", *(f"{n} double" for n in names)]))
    t = parts.groupBy("y", "bin").agg(F.sum("n").alias("n"), *[F.sum(n).alias(n) for n in names]).toArrow().sort_by([("y", "ascending"), ("bin", "ascending")])
    y, (bins, n) = t["y"].to_numpy(), (t[c].to_numpy() for c in ("bin", "n"))
    total = np.stack([t[c].to_numpy() for c in names], axis=1)
    bad, good = (Bins(bins[y == k], n[y == k], total[y == k]) for k in (0, 1))
    return bad, good


def _curvature(rows: DataFrame, mean: np.ndarray, spread: np.ndarray, w: np.ndarray, weights: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    def run(batches):
        out = np.zeros((FEATURES, FEATURES))
        for x, y in _blocks(batches):
            out += curved((x - mean) / spread, y, w, weights)
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel()], pa.list_(pa.float64()))], ["cells"])

    cells = rows.mapInArrow(run, "cells array<double>").toArrow()["cells"].combine_chunks()  # one small matrix a task
    return cells.flatten().to_numpy().reshape(-1, FEATURES, FEATURES).sum(axis=0)


def neighbours(values: DataFrame, place: int) -> tuple[float, float]:
    """The values at places place - 1 and place (from 0) of the one column of values, in order; by counts in ever narrower ranges."""
    v = F.col(values.columns[0])
    low, high, before = *values.agg(F.min(v), F.max(v)).first(), 0
    while low < high:
        slot = F.least(F.floor((v - F.lit(low)) / F.lit(high - low) * RANGES), F.lit(RANGES - 1))
        slots = values.where(v.between(low, high)).groupBy(slot.alias("slot")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).collect()
        slots.sort(key=lambda s: s["slot"])
        for i, s in enumerate(slots):  # the slot of place - 1
            if before + s["n"] >= place:
                break
            before += s["n"]
        if before + s["n"] == place:
            return s["high"], slots[i + 1]["low"]
        low, high = s["low"], s["high"]
    return low, high


def fit(docs: DataFrame, labels: DataFrame) -> Ranker | None:
    """The ranker of docs(doc_id, text), learned from all rows of labels(doc_id, quality) that aren't held out."""
    small_batches(docs.sparkSession)
    slim = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")).where(crc_mod(F.col("doc_id")) != 0)
    known = pick(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(crc_mod(F.col("doc_id")) != 0)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("y"))
    vectors = slim.select("doc_id", feature_column("text").alias("x"))  # before the join, which so shuffles no text
    rows = materialise(vectors.join(known, "doc_id").select("y", "x"), "vectors")
    plain = _totals(rows, "y")
    if set(plain) != {0, 1}:
        return None
    n, n_bad = plain[0][0] + plain[1][0], plain[0][0]
    shift = _ten_digits((plain[0][1] + plain[1][1]) / n)
    moved = _totals(rows, "y", shift)  # squares about the mean, as those about 0 would cancel
    off, spread = _scale(n, moved[0][1] + moved[1][1], moved[0][2] + moved[1][2])
    mean = _ten_digits(shift + off)
    weight = likeliest(FEATURES, lambda w: _sums(rows, mean, spread, w), lambda w, weights: _curvature(rows, mean, spread, w, weights)) / spread
    ranker = Ranker(mean, weight, 0.0, 1.0)
    raw = rows.select(ranker.raw(F.col("x")).alias("raw"))
    ranker.cut = _between(*neighbours(raw, n_bad), n_bad, n)
    ranker.steep = float(_ten_digits(2 / max(raw.agg(F.stddev_pop("raw")).first()[0], 1e-9)))
    return ranker


def _score(ranker: Ranker | None) -> Column:
    return ranker.score(feature_column("text")) if ranker else F.lit(0.5)


def rank_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs(doc_id, text)."""
    slim = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    held_out = F.coalesce(crc_mod(F.col("doc_id")) == 0, F.lit(False))
    rows = slim.select("doc_id", held_out.alias("held_out"), _score(fit(docs, labels)).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of docs that score at least CUT, with all their columns; rows with a null text are as empty ones.

    Only texts go to the workers; no row is shuffled.
    """
    return docs.where(_score(fit(docs, labels)) >= CUT).select(docs.columns)
