"""MinHash near-dedup by HyperMinHash sketches (operator 9).

1. Every text becomes its set of word shingles, as 64-bit hashes, and a HyperMinHash
   sketch: 256 buckets, each holding the leading-zero count and ten mantissa bits of its
   smallest hash. Documents with the same set form a class; only classes go on.
2. Registers are banded (42 bands of 6). Empty buckets borrow, for banding only, from
   the first filled bucket in a fixed random order, so that short texts keep the
   selectivity of long ones. A pair at similarity 0.8 misses all bands with a
   probability of 3e-6.
3. In each band group every class pairs with the group's smallest id: as many pairs as
   rows. The collision-corrected Jaccard estimate drops pairs more than five standard
   errors under the threshold; the rest are confirmed on their full sets.
4. All groups with one smallest id are a family. In families that still hold several
   components, all members outside the largest component are compared with the whole
   family, block by block: intersections of whole sets come from products of
   member-by-shingle matrices, and a block pair gives back the edges of a spanning forest,
   never all its pairs. So every pair that shares a band is either in one component
   already or has been tested, while a family of g near copies costs g pairs, not g*g.

Links that can be lost: a pair at similarity 0.8 that shares no band (3e-6), or whose estimate
lies more than five standard errors too low (3e-7); more similar pairs much more seldom.

Edge cases: null or blank text has an empty set and links with nothing; a null doc_id
can't be named, so such a row links with nothing and its component_id is null; rows
that share a doc_id are judged each by its own text; very long texts are one set, however
many shingles it has; an empty table gives no rows; only doc_id and text are read, so
further columns, whatever their names, do no harm.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import BROADCAST_ROWS, light, materialise, pick, small_batches

BUCKETS, MANTISSA, PER_BAND = 256, 10, 6
BANDS = BUCKETS // PER_BAND
EMPTY = 0xFFFF
#: Words whose hashes a worker remembers before it starts anew, and bytes of the longest of them.
MEMO, LONGEST = 400_000, 64
CHUNK = 128
#: Members, and shingles, that a block of a family holds; columns multiplied at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 256, 250_000, 4096

_MASK = (1 << 64) - 1


def _odd(seed: str, n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"{seed}{i}") | 1 for i in range(n)], np.uint64)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONGEST:
            if len(self) >= MEMO:
                self.clear()
            self[word] = h
        return h


def _finish(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct 64-bit shingle hashes."""

    def __init__(self, words: int):
        self.k, self.memo, self.weights = words, _WordHash(), _odd("shingle", words)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []  # bytes: only A-Z and ASCII white space
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        k = self.k
        if len(words) < k:
            with np.errstate(over="ignore"):
                s = (h * self.weights[: len(h)]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(h) * 0x9E3779B97F4A7C15 & _MASK)
                return _finish(s)
        n = len(words) - k + 1
        with np.errstate(over="ignore"):
            s = h[:n] * self.weights[0]
            for i in range(1, k):
                s += h[i : n + i] * self.weights[i]
            return np.unique(_finish(s))


def registers(hashes: np.ndarray) -> np.ndarray:
    """HyperMinHash registers: leading zeros << MANTISSA | mantissa of each bucket's minimum."""
    out = np.full(BUCKETS, EMPTY, np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        m, e = np.frexp(((hashes[first] >> np.uint64(4)) & np.uint64((1 << 52) - 1)).astype(np.float64))
        mantissa = np.clip((2 * m - 1) * (1 << MANTISSA), 0, (1 << MANTISSA) - 1).astype(np.int64)
        out[bucket[first]] = ((52 - e) << MANTISSA) | mantissa
    return out


#: For each bucket the fixed random order in which it looks for a filled one.
_ORDER = np.argsort(_finish(np.arange(BUCKETS * BUCKETS, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, BUCKETS), axis=1).argsort(axis=1).astype(np.uint16)
_BAND_WEIGHTS = _odd("band", BUCKETS)[: BANDS * PER_BAND].reshape(BANDS, PER_BAND)
_BAND_SEEDS = _odd("seed", BANDS)


def bands(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, over registers without empty places."""
    empty = np.flatnonzero(regs == EMPTY)
    if len(empty) == BUCKETS:
        return np.empty(0, np.int64)
    if len(empty):
        full = np.flatnonzero(regs != EMPTY)
        regs = regs.copy()
        regs[empty] = regs[full[_ORDER[np.ix_(empty, full)].argmin(axis=1)]]
    with np.errstate(over="ignore"):
        x = regs[: BANDS * PER_BAND].astype(np.uint64).reshape(BANDS, PER_BAND) + np.uint64(1)
        return _finish((x * _BAND_WEIGHTS).sum(axis=1, dtype=np.uint64) + _BAND_SEEDS).view(np.int64)


def jaccard_estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected estimates for rows of registers, and the filled buckets of each."""
    filled = (a != EMPTY) | (b != EMPTY)
    return corrected(((a == b) & filled).sum(axis=1), filled.sum(axis=1), na, nb)


def corrected(equal: np.ndarray, filled: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The estimate from counts of equal and of filled buckets, less the equal ones expected by chance."""
    n = np.maximum(filled, 1)
    ratio = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    chance = 0.169919487159739 * BUCKETS / (1 << MANTISSA) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(equal - chance, 0) / n, n


_SKETCH = "doc_id long, n_shingles long, digest binary, regs binary, bands array<long>"


def _sketch(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = Shingler(k)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 512):
                part = ids.slice(at, 512)
                counts, digests, regs, keys = [], [], [], []
                for x, doc in zip(texts.slice(at, 512), part, strict=True):
                    s = shingle(x.as_py())
                    counts.append(len(s))
                    if len(s) and doc.is_valid:
                        digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                        r = registers(s)
                        regs.append(r.tobytes())
                        keys.append(bands(r))
                    else:  # a key of its own, which no class has
                        digests.append(b"-" + repr(doc.as_py()).encode())
                        regs.append(None)
                        keys.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part, pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "digest", "regs", "bands"],
                )

    return run


def _estimated(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose estimate doesn't rule out the threshold."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("regs").alias(f"regs_{x}"), F.col("n").alias(f"n_{x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            a, b = (np.frombuffer(b"".join(col[x].to_pylist()), np.uint16).reshape(-1, BUCKETS) for x in ("regs_a", "regs_b"))
            na, nb = (col[x].to_numpy(zero_copy_only=False).astype(float) for x in ("n_a", "n_b"))
            est, n = jaccard_estimate(a, b, na, nb)
            t = percent / 100
            sizes = np.minimum(na, nb) >= t * np.maximum(na, nb)  # else no such pair can reach it
            keep = sizes & ((est >= t - 5 * np.sqrt(t * (1 - t) / n)) | (n < 24))
            yield pa.RecordBatch.from_arrays([col["a"], col["b"]], names=["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "regs_a", "regs_b", "n_a", "n_b")
    return joined.mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold.

    The partners of one `a` are dealt into chunks, each of which gets the text of `a`; how many
    chunks is told by broadcast, so that no task gets all pairs of one `a`.
    """
    heavy = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("k")).where("k > 1")
    dealt = pairs.join(light(materialise(heavy, "heavy")), "a", "left").select("a", "b", F.expr("pmod(xxhash64(b), coalesce(k, 1L))").alias("chunk"))
    rows = dealt.select("a", "chunk", F.col("b").alias("id"), F.lit(False).alias("lead")).unionByName(
        dealt.select("a", "chunk", F.col("a").alias("id"), F.lit(True).alias("lead")).distinct()
    )
    rows = rows.join(texts, "id").select("a", "chunk", "id", "lead", "text")

    def run(table: pa.Table) -> pa.Table:
        shingle = Shingler(k)
        lead = table.column("lead").to_pylist()
        ids = table.column("id").to_pylist()
        text = table.column("text").cast(pa.binary())
        heads = [shingle(text[i].as_py()) for i, x in enumerate(lead) if x]
        found = set()
        for i, x in enumerate(lead):
            if x:
                continue
            s = shingle(text[i].as_py())
            for h in heads:
                common = len(np.intersect1d(h, s, assume_unique=True))
                if common and 100 * common >= percent * (len(h) + len(s) - common):
                    found.add(ids[i])
        a = table.column("a")[0].as_py()
        return pa.table({"a": pa.array([a] * len(found), pa.int64()), "b": pa.array(sorted(found), pa.int64())})

    return rows.groupBy("a", "chunk").applyInArrow(run, "a long, b long")


def _forest(sets: list[np.ndarray], component: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the links between sets of different components."""
    m = len(sets)
    n = np.array([len(x) for x in sets], np.float64)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(counts > 1) - 1
    row = np.repeat(np.arange(m), n.astype(np.int64))
    keep = counts[inverse] > 1
    row, col = row[keep], shared[inverse[keep]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((m, m), np.float64)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, COLUMNS):
        lo, hi = np.searchsorted(col, [at, at + COLUMNS])
        dense = np.zeros((m, COLUMNS), np.float32)
        dense[row[lo:hi], col[lo:hi] - at] = 1
        common += dense @ dense.T
    linked = (100 * common >= percent * (n[:, None] + n[None, :] - common)) & (common > 0) & (component[:, None] != component[None, :])
    edges, new = [], np.ones(m, bool)
    for start in range(m):
        if not new[start] or not linked[start].any():
            continue
        new[start], stack = False, [start]
        while stack:
            i = stack.pop()
            for j in np.flatnonzero(linked[i] & new):
                new[j] = False
                edges.append((i, int(j)))
                stack.append(int(j))
    return edges


def _candidates(regs: np.ndarray, n: np.ndarray, component: np.ndarray, percent: int) -> np.ndarray:
    """Members whose estimate with some member of another component doesn't rule out the threshold."""
    m, t = len(regs), percent / 100
    equal, filled = np.zeros((m, m), np.int16), np.zeros((m, m), np.int16)
    for i in range(BUCKETS):
        col, full = regs[:, i], regs[:, i] != EMPTY
        either = full[:, None] | full[None, :]
        equal += (col[:, None] == col[None, :]) & either
        filled += either
    est, filled = corrected(equal, filled, n[:, None], n[None, :])
    near = (np.minimum(n[:, None], n[None, :]) >= t * np.maximum(n[:, None], n[None, :])) & ((est >= t - 5 * np.sqrt(t * (1 - t) / filled)) | (filled < 24))
    return np.flatnonzero((near & (component[:, None] != component[None, :])).any(axis=1))


def _family_links(members: DataFrame, classes: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components of a family, for members(family, id, component, n).

    Members of the largest component are linked among themselves already, so they meet the
    others only: a family of g with o others costs some g * o comparisons, not g * g. Those
    are of sketches; only members with a likely partner in the block get their whole sets.
    """
    per = members.groupBy("family", "component").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    sizes = per.groupBy("family").agg(F.max(F.struct("c", "component", "n")).alias("top"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    blocks = lambda c, n: F.greatest(F.ceil(c / BLOCK), F.ceil(n / BLOCK_SHINGLES))
    top = F.col("top")
    sizes = sizes.where("parts > 1").select(
        "family", top["component"].alias("main"), blocks(top["c"], top["n"]).alias("mb"), blocks(F.col("c") - top["c"], F.col("n") - top["n"]).alias("ob")
    )
    dealt = members.join(light(materialise(sizes, "sizes")), "family").withColumn("in_main", F.col("component") == F.col("main"))
    # Blocks of other members are 0 to ob - 1, those of the main component follow and meet only the others.
    dealt = dealt.withColumn("own", F.expr("if(in_main, ob + pmod(xxhash64(id), mb), pmod(xxhash64(id), ob))"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0L, if(in_main, ob, ob + mb) - 1)"))).where("own <> other")
    dealt = dealt.select("family", "id", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    about = texts.join(classes.select(F.col("cid").alias("id"), "regs", F.col("n").alias("size")), "id")
    rows = dealt.join(about, "id").select("family", "i", "j", "id", "component", "regs", "size", "text")

    def run(table: pa.Table) -> pa.Table:
        component = table.column("component").to_numpy()
        ids = table.column("id").to_numpy()
        edges: list[tuple[int, int]] = []
        if (component != component[0]).any():
            regs = np.frombuffer(b"".join(table.column("regs").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            likely = _candidates(regs, table.column("size").to_numpy().astype(float), component, percent)
            component, ids = component[likely], ids[likely]
            if len(likely):
                shingle = Shingler(k)
                sets = [shingle(x.as_py()) for x in table.column("text").take(pa.array(likely)).cast(pa.binary())]
                edges = _forest(sets, component, percent)
        return pa.table({"a": pa.array([ids[x] for x, _ in edges], pa.int64()), "b": pa.array([ids[y] for _, y in edges], pa.int64())})

    return rows.groupBy("family", "i", "j").applyInArrow(run, "a long, b long").where("a <> b")


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (a, b), for every id in a link.

    Large-star and small-star steps in turn, until neither changes an edge.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(edges)
    while before[0]:
        # One row a node: broadcast if there can't be many, so that a star's edges needn't meet in one task.
        small_side = F.broadcast if 2 * before[0] <= BROADCAST_ROWS else lambda df: materialise(df, "low")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = small_side(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_side(least), "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(small, "edges")
        after = mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sketches = materialise(docs.mapInArrow(_sketch(shingle_words), _SKETCH), "sketch")
    real = sketches.where("regs is not null")
    classes = materialise(real.groupBy("digest").agg(F.min("doc_id").alias("cid"), F.max("n_shingles").alias("n"), F.first("regs").alias("regs"), F.first("bands").alias("bands")), "classes")

    banded = classes.select("cid", F.explode("bands").alias("band"))
    # Written, so that the join has a shuffle of its own on both sides and a hot band can be split at run time.
    groups = materialise(banded.groupBy("band").agg(F.count("*").alias("size"), F.min("cid").alias("low")).where("size > 1"), "groups")
    members = materialise(banded.join(groups, "band").select("band", "cid", "low", "size"), "members")

    needed = materialise(members.select(F.col("cid").alias("doc_id")).distinct(), "needed")
    texts = materialise(docs.join(light(needed), "doc_id", "left_semi").select(F.col("doc_id").alias("id"), "text"), "texts")

    pairs = members.where("cid <> low").select(F.col("low").alias("a"), F.col("cid").alias("b")).distinct()
    likely = materialise(_estimated(pairs, classes, percent), "likely")
    stars = materialise(_confirmed(likely, texts, shingle_words, percent).distinct(), "links")
    first = materialise(components(stars), "components")

    family = members.where("size > 2").select(F.col("low").alias("family"), F.col("cid").alias("id")).distinct()
    family = family.where("family <> id").join(first, "id", "left").join(classes.select(F.col("cid").alias("id"), "n"), "id")
    family = materialise(family.select("family", "id", F.coalesce("component", "id").alias("component"), "n"), "family")
    late = materialise(_family_links(family, classes, texts, shingle_words, percent), "links")
    found = materialise(components(stars.unionByName(late)), "components")

    joined = (
        sketches.select("doc_id", "n_shingles", "digest")
        .join(classes.select("digest", "cid"), "digest", "left")
        .join(found.withColumnRenamed("id", "cid"), "cid", "left")
    )
    component = F.coalesce("component", "cid", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_copies(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """Rows of docs with one document of each component, all their columns kept.

    Rows that repeat id and text count as one document; rows without id stay.
    """
    verdict = materialise(near_duplicates(docs, shingle_words, percent).where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows"), F.max("kept").alias("kept")), "verdict")
    out = docs.join(light(verdict.where("not kept").select("doc_id")), "doc_id", "left_anti").select(docs.columns)
    if verdict.where("kept and rows > 1").isEmpty():
        return out
    named = out.where("doc_id is not null").withColumn("_text_digest", F.sha2("text", 256)).dropDuplicates(["doc_id", "_text_digest"]).drop("_text_digest")
    return named.unionByName(out.where("doc_id is null"))
