"""Line dedup (operator 13).

Lines that occur in several documents stay in one of them only. What comes back is a
compressed bitmap for each document, a bit for each line; texts are neither shuffled nor
copied to find it.

1. One scan splits the texts and hashes the keys of all long enough lines to 128 bits.
2. The hashes are range-partitioned and sorted by hash, document (largest first) and
   position. A hash that very many documents share thus spreads over several partitions.
3. Each partition is streamed once: the first document of a hash keeps its lines, those of
   the others are emitted once the third document has been met. Only a hash that began in
   an earlier partition, or goes on in a later one, is left open; its rows, and a witness
   for what this partition knows of it, go to a second step that counts its documents with
   partial aggregates. There are at most two such hashes a partition.
4. The positions to drop become a document's bitmap, eight lines a byte, deflated if that is
   shorter. `kept_lines` gives the texts back without those lines.

Edge cases: a null or empty text is one empty line, which stays; a null doc_id is a document
like others and smaller than all; rows that share a doc_id are one document in counting and
in keeping, and each has its own bitmap by its text; repeated rows share theirs; ties in
doc_id can't be, beyond that; very long texts are split whole; an empty table gives no rows;
only doc_id and text are read, so further columns, whatever their names, do no harm.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import light, materialise, pick, shuffle_partitions, small_batches

SPACE = b" \t\n\x0b\x0c\r"
#: Bitmaps: how the bytes after the first are packed.
PLAIN, DEFLATED = b"\0", b"\1"
#: Kinds of rows that a stream gives back.
DROP, OPEN, WITNESS = 0, 1, 2
#: Bytes of bitmaps that are sent whole to every executor.
BROADCAST_BYTES = 64 << 20

ROWS = "h1 long, h2 long, known boolean, doc long, content long, pos int"


# Lines ------------------------------------------------------------------------


def key_of(line: bytes) -> bytes:
    """A line without white space at its ends, A-Z in small letters (bytes.lower changes no others)."""
    return line.strip(SPACE).lower()


def long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode(errors="replace")) >= least)


def _hashed(least: int) -> Callable:
    """known, doc, content, text to a row for each long line, and one with position -1 and the number of lines as h1 for each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, owner, position, counts = bytearray(), [], [], []
            for i, text in enumerate(batch["text"].to_pylist()):
                lines = (text or b"").split(b"\n")
                counts.append(len(lines))
                for pos, line in enumerate(lines):
                    if len(line) >= least and long_enough(key := key_of(line), least):
                        digests += blake2b(key, digest_size=16).digest()
                        owner.append(i)
                        position.append(pos)
            h = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
            n = batch.num_rows
            at = np.concatenate([np.arange(n, dtype=np.int64), np.array(owner, np.int64)])
            h1, h2 = np.concatenate([np.array(counts, np.int64), h[:, 0]]), np.concatenate([np.zeros(n, np.int64), h[:, 1]])
            pos = np.concatenate([np.full(n, -1, np.int32), np.array(position, np.int32)])
            doc = [batch[c].take(pa.array(at)) for c in ("known", "doc", "content")]
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), *doc, pa.array(pos)], ["h1", "h2", "known", "doc", "content", "pos"])

    return run


# The stream -------------------------------------------------------------------


class Group:
    """What a stream holds of one hash: its first document, how many there were, and rows of the second while there is no third."""

    def __init__(self, key: tuple[int, int], begun_here: bool, least_docs: int) -> None:
        self.key, self.begun_here, self.least = key, begun_here, least_docs
        self.docs, self.last = 0, None
        self.pending: list[np.ndarray] = []
        self.witnesses: list[np.ndarray] = []

    def feed(self, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """rows: of this hash, in order; as (known, doc, content, pos)."""
        if not self.begun_here:
            yield OPEN, rows
            return
        ids = rows[:, :2]
        new = np.ones(len(rows), bool)
        new[1:] = (ids[1:] != ids[:-1]).any(axis=1)
        new[0] = self.last is None or (ids[0] != self.last).any()
        place = self.docs - 1 + np.cumsum(new)
        self.docs, self.last = int(place[-1]) + 1, ids[-1].copy()
        for i in np.flatnonzero(new & (place < self.least)):
            self.witnesses.append(rows[i : i + 1].copy())
        later = rows[place > 0]
        if self.docs < self.least:
            if len(later):
                self.pending.append(later.copy())
            return
        for held in self.pending:
            yield DROP, held
        self.pending = []
        if len(later):
            yield DROP, later

    def leave_open(self) -> Iterator[tuple[int, np.ndarray]]:
        """What the partitions after this one need, if the hash may go on there."""
        for held in self.pending:
            yield OPEN, held
        for held in self.witnesses:
            yield WITNESS, held


def _streamed(least_docs: int) -> Callable:
    """Rows in order of h1, h2, document and position to those that are dropped, open or witnesses."""
    names = ["kind", "h1", "h2", "known", "doc", "content", "pos"]

    def record(kind: int | np.ndarray, keys: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        kinds = np.broadcast_to(np.asarray(kind, np.int32), len(rows)).copy()
        columns = [kinds, keys[:, 0].copy(), keys[:, 1].copy(), rows[:, 0] == 1, rows[:, 1].copy(), rows[:, 2].copy(), rows[:, 3].astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def same_key(key: tuple[int, int], rows: np.ndarray) -> np.ndarray:
        return np.broadcast_to(np.array(key, np.int64), (len(rows), 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: Group | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch["h1"].to_numpy(), batch["h2"].to_numpy()], axis=1)
            rows = np.stack([batch[c].cast(pa.int64()).to_numpy(zero_copy_only=False) for c in ("known", "doc", "content", "pos")], axis=1)
            starts = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1])
            ends = np.append(starts[1:], len(keys))
            inner = []
            for i in sorted({0, len(starts) - 1}):  # the groups that may reach beyond the batch
                if i and len(starts) > 2:
                    inner = [slice(starts[1], ends[-2])]
                key = (int(keys[starts[i], 0]), int(keys[starts[i], 1]))
                if group is None or group.key != key:
                    group = Group(key, begun_here=group is not None, least_docs=least_docs)
                part = rows[starts[i] : ends[i]]
                for kind, out in group.feed(part):
                    yield record(kind, same_key(key, out), out)
            for piece in inner:  # whole groups within the batch
                drop = dropped(keys[piece], rows[piece], least_docs)
                if drop.any():
                    yield record(DROP, keys[piece][drop], rows[piece][drop])
        if group is not None:
            for kind, out in group.leave_open():
                yield record(kind, same_key(group.key, out), out)

    return run


def dropped(keys: np.ndarray, rows: np.ndarray, least_docs: int) -> np.ndarray:
    """Of whole groups in order: rows of all documents but the first, where a group has enough of them."""
    new_key = np.ones(len(keys), bool)
    new_key[1:] = (keys[1:] != keys[:-1]).any(axis=1)
    new_doc = new_key.copy()
    new_doc[1:] |= (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    group = np.cumsum(new_key) - 1
    first = np.flatnonzero(new_key)
    place = np.cumsum(new_doc)
    place = place - place[first][group]
    docs = np.maximum.reduceat(place, first) + 1
    return (place > 0) & (docs[group] >= least_docs)


def drops(hashed: DataFrame, least_docs: int) -> DataFrame:
    """known, doc, content, pos of the lines to drop."""
    p = shuffle_partitions(hashed.sparkSession)
    order = [F.asc("h1"), F.asc("h2"), F.desc("known"), F.desc("doc"), F.asc("content"), F.asc("pos")]
    streamed = hashed.repartitionByRange(p, *order).sortWithinPartitions(*order).mapInArrow(_streamed(least_docs), f"kind int, {ROWS}")
    streamed = materialise(streamed, "streamed")
    still = streamed.where(F.col("kind") != DROP)
    # Two hashes a partition at most, so that the result can be sent to all.
    known = still.groupBy("h1", "h2", "known", "doc").agg(F.lit(1).alias("one"))
    totals = known.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.max(F.struct("known", "doc")).alias("first"))
    totals = materialise(totals.where(F.col("docs") >= least_docs), "open-hashes")
    late = still.where(F.col("kind") == OPEN).join(light(totals), ["h1", "h2"])
    late = late.where((F.col("known") != F.col("first.known")) | (F.col("doc") != F.col("first.doc")))
    columns = ["known", "doc", "content", "pos"]
    return streamed.where(F.col("kind") == DROP).select(columns).unionByName(late.select(columns))


# Bitmaps ----------------------------------------------------------------------


def pack(n_lines: int, positions: np.ndarray) -> bytes:
    """A bit for each line, 1 for those that stay."""
    keep = np.ones(n_lines, bool)
    keep[positions] = False
    plain = np.packbits(keep).tobytes()
    small = zlib.compress(plain, 9)
    return DEFLATED + small if len(small) < len(plain) else PLAIN + plain


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    plain = zlib.decompress(bitmap[1:]) if bitmap[:1] == DEFLATED else bitmap[1:]
    return np.unpackbits(np.frombuffer(plain, np.uint8), count=n_lines).astype(bool)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["drops"]
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        counts = batch["n_lines"].to_pylist()
        bitmaps = [pack(n, values[offsets[i] : offsets[i + 1]]) for i, n in enumerate(counts)]
        kept = [batch[c] for c in ("known", "doc", "content", "n_lines")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.diff(offsets).astype(np.int64)), pa.array(bitmaps, pa.binary())], ["known", "doc", "content", "n_lines", "n_dropped", "keep"])


def content(text: Column) -> Column:
    """Tells apart the texts of rows that share a doc_id."""
    return F.xxhash64(text)


def keep_bitmaps(docs: DataFrame, least_length: int = 20, least_docs: int = 3) -> DataFrame:
    """doc_id, content, n_lines, n_dropped and keep, a bitmap, for every row of docs(doc_id, text); repeated rows once."""
    small_batches(docs.sparkSession)
    rows = pick(docs, "doc_id", "text")
    doc = F.col("doc_id").cast("long")
    rows = rows.select(doc.isNotNull().alias("known"), F.coalesce(doc, F.lit(0)).alias("doc"), content(F.col("text")).alias("content"), F.col("text").cast("binary").alias("text"))
    hashed = materialise(rows.mapInArrow(_hashed(least_length), ROWS), "line-hashes")
    columns = ["known", "doc", "content"]
    texts = hashed.where("pos < 0").select(*columns, F.col("h1").alias("n_lines"), F.lit(None).cast("int").alias("pos"))
    found = drops(hashed.where("pos >= 0"), least_docs).select(*columns, F.lit(None).cast("long").alias("n_lines"), "pos")
    lists = texts.unionByName(found).groupBy(*columns).agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("drops"))
    packed = lists.mapInArrow(_packed, "known boolean, doc long, content long, n_lines long, n_dropped long, keep binary")
    return packed.select(F.when(F.col("known"), F.col("doc")).alias("doc_id"), "content", "n_lines", "n_dropped", "keep")


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, n, bitmap in zip(*(batch[c].to_pylist() for c in ("_text", "_lines", "_keep")), strict=True):
            lines = (text or b"").split(b"\n")
            texts.append(b"\n".join(line for line, stays in zip(lines, unpack(bitmap, n).tolist(), strict=True) if stays))
        kept = [batch[c] for c in batch.schema.names if c not in ("_text", "_lines", "_keep")]
        names = [c for c in batch.schema.names if c not in ("_text", "_lines", "_keep")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.binary())], [*names, "_kept"])


def kept_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the text without the dropped lines, for every row of docs.

    Texts without a dropped line go their way past the bitmaps; the bitmaps of the others are
    sent to all if they are small, else both sides are shuffled.
    """
    bitmaps = materialise(bitmaps.where("n_dropped > 0"), "bitmaps")
    size = bitmaps.agg(F.sum(F.octet_length("keep") + 64)).first()[0] or 0
    side = bitmaps.select(F.col("doc_id").alias("_doc"), F.col("content").alias("_content"), F.col("n_lines").alias("_lines"), F.col("n_dropped").alias("_dropped"), F.col("keep").alias("_keep"))
    side = F.broadcast(side) if size <= BROADCAST_BYTES else side
    rows = pick(docs, "doc_id", "text").withColumns({"doc_id": F.col("doc_id").cast("long"), "content": content(F.col("text"))})
    joined = rows.join(side, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("content") == F.col("_content")), "left")
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    whole = joined.where("_keep IS NULL").select("doc_id", F.coalesce(lines, F.lit(1)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), F.coalesce("text", F.lit("")).alias("text"))
    cut = joined.where("_keep IS NOT NULL").select("doc_id", F.col("_dropped").alias("n_dropped"), F.col("text").cast("binary").alias("_text"), "_lines", "_keep", F.col("_lines").alias("n_lines"))
    cut = cut.mapInArrow(_without, "doc_id long, n_dropped long, n_lines long, _kept binary")
    return whole.unionByName(cut.select("doc_id", "n_lines", "n_dropped", F.col("_kept").cast("string").alias("text")))


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), long AS (SELECT row_no, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs
), keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM long
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) + CAST(count(*) > count(doc_id) AS INT) >= 3
), marked AS (SELECT k.*, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.keeper AS gone FROM keyed k LEFT JOIN common c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY row_no
"""
