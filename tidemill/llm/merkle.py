"""Merkle dataset manifest by fractal traversal (operator 11).

Every row is a leaf: the digest of its columns. The leaves of a source ascend by doc_id and
are hashed in runs of 16 to the source's subroot; the subroots likewise to the root.

1. One scan hashes the rows. From here on only ids, sources and digests travel.
2. Places within the sources come from range partitions and prefix sums, so a source that
   holds most rows is spread over many tasks.
3. Upwards: aligned blocks of 4,096 nodes (three levels) become their block's root, one
   streaming pass for each three levels, until every tree has one node left.
4. Downwards: each block gets one row with all that is above it (the path from its root,
   the subroot and the root) and is traversed once. The traversal holds, for each level, the
   existing subtree (the 16 nodes of the run that the current node lies in) and the desired
   one (the run after it), which grows by one node of the lowest level a step, so that it is
   complete when it is wanted. Each node's path is emitted in turn, followed by the block's.

A path has, for each level from the leaf up, the node's place in its run and the digests of
the run's other nodes, so that `fold` recomputes the root from a leaf and its path alone.

Edge cases: a null column is hashed as `-`; a null doc_id comes first in its source, a null
source before all others; rows that share source and doc_id are ordered by their leaf, and
repeated rows are leaves of their own, alike but for their paths; the only row of a source
is its subroot, the only source's subroot is the root; very long texts are hashed whole; an
empty table gives no rows; only doc_id, source, lang, n_chars and text are read, so further
columns, whatever their names, do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import light, materialise, pick
from tidemill.llm.mixing import prefix_sums

#: Nodes of a run, and levels of a block.
ARITY, HEIGHT = 16, 3
BLOCK = ARITY**HEIGHT
#: Hexadecimal digits of a digest.
DIGITS = 64
#: Paths of an Arrow batch on its way back: some 1 MB.
ROWS = 256

LEVEL = pa.struct([("place", pa.int32()), ("siblings", pa.string())])
PATH = "path array<struct<place:int,siblings:string>>"
UPPERS = "abcdefghijklmnopqrstuvwxyz".upper()


def field(value: Column) -> Column:
    """`-` if null, else the UTF-8 byte count, a colon and the value."""
    s = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row, with this text."""
    return F.sha2(F.concat(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text)), 256)


def tampered_leaf(every: int = 5) -> Column:
    """The leaf of a row whose text was changed to small letters, for one in `every` rows by a digest of the id; else null."""
    changed = F.crc32(F.col("doc_id").cast("string")) % every == 0
    return F.when(changed, leaf(F.translate("text", UPPERS, UPPERS.lower())))


def fold(start: Column, path: Column | str = "path") -> Column:
    """The root that a leaf and the siblings on its path give."""

    def up(digest: Column, level: Column) -> Column:
        before = level["place"] * DIGITS
        siblings = level["siblings"]
        return F.sha2(F.concat(F.substring(siblings, F.lit(1), before), digest, F.substring(siblings, before + 1, F.length(siblings))), 256)

    return F.aggregate(path, start, up)


def siblings_digest(path: Column | str = "path") -> Column:
    """One digest of all siblings, from the leaf's up to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: level["siblings"]), ""), 256)


# Trees in blocks --------------------------------------------------------------


def levels(n: int) -> int:
    """Levels of a tree of n nodes above the nodes, within a block."""
    height = 0
    while n > 1:
        n, height = -(-n // ARITY), height + 1
    return min(height, HEIGHT)


def digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class Subtree:
    """A run of a level as it grows from the nodes below it; holds one run a level at most."""

    def __init__(self, nodes: list[str], level: int, run: int) -> None:
        width = ARITY ** (level + 1)
        self.nodes, self.level, self.run = nodes, level, run
        self.at, self.end = run * width, min((run + 1) * width, len(nodes))
        self.stack: list[list[str]] = [[] for _ in range(level + 1)]

    def step(self) -> None:
        """Take in the next node, if one is left."""
        if self.at >= self.end:
            return
        node, self.at = self.nodes[self.at], self.at + 1
        for held in self.stack:
            held.append(node)
            if len(held) < ARITY or held is self.stack[-1]:
                break
            node = digest(held)
            held.clear()
        if self.at == self.end:
            self._close()

    def _close(self) -> None:
        for below, above in zip(self.stack, self.stack[1:], strict=False):
            if below:
                above.append(digest(below))
                below.clear()

    def grown(self) -> list[str]:
        while self.at < self.end:
            self.step()
        return self.stack[-1]


def block_root(nodes: list[str], height: int) -> str:
    return Subtree(nodes, height, 0).grown()[0]


def traverse(nodes: list[str], height: int) -> Iterator[list[tuple[int, list[str]]]]:
    """For each node in turn, its place and its run at every level of the block."""
    existing = [Subtree(nodes, level, 0).grown() for level in range(height)]
    desired = [Subtree(nodes, level, 1) for level in range(height)]
    for i in range(len(nodes)):
        for level in range(height):
            if i and i % ARITY ** (level + 1) == 0:
                existing[level] = desired[level].grown()
                desired[level] = Subtree(nodes, level, desired[level].run + 1)
        yield [(i // ARITY**level % ARITY, existing[level]) for level in range(height)]
        for growing in desired:
            growing.step()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each tree's block together, from rows in order."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        tree, block = batch["tree"].to_numpy(), batch["block"].to_numpy()
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (block[1:] != block[:-1])) + 1
        rows = pa.Table.from_batches([batch])
        for start, stop in zip([0, *cuts], [*cuts, len(tree)], strict=True):
            if held and last != (tree[start], block[start]):
                yield pa.concat_tables(held)
                held = []
            held.append(rows.slice(start, stop - start))
            last = (tree[start], block[start])
    if held:
        yield pa.concat_tables(held)


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    names = ["tree", "rank", "n", "digest"]
    for rows in _blocks(batches):
        tree, block, n = (rows[c][0].as_py() for c in ("tree", "block", "n"))
        out.append((tree, block, -(-n // BLOCK), block_root(rows["digest"].to_pylist(), levels(n))))
        if len(out) == 1024:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], names)


def _with_paths(carry: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _blocks(batches):
            above, rows = rows.slice(0, 1), rows.slice(1).combine_chunks()  # the block's own row has rank -1
            subroot, root, up = (above[c][0].as_py() for c in ("subroot", "root", "path"))
            up_places, up_siblings = [x["place"] for x in up], [x["siblings"] for x in up]
            height, places, siblings = levels(above["n"][0].as_py()), [], []
            joined: list[tuple] = [(-1, None, "")] * height
            sent = 0

            def batch(stop: int) -> pa.RecordBatch:
                own = height + len(up)
                offsets = pa.array(np.arange(stop - sent + 1, dtype=np.int32) * own)
                path = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(siblings, pa.string())], fields=list(LEVEL)))
                kept = [rows[c].slice(sent, stop - sent).combine_chunks() for c in ("tree", "rank", "digest", *carry)]
                same = [pa.array([x] * (stop - sent), pa.string()) for x in (subroot, root)]
                return pa.RecordBatch.from_arrays([*kept, *same, path], ["tree", "rank", "digest", *carry, "subroot", "root", "path"])

            for i, node in enumerate(traverse(rows["digest"].to_pylist(), height)):
                for level, (place, run_) in enumerate(node):
                    if joined[level][0] != place or joined[level][1] is not run_:
                        joined[level] = (place, run_, "".join(run_[:place] + run_[place + 1 :]))
                    places.append(place)
                    siblings.append(joined[level][2])
                places += up_places
                siblings += up_siblings
                if i + 1 - sent == ROWS:
                    yield batch(i + 1)
                    places, siblings, sent = [], [], i + 1
            if sent < len(rows):
                yield batch(len(rows))

    return run


def climb(nodes: DataFrame) -> list[DataFrame]:
    """nodes(tree, rank, n, digest) and its blocks' roots, then those roots' and so on; the last has one row a tree."""
    stack = [nodes]
    while len(stack) == 1 or not stack[-1].where("n > 1").isEmpty():
        rows = stack[-1].select("tree", F.expr(f"rank div {BLOCK}").alias("block"), "rank", "n", "digest")
        dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
        stack.append(materialise(dealt.mapInArrow(_roots, "tree long, rank long, n long, digest string"), "roots"))
    return stack


def descend(nodes: DataFrame, above: DataFrame, carry: list[str] = ()) -> DataFrame:
    """tree, rank, digest, carry, subroot, root, path of all nodes; above: those of their blocks' roots."""
    block = F.expr(f"rank div {BLOCK}").alias("block")
    own = nodes.select("tree", block, "rank", "n", "digest", *carry)
    # A block's height follows from its tree's n, which the row above it brings along.
    heads = above.select("tree", F.col("rank").alias("block"), F.lit(-1).cast("long").alias("rank"), F.col("below").alias("n"), "subroot", "root", "path")
    rows = own.unionByName(heads, allowMissingColumns=True).repartition("tree", "block").sortWithinPartitions("tree", "block", "rank")
    types = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = ", ".join(["tree long, rank long, digest string", *[f"`{c}` {types[c]}" for c in carry], "subroot string, root string", PATH])
    return rows.mapInArrow(_with_paths(list(carry)), schema)


def authentication_paths(stack: list[DataFrame], top: DataFrame, carry: list[str] = ()) -> DataFrame:
    """The paths of the stack's lowest nodes; top(tree, subroot, root, path): what is above each tree's root."""
    above = top.withColumn("rank", F.lit(0).cast("long"))
    for i in range(len(stack) - 2, -1, -1):
        # What a block's row must say of the nodes below it: how many their tree has.
        sizes = stack[i].groupBy("tree").agg(F.first("n").alias("below"))
        sizes = light(materialise(sizes, "tree-sizes"))
        above = descend(stack[i], above.join(sizes, "tree"), carry if i == 0 else [])
        if i:
            above = materialise(above.drop("digest"), "paths")
    return above


def ranked(rows: DataFrame, carry: list[str]) -> tuple[DataFrame, DataFrame]:
    """rows(source, doc_id, digest, carry) as nodes(tree, rank, n, ...), and the sources(source, tree, n)."""
    one = F.lit(1).cast("long")
    counts = materialise(rows.groupBy("source").agg(F.count("*").alias("n")), "source-counts")
    sources = prefix_sums(counts.withColumn("_one", one), [], [F.asc_nulls_first("source")], {"_one": "tree"}, "source-places").drop("_one")
    sources = materialise(sources, "sources")
    found = rows.join(light(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = prefix_sums(found.withColumn("_one", one), ["tree"], [F.asc_nulls_first("doc_id"), F.asc("digest")], {"_one": "rank"}, "leaf-places")
    return placed.select("tree", "rank", "n", "digest", "doc_id", "source", *carry), sources


def manifest(docs: DataFrame, extra: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, leaf, subroot, root and path of every row of docs(doc_id, source, lang, n_chars, text).

    extra: further short columns, computed in the one scan of the texts.
    """
    extra = extra or {}
    rows = pick(docs, "doc_id", "source", "lang", "n_chars", "text")
    rows = materialise(rows.select("doc_id", "source", leaf(F.col("text")).alias("digest"), *[c.alias(n) for n, c in extra.items()]), "leaves")
    nodes, sources = ranked(rows, list(extra))
    stack = climb(materialise(nodes, "nodes"))
    subroots = stack[-1].select("tree", F.col("digest").alias("subroot"))
    all_sources = sources.count()
    tops = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(all_sources).cast("long").alias("n"), F.col("subroot").alias("digest"))
    upper = climb(materialise(tops, "subroots"))
    nothing = F.array().cast(PATH.removeprefix("path "))
    root = upper[-1].select("tree", F.lit("").alias("subroot"), F.col("digest").alias("root"), nothing.alias("path"))
    over = authentication_paths(upper, root).select(F.col("rank").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    out = authentication_paths(stack, materialise(over, "source-paths"), ["doc_id", "source", *extra])
    return out.select("doc_id", "source", F.col("digest").alias("leaf"), *extra, "subroot", "root", "path")


def tampering(docs: DataFrame) -> DataFrame:
    """The manifest, with the root recomputed from rows some of which were changed meanwhile."""
    rows = manifest(docs, {"tampered": tampered_leaf()})
    rows = rows.select("doc_id", "leaf", "subroot", "root", siblings_digest().alias("proof_sha256"), fold(F.coalesce("tampered", "leaf")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: CRC-32 of doc_id's digits, bit by bit.
CRC_SQL = """
xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(c)::BIGINT FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
  lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)
"""

ORACLE_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, source, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, text,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small
  FROM documents
), leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(small) || ':' || small, '-')) AS small_leaf FROM texts
), sources AS (
  SELECT source, count(*) AS n, row_number() OVER (ORDER BY source COLLATE "C" NULLS FIRST) - 1 AS tree FROM leaves GROUP BY source
), placed AS (
  SELECT l.*, s.tree, s.n, row_number() OVER (PARTITION BY s.tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS rank
  FROM leaves l JOIN sources s ON l.source IS NOT DISTINCT FROM s.source
), up AS (
  SELECT tree, 0 AS level, rank, n, leaf AS digest FROM placed
  UNION ALL
  SELECT tree, level + 1, rank // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY rank)) FROM up WHERE n > 1 GROUP BY tree, level, rank // 16, n
), subroots AS (SELECT tree, digest AS subroot, level AS height FROM up WHERE n = 1
), top AS (
  SELECT -1 AS tree, 0 AS level, tree AS rank, (SELECT count(*) FROM sources) AS n, subroot AS digest FROM subroots
  UNION ALL
  SELECT tree, level + 1, rank // 16, (n + 15) // 16, sha256(string_agg(digest, '' ORDER BY rank)) FROM top WHERE n > 1 GROUP BY tree, level, rank // 16, n
), nodes AS (
  SELECT a.tree, a.level, a.rank,
    coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank < a.rank), '') AS lefts,
    coalesce(string_agg(b.digest, '' ORDER BY b.rank) FILTER (b.rank > a.rank), '') AS rights
  FROM (SELECT * FROM up UNION ALL SELECT * FROM top) a
  JOIN (SELECT * FROM up UNION ALL SELECT * FROM top) b ON a.tree = b.tree AND a.level = b.level AND a.rank // 16 = b.rank // 16
  WHERE a.n > 1 GROUP BY a.tree, a.level, a.rank
), starts AS (
  SELECT row_number() OVER () AS row_no, p.*, s.subroot, s.height,
    CASE WHEN p.doc_id IS NOT NULL AND crc % 5 = 0 THEN small_leaf ELSE leaf END AS folded
  FROM (SELECT *, CAST({crc} AS BIGINT) AS crc FROM placed) p JOIN subroots s USING (tree)
), steps AS (
  SELECT row_no, tree AS own, height, tree, 0 AS level, rank, folded, '' AS proof FROM starts
  UNION ALL
  SELECT row_no, own, height, CASE WHEN tree >= 0 AND s.level = height THEN -1 ELSE tree END,
    CASE WHEN tree >= 0 AND s.level = height THEN 0 ELSE s.level + 1 END, CASE WHEN tree >= 0 AND s.level = height THEN own ELSE s.rank // 16 END,
    CASE WHEN tree >= 0 AND s.level = height THEN folded ELSE sha256(lefts || folded || rights) END,
    CASE WHEN tree >= 0 AND s.level = height THEN proof ELSE proof || lefts || rights END
  FROM steps s LEFT JOIN nodes n USING (tree, level, rank)
  WHERE tree >= 0 OR s.level < (SELECT max(level) FROM top)
), ends AS (SELECT * FROM steps WHERE tree = -1 AND level = (SELECT max(level) FROM top)
), root AS (SELECT digest AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, e.folded AS folded_root, e.folded = root AS verified
FROM starts s JOIN ends e USING (row_no) CROSS JOIN root
""".replace("{crc}", CRC_SQL)
