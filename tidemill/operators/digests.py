"""Differences of two snapshots by digests of key ranges: only ranges that differ are looked into.

Rows are dealt into ranges by the leading bits of a hash of all their columns. A range's
digest is the sum of its rows' hashes and their number, which partial aggregates make
without moving rows. The digests are a tree: FANOUT ranges at the top, and for each one that
differs FANOUT more, until ranges hold LEAF rows or so. Only rows of the lowest ranges that
differ are shuffled, to be compared key by key; so what travels follows the changes, and not
the snapshots. A snapshot's digests can be stored, so that it isn't even read where it
doesn't differ.

Rows that repeat count once; a side that holds a row twice only makes its range differ.
Null keys are keys. Digests are of 64 bits: of n ranges that differ, about n / 2**64 are missed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.session import stored

#: Ranges that one is split into; rows of a lowest range; differing ranges that are sent whole to every executor.
FANOUT, LEAF, BROADCAST_RANGES = 1024, 64, 1_000_000
BITS = FANOUT.bit_length() - 1


def _hash(keys: list[str]) -> Column:
    filled = [x for k in keys for x in (F.col(k).isNull(), F.col(k))]
    return F.xxhash64(*filled)


def _range(level: int) -> Column:
    """The leading BITS * level bits of the hash."""
    return F.shiftrightunsigned(F.col("_h"), 64 - BITS * level)


def hashed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, _hash(keys).alias("_h"))


def digests(rows: DataFrame, level: int) -> DataFrame:
    """range, n, total: one row for each range of the level that has rows."""
    return rows.groupBy(_range(level).alias("range")).agg(F.count("*").alias("n"), F.sum(F.xxhash64("_h").cast("decimal(20)")).alias("total"))


def _within(rows: DataFrame, ranges: DataFrame, level: int) -> DataFrame:
    few = F.broadcast(ranges) if ranges.count() <= BROADCAST_RANGES else ranges
    return rows.join(few, _range(level) == F.col("range"), "left_semi")


def differing(old: DataFrame, new: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """The rows (hashed) of the lowest ranges in which the sides differ."""
    for level in range(1, levels + 1):
        a, b = (digests(side, level).withColumnsRenamed({"n": f"{s}_n", "total": f"{s}_total"}) for side, s in ((old, "a"), (new, "b")))
        both = a.join(b, "range", "full_outer")
        apart = both.where(~F.col("a_n").eqNullSafe(F.col("b_n")) | ~F.col("a_total").eqNullSafe(F.col("b_total"))).select("range")
        apart = stored(apart, "ranges")
        old, new = _within(old, apart, level), _within(new, apart, level)
    return old, new


def changes(old: DataFrame, new: DataFrame, keys: list[str], levels: int | None = None) -> DataFrame:
    """keys, status: the rows that were added or deleted, as sync.diff has them; unchanged ones are left out."""
    if levels is None:
        n = new.count()  # from the files' footers, where new is a table
        levels = max(1, min(3, math.ceil(math.log(max(n / LEAF, 2), FANOUT))))
    a, b = differing(hashed(old, keys), hashed(new, keys), levels)
    sides = a.select(*keys, F.lit(-1).alias("_side")).unionByName(b.select(*keys, F.lit(1).alias("_side")))
    met = sides.groupBy(*keys).agg(F.min("_side").alias("_least"), F.max("_side").alias("_most"))
    return met.where("_least = _most").select(*keys, F.when(F.col("_most") == 1, "added").otherwise("deleted").alias("status"))
