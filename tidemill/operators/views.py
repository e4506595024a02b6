"""Counts that are kept up to date by signed deltas.

A view is the number of rows by key of what some rows say (words of texts, languages,
sources). Rows that come count +1 and rows that go -1; a delta is the sum by key of both, so
that only changed rows are read. It is applied to the view's keyed table: the buckets of its
keys are rewritten, and keys that reach zero vanish.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.operators.keyed_table import KeyedTable, Version, _all
from tidemill.session import scratch, stored

Said = Callable[[DataFrame], DataFrame]


class CountView:
    """key columns and n: how often `said` gives each key for the rows of a table."""

    def __init__(self, said: Said, rows: DataFrame, path: str | None = None, n_buckets: int = 16) -> None:
        spark = rows.sparkSession
        self.said = said
        first = said(rows)
        self.keys = first.columns
        self.table = KeyedTable(spark, path or scratch(spark, "view"))
        self.table.create(first.groupBy(*self.keys).agg(F.count("*").alias("n")), self.keys, n_buckets=n_buckets)

    def delta(self, gone: DataFrame | None, come: DataFrame | None) -> DataFrame:
        """keys, n: what changes, without what cancels out."""
        parts = [self.said(df).select(*self.keys, F.lit(sign).cast("long").alias("n")) for df, sign in ((gone, -1), (come, 1)) if df is not None]
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return both.groupBy(*self.keys).agg(F.sum("n").alias("n")).where("n <> 0")

    def apply(self, gone: DataFrame | None = None, come: DataFrame | None = None) -> Version:
        change = stored(self.delta(gone, come), "delta")
        renamed = change.withColumnsRenamed({k: f"_d_{k}" for k in self.keys} | {"n": "_d"})

        def rewrite(v: Version, old: DataFrame) -> DataFrame:
            # Keys that the view lacks start at 0.
            fresh = self.table._numbered(change.withColumn("n", F.lit(0).cast("long")), v)
            on = _all(F.col(k).eqNullSafe(F.col(f"_d_{k}")) for k in self.keys)
            all_ = old.unionByName(fresh).groupBy(*[c for c in old.columns if c != "n"]).agg(F.sum("n").alias("n"))
            summed = all_.join(renamed, on, "left").withColumn("n", F.col("n") + F.coalesce("_d", F.lit(0)))
            return summed.where("n > 0").select(old.columns)

        return self.table._change("delta", lambda v: self.table._hit(change, v), rewrite)

    def read(self) -> DataFrame:
        return self.table.read()
