"""Keyed writes on a table in the shared folder: copy-on-write by bucket, versions, racing writers.

A table's rows lie in buckets by a hash of `bucket_by`. A write finds which buckets its rows
fall into, has Spark rewrite only those, and commits a new version: a small JSON manifest that
names the folder of every bucket. Folders are never changed, so older versions stay readable
until `vacuum`.

The manifest of a version can be created once only. A writer that finds its version taken
looks at what has been committed since: if that touched none of its buckets, it commits its
folders on top; else it runs again on the newest version. No rows pass through the driver,
which sees at most one number a bucket: the keys of a write meet the table by sort-merge.

Rules of the writes: keys that occur several times in one write are an error in the caller's
data and keep one row, the largest by all columns; null keys are equal to each other; columns
missing in a write are null; columns that the table doesn't have are an error. A table that is
created with unique=False holds any number of rows a key, equal ones too: all rows of a write
replace all that have their keys.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemill.session import shuffled

#: Files a bucket is written in at most, so that one large bucket isn't one task.
FILES = 4
BUCKET = "_bucket"


class Conflict(Exception):
    """Somebody else has committed the version."""


@dataclass
class Version:
    number: int
    buckets: dict[int, str]
    schema: str
    keys: list[str]
    bucket_by: list[str]
    n_buckets: int
    operation: str = "create"
    touched: list[int] = field(default_factory=list)
    bytes_written: int = 0
    unique: bool = True


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # Files --------------------------------------------------------------------

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _text(self, path: str) -> str:
        p, fs = self._hadoop(path)
        stream = fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create_once(self, path: str, text: str) -> None:
        """Write a whole file under a name that doesn't exist yet, or raise Conflict."""
        p, fs = self._hadoop(f"{path}.{uuid.uuid4().hex}")
        stream = fs.create(p, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        target, _ = self._hadoop(path)
        jvm = self.spark.sparkContext._jvm
        try:
            if fs.getUri().getScheme() == "file":  # renaming replaces here, linking doesn't
                os.link(p.toUri().getPath(), target.toUri().getPath())
            else:
                context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
                options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(p, target, options)
        except FileExistsError as error:
            raise Conflict(path) from error
        except Exception as error:
            if fs.exists(target):
                raise Conflict(path) from error
            raise
        finally:
            if fs.exists(p):
                fs.delete(p, False)

    def _log(self, number: int) -> str:
        return f"{self.path}/log/{number:010d}.json"

    def versions(self) -> list[int]:
        p, fs = self._hadoop(f"{self.path}/log")
        names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> Version:
        raw = json.loads(self._text(self._log(self.versions()[-1] if number is None else number)))
        return Version(**raw | {"buckets": {int(b): d for b, d in raw["buckets"].items()}})

    # Reading ------------------------------------------------------------------

    def _read(self, v: Version, buckets: set[int] | None = None, numbered: bool = False) -> DataFrame:
        schema = StructType.fromJson(json.loads(v.schema))
        paths = sorted({d for b, d in v.buckets.items() if buckets is None or b in buckets})
        full = StructType([*schema.fields, StructField(BUCKET, IntegerType())])
        if not paths:
            rows = self.spark.createDataFrame([], full)
        else:
            # A folder is <write>/_bucket=<number>; the number is read from the path.
            rows = self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*paths)
        return rows.select(*schema.names, *[BUCKET] * numbered)

    def read(self, version: int | None = None, where: dict | None = None) -> DataFrame:
        """The rows of a version; with `where`, values of all bucket columns, from their bucket only."""
        v = self.version(version)
        if where is None:
            return self._read(v)
        row = self.spark.range(1).select(*[F.lit(where[c]).cast(self._type(v, c)).alias(c) for c in v.bucket_by])
        only = {r[0] for r in row.select(self._bucket(v)).collect()}
        return self._read(v, only).where(_all(F.col(c).eqNullSafe(F.lit(where[c])) for c in v.bucket_by))

    def _type(self, v: Version, column: str) -> str:
        return StructType.fromJson(json.loads(v.schema))[column].dataType.simpleString()

    @staticmethod
    def _bucket(v: Version) -> Column:
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0null")) for c in v.bucket_by]), F.lit(v.n_buckets)).cast("int").alias(BUCKET)

    # Writing ------------------------------------------------------------------

    def create(self, rows: DataFrame, keys: list[str], bucket_by: list[str] | None = None, n_buckets: int = 16, unique: bool = True) -> Version:
        """The first version, from rows with these keys; one row a key if they are unique."""
        bucket_by = bucket_by or keys
        if not set(bucket_by) <= set(keys) and bucket_by != keys:
            keys = list(dict.fromkeys([*bucket_by, *keys]))
        v = Version(-1, {}, rows.schema.json(), list(keys), list(bucket_by), n_buckets, unique=unique)
        p, fs = self._hadoop(f"{self.path}/log")
        fs.mkdirs(p)
        found, size = self._write(_settled(rows, v).withColumn(BUCKET, self._bucket(v)))
        return self._commit(Version(0, found, v.schema, v.keys, v.bucket_by, n_buckets, "create", sorted(found), size, unique))

    def _write(self, rows: DataFrame) -> tuple[dict[int, str], int]:
        """Folders of the buckets, and their bytes."""
        folder = f"{self.path}/data/write={uuid.uuid4().hex}"
        spread = F.pmod(F.xxhash64(*[c for c in rows.columns if c != BUCKET]), F.lit(FILES))
        rows.repartition(F.col(BUCKET), spread).write.partitionBy(BUCKET).parquet(folder)
        p, fs = self._hadoop(folder)
        found = {int(f.getPath().getName().split("=")[1]): f"{folder}/{f.getPath().getName()}" for f in fs.listStatus(p) if f.isDirectory()}
        return found, int(fs.getContentSummary(p).getLength())

    def _commit(self, v: Version) -> Version:
        self._create_once(self._log(v.number), json.dumps(v.__dict__))
        return v

    def _change(self, operation: str, touched: Callable[[Version], set[int]], rewrite: Callable[[Version, DataFrame], DataFrame]) -> Version:
        """rewrite: all rows of the touched buckets, with their bucket, to those that replace them."""
        while True:
            base = self.version()
            hit = touched(base)
            if not hit:
                return base
            found, size = self._write(rewrite(base, self._read(base, hit, numbered=True)))
            latest = base
            while True:
                buckets = {b: d for b, d in latest.buckets.items() if b not in hit} | found
                try:
                    return self._commit(Version(latest.number + 1, buckets, base.schema, base.keys, base.bucket_by, base.n_buckets, operation, sorted(hit), size, base.unique))
                except Conflict:
                    since = [self.version(n) for n in self.versions() if n > latest.number]
                    latest = since[-1]
                    if any(hit & set(v.touched) for v in since):
                        for d in found.values():
                            p, fs = self._hadoop(d)
                            fs.delete(p, True)
                        break  # their rows are in our buckets: run again on them

    def _numbered(self, rows: DataFrame, v: Version) -> DataFrame:
        names = StructType.fromJson(json.loads(v.schema)).names
        if extra := set(rows.columns) - set(names):
            raise ValueError(f"the table has no columns {sorted(extra)}")
        whole = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(self._type(v, c)).alias(c) for c in names])
        return whole.withColumn(BUCKET, self._bucket(v))

    def _hit(self, rows: DataFrame, v: Version) -> set[int]:
        """Buckets that the rows fall into: a number each, at most n_buckets."""
        return {r[0] for r in rows.select(self._bucket(v)).distinct().collect()}

    def upsert(self, rows: DataFrame) -> Version:
        """Rows whose keys are there replace them, others are added."""

        def rewrite(v: Version, old: DataFrame) -> DataFrame:
            new = self._numbered(_settled(rows, v), v)
            return _without(old, new, v.keys).unionByName(new)

        return self._change("upsert", lambda v: self._hit(rows, v), rewrite)

    def delete(self, keys: DataFrame) -> Version:
        """Rows whose keys are among these go."""
        return self._change("delete", lambda v: self._hit(keys, v) & set(v.buckets), lambda v, old: _without(old, keys, v.keys))

    def delete_where(self, condition: Column) -> Version:
        """Rows for which the condition is true go; buckets without any aren't rewritten."""
        hit = lambda v: {r[0] for r in self._read(v, numbered=True).where(condition).select(BUCKET).distinct().collect()}
        return self._change("delete where", hit, lambda v, old: old.where(~F.coalesce(condition, F.lit(False))))

    def replace(self, rows: DataFrame) -> Version:
        """All rows that share the bucket columns with one of these are replaced by these."""

        def rewrite(v: Version, old: DataFrame) -> DataFrame:
            return _without(old, rows, v.bucket_by).unionByName(self._numbered(_settled(rows, v), v))

        return self._change("replace", lambda v: self._hit(rows, v), rewrite)

    def merge(self, changes: DataFrame, columns: list[str]) -> Version:
        """Filled values of `columns` replace those of rows with the same keys; buckets in which nothing changes stay."""

        def merged(v: Version, old: DataFrame) -> tuple[DataFrame, Column]:
            fresh = _one_a_key(changes, v.keys).select(*[F.col(k).alias(f"_k_{k}") for k in v.keys], *[F.col(c).alias(f"_new_{c}") for c in columns])
            rows = old.join(shuffled(fresh), _all(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in v.keys), "left")
            differs = F.lit(False)
            for c in columns:
                differs = differs | (F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)))
            return rows, differs

        def hit(v: Version) -> set[int]:
            rows, differs = merged(v, self._read(v, self._hit(changes, v) & set(v.buckets), numbered=True))
            return {r[0] for r in rows.where(differs).select(BUCKET).distinct().collect()}

        def rewrite(v: Version, old: DataFrame) -> DataFrame:
            rows, _ = merged(v, old)
            return rows.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in old.columns])

        return self._change("merge", hit, rewrite)

    def vacuum(self, keep: int = 1) -> None:
        """Delete versions but the last `keep`, and the folders that only they name."""
        numbers = self.versions()
        gone, stay = numbers[:-keep], numbers[-keep:]
        used = {d for n in stay for d in self.version(n).buckets.values()}
        for d in {d for n in gone for d in self.version(n).buckets.values()} - used:
            p, fs = self._hadoop(d)
            fs.delete(p, True)
        for n in gone:
            p, fs = self._hadoop(self._log(n))
            fs.delete(p, False)


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def _settled(rows: DataFrame, v: Version) -> DataFrame:
    return _one_a_key(rows, v.keys) if v.unique else rows


def _one_a_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c, t in rows.dtypes if not t.startswith("map")])
    return rows.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")


def _without(old: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    other = keys.select(*[F.col(k).alias(f"_k_{k}") for k in by]).distinct()
    return old.join(shuffled(other), _all(F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in by), "left_anti")
