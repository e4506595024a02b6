"""Helpers the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.session import small_batches  # noqa: F401

#: Words everywhere here: maximal runs without space and the characters U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a local one only for a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tidemill-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts lineage: a lost executor costs its running tasks, not the stages before.
    The tables belong to whoever runs the session: results read them, so only the caller
    knows when they can go, with `sweep`. The pipeline sweeps after each of its stages.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def session_dir(spark: SparkSession) -> str:
    return f"{work_dir(spark)}/tidemill-{spark.sparkContext.applicationId}"


def _folder(spark: SparkSession):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(session_dir(spark))
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def tables(spark: SparkSession) -> set[str]:
    """Names of the tables that `materialise` wrote in this session."""
    folder, fs = _folder(spark)
    return {f.getPath().getName() for f in fs.listStatus(folder)} if fs.exists(folder) else set()


def sweep(spark: SparkSession, keep: DataFrame | None = None, older: set[str] = frozenset()) -> None:
    """Delete the session's tables, but those that `keep` reads and those named in `older`."""
    folder, fs = _folder(spark)
    used = {f.rsplit("/", 2)[-2] for f in keep.inputFiles()} if keep is not None else set()
    for name in tables(spark) - used - set(older):
        fs.delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, name), True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Rows of a few numbers each that are sent whole to every executor: some 60 MB at most.
BROADCAST_ROWS = 2_000_000


def light(df: DataFrame) -> DataFrame:
    """A materialised side of a few numbers a row: broadcast if counted small, else left to a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the columns an operator reads, so that others with clashing names do no harm."""
    return df.select(*[df[n] for n in names])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
