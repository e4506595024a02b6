"""Session and table helpers shared by every query."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def get_session(cpus: str | int = "*", app: str = "tidemill", **extra: str) -> SparkSession:
    """A local session with the settings the library is tested under."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMILL_DRIVER_MEMORY", "8g"))
    )
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give the workers this package, once a Spark context, wherever they were started."""
    context = spark.sparkContext
    if getattr(context, "_tidemill_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="tidemill-ship-")
    here = Path(__file__).resolve().parent
    context.addPyFile(shutil.make_archive(f"{folder}/tidemill", "zip", here.parent, here.name))
    context._tidemill_shipped = True


#: Bytes of an Arrow batch on its way to a worker, and Spark's own default.
BATCH, DEFAULT_BATCH = "4m", str(64 << 20)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a few MB, unless the session's owner has chosen a size.

    The JVM and the worker each hold a batch several times over, for every running task.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if str(spark.conf.get(key)).rstrip("bB") == DEFAULT_BATCH:
        spark.conf.set(key, BATCH)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables below sf_dir; Spark's own reader resolves the path."""
    ship(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path below the shared folder of spark.checkpoint.dir; below a local one only for a local master."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context = spark.sparkContext
        path = context._tidemill_scratch = getattr(context, "_tidemill_scratch", None) or "file://" + tempfile.mkdtemp(prefix="tidemill-")
    return f"{path.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: what several steps need is computed once, and survives lost executors."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: never sent whole through the driver.

    Spark takes it for as small as its files or shuffled parts; words, keys and copied texts
    are many times that in memory.
    """
    return df.hint("merge")
