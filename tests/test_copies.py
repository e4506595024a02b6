"""Queries on tables in which rows repeat under other keys, as larger copies of the given ones do."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.oracle import differences
from tidemill.plans.catalogue import ORACLE_SQL, QUERIES

KEYS = {"pages": "page_id"}


@pytest.fixture(scope="module")
def copies(spark, sf_dir, tmp_path_factory):
    folder = tmp_path_factory.mktemp("copies")
    for name, key in KEYS.items():
        t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        n = t.agg(F.max(key)).first()[0] + 1
        t.unionByName(t.withColumn(key, F.col(key) + n)).coalesce(1).toPandas().to_parquet(folder / f"{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["manifest_remove", "manifest_upsert"])
def test_matches_oracle_on_copies(spark, copies, name):
    assert differences(spark, QUERIES[name], ORACLE_SQL[name], copies) == ""


def test_stream_of_arrivals_in_many_files(spark, sf_dir, tmp_path):
    """An arrival of more files than a micro-batch used to read: none of its messages is late."""
    spark.read.parquet(f"{sf_dir}/events.parquet").repartition(9, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"SET TimeZone = 'UTC'; CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4k")
    try:
        assert differences(spark, QUERIES["streamed_admission"], ORACLE_SQL["streamed_admission"], str(tmp_path), con) == ""
    finally:
        spark.conf.set(key, before)
