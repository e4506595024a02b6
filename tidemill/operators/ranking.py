"""Places in a total order over any number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import scratch


def places(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with each row's place by order, from 1.

    Rows are range-partitioned and written once, so that both readings see the same ranges;
    a row's place is its place in its range and the rows of the ranges before.
    """
    spark = df.sparkSession
    path = scratch(spark, "ranges")
    ranged = df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id())
    ranged.write.parquet(path)
    rows = spark.read.schema(ranged.schema).parquet(path)
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))  # one row a partition
    earlier = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    joined = rows.join(sizes.select("_range", earlier.alias("_before")), "_range")
    return joined.select(*df.columns, (F.col("_before") + within).cast("int").alias(name))
