"""Reports: coverage, distributions, labelled evaluation, and relational shapes over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import evaluation, scoring
from tidemill.plans.registry import query
from tidemill.session import table


@query("SELECT lang, count(*) AS heads, count(*) > 2 AS warning FROM documents WHERE coalesce(lang, '') <> '' GROUP BY lang")
def language_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document plays a head, languages the departments."""
    return evaluation.coverage(table(spark, sf_dir, "documents"), "lang")


@query("SELECT p_brand || p_size AS grp, count(*) AS n FROM part GROUP BY 1 HAVING count(*) < 20")
def thin_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat("p_brand", F.col("p_size").cast("string")).alias("grp"))
    return evaluation.thin(p, "grp")


@query("SELECT lang, source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ALL")
def distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""
WITH s AS (SELECT l.quality = 1 AS good, CAST(len(regexp_extract_all(d.text, '[.]')) AS DOUBLE) / (1 + length(d.text)) AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id),
a AS (SELECT min(score) FILTER (good) AS good_min, quantile_cont(score, 0.5) FILTER (good) AS good_median, max(score) FILTER (good) AS good_max,
  min(score) FILTER (NOT good) AS bad_min, quantile_cont(score, 0.5) FILTER (NOT good) AS bad_median, max(score) FILTER (NOT good) AS bad_max FROM s)
SELECT round(good_min, 6) AS good_min, round(good_median, 6) AS good_median, round(good_max, 6) AS good_max, round(bad_min, 6) AS bad_min, round(bad_median, 6) AS bad_median,
  round(bad_max, 6) AS bad_max, round(good_min - bad_max, 6) AS gap, round(CASE WHEN good_min > bad_max THEN (good_min + bad_max) / 2 END, 6) AS midpoint FROM a""")
def separation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.regexp_count("text", F.lit("[.]")) / (1 + F.length("text"))).alias("score"))
    j = table(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id")
    out = evaluation.separation(j, "score", F.col("quality") == 1)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("""
WITH s AS (SELECT doc_id, n_chars / 1000.0::DOUBLE AS final FROM documents)
SELECT CASE WHEN final >= 0.7 THEN 'high' WHEN final >= 0.35 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM s GROUP BY 1""")
def band_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(scoring.band(F.col("n_chars") / 1000).alias("band"))
    return d.groupBy("band").agg(F.count("*").alias("n"))


@query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_shipdate <= TIMESTAMP '1998-09-02'")
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(revenue), 2).alias("revenue"), F.count("*").alias("n"))


@query("""
SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def nation_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, c, n = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def customers_without_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return table(spark, sf_dir, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("SELECT user_id, event_id, date_diff('second', lag(ts) OVER w, ts) > 86400 AS new_session FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def idle_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sec = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", (sec - F.lag(sec).over(w) > 86_400).alias("new_session"))
