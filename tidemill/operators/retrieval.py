"""Exact vector retrieval with metadata filters, and re-ranking of pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators import blocks


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def pools(queries: DataFrame, vectors: DataFrame, n: int = 15, same_label: bool = False, carry: list[str] = ()) -> DataFrame:
    """query_id, pos, vec_id, score: the n nearest by cosine of each query among other vectors.

    queries(query_id, vector, label), vectors(vec_id, embedding, label). With same_label a
    query meets vectors of its own label only (a metadata filter before ranking); filters on
    one side are filters of that side. carry: further columns of vectors to pass through.

    A stated query set meets all vectors in blocks, as matrix products; each pair of blocks
    gives back n rows a query, so that this is what is shuffled.
    """
    key = F.col("label").cast("string") if same_label else F.lit("")
    found = blocks.nearest(queries.select("query_id", "vector", key.alias("key")), vectors.select("vec_id", "embedding", key.alias("key")), n)
    found = found.select("query_id", "pos", "vec_id", "score")
    return found.join(vectors.select("vec_id", *carry), "vec_id").select("query_id", "pos", "vec_id", "score", *carry) if carry else found


def rerank(pool: DataFrame, score: Column, k: int = 5) -> DataFrame:
    """Pools re-ordered by a new score, stable: equal scores keep their retrieval order. All rows stay; `kept` marks the top k."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "retrieved")
    df = pool.withColumnRenamed("pos", "retrieved").withColumn("score", score)
    df = df.withColumn("pos", F.row_number().over(best))
    return df.withColumn("kept", F.col("pos") <= k)


def with_fallback(scoped: DataFrame, plain: DataFrame) -> DataFrame:
    """The scoped pool of each query, or its plain pool where the scoped one is empty."""
    missing = plain.join(scoped.select("query_id").distinct(), "query_id", "left_anti")
    return scoped.withColumn("filtered", F.lit(True)).unionByName(missing.withColumn("filtered", F.lit(False)))


def centroids(vectors: DataFrame) -> DataFrame:
    """label, centroid: mean vector of each label."""
    parts = vectors.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


#: Centroids that are sent whole to every executor; else shares in which they meet the queries.
FEW_CENTROIDS, SHARES = 10_000, 64


def nearest_centroid(queries: DataFrame, centroids: DataFrame) -> DataFrame:
    """query_id, category, score: the centroid (category, centroid) of largest product with each query(query_id, vector); ties to the first category."""
    few = centroids.count() <= FEW_CENTROIDS
    shares = 1 if few else SHARES
    c = centroids.withColumn("_share", F.pmod(F.xxhash64("category"), F.lit(shares)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_share")
    pairs = queries.select("*", every).join(F.broadcast(c) if few else c, "_share")
    scored = pairs.select("query_id", "category", F.round(dot(F.col("vector"), F.col("centroid")), 9).alias("score"))
    best = scored.groupBy("query_id").agg(F.max(F.struct("score", (-F.col("category")).alias("n"))).alias("b"))
    return best.select("query_id", (-F.col("b.n")).alias("category"), F.col("b.score").alias("score"))


def upload_sources(pool: DataFrame) -> DataFrame:
    """A pool of uploads (title, page) with source_url and heading, which web chunks have of their own."""
    return pool.withColumns({"source_url": F.format_string("%s (page %d)", "title", "page"), "heading": F.col("title")})
