"""Labelled evaluation and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hit_ranks(ranked: DataFrame, key: str, hit: Column) -> DataFrame:
    """key, hit_rank: the first place whose row is a hit, null if none is."""
    return ranked.groupBy(key).agg(F.min(F.when(hit, F.col("pos"))).alias("hit_rank"))


def hit_summary(ranks: DataFrame, k: int = 5) -> DataFrame:
    r = F.col("hit_rank")
    return ranks.agg(F.count("*").alias("queries"), F.count_if(r == 1).alias("rank1"), F.count_if(r <= k).alias("top_k"), F.count_if(r.isNull()).alias("missed"))


def separation(scored: DataFrame, score: str, good: Column) -> DataFrame:
    """Least, median and greatest score of both classes, the gap between them and its middle."""
    g, b = F.when(good, F.col(score)), F.when(~good, F.col(score))
    df = scored.agg(
        F.min(g).alias("good_min"), F.percentile(g, F.lit(0.5)).alias("good_median"), F.max(g).alias("good_max"),
        F.min(b).alias("bad_min"), F.percentile(b, F.lit(0.5)).alias("bad_median"), F.max(b).alias("bad_max"),
    )
    gap = F.col("good_min") - F.col("bad_max")
    return df.withColumn("gap", gap).withColumn("midpoint", F.when(gap > 0, (F.col("good_min") + F.col("bad_max")) / 2))


def describe_pool(pools: DataFrame, key: str) -> DataFrame:
    """top1, its place in retrieval, and its ratio to the mean of the rest, of (key, retrieved, score)."""
    df = pools.groupBy(key).agg(F.max("score").alias("top1"), F.max_by("retrieved", F.struct("score", -F.col("retrieved"))).alias("argmax"), F.sum("score").alias("s"), F.count("*").alias("n"))
    rest = (F.col("s") - F.col("top1")) / F.nullif(F.col("n") - 1, F.lit(0))
    return df.select(key, "top1", "argmax", (F.col("top1") / F.nullif(rest, F.lit(0.0))).alias("ratio"))


def probe(pools: DataFrame, key: str, k: int = 5, epsilon: float = 1e-4) -> DataFrame:
    """top1, top2, floor (mean behind place k) and their ratio."""
    at = lambda c: F.max(F.when(c, F.col("score")))
    df = pools.groupBy(key).agg(at(F.col("pos") == 1).alias("top1"), at(F.col("pos") == 2).alias("top2"), F.avg(F.when(F.col("pos") > k, F.col("score"))).alias("floor"))
    return df.withColumn("ratio", (F.col("top1") + epsilon) / (F.col("floor") + epsilon))


def gap_confidence(top1: Column, top2: Column) -> Column:
    """The older confidence of a re-ranked list: its best score and the gap behind it."""
    return 0.6 * top1 + 0.4 * F.least(F.lit(1.0), (top1 - F.coalesce(top2, F.lit(0.0))) / 0.1)


def carrier(abs_: Column, sep: Column, rank: Column) -> Column:
    """The signal that carries a result; a missing or zero sep gives way to rank."""
    other = F.coalesce(F.nullif(sep, F.lit(0.0)), rank)
    return F.when(abs_ >= other, abs_).otherwise(other)


def coverage(heads: DataFrame, group: str) -> DataFrame:
    """Heads of each filled group, with a warning where there are more than two."""
    return heads.where(F.coalesce(group, F.lit("")) != "").groupBy(group).agg(F.count("*").alias("heads")).withColumn("warning", F.col("heads") > 2)


def head_warnings(heads: DataFrame, group: str, most: int = 2) -> DataFrame:
    """warning, grp, heads: groups with more heads than a card and a profile give, heads of no group, no group at all."""
    named = F.trim(F.coalesce(group, F.lit(""))) != ""
    per = heads.groupBy(F.when(named, F.col(group)).alias("grp")).agg(F.count("*").alias("heads"))
    found = per.where((F.col("heads") > most) | F.col("grp").isNull()).select(F.when(F.col("grp").isNull(), "unnamed").otherwise("crowded").alias("warning"), "grp", "heads")
    none = per.agg(F.count("grp").alias("heads")).where("heads = 0").select(F.lit("none").alias("warning"), F.lit(None).cast("string").alias("grp"), "heads")
    return found.unionByName(none)


def thin(df: DataFrame, group: str, least: int = 20) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") < least)


def sizes(df: DataFrame, length: Column, *by: str) -> DataFrame:
    """Least, floored mean and greatest length."""
    n = length.cast("long")
    return df.groupBy(*by).agg(F.count("*").alias("chunks"), F.min(n).alias("least"), F.floor(F.sum(n) / F.count(n)).cast("long").alias("mean"), F.max(n).alias("most"))


# Spreads at scale: sketches that are stored by part and merged. ---------------

#: Values a sketch keeps on its lowest level.
SKETCH = 200


def rank_error(k: int = SKETCH) -> float:
    """How far a quantile's rank may be from the one asked for, as a share of all rows (in 99 of 100 cases)."""
    return 2.296 / k**0.9723


def spread_sketches(df: DataFrame, value: Column, *by: str, k: int = SKETCH) -> DataFrame:
    """by, sketch: a mergeable quantile sketch of whole numbers for each group; nulls don't count."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_bigint(value.cast("long"), F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    """by, sketch: sketches of parts as one for each group, in whatever order."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch").alias("sketch"))


def spread(sketches: DataFrame, quantiles: list[float]) -> DataFrame:
    """The sketches' columns but the sketch, with n and values, one for each quantile."""
    rest = [c for c in sketches.columns if c != "sketch"]
    n = F.kll_sketch_get_n_bigint("sketch")
    return sketches.select(*rest, n.alias("n"), F.kll_sketch_get_quantile_bigint("sketch", F.array(*map(F.lit, quantiles))).alias("values"))


def rank_errors(df: DataFrame, value: Column, spreads: DataFrame, quantiles: list[float], by: str) -> DataFrame:
    """by, n, error: the largest distance of any quantile's rank from the one asked for; equal values have a range of ranks."""
    asked = spreads.select(F.col(by).alias("_by"), F.posexplode("values").alias("_i", "_v"))
    rows = df.select(F.col(by), value.alias("_x")).where("_x IS NOT NULL").join(F.broadcast(asked), F.col(by).eqNullSafe(F.col("_by")))
    met = rows.groupBy(by, "_i").agg(F.count_if(F.col("_x") < F.col("_v")).alias("_less"), F.count_if(F.col("_x") <= F.col("_v")).alias("_most"), F.count("*").alias("n"))
    q = F.get(F.array(*map(F.lit, quantiles)), F.col("_i"))
    off = F.greatest(F.col("_less") / F.col("n") - q, q - F.col("_most") / F.col("n"), F.lit(0.0))
    return met.groupBy(by).agg(F.max("n").alias("n"), F.max(off).alias("error"))
