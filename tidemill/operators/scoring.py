"""Confidence of ranked result sets, votes and the choice between two stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.rules import ASSERT_AT, EPSILON, FLOOR, HIGH, MEDIUM, PROFILES, RANK_TEMP, SPAN, STORE_MARGIN


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def band(x: Column) -> Column:
    return F.when(x >= HIGH, "high").when(x >= MEDIUM, "medium").otherwise("low")


def signals(pools: DataFrame, keys: list[str], k: int = 5, profile: str = "web") -> DataFrame:
    """One row a pool(keys, pos from 1, score): pool_size, top1, abs, sep, rank.

    sep compares the best with the mean of what lies behind place k, or of all but the best
    if nothing does. Sums of a pool are small and mergeable, so one shuffle by key suffices.
    """
    p = PROFILES[profile]
    cond = lambda c, v: F.when(c, v)
    pos, score = F.col("pos"), F.col("score")
    out = pools.groupBy(*keys).agg(
        F.count("*").alias("pool_size"),
        F.max("score").alias("top1"),
        F.max(cond(pos == 1, score)).alias("_first"),
        F.max(cond(pos == 2, score)).alias("_second"),
        F.avg(cond(pos > k, score)).alias("_tail"),
        F.avg(cond(pos > 1, score)).alias("_others"),
    )
    rest = F.coalesce("_tail", "_others")
    ratio = F.log10((F.col("_first") + EPSILON) / (rest + EPSILON))
    sep = F.when(rest.isNull(), 0.0).otherwise(sigmoid((ratio - p["sep_mid"]) / p["sep_temp"])) if p["use_sep"] else F.lit(0.0)
    rank = F.when(F.col("_second").isNull(), 1.0).otherwise(F.tanh((F.col("_first") - F.col("_second")) / RANK_TEMP))
    return out.select(
        *keys, "pool_size", "top1", ratio.alias("log_ratio"), sigmoid((F.col("top1") - p["abs_mid"]) / p["abs_temp"]).alias("abs"), sep.alias("sep"), rank.alias("rank")
    )


def confidence(found: DataFrame, filtered: Column, agreement: Column, profile: str = "web") -> DataFrame:
    """Adds set_confidence, final, band and mode to signals; bands use unrounded values."""
    if PROFILES[profile]["use_sep"]:
        sc = F.when(filtered, F.greatest("abs", "rank")).otherwise(F.greatest("abs", "sep"))
    else:
        sc = F.col("abs")
    df = found.withColumn("set_confidence", sc)
    df = df.withColumn("final", F.col("set_confidence") * (FLOOR + SPAN * agreement)).withColumn("band", band(F.col("final")))
    return df.withColumn("mode", F.when(F.col("rank") >= ASSERT_AT, "assert").otherwise("disambiguate"))


def votes(df: DataFrame, keys: list[str], label: str, pos: str, voters: int = 5) -> DataFrame:
    """The most frequent label of each key, ties to the one seen first, and its share."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    w = Window.partitionBy(*keys)
    ranked = counts.withColumn("total", F.sum("n").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "first", label)))
    return ranked.where("r = 1").select(*keys, F.col(label).alias("label"), "n", "total", F.round(F.col("n") / F.greatest(F.lit(voters), F.col("total")), 4).alias("agreement"))


def arbitrate(web: DataFrame, upload: DataFrame, keys: list[str]) -> DataFrame:
    """The better of two stores for each key, of rows (keys, band, final): by band, then final with a margin."""
    level = lambda b: F.when(b == "high", 2).when(b == "medium", 1).when(b == "low", 0).otherwise(-1)
    side = lambda df, s: df.select(*keys, F.col("band").alias(f"band_{s}"), F.col("final").alias(f"final_{s}"))
    both = side(web, "web").join(side(upload, "upload"), keys, "full_outer")
    w, u = level(F.col("band_web")), level(F.col("band_upload"))
    near = F.col("final_upload") >= STORE_MARGIN * F.col("final_web")
    return both.withColumn("store", F.when(u > w, "upload").when(w > u, "web").when(near, "upload").otherwise("web"))
