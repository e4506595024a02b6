"""Mixing sources to target weights (operator 1).

Sizes are counted in one pass over the texts; all later steps read only ids, sources and
sizes. Targets come from filling by weight below each source's bound (a sorted prefix sum
over sources). Documents get hash-random keys, are range-sorted by source and key over all
partitions, and get distributed prefix sums: sums of each partition's part of a source,
offsets over those few sums, running sums inside the part. A source whose target exceeds
its size repeats whole epochs; the rest of its budget is cut at the exact word.

Edge cases: null or blank text has size 0 and is never taken; a null source is a source of
its own, last in order; rows that repeat are each documents (equal keys are ordered by id,
then size); sources of size 0 have target 0; very long texts are counted whole, and may be
taken in part; an empty table gives no rows; only doc_id, text and source are read, so further
columns, whatever their names, do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import light, materialise, pick, shuffle_partitions, word_count


def prefix_sums(df: DataFrame, within: list[str], order: list[Column], names: dict[str, str], tag: str) -> DataFrame:
    """df with, for each value column in names, the sum over earlier rows of the same `within` key."""
    p = shuffle_partitions(df.sparkSession)
    ranged = df.repartitionByRange(p, *[F.col(c) for c in within], *order).withColumn("_part", F.spark_partition_id())
    ranged = materialise(ranged, tag)
    parts = ranged.groupBy(*within, "_part").agg(*[F.sum(v).alias(f"_sum_{v}") for v in names])
    earlier = Window.partitionBy(*within).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*within, "_part", *[F.coalesce(F.sum(f"_sum_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in names])
    running = Window.partitionBy(*within, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(parts, [*within, "_part"])
    return joined.select(*df.columns, *[(F.col(f"_off_{v}") + F.coalesce(F.sum(v).over(running), F.lit(0))).alias(n) for v, n in names.items()])


def targets(sizes: DataFrame, weights: list[int], share: float, bound: float) -> DataFrame:
    """sizes(source, size) with sid (place in code point order, null last) and target.

    target = least(bound * size, level * weight), where level spends share of all sizes;
    resharing the excess by weight until none is above ends at the same level.
    """
    rows = prefix_sums(sizes.withColumn("_one", F.lit(1).cast("long")), [], [F.asc_nulls_last("source")], {"_one": "sid"}, "sources").drop("_one")
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    rows = materialise(rows.withColumn("weight", weight).withColumn("most", F.lit(bound) * F.col("size")), "weights")
    total, all_weight = rows.agg(F.sum("size"), F.sum("weight")).first()
    total, all_weight = total or 0, all_weight or 1
    sorted_ = prefix_sums(rows.withColumn("ratio", F.col("most") / F.col("weight")), [], [F.asc("ratio"), F.asc("sid")], {"size": "size_before", "weight": "weight_before"}, "ratios")
    level = (F.lit(share * total) - F.lit(bound) * F.col("size_before")) / (F.lit(all_weight) - F.col("weight_before"))
    found = sorted_.withColumn("level", level).where("level <= ratio").agg(F.min_by("level", F.struct("ratio", "sid"))).first()[0]
    target = F.col("most") if found is None else F.least("most", F.lit(found) * F.col("weight"))
    return rows.withColumn("target", target).select("source", "sid", F.col("size").alias("source_size"), "target")


def mix(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, bound: float = 2.0, seed: str = "mix", carry: list[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs, before, taken for every row of docs(doc_id, text, source).

    carry: further short columns of docs to pass through.
    """
    sized = pick(docs, "doc_id", "text", "source", *carry).select("doc_id", "source", *carry, word_count(F.col("text")).alias("size"))
    sized = materialise(sized, "sizes")
    plan = light(materialise(targets(sized.groupBy("source").agg(F.sum("size").alias("size")), list(weights), share, bound), "plan"))
    rows = sized.join(plan.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("key", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = prefix_sums(rows, ["sid"], [F.asc("key"), F.asc("doc_id"), F.asc("size")], {"size": "before"}, "keyed")
    words = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.expr("CAST(floor(target) AS LONG) div source_size")).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", epochs.cast("long"))
    left = words - F.col("epochs") * F.col("source_size") - F.col("before")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left))
    return rows.select("doc_id", "source", *carry, "size", "source_size", "target", "epochs", "before", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: list[int] = (3, 1, 2), share: float = 1.5, bound: float = 2.0) -> DataFrame:
    """Rows of docs as often as the mix takes them, all their columns kept.

    The document in which a budget ends is taken whole if at least half of it is in.
    Rows that agree in id, source and text are taken as often as all of them together: one of
    them, if their other columns differ.
    """
    # The rows travel packed, so that none of their columns meets a working name.
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text", "source", F.xxhash64("text").alias("_digest"))
    plan = mix(keyed, weights, share, bound, carry=["_digest"])
    whole = F.col("taken") - F.col("epochs") * F.col("size")
    copies = F.col("epochs") + F.when((F.col("size") > 0) & (2 * whole >= F.col("size")), 1).otherwise(0)
    keys = ["_id", "_source", "_key"]
    plan = plan.groupBy(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("_digest").alias("_key")).agg(F.sum(copies).alias("_copies"), F.count("*").alias("_rows"))
    plan = materialise(plan.where("_copies > 0"), "copies")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source")) & (F.col("_digest") == F.col("_key"))
    joined = keyed.join(plan, same)
    if not plan.where("_rows > 1").isEmpty():
        joined = joined.where("_rows = 1").unionByName(joined.where("_rows > 1").dropDuplicates(keys))
    return joined.withColumn("_copy", F.explode(F.expr("sequence(1L, _copies)"))).select("_row.*")


ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sums AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, CAST(row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) - 1 AS BIGINT) AS sid FROM sums
), weighted AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 2.0::DOUBLE * source_size AS most FROM placed
), sorted AS (
  SELECT *, most / weight AS ratio,
    coalesce(sum(source_size) OVER w, 0)::DOUBLE AS size_before, coalesce(sum(weight) OVER w, 0)::DOUBLE AS weight_before,
    sum(source_size) OVER ()::DOUBLE AS total, sum(weight) OVER ()::DOUBLE AS all_weight
  FROM weighted WINDOW w AS (ORDER BY most / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (SELECT *, (1.5::DOUBLE * total - 2.0::DOUBLE * size_before) / (all_weight - weight_before) AS level FROM sorted
), plan AS (
  SELECT source, sid, source_size, least(most, (SELECT arg_min(level, (ratio, sid)) FROM levels WHERE level <= ratio) * weight) AS target FROM levels
), keyed AS (
  SELECT d.*, p.source_size, p.target, CASE WHEN p.source_size > 0 THEN CAST(floor(p.target) AS BIGINT) // p.source_size ELSE 0 END AS epochs,
    coalesce(sum(d.size) OVER (PARTITION BY p.sid ORDER BY md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized d JOIN plan p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, floor(target) - epochs * source_size - before)) AS BIGINT) AS taken
FROM keyed
"""
