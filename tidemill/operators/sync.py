"""Keeping a corpus current: snapshot differences, keyed writes, metadata joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from tidemill.functions.text import listing_department


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status: added, deleted or unchanged, by one full outer join of distinct keys."""
    a = old.select(*keys).distinct().withColumn("_old", F.lit(1))
    b = new.select(*keys).distinct().withColumn("_new", F.lit(1))
    both = a.join(b, keys, "full_outer")
    return both.select(*keys, F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").otherwise("unchanged").alias("status"))


def summary(changes: DataFrame, *by: str) -> DataFrame:
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    return changes.groupBy(*by).agg(count("added"), count("deleted"), count("unchanged"))


def keep_last(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each key: the last by order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new, and those of old whose key isn't among them."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def delete(df: DataFrame, ids: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(ids.select(*keys).distinct(), keys, "left_anti")


def replace_group(old: DataFrame, new: DataFrame, group: str) -> DataFrame:
    """All rows of the groups in new are replaced by new's."""
    return upsert(old, new, [group])


def update_metadata(df: DataFrame, meta: DataFrame, key: str, columns: list[str], only_changed: bool = False) -> DataFrame:
    """Columns of meta win where they are filled; vectors and texts aren't touched."""
    m = meta.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = df.join(m, key, "left")
    changed = F.lit(False)
    for c in columns:
        changed = changed | (F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)))
    joined = joined.where(changed) if only_changed else joined
    return joined.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in df.columns])


def purge(manifest: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Manifest rows whose key no longer occurs."""
    return manifest.join(seen.select(key).distinct(), key, "left_anti")


def registry(chunks: DataFrame, key: str, page: str) -> DataFrame:
    return chunks.groupBy(key).agg(F.count("*").alias("chunks"), F.max(F.coalesce(page, F.lit(1))).alias("pages"))


def department_edges(listings: DataFrame) -> DataFrame:
    """source_url, department from (ord, url, department, profiles): later listings win for a profile, a listing's own url last."""
    edges = listings.select(F.explode("profiles").alias("source_url"), "department", "ord")
    profiles = edges.groupBy("source_url").agg(F.max_by("department", "ord").alias("department"))
    own = listings.groupBy(F.col("url").alias("source_url")).agg(F.max_by("department", "ord").alias("department"))
    return upsert(profiles, own, ["source_url"])


def card_listings(chunks: DataFrame, own_names: Sequence[str] = ()) -> DataFrame:
    """ord, url, department, profiles of listing pages, from their chunks' cards; pages without a department aren't listings."""
    cards = chunks.where((F.col("chunk_type") == "faculty_card") & (F.col("profile_url") != ""))
    per = cards.groupBy(F.col("source_url").alias("url")).agg(F.collect_set("profile_url").alias("profiles"))
    named = per.withColumn("department", listing_department(F.col("url"), own_names)).where("department is not null")
    return named.select(F.col("url").alias("ord"), "url", "department", "profiles")


def metadata(df: DataFrame, reserved: Sequence[str]) -> Column:
    """All columns but the reserved ones as a map of strings: nulls become empty, what is no scalar becomes JSON."""
    scalar = lambda f: not isinstance(f.dataType, (ArrayType, MapType, StructType))
    value = lambda f: F.coalesce(F.col(f.name).cast("string") if scalar(f) else F.to_json(f.name), F.lit(""))
    pairs = [x for f in df.schema if f.name not in reserved for x in (F.lit(f.name), value(f))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
