"""Roles and departments of people in text: overlapping matches resolved as intervals."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tidemill.functions import rules

ROLE = "struct<start:int,stop:int,role:string,rank:int,raw:string>"
ROLES = ArrayType(
    StructType().add("start", IntegerType()).add("stop", IntegerType()).add("role", StringType()).add("rank", IntegerType()).add("raw", StringType())
)


@lru_cache(maxsize=1)
def _patterns() -> list[tuple[re.Pattern, str, int]]:
    return [(re.compile(p, re.I), role, rank) for p, role, rank in rules.ROLES]


def roles_in(text: str | None) -> list[dict]:
    """Matches of all role patterns, earliest first and the longest of those, none overlapping."""
    found = [(m.start(), -m.end(), i, m) for i, (p, _, _) in enumerate(_patterns()) for m in p.finditer(text or "")]
    out, at = [], 0
    for start, stop, i, m in sorted(found, key=lambda x: x[:3]):
        if start >= at:
            _, role, rank = _patterns()[i]
            out.append({"start": start, "stop": -stop, "role": role, "rank": rank, "raw": m[0]})
            at = -stop
    return out


@F.pandas_udf(ROLES)
def find_roles(text: pd.Series) -> pd.Series:
    return text.map(roles_in)


def primary(found: Column) -> Column:
    """The role of highest rank, the earliest of equals."""
    best = F.array_max(F.transform(found, lambda r: F.struct(r["rank"].alias("rank"), (-r["start"]).alias("neg"), r.alias("r"))))
    return best["r"]


def leading(found: Column, text: Column) -> Column:
    """Roles after a title of address, both within the leading window."""
    head = F.substring(text, 1, rules.LEADING_WINDOW)
    at = F.regexp_instr(head, F.lit("(?i)" + rules.HONORIFIC))
    size = F.length(F.regexp_extract(head, "(?i)" + rules.HONORIFIC, 0))
    return F.filter(found, lambda r: (at > 0) & (r["start"] >= at - 1 + size) & (r["start"] < rules.LEADING_WINDOW))


def _tail(text: str, stop: int, border: re.Pattern) -> str:
    tail = text[stop : stop + 200].lstrip(" \t\n\r-–—:,|")
    end = border.search(tail)
    tail = tail[: end.start()] if end else tail
    nxt = roles_in(tail)
    return tail[: nxt[0]["start"]] if nxt else tail


def department_text(text: Column, stop: Column, own_names: Sequence[str] = ()) -> Column:
    """The raw words after a role up to the first structural border or the next role.

    own_names: words of the institution's own name and of its sites, which are borders too.
    """
    places = "|".join(map(re.escape, [*rules.CAMPUSES, *own_names]))
    pattern = "|".join([*rules.DEPARTMENT_STOP, rf"\b(?:{places})\b"])

    @F.pandas_udf(StringType())
    def tails(text: pd.Series, stop: pd.Series) -> pd.Series:
        border = re.compile(pattern, re.I)
        return pd.Series([None if pd.isna(s) or t is None else _tail(t, int(s), border) for t, s in zip(text, stop, strict=True)])

    return tails(text, stop)


def metadata(df: DataFrame, text: str, url: str, kind: str, own_names: Sequence[str] = ()) -> DataFrame:
    """df with designation, designation_raw, designations_all, is_department_head and department; blank outside records of a person."""
    from tidemill.functions.text import is_person_record, normalize_department

    # Roles count only after a title of address near the beginning: other texts don't go to a worker whole.
    titled = is_person_record(F.col(url), F.col(kind)) & F.rlike(F.substring(text, 1, rules.LEADING_WINDOW), F.lit("(?i)" + rules.HONORIFIC))
    seen = F.when(titled, F.col(text))
    df = df.withColumn("_roles", F.when(titled, leading(find_roles(seen), F.col(text))).otherwise(F.array().cast(f"array<{ROLE}>")))
    df = df.withColumn("_first", primary(F.col("_roles"))).withColumn("_dept", normalize_department(department_text(F.when(F.col("_first").isNotNull(), F.col(text)), F.col("_first")["stop"], own_names)))
    names = F.array_sort(F.array_distinct(F.transform("_roles", lambda r: r["role"])))
    blank = lambda c: F.coalesce(c, F.lit(""))
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        blank(F.col("_first")["role"]).alias("designation"),
        blank(F.col("_first")["raw"]).alias("designation_raw"),
        F.array_join(names, "|").alias("designations_all"),
        F.coalesce(F.array_contains(names, "head_of_department"), F.lit(False)).alias("is_department_head"),
        blank(F.col("_dept")).alias("department"),
    )
