"""Registration of queries with their oracle SQL."""

from __future__ import annotations

import re

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query (spark, sf_dir) under its function's name."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add


# Pieces of DuckDB SQL for the text rules.
_W = r"[^\p{L}\p{N}_]"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_whole(pattern: str) -> str:
    return rf"(?:^|{_W})(?:{pattern})(?:{_W}|$)"


def sql_any(words: list[str]) -> str:
    return "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in words)


def sql_match(col: str, pattern: str) -> str:
    return f"regexp_matches({col}, {lit('(?i)' + pattern)})"


def sql_strip(col: str) -> str:
    return rf"regexp_replace({col}, '^\s+|\s+$', '', 'g')"


def sql_collapse(col: str) -> str:
    return sql_strip(rf"regexp_replace({col}, '\s+', ' ', 'g')")


def sql_clean(col: str) -> str:
    return sql_strip(rf"regexp_replace(regexp_replace(replace({col}, chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')")


def sql_lookup(table: dict[str, str], key: str, default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"
