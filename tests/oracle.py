"""Runs a query and its oracle SQL and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

from tidemill.session import TABLES


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if type(v).__name__ == "Decimal":
        return float(f"{float(v):.9g}")
    return v


def rows(names: list[str], values) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def differences(spark, query, sql: str, sf_dir: str, con=None) -> str:
    """Empty if the query's rows are the SQL's."""
    df = query(spark, sf_dir)
    ours = rows(df.columns, df.collect())
    res = (con or duck(sf_dir)).execute(sql)
    names = [d[0] for d in res.description]
    theirs = rows(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if ours != theirs:
        bad = [(a, b) for a, b in zip(ours, theirs, strict=False) if a != b][:2]
        return f"{len(ours)} and {len(theirs)} rows, of {sorted(names)} first {bad}"
    return ""
