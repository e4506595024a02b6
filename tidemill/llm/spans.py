"""Regex matches as spans, with Spark's own functions only.

Spark gives matches and the pieces between them; running sums of their lengths are the
places. Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,stop:int,text:string>>"


def find(text: Column, pattern: str, guard: Column | None = None) -> Column:
    """All leftmost non-overlapping matches, as structs (start, stop, text). guard: false rules out any match."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(state: Column, pair: Column) -> Column:
        begin = state["at"] + F.length(pair["gap"])
        end = begin + F.length(pair["m"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(begin.alias("start"), end.alias("stop"), pair["m"].alias("text")))).alias("out"))

    # Java's split drops nothing with limit -1, so there is one gap more than matches.
    pairs = F.filter(F.zip_with(gaps, matches, lambda g, m: F.struct(g.alias("gap"), m.alias("m"))), lambda p: p["m"].isNotNull())
    found = F.when(F.size(matches) > 0, F.aggregate(pairs, start, step, lambda s: s["out"])).otherwise(F.array().cast(SPAN))
    return found if guard is None else F.when(guard, found).otherwise(F.array().cast(SPAN))


def has(text: Column, mark: str) -> Column:
    return F.instr(text, mark) > 0


def joined(spans: Column, names: list[str]) -> Column:
    """kind:start:stop of structs (kind, start, stop), comma-joined in their order."""
    table = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", table[s["kind"]], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["stop"]) & (span["start"] < o["stop"]))
