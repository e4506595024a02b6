"""Preference formatting of chat pairs (operator 5), with DataFrame functions only.

The longest common prefix of turns of the chosen and the rejected conversation is rendered
once, as prompt; what follows becomes the two completions, each with a mask: the code point
ranges of prompt plus completion that carry loss, which are the assistant's words and the
end mark after them.

Edge cases: null roles count as "unknown", null texts as empty; turns are equal only if role
and text are (nulls equal nulls); a pair without turns gives empty strings; rows without
conv_id belong to no conversation; turns that share a number are ordered by role and text;
repeated turns stay; an empty table gives no rows; very long turns are rendered whole; only
the named columns are read, so further columns, whatever their names, do no harm.
A conversation is one output row, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import pick

END = "<|end|>\n"
TURNS = "array<struct<role:string,text:string>>"


def _head(t: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(t["role"], F.lit("unknown")), F.lit("|>\n"))


def _body(t: Column) -> Column:
    return F.concat(F.coalesce(t["text"], F.lit("")), F.lit(END))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column, offset: Column) -> Column:
    """start:stop ranges of the assistant's bodies, comma-joined."""
    start = F.struct(offset.alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(_head(t))
        stop = begin + F.length(_body(t))
        span = F.array(F.concat_ws(":", begin.cast("string"), stop.cast("string")))
        return F.struct(stop.alias("at"), F.when(t["role"] == "assistant", F.concat(s["out"], span)).otherwise(s["out"]).alias("out"))

    return F.array_join(F.aggregate(turns, start, step)["out"], ",")


def format_pairs(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, chosen, rejected: arrays of (role, text)) with prompt, completions and masks."""
    same = F.zip_with("chosen", "rejected", lambda a, b: a.eqNullSafe(b) & a.isNotNull())
    first = F.array_position(same, F.lit(False))
    df = pairs.withColumn("prompt_turns", F.when(first > 0, first - 1).otherwise(F.size("chosen")).cast("int"))
    rest = lambda c: F.slice(c, F.col("prompt_turns") + 1, F.greatest(F.size(c) - F.col("prompt_turns"), F.lit(0)))
    df = df.withColumn("prompt", render(F.slice("chosen", F.lit(1), F.col("prompt_turns"))))
    return df.select(
        "pair_id",
        "prompt_turns",
        "prompt",
        render(rest("chosen")).alias("chosen"),
        render(rest("rejected")).alias("rejected"),
        mask(rest("chosen"), F.length("prompt")).alias("chosen_mask"),
        mask(rest("rejected"), F.length("prompt")).alias("rejected_mask"),
    )


def self_pairs(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation: up to its last assistant turn, against a branch of it.

    The branch leaves at one of the assistant's turns, which by the conversation's id: there
    it says what the assistant says at its next turn (after the last at the first; nothing, if
    there is no other), and then goes on as the conversation does. So pairs part at any depth,
    and completions have any number of turns.
    """
    turns = pick(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null")
    df = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("all"))
    df = df.withColumn("all", F.transform("all", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))))
    places = F.filter(F.transform("all", lambda t, i: F.when(t["role"] == "assistant", i)), lambda i: i.isNotNull())
    df = df.withColumn("at", places)
    count = F.size("at")
    df = df.withColumns({"j": F.when(count > 0, F.pmod(F.col("conv_id"), count).cast("int")), "last": F.coalesce(F.get("at", count - 1) + 1, F.size("all"))})
    other = F.when(count > 1, F.get("all", F.get("at", (F.col("j") + 1) % count))["text"]).otherwise(F.lit(""))
    df = df.withColumns({"chosen": F.slice("all", F.lit(1), F.col("last")), "place": F.get("at", F.col("j")), "other": other})
    branch = F.transform("chosen", lambda t, i: F.struct(t["role"].alias("role"), F.when(i.eqNullSafe(F.col("place")), F.col("other")).otherwise(t["text"]).alias("text")))
    return df.select(F.col("conv_id").alias("pair_id"), "chosen", branch.alias("rejected"))


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id, role, text, coalesce(role = 'assistant', FALSE) AS a, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, count(*) AS n, max(pos) FILTER (a) AS la, count(*) FILTER (a) AS m FROM t GROUP BY conv_id
), o AS (SELECT conv_id, pos, text, row_number() OVER (PARTITION BY conv_id ORDER BY pos) - 1 AS j FROM t WHERE a
), b AS (
  SELECT c.conv_id, c.m, coalesce(c.la, c.n) AS last, p.pos AS place, p.text AS own, CASE WHEN c.m > 1 THEN q.text ELSE '' END AS other FROM c
  LEFT JOIN o p ON p.conv_id = c.conv_id AND p.j = ((c.conv_id % greatest(c.m, 1)) + c.m) % greatest(c.m, 1) LEFT JOIN o q ON q.conv_id = c.conv_id AND q.j = (p.j + 1) % greatest(c.m, 1)
), d AS (SELECT *, CASE WHEN m = 0 OR own IS NOT DISTINCT FROM other THEN last ELSE place - 1 END AS prompt_turns FROM b
), r AS (
  SELECT d.conv_id, t.pos, t.a, t.pos <= d.prompt_turns AS shared, length('<|' || coalesce(role, 'unknown') || '|>') + 1 AS head, '<|' || coalesce(role, 'unknown') || '|>' || chr(10) AS h,
    coalesce(t.text, '') || '<|end|>' || chr(10) AS body, coalesce(CASE WHEN t.pos = d.place THEN d.other ELSE t.text END, '') || '<|end|>' || chr(10) AS branch
  FROM d JOIN t ON t.conv_id = d.conv_id AND t.pos <= d.last
), s AS (
  SELECT *, sum(head + length(body)) OVER w - length(body) AS start_c, sum(head + CASE WHEN shared THEN length(body) ELSE length(branch) END) OVER w - length(branch) AS start_r
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
)
SELECT d.conv_id AS pair_id, CAST(d.prompt_turns AS INTEGER) AS prompt_turns, coalesce(string_agg(h || body, '' ORDER BY pos) FILTER (shared), '') AS prompt,
  coalesce(string_agg(h || body, '' ORDER BY pos) FILTER (NOT shared), '') AS chosen, coalesce(string_agg(h || branch, '' ORDER BY pos) FILTER (NOT shared), '') AS rejected,
  coalesce(string_agg(CAST(start_c AS BIGINT) || ':' || CAST(start_c + length(body) AS BIGINT), ',' ORDER BY pos) FILTER (a AND NOT shared), '') AS chosen_mask,
  coalesce(string_agg(CAST(start_r AS BIGINT) || ':' || CAST(start_r + length(branch) AS BIGINT), ',' ORDER BY pos) FILTER (a AND NOT shared), '') AS rejected_mask
FROM d LEFT JOIN s ON s.conv_id = d.conv_id GROUP BY d.conv_id, d.prompt_turns
"""
