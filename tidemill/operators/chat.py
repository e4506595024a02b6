"""Conversations as sets: lists, histories, retention, contacts, citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import collapse


def overview(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Every conversation with its message count and first question, latest activity first."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
    per = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), first.alias("title"), F.max("turn").alias("last_turn"))
    return conversations.join(per, "conv_id", "left").select("conv_id", F.coalesce("messages", F.lit(0)).alias("messages"), "title", "last_turn")


def recent(listed: DataFrame, *order: Column, n: int = 50) -> DataFrame:
    """The first n of a list by order, with their place; only n rows reach one task."""
    first = listed.orderBy(*order).limit(n)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def create(requests: DataFrame, now: Column, seed: int | None = None) -> DataFrame:
    """requests with the random id of a new conversation and its two times, equal at first."""
    return requests.withColumns({"id": F.uuid() if seed is None else F.uuid(F.lit(seed)), "created_at": now, "last_active_at": now})


def last_messages(messages: DataFrame, n: int) -> DataFrame:
    """The last n turns of each conversation; n = 0 means all."""
    if not n:
        return messages
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def exchanges(messages: DataFrame) -> DataFrame:
    """conv_id, turn, question, answer: an assistant turn with the user turn right before it, other roles aside."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = messages.where(F.col("role").isin("user", "assistant"))
    df = df.withColumn("_role", F.lag("role").over(w)).withColumn("question", F.lag("text").over(w))
    return df.where("role = 'assistant' and _role = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


def _short(answer: Column, width: int) -> Column:
    """An answer without images and badges, on one line, cut."""
    return F.substring(collapse(F.regexp_replace(F.regexp_replace(answer, r"!\[[^\]]*\]\([^)]*\)", ""), r"(?s)<div.*?</div>", "")), 1, width)


def history(messages: DataFrame, turns: int = 2, width: int = 300) -> DataFrame:
    """conv_id, history: the last exchanges as lines, answers without images and badges, cut."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    line = F.concat(F.lit("User: "), "question", F.lit("\nAssistant: "), _short(F.col("answer"), width))
    df = exchanges(messages).withColumn("r", F.row_number().over(w)).where(F.col("r") <= turns).withColumn("line", line)
    return df.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda s: s["line"]), "\n").alias("history"))


def histories(messages: DataFrame, width: int = 300) -> DataFrame:
    """conv_id, turn, text, history of every user turn: the lines of the last two exchanges before it, as `history` has them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    line = F.concat(F.lit("User: "), "question", F.lit("\nAssistant: "), _short(F.col("answer"), width))
    pairs = exchanges(messages).withColumn("_line", line)
    pairs = pairs.select("conv_id", "turn", F.struct(F.lag("_line").over(w).alias("first"), F.col("_line").alias("second")).alias("_pair"))
    df = messages.where(F.col("role").isin("user", "assistant")).join(pairs, ["conv_id", "turn"], "left")
    df = df.withColumn("_last", F.last("_pair", ignorenulls=True).over(before)).where("role = 'user'")
    return df.select("conv_id", "turn", "text", F.when(F.col("_last").isNotNull(), F.concat_ws("\n", "_last.first", "_last.second")).alias("history"))


def append(messages: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All messages, and each conversation's last activity."""
    out = messages.unionByName(new, allowMissingColumns=True)
    return out, out.groupBy("conv_id").agg(F.max("created_at").alias("last_active_at"))


def expired(conversations: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return conversations.where(F.col("last_active_at") < now - F.expr(f"INTERVAL {days} DAYS"))


def drop_conversations(conversations: DataFrame, messages: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Children and parents without the conversations in gone."""
    ids = gone.select("conv_id").distinct()
    return conversations.join(ids, "conv_id", "left_anti"), messages.join(ids, "conv_id", "left_anti")


def upsert_contacts(events: DataFrame) -> DataFrame:
    """contact, conv_id, created_at from (contact, conv_id, seq, at): the first time stays, the last conversation wins."""
    return events.groupBy("contact").agg(F.max_by("conv_id", "seq").alias("conv_id"), F.min("at").alias("created_at"))


def resolve(requests: DataFrame, live: DataFrame) -> DataFrame:
    """What a request's conversation id leads to: new, same, or missing."""
    j = requests.join(live.select(F.col("conv_id").alias("_live")).distinct(), F.col("conv_id") == F.col("_live"), "left")
    state = F.when(F.coalesce(F.col("conv_id").cast("string"), F.lit("")) == "", "new").when(F.col("_live").isNull(), "missing").otherwise("same")
    return j.withColumn("state", state).drop("_live")


def citations(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources an answer cites, in order of first use.

    answers(answer_id, answer, declined), chunks(answer_id, pos, url, photo): the chunk at
    place i is cited if [i] stands in the answer; nothing is if the answer declines.
    """
    j = chunks.join(answers.where(~F.col("declined")), "answer_id")
    used = j.where(F.instr(F.col("answer"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))) > 0)
    per = used.groupBy("answer_id", "url").agg(F.min("pos").alias("first_pos"), F.min_by("photo", "pos").alias("photo"))
    w = Window.partitionBy("answer_id").orderBy("first_pos")
    return per.withColumn("place", F.row_number().over(w))


def photos(cited: DataFrame, allowed: Column, shown: DataFrame) -> DataFrame:
    """Distinct filled photos of citations, where allowed and not shown in the conversation before."""
    fresh = cited.where(allowed & (F.coalesce("photo", F.lit("")) != "")).groupBy("answer_id", "photo").agg(F.min("first_pos").alias("first_pos"))
    return fresh.join(shown, ["answer_id", "photo"], "left_anti")


def context(chunks: DataFrame, key: str, width: int = 1400) -> DataFrame:
    """key, context: numbered sources with collapsed, cut content, from (key, pos, source_url, content)."""
    block = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] Source: "), "source_url", F.lit("\n"), F.substring(collapse(F.col("content")), 1, width))
    return chunks.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", block.alias("b")))), lambda s: s["b"]), "\n\n").alias("context"))


def cost(called: Column, declined: Column) -> Column:
    """What an answer cost: skipped (no model called; also if unknown), no answer, or generated."""
    return F.when(~F.coalesce(called, F.lit(False)), "skipped").when(F.coalesce(declined, F.lit(False)), "no answer").otherwise("generated")
