"""Inbound messages: duplicates, rate limits and admission, as batch and as streams."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.functions.rules import RATE_LIMIT, RATE_WINDOW, SEEN_IDS


def first_of_each(messages: DataFrame, key: str = "msg_id", at: str = "ts") -> DataFrame:
    """The first delivery of each message."""
    w = Window.partitionBy(key).orderBy(at)
    return messages.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_of_each_stream(messages: DataFrame, key: str = "msg_id", at: str = "ts", delay: str = "1 hour") -> DataFrame:
    """The same on a stream: a redelivery within the watermark's delay is dropped."""
    return messages.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def rolling_count(messages: DataFrame, key: str, at: str = "ts", seconds: int = RATE_WINDOW) -> DataFrame:
    """Messages of the key in the last `seconds`, this one included: an upper bound of what the limit counts."""
    w = Window.partitionBy(key).orderBy(F.unix_micros(F.col(at).cast("timestamp"))).rangeBetween(-seconds * 1_000_000, 0)
    return messages.withColumn("recent", F.count("*").over(w))


def admit(times: Iterable[float], accepted: list[float], limit: int, window: float) -> Iterator[bool]:
    """Which messages, in order of time, a sliding window lets through; rejected ones don't count. Changes `accepted`."""
    for t in times:
        while accepted and t - accepted[0] > window:
            accepted.pop(0)
        ok = len(accepted) < limit
        if ok:
            accepted.append(t)
        yield ok


def rate_limited(messages: DataFrame, key: str, order: str, limit: int = RATE_LIMIT, window: int = RATE_WINDOW) -> DataFrame:
    """messages(key, ts, order) with `allowed`. Acceptance depends on earlier acceptance, so a key is
    folded in order of time, in one task by its nature; its rows arrive in pieces, and only the
    accepted times of one window are held."""
    schema = f"{key} {dict(messages.dtypes)[key]}, {order} {dict(messages.dtypes)[order]}, allowed boolean"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, accepted = None, []
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf["_t"], strict=True):
                if k != last:
                    last, accepted = k, []
                out += admit([t], accepted, limit, window)
            yield pd.DataFrame({key: pdf[key], order: pdf[order], "allowed": out})

    slim = messages.select(key, order, (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("_t"))
    return slim.repartition(F.col(key)).sortWithinPartitions(key, "_t", order).mapInPandas(run, schema)


class RateLimiter(StatefulProcessor):
    """The limit on a stream keyed by sender; state is the accepted times of one window."""

    def __init__(self, limit: int = RATE_LIMIT, window: int = RATE_WINDOW):
        self.limit, self.window = limit, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getValueState("accepted", "times array<double>")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        held = list(self.accepted.get()[0]) if self.accepted.exists() else []
        for pdf in rows:
            pdf = pdf.sort_values(["t", "event_id"])
            allowed = list(admit(pdf["t"], held, self.limit, self.window))
            yield pd.DataFrame({"sender": pdf["sender"], "event_id": pdf["event_id"], "allowed": allowed})
        self.accepted.update((held,))

    def close(self) -> None:
        pass


class SeenIds(StatefulProcessor):
    """First-in-first-out memory of message ids, per shard: an id comes through again after `size` others."""

    def __init__(self, size: int = SEEN_IDS):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "ids array<bigint>")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[pd.DataFrame]:
        ids = deque(self.seen.get()[0]) if self.seen.exists() else deque()
        known = set(ids)
        for pdf in rows:
            new = []
            for i in pdf["event_id"]:
                new.append(i not in known)
                if new[-1]:
                    ids.append(int(i))
                    known.add(i)
                    if len(ids) > self.size:
                        known.discard(ids.popleft())
            yield pdf[new]
        self.seen.update((list(ids),))

    def close(self) -> None:
        pass


def rate_limited_stream(messages: DataFrame, limit: int = RATE_LIMIT, window: int = RATE_WINDOW) -> DataFrame:
    """sender, event_id, allowed for a stream of (sender, event_id, t in seconds)."""
    return messages.groupBy("sender").transformWithStateInPandas(RateLimiter(limit, window), "sender long, event_id long, allowed boolean", "Append", "None")


def admission(messages: DataFrame, limit: int = RATE_LIMIT, window: int = RATE_WINDOW) -> DataFrame:
    """msg_id, ord, outcome for (ord, msg_id, sender, ts, kind, body).

    Without id or sender: skip. Redelivered: duplicate. Not text: notice. Over the limit:
    limited. Blank: blank, which still uses up the quota. Else: answer.
    """
    known = F.coalesce((F.col("msg_id") != "") & F.col("sender").isNotNull(), F.lit(False))
    skipped = messages.where(~known).select("msg_id", "ord", F.lit("skip").alias("outcome"))
    # Messages without id or sender may be many; they share no task.
    df = messages.where(known).withColumn("_n", F.row_number().over(Window.partitionBy("msg_id").orderBy("ts", "ord")))
    text = df.where((F.col("_n") == 1) & (F.col("kind") == "text"))
    df = df.join(rate_limited(text, "sender", "ord", limit, window).select("ord", "allowed"), "ord", "left")
    outcome = (
        F.when(F.col("_n") > 1, "duplicate").when(~F.col("kind").eqNullSafe("text"), "notice")
        .when(~F.col("allowed"), "limited").when(F.coalesce(F.regexp_replace("body", r"\s", ""), F.lit("")) == "", "blank").otherwise("answer")
    )
    return df.select("msg_id", "ord", outcome.alias("outcome")).unionByName(skipped)
