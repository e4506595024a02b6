"""Admission of inbound messages as one stateful stream.

All that the rules remember of a sender is one composite state: the ids that were seen, first
in first out; the times of the messages that the limit let through; the time of the last one;
and the messages that wait for their turn. Messages are judged in order of (ts, ord), which is
not the order they arrive in: a message waits until the watermark has passed its time, by an
event-time timer. Results are those of `messages.admission` on the same rows, whatever micro-
batches they come in, as long as no message is later than the watermark's delay.

A sender that was silent for `idle` is forgotten by another timer. A redelivery after that, or
after `seen` other messages of the sender, is taken for a new message.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemill.functions.rules import RATE_LIMIT, RATE_WINDOW, SEEN_IDS

WAITING = "us bigint, ord bigint, msg_id string, is_text boolean, is_blank boolean"
STATE = "ids array<string>, accepted array<bigint>, last bigint"
RESULT = "msg_id string, ord bigint, outcome string"


def judged(rows: list[tuple], ids: deque, accepted: deque, limit: int, window_us: int, seen: int) -> list[str]:
    """The outcome of each row (us, ord, msg_id, is_text, is_blank) in order; changes the memory of ids and accepted times."""
    known, out = set(ids), []
    for us, _, msg_id, is_text, is_blank in rows:
        if msg_id in known:
            out.append("duplicate")
            continue
        if len(ids) == seen:
            known.discard(ids.popleft())
        ids.append(msg_id)
        known.add(msg_id)
        if not is_text:
            out.append("notice")
            continue
        while accepted and us - accepted[0] > window_us:
            accepted.popleft()
        if len(accepted) >= limit:
            out.append("limited")
            continue
        accepted.append(us)
        out.append("blank" if is_blank else "answer")
    return out


class Admission(StatefulProcessor):
    def __init__(self, limit: int, window: int, idle: int, seen: int) -> None:
        self.limit, self.window_us, self.idle_ms, self.seen = limit, window * 1_000_000, idle * 1000, seen

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.memory = handle.getValueState("memory", STATE)
        self.waiting = handle.getListState("waiting", WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for pdf in rows:
            new = list(pdf[["us", "ord", "msg_id", "is_text", "is_blank"]].itertuples(index=False, name=None))
            self.waiting.appendList([(int(u), None if pd.isna(o) else int(o), m, bool(t), bool(b)) for u, o, m, t, b in new])
            first = min([u for u, *_ in new] + [first] * (first is not None))
        if first is not None:
            self.handle.registerTimer(-(-int(first) // 1000))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda r: (r[0], r[1] is not None, r[1])) if self.waiting.exists() else []
        due = [r for r in held if r[0] <= now * 1000]
        later = held[len(due) :]
        ids, accepted, last = self.memory.get() if self.memory.exists() else ([], [], 0)
        if due:
            ids, accepted = deque(ids), deque(accepted)
            outcomes = judged(due, ids, accepted, self.limit, self.window_us, self.seen)
            last = due[-1][0]
            self.memory.update((list(ids), list(accepted), last))
            if later:
                self.waiting.put(later)
                self.handle.registerTimer(-(-later[0][0] // 1000))
            else:
                self.waiting.clear()
            self.handle.registerTimer(last // 1000 + self.idle_ms)
            yield pd.DataFrame({"msg_id": [r[2] for r in due], "ord": [r[1] for r in due], "outcome": outcomes})
        elif not later and last // 1000 + self.idle_ms <= now:
            self.memory.clear()

    def close(self) -> None:
        pass


def known(messages: DataFrame) -> Column:
    return F.coalesce((F.col("msg_id") != "") & F.col("sender").isNotNull(), F.lit(False))


def admission_stream(messages: DataFrame, limit: int = RATE_LIMIT, window: int = RATE_WINDOW, delay: str = "10 minutes", idle: int = 7 * 86_400, seen: int = SEEN_IDS) -> DataFrame:
    """msg_id, ord, outcome for a stream of (ord, msg_id, sender, ts, kind, body); needs the RocksDB state store."""
    timed = messages.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    blank = F.coalesce(F.regexp_replace("body", r"\s", ""), F.lit("")) == ""
    rows = timed.where(known(messages)).select("sender", "ts", F.unix_micros("ts").alias("us"), F.col("ord").cast("long").alias("ord"), "msg_id", F.col("kind").eqNullSafe("text").alias("is_text"), blank.alias("is_blank"))
    return rows.groupBy("sender").transformWithStateInPandas(Admission(limit, window, idle, seen), RESULT, "Append", "EventTime")


def skipped(messages: DataFrame) -> DataFrame:
    """Messages without id or sender need no state: a query of their own."""
    return messages.where(~known(messages)).select("msg_id", F.col("ord").cast("long").alias("ord"), F.lit("skip").alias("outcome"))
