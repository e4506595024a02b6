"""Admission as a stream: equal to the batch form under reordered micro-batches and after a restart."""

import random
from collections import deque

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.streaming import messages as ms
from tidemill.streaming.admission import admission_stream, judged, skipped

SCHEMA = "ord long, msg_id string, sender long, ts timestamp, kind string, body string"
START = 1_700_000_000


def inbound(n=400, seed=9):
    """Bursts of four senders with redeliveries, images and blanks, in order of time."""
    rng, rows, t = random.Random(seed), [], 0
    for i in range(n):
        t += rng.choice([1, 5, 30, 120])
        sender = rng.choice([1, 2, 3, 4, None])
        rows.append((i, rng.choice([f"m{i}", f"m{i}", f"m{i}", "", None]), sender, START + t, rng.choice(["text", "text", "text", "image", None]), rng.choice(["hi", " \n", None, "what"])))
        if rng.random() < 0.3:
            rows.append((i + 10_000, rows[-1][1], sender, START + t + rng.choice([0, 20, 100]), *rows[-1][4:]))
    return sorted(rows, key=lambda r: (r[3], r[0]))


def written(rows, path):
    pdf = pd.DataFrame(rows, columns=["ord", "msg_id", "sender", "ts", "kind", "body"])
    pdf = pdf.astype({"sender": "Int64"}).assign(ts=pd.to_datetime(pdf["ts"], unit="s", utc=True))
    pdf.to_parquet(path, coerce_timestamps="us")


def run(spark, folder, out):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for name, rule in (("known", lambda m: admission_stream(m, limit=3, window=600, delay="5 minutes")), ("skip", skipped)):
        src = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        q = rule(src).writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/cp-{name}").outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(300) and q.exception() is None


def test_stream_equals_batch_after_reordering_and_restart(spark, tmp_path):
    pytest.importorskip("google.protobuf", reason="stateful processors need protobuf")
    rows = inbound()
    batch = spark.createDataFrame([(o, m, s, pd.Timestamp(t, unit="s").to_pydatetime(), k, b) for o, m, s, t, k, b in rows], SCHEMA)
    want = sorted((tuple(r) for r in ms.admission(batch, limit=3, window=600).select("ord", "msg_id", "outcome").collect()), key=repr)
    assert {w[2] for w in want} == {"skip", "duplicate", "notice", "limited", "blank", "answer"}
    # Arrival is up to four minutes late; the last message moves the watermark past all others.
    rng = random.Random(1)
    arriving = sorted(rows, key=lambda r: r[3] + rng.uniform(0, 240))
    parts = [arriving[i : i + 90] for i in range(0, len(arriving), 90)]
    last = [(99_999, "end", 9, rows[-1][3] + 10_000, "text", "end")]
    for half, files in enumerate((parts[:3], [*parts[3:], last])):
        for i, part in enumerate(files):
            (tmp_path / "in" / f"{half}{i}").mkdir(parents=True)
            rng.shuffle(part)
            written(part, tmp_path / "in" / f"{half}{i}" / "part.parquet")
        run(spark, tmp_path / "in", tmp_path / "out")
    got = spark.read.parquet(str(tmp_path / "out/known")).unionByName(spark.read.parquet(str(tmp_path / "out/skip"))).where(F.col("ord") != 99_999)
    assert sorted(((r.ord, r.msg_id, r.outcome) for r in got.collect()), key=repr) == want


def test_memory_is_first_in_first_out():
    ids, accepted = deque(), deque()
    row = lambda i, m: (i * 10**6, i, m, True, False)
    assert judged([row(1, "a"), row(2, "b"), row(3, "a"), row(4, "c"), row(5, "a")], ids, accepted, 9, 10**9, seen=2) == ["answer", "answer", "duplicate", "answer", "answer"]
    assert list(ids) == ["c", "a"] and len(accepted) == 4
    assert judged([row(6, "x"), row(7, "y")], ids, accepted, 5, 10**12, seen=2) == ["answer", "limited"]
