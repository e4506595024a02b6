"""What may not grow with the input: blocks that a worker holds at once, rows that go through the driver."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemill.operators import blocks, keyed_table, spelling, vector_index
from tidemill.session import scratch


def test_a_worker_gives_back_each_pair_of_blocks_before_the_next():
    x = np.eye(4)
    row = {"key": "", "q_ids": [0, 1], "q_width": 4, "q_data": x[:2].tobytes(), "ids": [0, 1, 2, 3], "width": 4, "data": x.tobytes()}
    found = list(blocks._nearest(2)(iter([pa.RecordBatch.from_pylist([row] * 5)])))
    assert [b.num_rows for b in found] == [4] * 5


def test_products_with_centres_are_bounded():
    assert max(s.stop - s.start for s in vector_index.shares(10_000, 4096)) * 4096 <= vector_index.PRODUCT
    rng = np.random.default_rng(1)
    x, c = rng.normal(size=(3000, 8)), rng.normal(size=(700, 8))
    assert (vector_index.closest(x, c) == ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_batches_are_small(spark, sf_dir):
    from tidemill.session import BATCH, table

    table(spark, sf_dir, "pages")
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == BATCH


def test_spelling_broadcasts_only_lengths(spark):
    tokens = spark.createDataFrame([("engineerin",), ("departmnt",)], "token string")
    vocab = spark.createDataFrame([("engineering", 2), ("department", 3)], "word string, n long")
    plan = spelling.correct(tokens, vocab)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 2 and plan.count("SortMergeJoin") >= 2


def test_a_task_gives_back_only_rows_that_may_be_among_the_best():
    q, far, close = np.eye(3)[:1], np.tile([0.6, 0.8, 0.0], (20, 1)), np.tile([0.8, 0.6, 0.0], (20, 1))
    block = lambda v, at: {"key": "", "q_ids": [0], "q_width": 3, "q_data": q.tobytes(), "ids": list(range(at, at + 20)), "width": 3, "data": v.tobytes()}
    rows = [block(close, 100), block(far, 200), block(-close, 300), block(close, 50)]
    found = pa.Table.from_batches(list(blocks._nearest(4)(iter([pa.RecordBatch.from_pylist([r]) for r in rows])))).to_pylist()
    assert [r["vec_id"] for r in found] == [*range(100, 104), *range(50, 54)] and {r["score"] for r in found} == {0.8}


def test_spelling_makes_keys_for_few_edits_first_and_scores_only_the_best(spark):
    """Word lengths around every limit against brute force, and no subsequences in nested lambdas."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("abcd"), n))
    vocab = sorted({word(n) for n in (*range(5, 36), 60) for _ in range(3)})
    tokens = set()
    for w in vocab:
        for edits in range(1, 7):
            t = list(w)
            for _ in range(edits):
                at = rng.integers(len(t))
                t[at : at + 1] = [[], ["x"], [t[at], "a"]][rng.integers(3)]
            tokens.add("".join(t))
    tokens = sorted(t for t in tokens - set(vocab) if len(t) >= spelling.LEAST_TOKEN)
    df = spelling.correct(spark.createDataFrame([(t,) for t in tokens], "token string"), spark.createDataFrame([(w, 2) for w in vocab], "word string, n long"))
    want = {}
    for t in tokens:
        near = [(-200.0 * spelling.lcs(t, w) / (len(t) + len(w)), len(w), w) for w in vocab if abs(len(w) - len(t)) <= spelling.MOST_DELTA]
        if near and min(near)[0] <= -spelling.CUTOFF:
            want[t] = min(near)[2]
    assert {r.token: r.word for r in df.collect()} == want and len(want) > 100
    assert "flatten" not in df._jdf.queryExecution().executedPlan().toString()


def test_an_indexs_writes_and_searches_broadcast_nothing(spark):
    x = np.random.default_rng(2).normal(size=(300, 8))
    v = spark.createDataFrame([(i, r.tolist(), "l") for i, r in enumerate(x)], "vec_id long, embedding array<double>, label string")
    index = vector_index.VectorIndex.build(v, scratch(spark, "index"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    held = index.entries.read()
    assert "Broadcast" not in plan(keyed_table._without(held, v.where("vec_id % 3 = 1").select("vec_id"), ["vec_id"]))
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    found = index.search(asked, v, 5)
    assert "Broadcast" not in plan(found) and found.count() == 30
