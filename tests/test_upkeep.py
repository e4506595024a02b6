"""Range digests, maintained counts and quantile sketches against full recomputation."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import digests, evaluation, sync, views


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("levels", [None, 1, 2])
def test_changes_equal_the_full_diff(spark, levels):
    rng = random.Random(7)
    old = [(rng.randrange(3000), rng.choice(["a", None, ""])) for _ in range(5000)]
    new = [r for r in old if rng.random() > 0.01] + [(9000 + i, "n") for i in range(20)] + old[:5] + [(None, None)]
    a, b = (spark.createDataFrame(x, "id long, part string") for x in (old, new))
    # The full outer join of the plain diff doesn't match null keys, so it gets a filled copy.
    filled = lambda df: df.select(F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("part", F.lit("null")).alias("part"))
    want = rows_of(sync.diff(filled(a), filled(b), ["id", "part"]).where("status <> 'unchanged'"))
    got = digests.changes(a, b, ["id", "part"], levels)
    assert rows_of(filled(got).withColumn("status", F.col("part")).drop("status")) == [w[:2] for w in want]
    assert sorted(r.status for r in got.collect()) == sorted(w[2] for w in want)
    assert digests.changes(a, a, ["id", "part"]).count() == 0 and digests.changes(a.limit(0), a.limit(0), ["id", "part"]).count() == 0


def test_only_ranges_that_differ_are_looked_into(spark):
    a = spark.range(200_000).select("id", F.lit("x").alias("part"))
    b = a.where("id <> 77").unionByName(spark.createDataFrame([(-5, "x")], "id long, part string"))
    left, right = digests.differing(digests.hashed(a, ["id", "part"]), digests.hashed(b, ["id", "part"]), 2)
    assert left.count() <= 4 and right.count() <= 4
    assert rows_of(digests.changes(a, b, ["id", "part"])) == [(-5, "x", "added"), (77, "x", "deleted")]


def test_maintained_counts_equal_recomputation(spark):
    rng = random.Random(2)
    say = lambda df: df.select(F.explode(F.split("text", " ")).alias("word"))
    doc = lambda i: (i, " ".join(rng.choice("abcdefghij") for _ in range(6)))
    frame = lambda d: spark.createDataFrame(list(d.items()), "id long, text string")
    state = dict(doc(i) for i in range(30))
    view = views.CountView(say, frame(state), n_buckets=8)
    for k in range(3):
        gone = {i: state[i] for i in rng.sample(sorted(state), 12)}
        come = dict(doc(i) for i in [*list(gone)[:6], *range(100 + 3 * k, 103 + 3 * k)])
        view.apply(frame(gone), frame(come))
        state = {i: t for i, t in state.items() if i not in gone} | come
        assert rows_of(view.read()) == rows_of(say(frame(state)).groupBy("word").agg(F.count("*").alias("n")))
    version = view.table.version()
    view.apply(frame({1: "a b"}), frame({2: "b a"}))
    assert view.table.version().number == version.number, "what cancels out touches nothing"
    view.apply(frame(state))
    assert view.read().count() == 0, "groups that reach zero vanish"


@pytest.mark.parametrize("values", [range(20_000), [7] * 5000 + list(range(3000)), [1], [5, None, 5]])
def test_merged_sketches_stay_within_their_error(spark, values):
    quantiles = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]
    df = spark.createDataFrame([(v, i % 11, "g") for i, v in enumerate(values)], "v long, part int, g string")
    parts = evaluation.spread_sketches(df, F.col("v"), "g", "part")
    once = evaluation.spread(evaluation.merged_sketches(parts, "g"), quantiles)
    twice = evaluation.spread(evaluation.merged_sketches(evaluation.merged_sketches(parts.withColumn("half", F.col("part") % 2), "g", "half"), "g"), quantiles)
    for spreads in (once, twice):
        (found,) = evaluation.rank_errors(df, F.col("v"), spreads, quantiles, "g").collect()
        assert found.n == sum(v is not None for v in values) == spreads.first().n
        assert found.error <= 2 * evaluation.rank_error()
