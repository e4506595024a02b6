"""Keyed tables: writes as versions, only touched buckets rewritten, racing writers."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from tidemill.operators.keyed_table import Conflict, KeyedTable
from tidemill.session import scratch

SCHEMA = "id long, doc string, text string, tag string"


def made(spark, rows, **kw):
    t = KeyedTable(spark, scratch(spark, "keyed"))
    t.create(spark.createDataFrame(rows, SCHEMA), ["id"], **kw)
    return t


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_writes_equal_a_dictionary(spark):
    rng = random.Random(3)
    row = lambda i: (i, rng.choice(["a", "b", None]), f"t{rng.random()}", rng.choice([None, "x", "y"]))
    state = {i: row(i) for i in [*range(40), None]}
    t, history = made(spark, list(state.values()), n_buckets=8), []
    history.append(rows_of(t.read()))
    for step in range(3):
        new = [row(i) for i in rng.sample(range(60), 5)] + [row(None)] * (step == 1)
        t.upsert(spark.createDataFrame(new, SCHEMA))
        state |= {r[0]: r for r in new}
        gone = [*rng.sample(range(60), 4), *([None] if step == 2 else [])]
        t.delete(spark.createDataFrame([(i,) for i in gone], "id long"))
        state = {i: r for i, r in state.items() if i not in gone}
        changes = [(i, rng.choice([None, "new"])) for i in rng.sample(range(60), 6)]
        t.merge(spark.createDataFrame(changes, "id long, tag string"), ["tag"])
        state |= {i: (*state[i][:3], tag) for i, tag in changes if tag and i in state}
        assert rows_of(t.read()) == sorted(state.values(), key=repr)
        history.append(rows_of(t.read()))
    assert rows_of(t.read(0)) == history[0], "old versions stay"
    t.delete_where(F.col("tag") == "new")
    assert rows_of(t.read()) == sorted((r for r in state.values() if r[3] != "new"), key=repr)
    t.vacuum(keep=1)
    assert len(t.versions()) == 1 and rows_of(t.read()) == sorted((r for r in state.values() if r[3] != "new"), key=repr)


def test_only_touched_buckets_are_rewritten(spark):
    t = made(spark, [(i, None, "x" * 200, None) for i in range(2000)], n_buckets=32)
    first = t.version()
    v = t.upsert(spark.createDataFrame([(5, "d", "new", None), (5, "d", "new", None)], SCHEMA))
    assert len(v.touched) == 1 and v.bytes_written < first.bytes_written / 8
    assert sum(v.buckets[b] != first.buckets[b] for b in v.buckets) == 1
    assert t.read(where={"id": 5}).collect() == [(5, "d", "new", None)]
    assert len(t.read(where={"id": 5}).inputFiles()) < 6
    same = t.merge(spark.createDataFrame([(5, "new"), (7, None)], "id long, text string"), ["text"])
    assert same.number == v.number, "nothing changes: no version"
    assert t.delete(spark.createDataFrame([], "id long")).number == v.number
    with pytest.raises(ValueError, match="no columns"):
        t.upsert(spark.createDataFrame([(1, 2)], "id long, other long"))


def test_replace_by_group(spark):
    rows = [(i, f"d{i % 5}", f"t{i}", None) for i in range(50)]
    t = KeyedTable(spark, scratch(spark, "keyed"))
    t.create(spark.createDataFrame(rows, SCHEMA), ["doc", "id"], bucket_by=["doc"], n_buckets=16)
    new = [(900, "d1", "n", "x"), (901, "d7", "n", "x")]
    t.replace(spark.createDataFrame(new, SCHEMA))
    assert rows_of(t.read()) == sorted([r for r in rows if r[1] != "d1"] + new, key=repr)


def test_empty_table(spark):
    t = made(spark, [])
    assert t.read().count() == 0 and t.read().columns == ["id", "doc", "text", "tag"]
    t.upsert(spark.createDataFrame([(1, None, None, None)], SCHEMA))
    assert t.read().count() == 1


def test_racing_writers(spark):
    """Both writers start from one version; neither's rows are lost, whether they touch the same buckets or not."""
    t = made(spark, [(i, None, "old", None) for i in range(64)], n_buckets=4)
    start, real, errors = threading.Barrier(2), KeyedTable._write, []

    def slow(self, rows):
        out = real(self, rows)
        if not getattr(self, "met", False):
            self.met = True
            start.wait(60)  # both have written on the same version before either commits
        return out

    def write(ids, text):
        try:
            own = KeyedTable(spark, t.path)
            own._write = slow.__get__(own)
            own.upsert(spark.createDataFrame([(i, None, text, None) for i in ids], SCHEMA))
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    both = [threading.Thread(target=write, args=(range(0, 30), "a")), threading.Thread(target=write, args=(range(30, 70), "b"))]
    [x.start() for x in both]
    [x.join() for x in both]
    assert not errors and t.versions() == [0, 1, 2]
    assert {r.id: r.text for r in t.read().collect()} == {i: "a" if i < 30 else "b" for i in range(70)}
    with pytest.raises(Conflict):
        t._commit(t.version(1))


def test_keys_that_repeat_keep_all_their_rows(spark):
    """Rows of a key that aren't unique all stay, equal ones too, and all go together."""
    old = [(1, "a", "t", None), (1, "a", "t", None), (1, "b", "t", None), (2, "a", "t", None), (None, "a", "t", None), (None, "a", "t", None)]
    t = made(spark, old, n_buckets=4, unique=False)
    assert rows_of(t.read()) == sorted(old, key=repr)
    new = [(1, "c", "u", None), (1, "c", "u", None)]
    t.upsert(spark.createDataFrame(new, SCHEMA))
    assert rows_of(t.read()) == sorted(new + old[3:], key=repr)
    t.delete(spark.createDataFrame([(1,), (2,)], "id long"))
    assert rows_of(t.read()) == sorted(old[4:], key=repr)
    assert rows_of(t.read(0)) == sorted(old, key=repr)
