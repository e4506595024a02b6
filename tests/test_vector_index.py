"""The vector index: exact results, recall of approximate ones, upkeep by id, what is read; blocked scans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import blocks, retrieval
from tidemill.operators.vector_index import Model, VectorIndex
from tidemill.session import scratch

SCHEMA = "vec_id long, embedding array<float>, label string"


def frame(spark, x, labels=3, start=0):
    return spark.createDataFrame([(start + i, v, None if i % 11 == 0 else f"l{i % labels}") for i, v in enumerate(x.tolist())], SCHEMA)


def asked(v, every=10):
    return v.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


def found(df):
    return {(r.query_id, r.pos): (r.vec_id, r.score) for r in df.collect()}


def plain(v, k, same_label):
    rows = [(r.vec_id, np.array(r.embedding, float), r.label) for r in v.collect() if r.embedding is not None and all(x is not None and np.isfinite(x) for x in r.embedding)]
    width = max(len(x) for _, x, _ in rows)
    rows = [(i, np.pad(x, (0, width - len(x))), label) for i, x, label in rows]
    out = {}
    for i, x, label in rows:
        if i % 10:
            continue
        scores = []
        for j, y, other in rows:
            if i != j and (not same_label or (label is not None and label == other)):
                norm = np.sqrt(x @ x) * np.sqrt(y @ y)
                scores.append((-round(min(1, max(0, x @ y / norm)) if norm else 0.0, 9), j))
        for pos, (s, j) in enumerate(sorted(scores)[:k], 1):
            out[i, pos] = (j, -s)
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((12, 16)) * 2
    return centres[rng.integers(0, 12, 900)] + rng.standard_normal((900, 16))


@pytest.mark.parametrize("same_label", [False, True])
def test_exact_searches_equal_plain_loops(spark, clustered, same_label):
    v = frame(spark, clustered)
    odd = [(10_000, [1.0] * 3, "l1"), (10_010, [0.0] * 16, "l0"), (10_001, None, "l0"), (10_020, [float("nan")] * 16, "l0"), (10_003, [None] * 16, "l1"), (10_030, [], "l2"), (10_040, clustered[7].tolist(), "l1"), (10_050, clustered[7].tolist(), "l1")]
    v = v.unionByName(spark.createDataFrame(odd, SCHEMA))
    want = plain(v, 15, same_label)
    index = VectorIndex.build(v, scratch(spark, "index"))
    assert found(retrieval.pools(asked(v), v, 15, same_label)) == want
    assert found(index.search(asked(v), v, 15, same_label)) == want
    assert found(index.search(asked(v), v, 15, same_label, probes=1)) == want, "exact from a poor start, too"


def test_large_query_sides_are_dealt_in_shares(spark, clustered, monkeypatch):
    v = frame(spark, clustered[:200])
    want = found(retrieval.pools(asked(v), v, 5))
    monkeypatch.setattr(blocks, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(blocks, "ROWS", 16)
    monkeypatch.setattr(blocks, "QUERIES", 3)
    assert found(retrieval.pools(asked(v), v, 5)) == want


def test_recall_and_bytes_of_approximate_searches(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = VectorIndex.build(v, scratch(spark, "index"))
    q = asked(v, 5)
    for same_label in (False, True):
        want = {(i, x[0]) for (i, _), x in found(retrieval.pools(q, v, 15, same_label)).items()}
        got = {(i, x[0]) for (i, _), x in found(index.search(q, v, 15, same_label, exact=False)).items()}
        assert len(got & want) / len(want) >= 0.95
    assert index.bytes_read({0}) < index.bytes_read() / 3


def test_half_a_byte_a_dimension_is_exact_too(spark, clustered):
    v = frame(spark, clustered)
    index = VectorIndex.build(v, scratch(spark, "index"), lists=8, code_bytes=8)
    assert index.model().coarse.shape == (8, 16) and len(index.model().books) == 8
    assert found(index.search(asked(v), v, 10)) == plain(v, 10, False)


def test_upkeep_by_id(spark, clustered):
    v = frame(spark, clustered)
    index = VectorIndex.build(v, scratch(spark, "index"))
    moved = frame(spark, -clustered[:40])  # to other lists
    new = frame(spark, clustered[:25] * 0.5 + 0.1, start=5000)
    before = index.entries.version()
    index.upsert(moved.unionByName(new))
    index.delete(spark.createDataFrame([(i,) for i in range(100, 140)], "vec_id long"))
    now = v.where("vec_id >= 140 or (vec_id >= 40 and vec_id < 100)").unionByName(moved).unionByName(new)
    assert sorted(r.vec_id for r in index.entries.read().select("vec_id").collect()) == sorted(r.vec_id for r in now.collect())
    assert found(index.search(asked(now), now, 10)) == plain(now, 10, False)
    one = index.entries.version()
    index.delete(spark.createDataFrame([(500,)], "vec_id long"))
    assert len(index.entries.version().touched) == 1 and one.number > before.number
    with pytest.raises(Exception, match="dimensions"):
        index.upsert(spark.createDataFrame([(1, [1.0] * 17, None)], SCHEMA))


def test_empty_index(spark):
    empty = spark.createDataFrame([], SCHEMA)
    index = VectorIndex.build(empty, scratch(spark, "index"))
    assert index.search(asked(empty), empty, 5).count() == 0


def test_codes_say_how_wrong_they_are(clustered):
    model = Model.fit(clustered, 8, 16)
    lists, codes, errors, radii = model.encode(clustered)
    x = clustered / np.linalg.norm(clustered, axis=1)[:, None]
    assert np.allclose(np.linalg.norm(model.decode(lists, codes) - x, axis=1), errors)
    assert np.allclose(np.linalg.norm(model.coarse[lists] - x, axis=1), radii) and errors.max() < 0.2 * radii.max()
