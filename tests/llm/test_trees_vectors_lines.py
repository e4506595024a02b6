"""Merkle manifest, whitening and line dedup: brute force, exactness, edge cases."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import sha
from tests.llm.test_llm import DOCS, documents, odd_documents
from tidemill.llm import line_dedup, merkle, whitening

# op11 ----------------------------------------------------------------------


def plain_field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(nodes):
    """The levels of a tree, lowest first."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 16])) for i in range(0, len(out[-1]), 16)])
    return out


def plain_siblings(tree, i):
    """Runs' other nodes, level by level, with the place among them."""
    out = []
    for nodes in tree[:-1]:
        run = nodes[i // 16 * 16 : i // 16 * 16 + 16]
        out.append((i % 16, run[: i % 16] + run[i % 16 + 1 :]))
        i //= 16
    return out


def plain_manifest(rows):
    """rows: (doc_id, text, lang, source, n_chars); results in any order."""
    by = defaultdict(list)
    for i, text, lang, source, n in rows:
        leaf, low = ("".join(map(plain_field, (i, source, lang, n, t))) for t in (text, text and "".join(c.lower() if "A" <= c <= "Z" else c for c in text)))
        tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        by[source].append((i is not None, i or 0, sha(leaf), sha(low) if tampered else sha(leaf), i))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in sources]
    top = plain_tree([t[-1][0] for t in trees])
    out = []
    for k, s in enumerate(sources):
        for j, (_, _, leaf, start, i) in enumerate(sorted(by[s], key=lambda x: x[:3])):
            path = plain_siblings(trees[k], j) + plain_siblings(top, k)
            node = start
            for place, others in path:
                node = sha("".join([*others[:place], node, *others[place:]]))
            out.append((i, leaf, trees[k][-1][0], top[-1][0], sha("".join(x for _, o in path for x in o)), node, node == top[-1][0]))
    return sorted(out, key=repr)


def test_manifest_equals_brute_force(spark):
    rng = random.Random(11)
    sizes = {None: 3, "": 1, "one": 1, "full": 4096, "more": 4097, "hot": 9000, "z": 17, "é": 256, "Z": 15}
    sizes |= {f"s{i}": rng.randrange(1, 4) for i in range(300)}
    rows = [(rng.randrange(10**6), rng.choice(["Ab", "ab", "", None, "é\nX"]), rng.choice(["en", None]), s, rng.choice([3, None])) for s, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    got = merkle.tampering(spark.createDataFrame(rows, DOCS).repartition(7))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_manifest(rows)


def test_manifest_edges(spark):
    df = odd_documents(spark)
    got = sorted((tuple(r) for r in merkle.tampering(df).collect()), key=repr)
    assert got == plain_manifest([tuple(r)[:5] for r in df.collect()])
    assert merkle.tampering(df.limit(0)).count() == 0


def test_traversal_gives_every_run_and_holds_few_nodes():
    for n in (1, 2, 16, 17, 255, 256, 257, 4095, 4096):
        nodes = [sha(str(i)) for i in range(n)]
        height, tree = merkle.levels(n), plain_tree(nodes)
        assert merkle.block_root(nodes, height) == tree[-1][0] and height == len(tree) - 1
        for i, path in enumerate(merkle.traverse(nodes, height)):
            assert [(p, r[:p] + r[p + 1 :]) for p, r in path] == plain_siblings(tree, i)
    growing = merkle.Subtree([sha(str(i)) for i in range(4096)], 2, 0)
    for _ in range(4096):
        growing.step()
        assert sum(map(len, growing.stack)) <= 3 * 16


def test_a_path_proves_its_leaf_only(spark):
    rows = [(i, f"T{i}", "en", "s", 1) for i in range(40)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS)).withColumns({"own": merkle.fold(F.col("leaf")), "other": merkle.fold(F.sha2("leaf", 256))}).collect()
    assert all(r.own == r.root != r.other for r in got)


# op12 ----------------------------------------------------------------------


def plain_whitening(vectors, k):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    exact = x * n - s
    a = (exact / n).astype(float)
    e, u = np.linalg.eigh(a.T @ a / n)
    e, u = e[::-1], u[:, ::-1]
    real = e[:k] > e.sum() * 1e-12
    w = a @ u[:, :k][:, real] / np.sqrt(e[:k][real])
    return n, [int(v) for v in (exact**2).sum(axis=1)], w, (e / e.sum())[:k][real]


def check_whitening(rows, ids, vectors, k):
    n, deviation, w, explained = plain_whitening(vectors, k)
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows) == w.size
    for j in range(w.shape[1]):
        column = np.array([got[i, j + 1].whitened for i in ids])
        sign = np.sign(column @ w[:, j])
        assert np.allclose(column * sign, w[:, j], rtol=1e-8, atol=1e-8)
        assert got[ids[0], j + 1].explained == pytest.approx(explained[j], rel=1e-10)
    assert all(r.n == n and r.identity_error < 1e-10 for r in rows)
    assert [got[i, 1].deviation for i in ids] == deviation


def test_whitening_equals_eigenvectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = df.collect()
    check_whitening(whitening.whitened(df, 32).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 32)


def test_small_blocks_reach_the_same(spark):
    """Blocks narrower than the vectors need passes, and are widened for eigenvalues close to each other."""
    rng = np.random.default_rng(3)
    decaying = rng.standard_normal((400, 40)) * (0.7 ** np.arange(40)) * 50 + 1000
    df = spark.createDataFrame([(i, v) for i, v in enumerate(decaying.tolist())], "vec_id long, embedding array<double>")
    model = whitening.fit(df, k=4, oversample=6)
    assert 1 < model.passes <= whitening.PATIENCE
    x = np.floor(64 * decaying) + 1_000_000
    e, u = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(model.eigenvalues, e[::-1][:4], rtol=1e-10)
    assert np.allclose(np.abs((model.components * u[:, ::-1][:, :4]).sum(axis=0)), 1, atol=1e-10)
    flat = rng.standard_normal((400, 12))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(flat.tolist())], "vec_id long, embedding array<double>")
    model = whitening.fit(df, k=3, oversample=0)
    assert np.allclose(model.eigenvalues, np.linalg.eigvalsh(np.cov((np.floor(64 * flat)).T, bias=True))[::-1][:3], rtol=1e-10)


def test_whitening_edges(spark):
    schema = "vec_id long, embedding array<float>, deviation string, i string, n string, whitened string, place string"
    rng = random.Random(2)
    good = [(i, [rng.random() for _ in range(5)]) for i in range(40)] + [(None, [0.5] * 5), (3, [1.0, 2.0, 0.0, 4.0, 0.5]), (3, [1.0, 2.0, 0.0, 4.0, 0.5])]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0, 4.0]), (92, [float("nan")] * 5), (93, [float("inf")] * 5)]
    frame = lambda rows: spark.createDataFrame([(*r, *["clash"] * 5) for r in rows], schema)
    out = whitening.whitened(frame(good + bad), 32).collect()
    assert len(out) == 43 * 5 and sum(r.vec_id is None for r in out) == 5 and {r.n for r in out} == {43}
    assert max(r.component for r in out) == 5 and out[0].identity_error < 1e-9
    assert whitening.whitened(frame(good[:1]), 32).count() == 0  # one row: no spread
    assert whitening.whitened(frame(bad), 32).count() == 0
    assert whitening.whitened(frame([]), 32).count() == 0
    assert whitening.whitened(frame([(1, [])]), 32).count() == 0
    line = whitening.whitened(frame([(i, [float(i), 1.0, 2.0]) for i in range(4)]), 32).collect()
    assert {r.component for r in line} == {1} and len(line) == 4
    short = whitening.whitened(frame([(1, [1.0]), (2, [2.0, 5.0]), (3, [0.0, 0.0])]), 32).collect()
    check_whitening(short, [1, 2, 3], [[1.0, 0.0], [2.0, 5.0], [0.0, 0.0]], 32)
    huge = whitening.whitened(frame([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 3.0])]), 32).collect()
    assert all(r.deviation is None for r in huge if r.vec_id < 3) and all(math.isfinite(r.whitened) for r in huge)


# op13 ----------------------------------------------------------------------


def plain_lines(rows, least=20, least_docs=3):
    """rows: (doc_id, text); (doc_id, n_lines, n_dropped, text) in any order."""
    split = [(i, (t or "").split("\n")) for i, t in rows]
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, lines in split:
        for line in lines:
            if len(k := key(line)) >= least:
                holders[k].add((i is not None, i or 0))
    out = []
    for i, lines in split:
        stay = [x for x in lines if len(holders[key(x)]) < least_docs or max(holders[key(x)]) == (i is not None, i or 0)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def lined(docs):
    return sorted((tuple(r) for r in line_dedup.kept_lines(docs, line_dedup.keep_bitmaps(docs)).collect()), key=repr)


def shared_lines(n, seed):
    rng = random.Random(seed)
    pool = [f"A shared line of text, number {i}" for i in range(30)] + ["ß" * 19, "ß" * 20, "É" * 20, "x" * 19, "short", "", "\tA Line with Space at its ends \x0b", "a line with space at its ends"]
    return [(i, "\n".join(["The one line that every document has"] * (i % 3 > 0) + [rng.choice(pool) for _ in range(rng.randrange(8))] + [f"own line of document {i} and long"])) for i in range(n)]


def test_lines_equal_brute_force(spark, sf_dir):
    rows = documents(sf_dir) + [(10**6 + i, t) for i, t in shared_lines(600, 5)]
    assert lined(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == plain_lines(rows)


def test_hot_lines_reach_over_partitions(spark, monkeypatch):
    """One line in all documents, in many small batches and partitions."""
    rows = shared_lines(400, 6)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    monkeypatch.setattr(line_dedup, "shuffle_partitions", lambda spark: 40)
    try:
        assert lined(spark.createDataFrame(rows, "doc_id long, text string")) == plain_lines(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_large_bitmaps_are_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", 0)
    rows = shared_lines(50, 7)
    assert lined(spark.createDataFrame(rows, "doc_id long, text string")) == plain_lines(rows)


def test_line_edges(spark):
    df = odd_documents(spark)
    assert lined(df) == plain_lines([tuple(r)[:2] for r in df.collect()])
    assert lined(df.limit(0)) == []
    same = "a line that is long enough to be a key"
    rows = [(None, same), (None, same + "\nother"), (1, same), (1, same), (2, f"{same}\n{same}"), (2, "x"), (3, None), (3, "")]
    assert lined(spark.createDataFrame(rows, "doc_id long, text string")) == plain_lines(rows)
    two = [(1, same), (1, same + "\nmore"), (2, same)]
    assert [r[2] for r in lined(spark.createDataFrame(two, "doc_id long, text string"))] == [0, 0, 0]


def test_bitmaps(spark):
    rng = random.Random(1)
    for n in (1, 7, 8, 9, 1000, 100_000):
        gone = np.array(sorted(rng.sample(range(n), n // 3)), np.int64)
        bitmap = line_dedup.pack(n, gone)
        assert np.flatnonzero(~line_dedup.unpack(bitmap, n)).tolist() == gone.tolist() and len(bitmap) <= n // 8 + 2
    assert len(line_dedup.pack(100_000, np.arange(0))) < 100
    one = line_dedup.keep_bitmaps(spark.createDataFrame([(1, "a\nb")], "doc_id long, text string")).first()
    assert (one.doc_id, one.n_lines, one.n_dropped) == (1, 2, 0) and hashlib.sha256(one.keep).digest()
