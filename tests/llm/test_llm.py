"""Operators of the llm subpackage: oracle SQL, brute force, recall, held-out accuracy and edge cases."""

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.brute import joined, pii_base, plain_battery, plain_features, plain_fit, quality_features, secret_base, sha, sigmoid
from tests.oracle import differences, duck
from tidemill.llm import ann, bpe, exact_topk, mixing, near_dedup, pii, preferences, quality, registry, secrets, token_counts
from tidemill.llm.common import materialise

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_oracle(spark, sf_dir, name):
    assert differences(spark, registry.QUERIES[name], registry.ORACLE_SQL[name], sf_dir) == ""


def documents(sf_dir):
    return duck(sf_dir).execute("SELECT doc_id, text FROM documents").fetchall()


def odd_documents(spark):
    """Nulls, empty and very long texts, ties and repeated rows, and columns that clash with working names."""
    long = " ".join(f"word{i % 9973} a{i}" for i in range(40_000))
    rows = [
        (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "  \n\t ", None, None, 3), (4, long, "en", "s", len(long)),
        (5, "same text here again and again now", "en", "t", 34), (5, "same text here again and again now", "en", "t", 34), (6, "same text here again and again now", "en", None, 34),
        (None, "no id with a mail x@y.org", "en", "", 10), (7, "x" * 50_000, "en", "s", 50_000), (8, "4" * 30_000, "en", "s", 30_000), (9, "a@" * 5_000 + "b.c", "en", "s", 9),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("size", "key", "band", "component", "n", "regs", "target", "id", "a", "b", "spans", "_base", "_digest", "_id", "_copies", "kept", "quality", "x", "content", "bucket"):
        df = df.withColumn(c, F.lit("clash"))
    return df


# op1 -----------------------------------------------------------------------


def test_mix_edges(spark):
    rows = mixing.mix(odd_documents(spark)).collect()
    assert len(rows) == 12
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
    assert all(t <= 2 * s and abs(n - t) < 1 + 1e-6 for t, s, n in by.values())
    assert math.isclose(sum(t for t, _, _ in by.values()), 1.5 * sum(r.size for r in rows))
    assert mixing.mix(odd_documents(spark).limit(0)).count() == 0


def test_mixed_rows(spark):
    df = odd_documents(spark)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    plan = {(r.doc_id, r.size): r for r in mixing.mix(df).collect()}
    n = {r.doc_id: r["count"] for r in out.where("doc_id = 4").groupBy("doc_id").count().collect()}
    assert n.get(4, 0) in (1, 2) and plan[4, 80_000].epochs >= 1


def test_repeated_rows_keep_to_their_budget(spark):
    same, other = "one two three four five six seven eight nine ten", "a b c d e f g h i j"
    rows = [(1, same, None, "s", 0)] * 30 + [(2 + i, other, None, "s", 0) for i in range(30)] + [(100 + i, other, None, "t", 0) for i in range(60)]
    df = spark.createDataFrame(rows, DOCS)
    target = {r.source: r.target for r in mixing.mix(df).select("source", "target").distinct().collect()}
    taken = {r.source: 10 * r["count"] for r in mixing.mixed(df).groupBy("source").count().collect()}
    assert all(abs(taken[s] - target[s]) <= 10 for s in target) and set(taken) == set(target)


# op2, op8 ------------------------------------------------------------------


def noisy(n=250):
    rng = random.Random(4)
    bits = ["a@b.c", "x", "@", ".", "1", "23", "+1", "(555) ", "-", " ", "4111 1111 1111 1111", "127.0.0.1", "300", "token", "=:", "api_key", '"', "AKIAABCDEFGH", "0123456789abcdef", "deadbeef", "é", "日", "secret = ", "\n", "%x"]
    return [(10**6 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize(("find", "base", "kinds"), [(pii.find_personal, pii_base, ("email", "ip", "card", "phone")), (secrets.find_secrets, secret_base, ("assign", "access", "hex"))])
def test_spans_equal_brute_force(spark, sf_dir, find, base, kinds):
    docs = documents(sf_dir) + noisy() + [(-1, None), (-2, ""), (-3, "4" * 20_000), (-4, "a@" * 3000 + "b.c")]
    got = {r.doc_id: r for r in find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        want = base(t)
        assert got[i].base_sha256 == sha(joined(want)), (i, t and t[:200])
        assert tuple(got[i][f"n_{k}"] for k in kinds) == tuple(sum(s[0] == k for s in want) for k in kinds)
        assert set(filter(None, joined(want).split(","))) <= set(got[i].spans.split(","))


@pytest.mark.parametrize("find", [pii.find_personal, secrets.find_secrets])
def test_span_edges(spark, find):
    assert find(odd_documents(spark)).count() == 12
    assert find(odd_documents(spark).limit(0)).count() == 0


def test_weak_supervision_equals_brute_force(spark):
    rng = random.Random(19)
    spans = []
    for _ in range(400):  # four labelers right at different rates, one silent
        truth = rng.random() < 0.6
        votes = tuple((1 if truth == (rng.random() < good) else -1) if rng.random() < 0.8 else 0 for good in (0.95, 0.8, 0.7, 0.6))
        spans.append((rng.randrange(9), (*votes, 0), tuple(rng.randrange(2) for _ in range(3))))
    span = "array<struct<kind:int,start:int,stop:int,group:int,votes:array<int>,shape:array<int>>>"
    packed = [(0, 0, 1, g, list(v), list(s)) for g, v, s in spans]
    w = pii.fit(spark.createDataFrame([(packed[:150], packed[150:]), ([], [])], f"_base {span}, _more {span}"))
    assert w == pytest.approx(plain_fit(spans), rel=1e-9, abs=1e-12)
    assert w[1] > w[2] > w[3] > w[4] > 0 == w[5], "more reliable labelers weigh more"


def test_every_span_is_judged_and_numbers_are_rejected(spark):
    """On the given documents, too: probabilities by plain loops, and decisions in which the classifier has a part."""
    import os

    sf = "/root/testdata/sf0.01" if os.path.exists("/root/testdata/sf0.01") else "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    extra = [(10**6 + i, t) for i, t in enumerate(["order 4155 552 671 88", "tel (415) 555-2671", "2024-01-02 10 20 30", "12345678901234567", "mail an.address-longer-than-forty-characters.in-all.of-it [at] example [dot] org"])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    found = pii.candidates(docs).select("doc_id", "_base", "_more").collect()
    one = lambda s: (s.group, tuple(s.votes), tuple(s["shape"]))
    w = plain_fit([one(s) for r in found for s in [*r._base, *r._more]])
    p = lambda s: sigmoid(sum(a * b for a, b in zip(w, plain_features(*one(s)), strict=True)))
    want = {}
    for r in found:
        spans = sorted((s.kind, s.start, s.stop, p(s)) for s in [*r._base, *[s for s in r._more if p(s) >= 0.5]])
        want[r.doc_id] = (",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b, _ in spans), [x for *_, x in spans])
    got = {r.doc_id: (r.spans, [float(x) for x in r.scores.split(",") if x]) for r in pii.find_personal(docs).collect()}
    assert {i: s for i, (s, _) in got.items()} == {i: s for i, (s, _) in want.items()}
    assert all(got[i][1] == pytest.approx(want[i][1], abs=1e-6) for i in got)
    assert [got[10**6 + i][0].split(":")[0] for i in range(5)] == ["", "phone", "", "", "email"]
    more = [p(s) for r in found if r.doc_id < 10**6 for s in r._more]
    assert more and any(x < 0.5 for x in more), "the classifier decides on spans of the given documents"


def test_more_personal_data_is_found(spark):
    text = "Call me: (415) 555-2671 or write to jane [at] example [dot] com, signed Dr. Jane Doe, ssn 123-45-6789. Version v 1.2.3.4"
    docs = spark.createDataFrame([(i, text) for i in range(30)], "doc_id long, text string")
    spans = pii.find_personal(docs).first().spans
    assert {s.split(":")[0] for s in spans.split(",")} == {"email", "ip", "phone", "ssn", "person"}


def test_redaction(spark):
    rows = [(1, "é mail a.b@c.de, then +1 (555) 555-1234 at 10.0.0.1.", "clash"), (2, None, "k"), (3, "clean", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.redact(df).collect()}
    assert got[1].text == "é mail [EMAIL], then [PHONE] at [IP]."
    assert (got[1].spans, got[2].text, got[3].text) == ("clash", None, "clean")
    assert pii.redact(odd_documents(spark)).count() == 12


def test_random_tokens_are_secrets_and_words_are_not(spark):
    rng = random.Random(8)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    keys = ["".join(rng.choice(alnum) for _ in range(44)) for _ in range(30)]
    flat = ["zk7" * 14 + "x" for _ in range(30)]
    docs = [(i, f"see {k} there") for i, k in enumerate(keys)] + [(100 + i, f"see {k} there") for i, k in enumerate(flat)] + [(200, "Donaudampfschifffahrtsgesellschaft")]
    got = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert sum(got[i] == "random:4:48" for i in range(30)) >= 22
    assert not any(got[100 + i] for i in range(30)) and got[200] == ""


def secret_like(rng, i):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    return "".join(rng.choice(letters if i % 2 else "0123456789abcdef") for _ in range(rng.choice([20, 24, 30, 40, 64]) if i % 2 else rng.randrange(20, 32)))


def ordinary(rng):
    words = "alpha beta gamma delta config server network module handler manager version release candidate number table index".split()
    return "_".join(rng.choice(words) for _ in range(rng.randrange(3, 7))) + f"_{rng.randrange(1, 2025)}"


def test_battery_equals_brute_force(spark):
    rng = random.Random(17)
    tokens = [secret_like(rng, i) for i in range(60)] + [ordinary(rng) for _ in range(60)] + ["a" * 40, "ab" * 20, "Zm9v" * 8 + "==", "A2B3" * 6, "x+/" * 9, "0" * 31 + "f"]
    df = spark.createDataFrame([(t,) for t in tokens], "token string")
    for r in df.select("token", secrets.battery(F.col("token")).alias("p")).collect():
        assert r.p == pytest.approx(plain_battery(r.token), rel=1e-9, abs=1e-300), r.token


def test_reported_tokens_are_the_controlled_discoveries(spark):
    """Precision and recall on planted random tokens among ordinary ones of the same lengths."""
    rng = random.Random(3)
    docs = []
    for i in range(400):
        t, o = secret_like(rng, i), ordinary(rng)
        docs.append((i, f"see {t} and {o} here", t))
    found = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id int, text string, t string")).collect()}
    hits = [text[slice(*map(int, x.split(":")[1:]))] == t for i, text, t in docs for x in found[i].split(",") if x.startswith("random")]
    assert sum(hits) >= 0.85 * 400 and sum(hits) >= (1 - 1.5 * secrets.RATE) * len(hits)
    plain = spark.createDataFrame([(i, f"only {ordinary(rng)}") for i in range(200)], "doc_id int, text string")
    assert sum(r.spans.count("random") for r in secrets.find_secrets(plain).collect()) <= 20


def plain_steps(tokens):
    """By length class, how many tokens there are at each step."""
    counts = {c: [0] * (secrets.STEPS + 1) for c in range(len(secrets.CLASSES))}
    for t in tokens:
        counts[plain_class(t)][plain_step(t)] += 1
    return counts


def plain_class(token):
    return max([i for i, least in enumerate(secrets.CLASSES) if len(token) >= least], default=0)


def plain_step(token):
    return min(secrets.STEPS, math.floor(-10 * math.log10(max(plain_battery(token), 1e-12))))


def plain_random():
    import base64
    import hashlib

    out = []
    for i in range(secrets.MEASURED * len(secrets.CLASSES)):
        n = secrets.CLASSES[i % len(secrets.CLASSES)]
        first, second = (hashlib.sha512(f"{i}:{j}".encode()).hexdigest() for j in (0, 0))
        out.append((first if i % 2 == 0 else base64.b64encode(bytes.fromhex(first + second)).decode().rstrip("="))[:n])
    return out


def test_secret_scan_equals_plain_loops(spark):
    """Spans and scores of a whole scan: every span is judged, and what is reported follows from the counts."""
    import os
    import re

    sf = "/root/testdata/sf0.01" if os.path.exists("/root/testdata/sf0.01") else "/root/testdata/sf0.001"
    rng = random.Random(12)
    docs = documents(sf) + [(10**6 + i, f"see {secret_like(rng, i)} and {ordinary(rng)} here, token={secret_like(rng, i)}") for i in range(120)]
    found = []
    for i, text in docs:
        base = []
        for kind, a, b in secret_base(text):
            piece = text[a:b]
            base.append((a, ("assign", "access", "hex").index(kind), b, re.search("[:=] *[\"']?([A-Za-z0-9+/_.=-]+)$", piece)[1] if kind == "assign" else piece))
        free = lambda m, base=base: all(m.end() <= a or b <= m.start() for a, _, b, _ in base)
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+", text or "") if free(m)]
        found.append((i, sorted(base), more))
    counts, measured = plain_steps(t for _, base, more in found for *_, t in base + more), plain_steps(plain_random())
    shares, limits = secrets.ordinary_shares(counts, measured), secrets.bounds(counts, measured)
    want = {}
    for i, base, more in found:
        spans = sorted(base + [s for s in more if plain_step(s[3]) < limits[plain_class(s[3])]])
        q = [min(shares[plain_class(t)][plain_step(t) :]) for *_, t in spans]
        want[i] = (",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b, _ in spans), [(round(10 ** (-plain_step(t) / 10), 8), round(x, 6)) for (*_, t), x in zip(spans, q, strict=True)])
    rows = secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    got = {r.doc_id: (r.spans, [tuple(map(float, x.split(":"))) for x in r.scores.split(",") if x]) for r in rows}
    assert got == want
    judged = [s for i, (_, scores) in got.items() if i < 10**6 for s in scores]
    assert judged and all(0 <= p <= 1 and 0 <= q <= 1 for p, q in judged), "on the given table, too, the battery judges what is found"


def test_bounds_of_reported_steps():
    random_ = {c: [500, 200, 150, 100, 50] + [0] * (secrets.STEPS - 4) for c in range(6)}
    counts = {c: [0] * (secrets.STEPS + 1) for c in range(6)}
    counts[1][:5] = [50, 20, 15, 10, 5]  # random ones only: all are reported
    counts[2][:3], counts[2][60] = [50, 20, 15], 500  # 500 ordinary ones far out stay unreported
    counts[3][70] = 9  # ordinary ones only
    got = secrets.bounds(counts, random_, 0.1)
    assert got[0] == 0 and got[1] == secrets.STEPS + 1 and 5 <= got[2] <= 60 and got[3] == 0


# op3 -----------------------------------------------------------------------


def test_quality_held_out(spark):
    import os

    sf = "/root/testdata/sf0.01" if os.path.exists("/root/testdata/sf0.01") else "/root/testdata/sf0.001"
    out = registry.op3_quality_rank(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    r, good = out.score.rank(), out.quality == 1
    auc = (r[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95 and (out.predicted == out.quality).mean() > 0.95
    assert out.score.between(0, 1).all() and ((out.score >= 0.3) == (out.predicted == 1)).all()


def test_quality_scores_equal_brute_force(spark):
    """Features by plain loops, the drawn rows by hand, and Bradley-Terry's conditions at the fitted weights."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    x = {i: quality_features(t) for i, t in rows.items()}
    for i, t in rows.items():
        assert quality.features((t or "").encode()) == pytest.approx(x[i], abs=1e-12)
    known = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 and r.quality is not None}
    ids = [r.doc_id for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect() if r.doc_id in known]
    ranker = quality.train(np.array([x[i] for i in ids]), np.array([known[i] for i in ids]))
    got = {r.doc_id: r for r in quality.rank_quality(docs, labels).collect()}
    assert set(got) == set(rows)
    raw = {i: sum((v - m) * w for v, m, w in zip(x[i], ranker.mean, ranker.weight, strict=True)) for i in rows}
    for i, r in got.items():
        assert r.score == pytest.approx(1 / (1 + math.exp(-(raw[i] - ranker.cut) * ranker.steep - math.log(0.3 / 0.7))), abs=1e-9)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
    good, bad = ([raw[i] for i in ids if known[i] == y] for y in (1, 0))
    assert sum(a > b for a in good for b in bad) > 0.9 * len(good) * len(bad)
    below = sum(raw[i] < ranker.cut for i in ids)
    assert abs(below - len(bad)) <= 1, "the cut is the quantile at the share of bad labels"
    kept = {r.doc_id for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r.predicted}


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (5, 1, 0), (5, 0, 0), (None, 1, 0), (6, None, 0)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.limit(0)):
        rows = quality.rank_quality(odd_documents(spark), lab).collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
    assert quality.rank_quality(odd_documents(spark).limit(0), labels).count() == 0
    assert quality.keep_good(odd_documents(spark), labels).columns == odd_documents(spark).columns


def test_quality_is_fitted_on_all_labelled_rows(spark, monkeypatch):
    """The weights are those of all pairs, listed one by one, and every labelled row moves them."""
    from tidemill.llm.common import pick

    rng = np.random.default_rng(4)
    words = ["plain", "Words", "WITH", "some", "!!!", "|", "#x#", "of", "all", "kinds"]
    texts = [" ".join(rng.choice(words, rng.integers(5, 40))) for _ in range(300)]
    labels = [int(rng.random() < 1 / (1 + math.exp(t.count("!") - 5))) for t in texts]
    ids = [i for i in range(2_000) if zlib.crc32(str(i).encode()) % 5][:300]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
    known = spark.createDataFrame(list(zip(ids, labels, strict=True)), "doc_id long, quality int")
    monkeypatch.setattr(quality, "SAMPLE", 50, raising=False)
    monkeypatch.setattr(quality, "PAIRS", 400, raising=False)
    ranker = quality.fit(pick(docs, "doc_id", "text"), known)
    x, y = np.array([quality.features(t.encode()) for t in texts]), np.array(labels)
    spread = x.std(axis=0)
    spread[spread < 1e-7] = 1
    assert ranker.mean == pytest.approx(x.mean(axis=0), abs=1e-8)
    z = (x - x.mean(axis=0)) / spread
    d = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, x.shape[1])
    w = ranker.weight * spread
    slope = d.T @ (1 / (1 + np.exp(d @ w))) / len(d) - 1e-3 * w
    assert np.abs(slope).max() < 1e-5, "the likelihood of all pairs is at its maximum"
    assert ranker.cut == pytest.approx(np.quantile((x - ranker.mean) @ ranker.weight, (y == 0).mean()), abs=1e-9)


def test_neighbours_of_a_place(spark):
    values = [3.0, -1.0, 3.0, 1e9, 3.0, 3.0 + 1e-12, 0.0, -1e-300]
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    for place in range(1, len(values)):
        assert quality.neighbours(df, place) == tuple(sorted(values)[place - 1 : place + 1])


# op4, op10 -----------------------------------------------------------------


def odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 0.0]), (None, [1.0, 1.0]), (5, [0.0, 0.0]), (6, [-1.0, 0.5]), (7, [3.0]), (8, [])]
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)


def brute_topk(x, ids, k, every, score):
    out = []
    for q in np.flatnonzero(ids % every == 0):
        s = score(x[q], x)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:k]
        out += [(int(ids[q]), r + 1, int(ids[i]), s[i]) for r, i in enumerate(order)]
    return sorted(out)


def test_exact_topk_with_ties(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(-3, 4, (700, 6)).astype(np.float32) / 64
    ids = np.arange(700)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in exact_topk.exact_topk(df).collect())
    y = np.floor(64 * x.astype(float))
    assert got == brute_topk(y, ids, 20, 20, lambda q, c: (c @ q).astype(int))


def test_exact_topk_stops_early_on_skewed_lists():
    """A few rows hold most of the mass: a small part of the lists tells the best, and light blocks aren't read."""
    rng = np.random.default_rng(3)
    heavy = np.where(rng.random((3000, 1)) < 0.02, 40, 1)
    x = np.floor(heavy * rng.standard_exponential((3000, 12)))
    ids = np.arange(3000)
    got = exact_topk.search_block(x[:50], ids[:50], x, ids, 5)
    assert len(got) == 50
    for i, places, scores, _ in got:
        s = x @ x[i]
        s[i] = -np.inf
        order = np.lexsort((ids, -s))[:5]
        assert sorted(zip(-scores, ids[places], strict=True))[:5] == sorted(zip(-s[order].astype(int), order, strict=True))
    assert np.mean([read for *_, read in got]) < 0.5
    light = np.flatnonzero(heavy[:, 0] == 1)
    floors = np.array([np.sort(np.delete(x @ x[i], i))[-5] for i in range(50)])
    assert len(exact_topk.search_block(x[:50], ids[:50], x[light], ids[light], 5, floors)) < 25


def test_bounds_come_from_what_the_lists_have_shown():
    """Unseen places hold the fronts or the ends, and the real scores lie between the bounds at every depth."""
    rng = np.random.default_rng(2)
    x, q = (np.floor(8 * rng.standard_normal((n, 5))) for n in (300, 7))
    lists, split = exact_topk.Lists(x), np.hstack([np.maximum(q, 0), np.minimum(q, 0)])
    wider = np.inf
    for share in exact_topk.DEPTHS:
        m = lists.depth(share)
        upper, lower = (lists.read(share, unseen) for unseen in (lists.fronts(share), lists.ends))
        for d in range(5):
            seen = set(lists.order[300 - m :, d].tolist())
            assert all(upper[i, d] == (x[i, d] if i in seen else lists.fronts(share)[d]) and lower[i, d] == (x[i, d] if i in seen else x[:, d].min()) for i in range(300))
        most, least, scores = split @ upper.T, split @ lower.T, q @ x.T
        assert (least <= scores).all() and (scores <= most).all()
        assert (most - least).mean() <= wider
        wider = (most - least).mean()
    assert wider == 0


def test_exact_topk_reads_less_of_larger_tables():
    rng = np.random.default_rng(8)
    part = {}
    for n in (500, 6000):
        x = np.floor(8 * rng.standard_normal((n, 64)))
        pilot = np.array([np.sort(np.delete(x[: n // 2] @ x[i], i))[-20] for i in range(40)])  # what half the rows have reached
        got = exact_topk.search_block(x[:40], np.arange(40), x, np.arange(n), 20, pilot)
        part[n] = np.mean([read for *_, read in got])
        for i, places, scores, _ in got:
            s = np.delete(x @ x[i], i)
            assert sorted(scores.tolist()) == np.sort(s)[-20:].astype(int).tolist() and i not in places
    assert part[6000] < part[500] <= 1


def test_exact_topk_of_huge_components():
    x = np.array([[2.0**70, 1.0], [2.0**70, -1.0], [-1.0, 2.0]])
    (_, places, scores, _), *_ = exact_topk.search_block(x[:1], np.array([0]), x, np.array([0, 1, 2]), 5)
    assert places.tolist() == [1, 2] and scores[0] == 2**63 - 1


def test_exact_topk_with_a_pilot_block(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "PILOT", 100)
    monkeypatch.setattr(exact_topk, "LEAST_BLOCK", 64)
    x = np.random.default_rng(12).integers(-3, 4, (700, 6)).astype(float)  # many equal scores
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in exact_topk.exact_topk(df, k=7, query_every=20, scale=1).collect())
    want = []
    for i in range(0, 700, 20):
        s = x @ x[i]
        order = [j for j in np.lexsort((np.arange(700), -s)) if j != i][:7]
        want += [(i, n, int(j), int(s[j])) for n, j in enumerate(order, start=1)]
    assert got == want


def test_vector_edges(spark):
    exact = sorted(tuple(r) for r in exact_topk.exact_topk(odd_vectors(spark)).collect())
    assert [r[:3] for r in exact if r[0] == 0] == [(0, 1, 20), (0, 2, 7), (0, 3, 5), (0, 4, 6), (0, 5, 8)][: len([r for r in exact if r[0] == 0])]
    near = [tuple(r) for r in ann.ann_topk(odd_vectors(spark)).collect()]
    assert {r[0] for r in near} <= {0, 20} and all(r[2] in (0, 6, 7, 20) for r in near)
    assert exact_topk.exact_topk(odd_vectors(spark).limit(0)).count() == 0
    assert ann.ann_topk(odd_vectors(spark).limit(0)).count() == 0


def test_ann_recall_and_scores(spark, sf_dir):
    got = registry.op10_ann_search(spark, sf_dir).toPandas()
    rows = duck(sf_dir).execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float)
    want = brute_topk(x, ids, 20, 20, lambda q, c: c @ q)
    pairs = set(zip(got.query_id, got.vec_id, strict=True))
    assert np.mean([(q, v) in pairs for q, _, v, _ in want]) >= 0.9
    at = {int(i): n for n, i in enumerate(ids)}
    assert np.allclose(got.score, [x[at[q]] @ x[at[v]] for q, v in zip(got.query_id, got.vec_id, strict=True)])
    for _, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, len(g) + 1)) and (np.diff(g.score) <= 0).all()


def test_ann_with_one_hot_bucket(spark):
    x = np.vstack([np.tile([1.0, 0.0, 0.0], (900, 1)), np.random.default_rng(2).standard_normal((300, 3))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [r.vec_id for r in ann.ann_topk(df).where("query_id = 0").orderBy("rank").collect()]
    s = x @ x[0]
    s[0] = -9
    assert got == np.lexsort((np.arange(1200), -s))[:20].tolist()


def copy_groups(shares, rows, noise=0.0):
    """Unit vectors, of which groups with these shares are (nearly) copies of one vector each."""
    rng = np.random.default_rng(4)
    x, at = rng.standard_normal((rows, 32)), 0
    for share in shares:
        size = int(share * rows)
        x[at : at + size] = x[at] + noise * rng.standard_normal((size, 32))
        at += size
    return (x / np.sqrt((x**2).sum(axis=1, keepdims=True)))[rng.permutation(rows)]


@pytest.mark.parametrize(("shares", "rows", "noise"), [((1 / 3, 1 / 3), 900, 0.0), ((0.11,) * 5, 900, 0.01), ((0.2,) * 3, 500, 0.0), ((0.24,) * 4, 900, 0.01)])
def test_ann_recall_outside_large_groups_of_copies(spark, shares, rows, noise):
    x, ids = copy_groups(shares, rows, noise), np.arange(rows)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in ann.ann_topk(df).collect()]
    found = np.zeros(rows)
    for q in range(0, rows, 20):
        s = np.delete(x @ x[q], q)
        least = np.sort(s)[-20]
        found[q] = sum(r[0] == q and r[3] >= least - 1e-9 for r in got)
    assert len(got) == len(ids[::20]) * 20 and found[::20].mean() >= 0.95 * 20 and found[::20].min() >= 0.7 * 20


def reranked(x, queries):
    """Share of rows in a visited bucket, recall of the 20 best in them, and functions of a table."""
    n = len(x)
    index = ann.fitted(np.arange(n)[: ann.SAMPLE], x[: ann.SAMPLE], float(np.sqrt((x**2).sum(axis=1)).max()), n, 20)
    place, asked = index.place(index.lifted(x)), index.place(index.scaled(x[queries]))
    hit = np.zeros((len(queries), n), bool)
    for t in range(ann.TABLES):
        _, bucket = index.keys(np.floor(place[:, t]))
        who, cells = index.visits(asked[:, t])
        _, visited = index.keys(cells)
        for q in range(len(queries)):
            hit[q] |= np.isin(bucket, visited[who == q])
    s = x[queries] @ x.T
    s[np.arange(len(queries)), queries] = -np.inf
    return hit.mean(), np.take_along_axis(hit, np.argsort(-s, axis=1)[:, :20], axis=1).mean(), index.hashes


def test_ann_reranks_a_smaller_part_of_larger_tables():
    rng = np.random.default_rng(21)
    x = rng.standard_normal((30_000, 64))
    x /= np.sqrt((x**2).sum(axis=1, keepdims=True))
    parts = {n: reranked(x[:n], np.arange(40)) for n in (500, 4000, 30_000)}
    shares = [p[0] for p in parts.values()]
    assert shares == sorted(shares, reverse=True) and shares[-1] < 0.65
    assert all(recall >= 0.9 for _, recall, _ in parts.values()) and [p[2] for p in parts.values()] == [6, 8, 11]
    near = (np.repeat(x[:100], 300, axis=0) + 0.05 * rng.standard_normal((30_000, 64)))[rng.permutation(30_000)]  # groups far from each other
    share, recall, _ = reranked(near / np.sqrt((near**2).sum(axis=1, keepdims=True)), np.arange(40))
    assert recall >= 0.9 and share < 0.1


def test_ann_visits_the_likeliest_buckets_first():
    x = np.random.default_rng(5).standard_normal((300, 6))
    index = ann.fitted(np.arange(300), x, float(np.sqrt((x**2).sum(axis=1)).max()), 300, 5)
    asked = index.place(index.scaled(x[:20]))[:, 0]
    who, cells = index.visits(asked)
    steps = np.array(list(itertools.product((-1, 0, 1), repeat=index.hashes)))
    for q in range(20):
        wall = (np.floor(asked[q]) + steps - asked[q]) * index.width / index.radius
        p = np.prod([[math.erf((w + ann.WIDTH) / 2**0.5) - math.erf(w / 2**0.5) for w in row] for row in wall], axis=1) / 2**index.hashes
        order = np.argsort(-p)
        need = int((np.cumsum(p[order]) - p[order] < ann.TARGET).sum())
        assert {tuple(c) for c in cells[who == q]} == {tuple(c) for c in np.floor(asked[q]) + steps[order[:need]]}


def test_ann_of_huge_and_tiny_components(spark):
    x = np.random.default_rng(13).standard_normal((300, 8))
    for factor in (1e150, 1e-150, 1e200):
        df = spark.createDataFrame([(i, (v * factor).tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = [(r.query_id, r.vec_id) for r in ann.ann_topk(df, k=5).collect()]
        assert len(set(got)) == len(got)
        if factor < 1e200:  # else products overflow
            s = x[::20] @ x.T
            s[np.arange(15), np.arange(15) * 20] = -np.inf
            want = {(20 * i, int(j)) for i in range(15) for j in np.argsort(-s[i])[:5]}
            assert len(got) == 75 and len(want & set(got)) >= 0.9 * 75


def test_ann_gives_all_candidates_if_fewer(spark):
    rng = np.random.default_rng(6)
    groups = np.repeat(rng.standard_normal((6, 16)), 3, axis=0) + 1e-3 * rng.standard_normal((18, 16))
    for x, k in ((groups, 20), (groups, 17), (rng.standard_normal((21, 16)), 20)):
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        got = [(r[0], r[2]) for r in ann.ann_topk(df, k=k, query_every=1).collect()]
        assert sorted(got) == [(a, b) for a in range(len(x)) for b in range(len(x)) if a != b]
    near = sorted(tuple(r)[:3] for r in ann.ann_topk(odd_vectors(spark)).collect())
    assert near == [(0, 1, 20), (0, 2, 7), (0, 3, 6), (20, 1, 0), (20, 2, 7), (20, 3, 6)]
    assert ann.ann_topk(odd_vectors(spark).where("vec_id = 0")).count() == 0


# op5 -----------------------------------------------------------------------


def test_preference_prefix_and_masks(spark):
    t = lambda *turns: [{"role": r, "text": x} for r, x in turns]
    a = t(("user", "hi"), ("assistant", "hello"), ("user", "é"), ("assistant", "good"))
    rows = [
        (1, a, t(("user", "hi"), ("assistant", "hello"), ("user", "é"), ("assistant", "bad"), ("user", "x"))),
        (2, a, a), (3, [], []), (4, a[:1], []), (5, t((None, None)), t((None, None), ("assistant", "z"))),
    ]
    df = spark.createDataFrame(rows, f"pair_id long, chosen {preferences.TURNS}, rejected {preferences.TURNS}")
    got = {r.pair_id: r for r in preferences.format_pairs(df).collect()}
    one = got[1]
    assert one.prompt_turns == 3 and one.chosen == "<|assistant|>\ngood<|end|>\n" and one.rejected.endswith("<|user|>\nx<|end|>\n")
    s, e = map(int, one.chosen_mask.split(":"))
    assert (one.prompt + one.chosen)[s:e] == "good<|end|>\n"
    s, e = map(int, one.rejected_mask.split(":"))
    assert (one.prompt + one.rejected)[s:e] == "bad<|end|>\n"
    assert (got[2].prompt_turns, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (4, "", "", "")
    assert (got[3].prompt_turns, got[3].prompt) == (0, "")
    assert (got[4].prompt_turns, got[4].rejected) == (0, "")
    assert (got[5].prompt_turns, got[5].chosen, got[5].rejected) == (1, "", "<|assistant|>\nz<|end|>\n")


def test_preference_edges(spark):
    rows = [(1, 0, "user", None), (1, 0, None, "x"), (1, None, "assistant", ""), (None, 0, "user", "lost"), (2, 0, "user", "only"), (3, 1, "assistant", "b"), (3, 1, "assistant", "b")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in preferences.format_pairs(preferences.self_pairs(df)).collect()}
    assert set(got) == {1, 2, 3} and got[2].chosen == "" and got[3].prompt_turns == 2  # both say the same
    assert preferences.format_pairs(preferences.self_pairs(df.limit(0))).count() == 0


def test_preference_branches_part_at_any_depth(spark):
    long = "é" * 200_000
    turns = [(r, t) for i in range(3) for r, t in (("user", f"q{i}"), ("assistant", f"a{i}" if i else long))]
    df = spark.createDataFrame([(c, i, r, t) for c in (3, 4, 5) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in preferences.format_pairs(preferences.self_pairs(df)).collect()}
    assert [got[c].prompt_turns for c in (3, 4, 5)] == [1, 3, 5]
    assert got[3].chosen_mask.count(":") == 3 and got[5].chosen_mask.count(":") == 1
    for c, said in ((3, ["a1", "a1", "a2"]), (4, ["a2", "a2"]), (5, [long])):
        whole = got[c].prompt + got[c].rejected
        assert [whole[slice(*map(int, m.split(":")))].removesuffix(preferences.END) for m in got[c].rejected_mask.split(",")] == said


# op6, op7 ------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts(sf_dir):
    rng = random.Random(5)
    own = ["", "<|endoftext|> hi's <|startoftext|>x", "İSTANBUL ΣΑΣ ﬁ é ① 日本語  x\x85y ᠎ z\x1c q", "a" * 3000, "ha" * 2000, "!!!!!????....!!!", "we're they'll I'D 'S", "😀 ́é"]
    own += ["".join(rng.choice("aehtins'rl.é1日 ") for _ in range(300)) for _ in range(100)]
    own += ["".join(chr(rng.choice([rng.randrange(1, 0x250), rng.randrange(0x370, 0x600), rng.randrange(0x1E00, 0x2C00), rng.randrange(0x1F300, 0x1F700)])) for _ in range(100)) for _ in range(100)]
    return [(i, t) for i, t in enumerate(own)] + [(10_000 + i, t) for i, t in documents(sf_dir)]


def test_token_counts_and_cache(spark, texts, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    df = spark.createDataFrame([*texts, (-1, None), (-2, texts[0][1])], "doc_id long, text string")
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = {r.doc_id: r for r in token_counts.token_counts(df, path, cache).collect()}
        for i, t in texts:
            n = len(tok.encode(t, add_special_tokens=False).ids)
            assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len(t.encode()), n > 1024)
        assert (got[-1].n_tokens, got[-1].n_bytes) == (0, 0)
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t for _, t in texts}), "the second run encodes nothing"
    more = spark.createDataFrame([(1, "new text"), (2, "new text"), (3, texts[5][1])], "doc_id long, text string")
    token_counts.token_counts(more, path, cache).collect()
    assert spark.read.parquet(cache).count() == stored.count() + 1 if stored.count() else True
    piece = public_tokenizers.path("piece_bpe_32k.model")
    assert token_counts.token_counts(more, piece, cache).count() == 3


def test_token_counts_of_hot_and_rare_digests(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(i, "the hot text" if i % 3 == 0 else f"rare text {i}") for i in range(600)]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string"), path, f"file://{tmp_path}/hot").collect()
    count = token_counts.load_tokenizer(path)
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(i, count([t])[0]) for i, t in rows]


def test_token_count_edges(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert token_counts.token_counts(odd_documents(spark), path, f"file://{tmp_path}/a").count() == 12
    assert token_counts.token_counts(odd_documents(spark).limit(0), path, f"file://{tmp_path}/b").count() == 0


def test_bpe_equals_the_library(spark, texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    df = spark.createDataFrame([*texts, (-1, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.bpe_round_trip(df, path).collect()}
    dig = {r.doc_id: r for r in bpe.digests(bpe.bpe_round_trip(df, path)).collect()}
    for i, t in [*texts, (-1, "")]:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert got[i].ids == " ".join(map(str, ids)), t[:100]
        assert got[i].decoded == tok.decode(ids, skip_special_tokens=False) and got[i].n_tokens == len(ids)
        assert (dig[i].ids_sha256, dig[i].decoded_sha256) == (bpe.hexdigest(got[i].ids), bpe.hexdigest(got[i].decoded))


def test_long_words_dont_fill_the_memo(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "MEMO_CHARS", 2_000)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, tok = Tokenizer.from_file(path), bpe.WordTokenizer(path)
    for i in range(6):
        text = " ".join(f"{chr(97 + i)}{'qzxv' * n} common" for n in range(1, 60))
        want = library.encode(text, add_special_tokens=False).ids
        assert tok.encode([text]) == [" ".join(map(str, want))]
        assert sum(map(len, tok.young)) == tok.held <= 2_000 and sum(map(len, tok.old)) < 20_000
    short, hashes = b"w", near_dedup._WordHash()
    assert hashes[b"w" * 1000] != hashes[short] and list(hashes) == [short]


def test_bpe_of_any_characters_equals_the_library(monkeypatch):
    """Pieces between white space are encoded alone, so every kind of space, mark, case and separator must agree."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "MEMO", 300)
    monkeypatch.setattr(bpe, "GROUP_CHARS", 200)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, tok, rng = Tokenizer.from_file(path), bpe.WordTokenizer(path), random.Random(5)
    odd = [*map(chr, range(0x300)), *"\u0301\u0308\u2028\u2003\u180e\u200b\u212a\u212b\u1e9e\u03a3\u03c2\ud55c\ufb01\u0661", "e\u0301", "\U0001f600", "<|endoftext|>", "<|startoftext|>", "'RE", "don't"]
    plain = [*"abcde the 'sT 12,.!  \n"]
    texts = ["".join(rng.choice(odd if rng.random() < 0.4 else plain) for _ in range(rng.randrange(60))) for _ in range(6000)]
    for text, ids, want in zip(texts, tok.encode(texts), library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids == " ".join(map(str, want.ids)), repr(text)
        assert tok.decode(ids) == (len(want.ids), library.decode(want.ids, skip_special_tokens=False)), repr(text)


def test_speculation_is_verified_pair_by_pair():
    tok = bpe.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 14))) for _ in range(4000)]
    got = tok.model.encode_words(words)
    assert got == [tok.model.merge(w) for w in words]
    assert 0 < tok.model.exact < len(words), "some guesses stand and some don't"


def test_bpe_edges(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    assert bpe.bpe_round_trip(odd_documents(spark), path).count() == 12
    assert bpe.bpe_round_trip(odd_documents(spark).limit(0), path).count() == 0


# op9 -----------------------------------------------------------------------


def brute_components(docs, k, percent):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    at = {}
    for i in ids:
        for s in sets[i]:
            at.setdefault(s, []).append(i)
    pairs = {}
    for group in at.values():
        for n, a in enumerate(group):
            for b in group[n + 1 :]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    for (a, b), n in pairs.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def family(n, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(500)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(edits + 1)):
            t[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(t))
    return out


def test_components_equal_brute_force(spark, sf_dir):
    texts = family(60, 100, 6, 1) + family(60, 30, 2, 2) + family(40, 300, 12, 3) + ["A b\tc", "a B c", "a b", "", None, "one two three four", "ONE two three four five"]
    docs = documents(sf_dir) + [(10_000 + i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in near_dedup.near_duplicates(df, 4, 80).collect()}
    want = brute_components(docs, 4, 80)
    assert {i: (got[i].n_shingles, got[i].component_id) for i in got} == want
    assert all(got[i].kept == (want[i][1] == i) for i in got)


def test_a_family_without_a_centre_is_compared_in_blocks(spark, monkeypatch):
    """A chain: neighbours are linked, others aren't, so stars alone would miss links."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[i * 6 : i * 6 + 120])) for i in range(40)]
    rng = random.Random(1)
    ids = rng.sample(range(1000), 40)
    docs = [(ids[i], t) for i, t in docs]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 80).collect()}
    assert got == {i: c for i, (_, c) in brute_components(docs, 4, 80).items()}


def test_a_family_of_one_large_component_and_others(spark, monkeypatch):
    """Near copies in one component, a looser circle around it, and bridges between the two."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]

    def edited(words, n):
        places = set(rng.sample(range(150), n))
        return [f"x{rng.random()}" if i in places else w for i, w in enumerate(words)]

    loose = edited(base, 5)
    texts = [edited(base, 1) for _ in range(30)] + [edited(loose, 1) for _ in range(12)] + [edited(base, 4) for _ in range(10)]
    ids = rng.sample(range(1000), len(texts))
    docs = [(i, " ".join(t)) for i, t in zip(ids, texts, strict=True)]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), 4, 80).collect()}
    want = {i: c for i, (_, c) in brute_components(docs, 4, 80).items()}
    assert got == want and len(set(want.values())) > 1


def test_hypermin_estimates():
    rng = np.random.default_rng(4)
    for overlap in (0.2, 0.5, 0.8, 0.95):
        a = rng.integers(0, 2**63, 3000).astype(np.uint64)
        b = np.concatenate([a[: int(3000 * 2 * overlap / (1 + overlap))], rng.integers(0, 2**63, 3000 - int(3000 * 2 * overlap / (1 + overlap))).astype(np.uint64)])
        ra, rb = (near_dedup.registers(np.unique(near_dedup._finish(x))) for x in (a, b))
        n = np.array([3000.0])
        est, _ = near_dedup.jaccard_estimate(ra[None], rb[None], n, n)
        assert abs(est[0] - overlap) < 0.13


def test_dedup_edges(spark):
    df = odd_documents(spark)
    rows = near_dedup.near_duplicates(df, 4, 80).collect()
    assert len(rows) == 12
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert (by[1].n_shingles, by[1].component_id, by[6].component_id, by[6].kept) == (0, 1, 5, False)
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_dedup.near_duplicates(df.limit(0), 4, 80).count() == 0
    left = near_dedup.drop_copies(df)
    assert left.columns == df.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8, 9]


# Pipeline ------------------------------------------------------------------


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as p
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in p.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        if name != "mixing":
            assert docs.count() <= before
            before = docs.count()
    for t in (r.text for r in docs.collect()):
        assert not pii_base(t)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, " ".join(map(str, tok.encode(r.text, add_special_tokens=False).ids))) for r in docs.collect())
    assert sorted((r.doc_id, r.ids) for r in p.run(spark, sf_dir).collect()) == want


def test_sweep_leaves_what_is_read_and_what_was_there(spark):
    from tidemill.llm.common import sweep, tables

    older = materialise(spark.range(3), "older")
    before = tables(spark)
    gone, kept = materialise(spark.range(4), "gone"), materialise(spark.range(5), "kept")
    sweep(spark, kept, before)
    assert older.count() == 3 and kept.count() == 5 and len(tables(spark)) == len(before) + 1
    with pytest.raises(Exception, match="(?i)not.*exist|FILE_NOT_EXIST"):
        gone.count()


def test_pipeline_stages_take_odd_documents(spark, sf_dir):
    import corpus_pipeline as p

    docs = odd_documents(spark)
    for name, stage in p.STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
        assert stage(spark, odd_documents(spark).limit(0), sf_dir).count() == 0
    assert docs.count() > 0
