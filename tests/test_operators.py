"""Operators that SQL can't express, on small inputs with known results."""

import math
import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.functions import html, roles
from tidemill.functions import text as tx
from tidemill.operators import chunking, spelling
from tests.golden import GOLDEN
from tidemill.plans.texts import PEOPLE
from tidemill.streaming import messages as ms


# Scoring -------------------------------------------------------------------


def test_golden_confidence(spark):
    from tidemill.operators import scoring

    rows = [(k, i, s) for k, v in GOLDEN.items() for i, s in enumerate(v, 1)]
    pool = spark.createDataFrame(rows, "q string, pos int, score double")
    got = {r.q: r for r in scoring.confidence(scoring.signals(pool, ["q"]), F.lit(False), F.lit(0.6)).collect()}
    want = {
        "fee": (0.9436, 0.7393, 0.4731, 0.8304, "high", "assert"),
        "head": (0.0000, 0.9610, 0.9157, 0.8457, "high", "assert"),
        "english": (0.0031, 0.4800, 1.0000, 0.4224, "medium", "assert"),
        "hostel": (0.9524, 0.9834, 0.0539, 0.8654, "high", "disambiguate"),
        "mba": (0.0000, 0.2621, 0.2222, 0.2306, "low", "disambiguate"),
    }
    for q, (a, s, r, final, band, mode) in want.items():
        g = got[q]
        assert [round(x, 4) for x in (g["abs"], g["sep"], g["rank"], g["final"])] == [a, s, r, final]
        assert (g["band"], g["mode"]) == (band, mode)
    assert got["single"]["sep"] == 0 and got["single"]["rank"] == 1


@pytest.mark.parametrize(("top", "want"), [(0.7418, 0.9989), (0.1646, 0.7400), (0.0, 0.3543), (0.0101, 0.3778)])
def test_upload_profile(spark, top, want):
    from tidemill.operators import scoring

    pool = spark.createDataFrame([("q", 1, top)], "q string, pos int, score double")
    got = scoring.confidence(scoring.signals(pool, ["q"], profile="upload"), F.lit(False), F.lit(1.0), "upload").first()
    assert round(got["set_confidence"], 4) == want and got["band"] == ("high" if want >= 0.7 else "medium")


def test_arbitration_margin_and_missing_sides(spark):
    from tidemill.operators import scoring

    web = spark.createDataFrame([(1, "high", 0.9), (2, "high", 0.9), (3, "low", 0.1), (4, "high", 0.8)], "q long, band string, final double")
    up = spark.createDataFrame([(1, "high", 0.882), (2, "high", 0.881), (4, "medium", 0.6), (5, "low", 0.2)], "q long, band string, final double")
    got = {r.q: r.store for r in scoring.arbitrate(web, up, ["q"]).collect()}
    assert got == {1: "upload", 2: "web", 3: "web", 4: "web", 5: "upload"}


def test_votes_tie_goes_to_first_seen(spark):
    from tidemill.operators import scoring

    df = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, "c"), (2, 0, "x"), (2, 1, "x"), (3, 0, None)], "q long, pos long, label string")
    got = {r.q: (r.label, r.agreement) for r in scoring.votes(df, ["q"], "label", "pos").collect()}
    assert got == {1: ("b", 0.4), 2: ("x", 0.4)}


# Roles ---------------------------------------------------------------------


def test_longer_role_wins_and_none_overlap():
    assert [r["role"] for r in roles.roles_in("Vice-Chairperson and Chairperson")] == ["deputy_head", "head_of_department"]
    assert [r["role"] for r in roles.roles_in("assistant professor, professor emeritus")] == ["assistant_professor", "professor_emeritus"]
    assert roles.roles_in(None) == []


def test_role_metadata(spark):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(PEOPLE)], "i int, url string, kind string, text string")
    got = {r.i: r for r in roles.metadata(df, "text", "url", "kind").collect()}
    assert (got[0].designation, got[0].department, got[0].is_department_head) == ("head_of_department", "electronics and communication", True)
    assert (got[1].designation, got[1].department, got[1].is_department_head) == ("deputy_head", "computer science", False)
    assert got[2].designation == ""  # not a record of a person
    assert (got[3].designation, got[3].designations_all) == ("principal", "associate_professor|principal")
    assert got[4].designation == ""  # no title of address
    assert (got[5].designation, got[5].department) == ("professor", "")


# Pages ---------------------------------------------------------------------

PAGE = """<html><nav>menu</nav><div class="breadcrumb">x</div><main><h1>Top</h1><p>Intro &amp; more</p>
<h2>Fees</h2><table><tr><th>Year</th><th></th></tr><tr><td>1</td><td>10\n</td></tr><tr><td></td></tr></table>
<div class="fc-item"><img src="/p.png"><a href="/faculty/a">A  B</a></div><div class="fc-item"><a href="mailto:x">C</a></div>
<ul><li><b>June 2020</b> first</li><li>second</li><li><strong>May 2021</strong> third</li></ul><h3>Empty</h3></main><footer>f</footer></html>"""


def test_page_chunks():
    got = html.page_chunks(PAGE, "http://u.edu/x/", "T")
    kinds = [c["chunk_type"] for c in got]
    assert kinds == ["table", "faculty_card", "faculty_card", "text", "text", "text"]
    assert got[0]["content"] == "Fees\n\nThe following table shows fees details for T, including the data below:\n\nYear\n1 | 10"
    assert got[1]["content"] == "Faculty\n\nA B Profile: http://u.edu/faculty/a" and got[1]["photo_url"] == "http://u.edu/p.png"
    assert got[2]["content"] == "Faculty\n\nC"
    assert [c["content"] for c in got[3:]] == ["Top\n\nIntro & more", "Fees\n\n* June 2020 first\n* second", "Fees\n\n* May 2021 third"]


def test_page_chunks_of_broken_html():
    assert html.page_chunks(None, "u", "") == []
    assert html.page_chunks("<p>a<p>b</div></b>", "u", "")[0]["content"] == "a b\nb"


# Chunker -------------------------------------------------------------------


def chunked(spark, *documents, lossless=False):
    """Bodies of the chunks of each document, a list of (text, page)."""
    df = spark.createDataFrame([(str(i), "T", d) for i, d in enumerate(documents)], "doc_id string, title string, blocks array<struct<text:string,page:int>>")
    rows = chunking.chunks(df, lossless).collect()
    return [[r.content for r in sorted((r for r in rows if r.doc_id == str(i)), key=lambda r: int(r.chunk_id.split(":")[2]))] for i in range(len(documents))]


def test_merging_and_splitting(spark):
    small, big = "s" * 100, "b" * 1150
    merged, pages, split, cut, fits, table, none = chunked(
        spark, [(small, 1), ("x" * 50, 1)], [(small, 1), (small, 2)], [(small, 1), (big, 1)], [("y" * 1201, 1)], [("y" * 1200, 1)],
        [("Head\n" + "\n".join(f"{i} | {'c' * 80}" for i in range(30)), 3)], [(" \n", 1)],
    )
    assert merged == [f"From T, page 1:\n\n{small}\n\n{'x' * 50}"]
    assert pages == [f"From T, page {p}:\n\n{small}" for p in (1, 2)]
    # A short run takes the next block past the limit, then splits.
    assert split == [f"From T, page 1: (part 1 of 2)\n\n{small}", f"From T, page 1: (part 2 of 2)\n\n{small}\n{big}"]
    assert cut == fits == [f"From T, page 1:\n\n{'y' * 1200}"]
    assert len(table) == 3 and all(t.startswith(f"From T, page 3: (part {i} of 3)\n\nHead\n") for i, t in enumerate(table, start=1))
    assert none == []
    assert chunked(spark, [("y" * 2500, 1)], lossless=True) == [[f"From T, page 1: (part {i} of 3)\n\n{'y' * n}" for i, n in ((1, 1200), (2, 1200), (3, 100))]]


def test_no_piece_exceeds_the_limit_and_none_is_lost(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a", "b c ", "\n", "\n\n", "\n \n", "word" * rng.randrange(400)]) for _ in range(rng.randrange(25))) for _ in range(150)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for lossless in (False, True):
        for r in df.select("text", chunking.split_long(F.col("text"), lossless=lossless).alias("pieces")).collect():
            assert all(len(p) <= 1200 for p in r.pieces)
            if lossless:
                assert "".join("".join(r.pieces).split()) == "".join(r.text.split())


# Spelling ------------------------------------------------------------------


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
@settings(deadline=None)
def test_lcs(a, b):
    assert spelling.lcs(a, b) == _lcs(a, b)


def test_corrections_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    vocab = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(3, 12))) for _ in range(400)} | {"badminton", "adm", "hostel"})
    tokens = sorted({"".join(rng.choice("abcde") for _ in range(rng.randint(5, 12))) for _ in range(300)} | {"badmintan", "hostell"})
    tail = "donaudampfschifffahrt"
    vocab = sorted({*vocab, tail, tail[:-2], "hottentottenpotentat"})
    tokens = sorted({*tokens, tail[1:], tail.replace("dampf", "damf"), tail + "en", "hottentotenpotentat", "x" + tail[:12]})
    v = spark.createDataFrame([(w, 2) for w in vocab], "word string, n long")
    t = spark.createDataFrame([(w,) for w in tokens if w not in vocab], "token string")
    got = {r.token: r.word for r in spelling.correct(t, v).collect()}
    want = {}
    for w in tokens:
        near = [(-200.0 * _lcs(w, x) / (len(w) + len(x)), len(x), x) for x in vocab if abs(len(x) - len(w)) <= 2]
        if w not in vocab and near and -min(near)[0] >= 82:
            want[w] = min(near)[2]
    assert got == want and got["badmintan"] == "badminton"


def test_corrected_keeps_shape(spark):
    q = spark.createDataFrame([(1, "BADMINTAN, Badmintan (badmintan)! ok"), (2, "")], "query_id long, text string")
    fixes = spark.createDataFrame([("badmintan", "badminton", 94.0)], "token string, word string, ratio double")
    got = {r.query_id: r.corrected for r in spelling.corrected(q, fixes).collect()}
    assert got[1] == "BADMINTON, Badminton (badminton)! ok"


# Messages ------------------------------------------------------------------


def _brute_limit(rows, limit, window):
    out, held = {}, {}
    for key, t, i in sorted(rows):
        log = held.setdefault(key, [])
        log[:] = [x for x in log if t - x <= window]
        out[i] = len(log) < limit
        if out[i]:
            log.append(t)
    return out


def test_rate_limit_batch(spark):
    import random

    rng = random.Random(5)
    rows = [(rng.randrange(3), rng.randrange(20_000), i) for i in range(400)]
    rows += [(9, 0, 1000), (9, 3600, 1001), (8, 0, 1002), (8, 3601, 1003)]
    df = spark.createDataFrame(rows, "k long, t long, i long").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.i: r.allowed for r in ms.rate_limited(df, "k", "i", limit=3, window=3600).collect()}
    assert got == _brute_limit(rows, 3, 3600)
    edge = {r.i: r.allowed for r in ms.rate_limited(df, "k", "i", limit=1, window=3600).collect()}
    assert not edge[1001] and edge[1003]  # exactly the window's length still counts


def test_rate_limit_stream_equals_batch(spark, tmp_path):
    import random

    pytest.importorskip("google.protobuf", reason="stateful processors need protobuf")
    rng = random.Random(6)
    rows = sorted(((rng.randrange(3), rng.randrange(20_000), i) for i in range(200)), key=lambda r: r[1])
    for n in range(2):
        pd.DataFrame(rows[n * 100 : n * 100 + 100], columns=["sender", "t", "event_id"]).astype({"t": float}).to_parquet(tmp_path / f"{n}.parquet")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = spark.readStream.schema("sender long, t double, event_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = ms.rate_limited_stream(src, 3, 3600).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.allowed for r in spark.table("limited").collect()}
    assert got == _brute_limit([(k, t, i) for k, t, i in rows], 3, 3600)


def test_stream_dedup(spark, tmp_path):
    pd.DataFrame({"msg_id": ["a", "b", "a"], "ts": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 00:00", "2024-01-01 00:01"])}).to_parquet(tmp_path / "0.parquet", coerce_timestamps="us")
    src = spark.readStream.schema("msg_id string, ts timestamp").parquet(str(tmp_path))
    q = ms.first_of_each_stream(src).writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.msg_id for r in spark.table("firsts").collect()) == ["a", "b"]


def test_admission_order(spark):
    rows = [
        (1, "m1", 7, 0, "text", "hi"), (2, "m1", 7, 1, "text", "hi"), (3, "m2", 7, 2, "image", None), (4, "m3", 7, 3, "text", "  "),
        (5, "m4", 7, 4, "text", "yo"), (6, "m5", 7, 5, "text", "late"), (7, None, 7, 6, "text", "x"), (8, "m6", None, 7, "text", "x"),
    ]
    df = spark.createDataFrame(rows, "ord long, msg_id string, sender long, t long, kind string, body string").withColumn("ts", F.timestamp_seconds("t"))
    got = {r.ord: r.outcome for r in ms.admission(df, limit=3).collect()}
    assert got == {1: "answer", 2: "duplicate", 3: "notice", 4: "blank", 5: "answer", 6: "limited", 7: "skip", 8: "skip"}


# Text ----------------------------------------------------------------------


def test_markup(spark):
    t = "# Head\n**Bold** and *it* [1]\n\n\n\n- a [s](https://x.y)\n`c`"
    df = spark.createDataFrame([(t, ["u1", "u2"], "medium", False), (t, ["u1"], "high", True), ("z" * 5000, [], "high", False)], "t string, s array<string>, b string, d boolean")
    a, b, c = [r[0] for r in df.select(tx.markup(F.col("t"), F.col("s"), F.col("b"), F.col("d"))).collect()]
    assert a.startswith("_Head_\n*Bold* and _it_\n\n• a s (https://x.y)\n```c```\n\n_This one") and a.endswith("*Sources:*\nu1\nu2")
    assert "Source" not in b
    assert c == "z" * 4076 + "\n\n…(truncated)"


def test_sources(spark, tmp_path):
    from tidemill.sources import files

    (tmp_path / "a.html").write_text("<p>x</p>")
    (tmp_path / "a.meta.json").write_text('{"url": "http://u", "title": "T"}')
    (tmp_path / "b.html").write_text("no meta")
    assert [tuple(r) for r in files.read_saved_pages(spark, str(tmp_path)).collect()] == [("http://u", "T", "<p>x</p>")]
    (tmp_path / "seeds.json").write_text('["http://a", "http://b", "http://a"]')
    assert sorted(r.url for r in files.read_seeds(spark, str(tmp_path / "seeds.json")).collect()) == ["http://a", "http://b"]
    (tmp_path / "reg.json").write_text('{"d": {"doc_id": "d", "chunks": 3}}')
    assert files.read_registry(spark, str(tmp_path / "reg.json")).first().chunks == 3
    (tmp_path / "bad.json").write_text("{")
    assert files.read_registry(spark, str(tmp_path / "bad.json")).count() == 0
    assert files.read_registry(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "t").mkdir()
    (tmp_path / "t/x.md").write_text("one\n\n two  three\n\n\n")
    assert [(r.pos, r.text) for r in files.read_blocks(spark, str(tmp_path / "t")).orderBy("pos").collect()] == [(0, "one"), (1, "two three")]
    assert files.prose_or_tables("p" * 12, ["t" * 10]) == [("t" * 10, "table")]
    assert math.isclose(len(files.prose_or_tables("p" * 13, ["t" * 10])), 2)


# Guards and schedules ------------------------------------------------------


@pytest.mark.parametrize("secret", ["k", "x" * 64, "long key " * 20, "ключ"])
def test_hmac_equals_the_library(spark, secret):
    import hashlib
    import hmac

    bodies = ["", "{}", "body é 日本 😀", "z" * 1000]
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    got = [r[0] for r in df.select(tx.hmac_sha256(F.col("b"), secret)).collect()]
    assert got == [hmac.new(secret.encode(), b.encode(), hashlib.sha256).hexdigest() for b in bodies]


def test_signatures_fail_closed(spark):
    df = spark.createDataFrame([("b", None), (None, "sha256="), ("b", "")], "b string, h string")
    for secret in (None, "", "k"):
        assert [r[0] for r in df.select(tx.signed(F.col("b"), F.col("h"), secret)).collect()] == [False] * 3


def test_bounds_and_weekly_runs(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("ab",), ("a" * 500,), ("a" * 501,)], "q string")
    assert [r[0] for r in df.select(tx.within_bounds(F.col("q"))).collect()] == [False, False, False, True, True, False]
    at = ["2024-01-06 21:29:59", "2024-01-06 21:30:00", "2024-01-06 21:30:01", "2024-01-08 00:00:00"]
    runs = spark.createDataFrame([(t,) for t in at], "t string").select(tx.next_weekly(F.col("t").cast("timestamp")).cast("string"))
    assert [r[0] for r in runs.collect()] == ["2024-01-06 21:30:00"] * 2 + ["2024-01-13 21:30:00"] * 2


def test_lossless_chunks_hold_the_whole_of_long_lines(spark):
    line = "".join(chr(97 + i % 26) + str(i) for i in range(1500))
    df = spark.createDataFrame([(line,), (f"head\n{line}\ntail",)], "text string")
    one, two = (r.pieces for r in df.select(chunking.split_long(F.col("text"), lossless=True).alias("pieces")).collect())
    assert one == [line[i : i + 1200] for i in range(0, len(line), 1200)]
    assert "".join(two).replace("\n", "") == f"head{line}tail"
    (bodies,) = chunked(spark, [(line, 1)], lossless=True)
    assert "".join(b.split("\n\n", 1)[1] for b in bodies) == line


def test_document_chunks_keep_every_long_line(spark, sf_dir):
    from tests.oracle import duck
    from tidemill.plans.catalogue import QUERIES

    held: dict[str, str] = {}
    for r in QUERIES["document_chunks"](spark, sf_dir).orderBy(F.split("chunk_id", ":")[2].cast("int")).collect():
        held[r.doc_id] = held.get(r.doc_id, "") + r.content.split("\n\n", 1)[1]
    flat = lambda t: "".join(t.split())
    rows = duck(sf_dir).execute("SELECT doc_id, text FROM documents WHERE len(text) > 1200 AND NOT contains(text, chr(10))").fetchall()
    assert rows and all(flat(text) in flat(held[str(i)]) for i, text in rows)


def test_language_coverage_counts_every_document(spark, sf_dir):
    from tests.oracle import duck
    from tidemill.plans.catalogue import QUERIES

    total, langs = duck(sf_dir).execute("SELECT count(*), count(DISTINCT lang) FROM documents WHERE coalesce(lang, '') <> ''").fetchone()
    got = QUERIES["language_coverage"](spark, sf_dir).collect()
    assert sum(r.heads for r in got) == total and len(got) == langs


# Office files --------------------------------------------------------------

_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def office_file(path, parts):
    import zipfile

    with zipfile.ZipFile(path, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)


def links(**targets):
    rows = "".join(f'<Relationship Id="{i}" Type="{_REL}/{kind}" Target="{t}"/>' for i, (kind, t) in targets.items())
    return f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rows}</Relationships>'


def test_office_blocks(spark, tmp_path):
    from tidemill.sources import files

    w, a = 'xmlns:w="w"', f'xmlns:a="a" xmlns:p="p" xmlns:r="{_REL}"'
    cell = lambda *ps: "<w:tc>" + "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in ps) + "</w:tc>"
    table = f"<w:tbl><w:tr>{cell('Year')}{cell('')}</w:tr><w:tr>{cell('1')}{cell('two', 'lines')}</w:tr><w:tr>{cell(' ')}</w:tr></w:tbl>"
    paragraphs = "<w:p><w:r><w:t>One</w:t><w:tab/><w:t>more</w:t></w:r></w:p><w:p/>" + table + "<w:p><w:r><w:t>Two</w:t></w:r></w:p>"
    office_file(tmp_path / "d.docx", {"word/document.xml": f"<w:document {w}><w:body>{paragraphs}</w:body></w:document>"})

    shape = lambda t: f"<p:sp><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>"
    notes = f'<p:notes {a}><p:sp><p:nvPr><p:ph type="sldNum"/></p:nvPr><a:p><a:r><a:t>7</a:t></a:r></a:p></p:sp><p:sp><p:nvPr><p:ph type="body"/></p:nvPr><a:p><a:r><a:t>say it</a:t></a:r></a:p></p:sp></p:notes>'
    grid = "<p:graphicFrame><a:tbl><a:tr><a:tc><a:p><a:r><a:t>x</a:t></a:r></a:p></a:tc><a:tc><a:p><a:r><a:t>y</a:t></a:r></a:p></a:tc></a:tr></a:tbl></p:graphicFrame>"
    office_file(
        tmp_path / "s.pptx",
        {
            "ppt/presentation.xml": f'<p:presentation {a}><p:sldIdLst><p:sldId r:id="r2"/><p:sldId r:id="r1"/><p:sldId r:id="r3"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": links(r1=("slide", "slides/slide1.xml"), r2=("slide", "/ppt/slides/slide2.xml"), r3=("slide", "slides/slide3.xml")),
            "ppt/slides/slide1.xml": f"<p:sld {a}>{shape('Title')}{grid}</p:sld>",
            "ppt/slides/_rels/slide1.xml.rels": links(n=("notesSlide", "../notesSlides/n1.xml")),
            "ppt/notesSlides/n1.xml": notes,
            "ppt/slides/slide2.xml": f"<p:sld {a}>{shape('First')}</p:sld>",
            "ppt/slides/slide3.xml": f"<p:sld {a}/>",
        },
    )
    rows = '<row><c t="s"><v>1</v></c><c><v>2.5</v></c><c t="b"><v>1</v></c></row><row><c/></row><row><c t="inlineStr"><is><t>in</t></is></c><c t="str"><f>A1</f><v>9:00</v></c></row>'
    office_file(
        tmp_path / "t.XLSX",
        {
            "xl/workbook.xml": f'<workbook xmlns:r="{_REL}"><sheets><sheet name="Empty" r:id="a"/><sheet name="Times" r:id="b"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": links(a=("worksheet", "worksheets/sheet1.xml"), b=("worksheet", "worksheets/other.xml")),
            "xl/sharedStrings.xml": "<sst><si><t>zero</t></si><si><r><t>sh</t></r><r><t>ared</t></r></si></sst>",
            "xl/worksheets/sheet1.xml": "<worksheet><sheetData/></worksheet>",
            "xl/worksheets/other.xml": f"<worksheet><sheetData>{rows}</sheetData></worksheet>",
        },
    )
    got = {(r.path.rsplit("/", 1)[1], r.pos): (r.text, r.page, r.kind) for r in files.read_blocks(spark, str(tmp_path)).collect()}
    assert got == {
        ("d.docx", 0): ("One more\nTwo", 1, "text"),
        ("d.docx", 1): ("Year\n1 | two lines", 1, "table"),
        ("s.pptx", 0): ("First", 1, "slide"),
        ("s.pptx", 1): ("Title\nx | y\nSpeaker notes: say it", 2, "slide"),
        ("t.XLSX", 0): ("Sheet: Times\nshared | 2.5 | True\nin | 9:00", 2, "sheet"),
    }


# Models and routes ---------------------------------------------------------


def test_models_are_asked_in_turn():
    from tidemill.operators import generation

    asked = []

    def first(x):
        asked.append(("first", x))
        return [None if v < 3 else f" {v} " for v in x]

    def broken(x):
        raise OSError

    def last(x):
        asked.append(("last", x))
        return [None if v == 0 else "last" for v in x]

    out = generation.in_turn([("f", first), ("b", broken), ("l", last)])([0, 1, 5])
    assert out == [{"text": None, "model": None, "failures": 1}, {"text": "last", "model": "l", "failures": 1}, {"text": "5", "model": "f", "failures": 0}]
    assert asked == [("first", [0, 1, 5]), ("last", [0, 1])]


def test_every_route_is_taken(spark, sf_dir):
    from tidemill.plans.catalogue import QUERIES

    routes = {r.route for r in QUERIES["routed_pools"](spark, sf_dir).select("route").distinct().collect()}
    assert {None, "department_heads", "principal_engineering", "principal_computing"} <= routes and any(r and r.startswith("faculty_") for r in routes)


def test_a_department_without_a_head_goes_to_its_principal(spark):
    from tidemill.operators import routing

    chunks = [
        (1, [1.0, 0.0], "principal", "", None, False), (2, [0.6, 0.8], "head_of_department", "ece", "electronics and communication", True),
        (3, [0.0, 1.0], "professor", "", "electronics and communication", False), (4, [0.5, 0.5], "", None, None, False),
    ]
    c = spark.createDataFrame(chunks, "vec_id long, embedding array<double>, designation string, department string, department_canon string, is_department_head boolean")
    texts = ["Who is the HOD of ECE?", "Who is the HOD of chemistry?", "who is the hod", "principal?", "staff in ece", "staff in physics", None]
    q = spark.createDataFrame([(-1 - i, [1.0, 0.0], t) for i, t in enumerate(texts)], "query_id long, vector array<double>, text string")
    got = {}
    for r in routing.routed_pools(q, c).orderBy("query_id", "pos").collect():
        got.setdefault(-1 - r.query_id, []).append((r.vec_id, r.route, r.filtered, r.rerank_text))
    assert got[0] == [(2, "department_heads", True, texts[0])]
    assert got[1] == [(1, "principal_engineering", True, f"{texts[1]} School of Engineering")]
    assert got[3] == [(1, "principal_engineering", True, "principal? School of Engineering")]
    assert [x[:2] for x in got[4]] == [(2, "faculty_electronics and communication"), (3, "faculty_electronics and communication")]
    for plain in (2, 5, 6):
        assert [x[0] for x in got[plain]] == [1, 4, 2, 3] and {x[1:3] for x in got[plain]} == {(None, False)}
    assert routing.routed_pools(q, c.where("designation <> 'principal'")).where("query_id = -2").select("route").distinct().collect()[0].route is None
    assert routing.routed_pools(q.limit(0), c).count() == 0


def test_listing_departments_skip_own_names(spark):
    urls = [("http://u/oakfield/physics/faculty/",), ("http://u/physics/oakfield/faculty/",), ("http://u/school/faculty",)]
    df = spark.createDataFrame(urls, "url string")
    assert [r.d for r in df.select(tx.listing_department(F.col("url"), ["oakfield"]).alias("d")).collect()] == ["physics", "physics", None]


def test_places_over_many_ranges(spark):
    import random

    from tidemill.operators import ranking

    rows = [(random.Random(i).randrange(5), i) for i in range(300)] + [(2, 7)] * 3 + [(None, 1)]
    df = spark.createDataFrame(rows, "v int, id int")
    got = sorted((r.place, r.v, r.id) for r in ranking.places(df, F.desc_nulls_last("v"), F.asc("id")).collect())
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [g[0] for g in got] == list(range(1, 305)) and [g[1:] for g in got] == want
    assert ranking.places(df.limit(0), F.asc("id")).count() == 0


def test_only_rows_that_fail_are_lost(spark):
    from tidemill.operators import generation

    def model(texts):
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return [t.upper() for t in texts]

    df = spark.createDataFrame([(i, "bad" if i % 10 == 3 else None if i == 5 else f"t{i}") for i in range(40)], "id long, text string").withColumn("ask", F.col("text").isNotNull())
    got = {r.id: (r.out, r.error) for r in generation.with_model(df, model, "text", "out", where="ask", budget=40, errors="error").collect()}
    assert got == {i: (None, "ValueError: no") if i % 10 == 3 else (None, None) if i == 5 else (f"T{i}", None) for i in range(40)}
    with pytest.raises(Exception, match="no"):
        generation.with_model(df.where("ask"), model, "text", "out").collect()


def test_groups_of_like_length_waste_little(spark, sf_dir):
    from tidemill.operators import generation

    lengths = [len(r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    groups = generation.by_length(lengths, 64, 100_000)
    assert sorted(i for g in groups for i in g) == list(range(len(lengths)))
    padded = sum(len(g) * max(lengths[i] for i in g) for g in groups)
    assert padded <= generation.WASTE * sum(lengths) and all(len(g) <= 64 and (len(g) == 1 or len(g) * max(lengths[i] for i in g) <= 100_000) for g in groups)
    assert generation.by_length([3, 1, 2], 2, None) == [[0, 1], [2]]


def test_pages_of_mixed_content_keep_prose_or_tables(spark, tmp_path, monkeypatch):
    from tidemill.sources import files

    monkeypatch.setattr(files, "PARSERS", dict(files.PARSERS))

    @files.page_parser(".pdf")
    def pages(data):
        table = [["01-Jul", "Wed\n(a)"], [None, ""], ["02-Jul", None]]
        return [("01-Jul Wed (a) 02-Jul", [table]), ("long   prose " * 10, [table, [[None]]]), (None, [table]), ("only\xa0prose", []), ("", [])]

    (tmp_path / "a.pdf").write_bytes(b"x")
    got = sorted((r.pos, r.text, r.page, r.kind) for r in files.read_blocks(spark, str(tmp_path)).collect())
    rows = "01-Jul | Wed (a)\n02-Jul"
    assert got == [(0, rows, 1, "table"), (1, rows, 2, "table"), (2, ("long prose " * 10).strip(), 2, "text"), (3, rows, 3, "table"), (4, "only prose", 4, "text")]


def test_registries_and_seeds_are_written_in_parts(spark, tmp_path, monkeypatch):
    from tidemill.sources import files

    monkeypatch.setattr(files, "AT_ONCE", 10)
    rows = [(f"d{i}", "t", None, i, 1, None) for i in range(45)]
    schema = "doc_id string, title string, filename string, chunks int, pages int, uploaded_at string"
    files.write_registry(spark.createDataFrame(rows, schema), str(tmp_path / "r"))
    assert len(list((tmp_path / "r").glob("part-*.txt"))) > 1
    assert sorted(map(tuple, files.read_registry(spark, str(tmp_path / "r")).collect()), key=repr) == sorted(rows, key=repr)
    files.write_registry(spark.createDataFrame([], schema), str(tmp_path / "r"))
    assert files.read_registry(spark, str(tmp_path / "r")).count() == 0
    files.write_seeds(spark.createDataFrame([(f"u{i}",) for i in range(45)], "url string"), str(tmp_path / "s"))
    assert sorted(r.url for r in files.read_seeds(spark, str(tmp_path / "s")).collect()) == sorted(f"u{i}" for i in range(45))


def test_many_centroids_meet_queries_in_shares(spark, monkeypatch):
    from tidemill.operators import retrieval

    rng = random.Random(4)
    vector = lambda: [rng.random() for _ in range(4)]
    q = spark.createDataFrame([(i, vector()) for i in range(30)], "query_id long, vector array<double>")
    c = spark.createDataFrame([(i, vector()) for i in range(50)] + [(60, [2.0] * 4), (61, [2.0] * 4)], "category long, centroid array<double>")
    few = sorted(map(tuple, retrieval.nearest_centroid(q, c).collect()))
    monkeypatch.setattr(retrieval, "FEW_CENTROIDS", 0)
    assert sorted(map(tuple, retrieval.nearest_centroid(q, c).collect())) == few and {x[1] for x in few} == {60}
