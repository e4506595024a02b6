"""Known inputs with known results: people, a page, spellings, messages, departments, ids, confidences."""

import pytest
from pyspark.sql import functions as F

from tidemill.functions import html as pages
from tidemill.functions import roles, rules
from tidemill.functions import text as tx
from tidemill.operators import scoring, spelling, sync
from tidemill.sources.files import file_kind

_OWN = ["oakfield"]
_ECE = "electronics and communication"
PERSONS = [
    # label, url, kind, text; designation, as written, all designations, head, department
    ("hod", "http://u/faculty/a", "text", "Dr. A. Rao HOD, Department of Electronics and Communication, School of Engineering, Bengaluru | Professor, Department of Electronics and Communication", ("head_of_department", "HOD", "head_of_department|professor", True, _ECE)),
    ("card", "http://u/faculty/a", "faculty_card", "Faculty Dr. A. Rao HOD Department of Electronics and Communication School of Engineering Bengaluru Professor Profile: http://u/faculty/a", ("head_of_department", "HOD", "head_of_department|professor", True, _ECE)),
    ("deputy", "http://u/faculty/b", "text", "Dr. B. Iyer Vice-Chairperson, Electronics and Communication Engineering, School of Engineering | Assistant Professor (Sl. Gd.), Electronics and Communication Engineering", ("deputy_head", "Vice-Chairperson", "assistant_professor|deputy_head", False, _ECE)),
    ("eee", "http://u/faculty/c", "text", "Dr. C. Nair Chairperson, Department of Electrical and Electronics Engineering, School of Engineering", ("head_of_department", "Chairperson", "head_of_department", True, "electrical and electronics")),
    ("own name", "http://u/faculty/d", "text", "Dr. D. Pai Professor, Department of Physics Oakfield Campus", ("professor", "Professor", "professor", False, "physics")),
    ("no address", "http://u/faculty/e", "text", "Achievements of a group on health. Chairperson of the group.", ("", "", "", False, "")),
    ("no person", "http://u/library", "text", "Dr. F. Shah Chairperson of the grievances box", ("", "", "", False, "")),
    ("late", "http://u/faculty/g", "text", "Dr. G. Das Professor, School of Computing " + "x " * 80 + "chairperson of something", ("professor", "Professor", "professor", False, "")),
    ("title only", "http://u/faculty/h", "faculty_card", "Faculty Dr. H. Roy Chairperson Head of Department Professor Profile: http://u/faculty/h", ("head_of_department", "Chairperson", "head_of_department|professor", True, "")),
    ("nothing", "http://u/faculty/i", "text", None, ("", "", "", False, "")),
]



def test_known_persons(spark):
    df = spark.createDataFrame([p[:4] for p in PERSONS], "label string, url string, kind string, text string")
    got = {r.label: (r.designation, r.designation_raw, r.designations_all, r.is_department_head, r.department) for r in roles.metadata(df, "text", "url", "kind", _OWN).collect()}
    assert got == {p[0]: p[4] for p in PERSONS}


KNOWN_PAGE = """<html><nav>menu</nav><div class="breadcrumb">x</div><div id="why-oakfield-sec">choose us</div><main><h1>Top</h1><p>Intro &amp; more</p>
<h2>Fees</h2><table><tr><th>Year</th><th></th></tr><tr><td>1</td><td>10
</td></tr><tr><td></td></tr></table><table><tr><td> </td></tr></table>
<div class="fc-item"><img src="/p.png"><a href="/faculty/a">Dr. A  Rao HOD Department of Physics</a></div><div class="fc-item"><a href="mailto:x">C</a></div>
<ul><li><b>June 2020</b> first</li><li>second</li><li><strong>May 2021</strong> third</li></ul><h3>Empty</h3></main><footer>f</footer></html>"""
_LISTING = "http://u.edu/bengaluru/physics/faculty/"
KNOWN_CHUNKS = [
    # kind, heading, content, photo, profile, designation, department
    ("table", "Fees", "Fees\n\nThe following table shows fees details for T, including the data below:\n\nYear\n1 | 10", "", "", "", ""),
    ("faculty_card", "Faculty", "Faculty\n\nDr. A Rao HOD Department of Physics Profile: http://u.edu/faculty/a", "http://u.edu/p.png", "http://u.edu/faculty/a", "head_of_department", "physics"),
    ("faculty_card", "Faculty", "Faculty\n\nC", "", "", "", ""),
    ("text", "Top", "Top\n\nIntro & more", "", "", "", ""),
    ("text", "Fees", "Fees\n\n* June 2020 first\n* second", "", "", "", ""),
    ("text", "Fees", "Fees\n\n* May 2021 third", "", "", "", ""),
]



def known_page(spark):
    return pages.extract(spark.createDataFrame([(_LISTING, "T", KNOWN_PAGE), ("http://u.edu/none", "N", None)], "url string, title string, html string"), _OWN)


def test_known_page(spark):
    got = sorted((r.chunk_type, r.heading, r.content, r.photo_url, r.profile_url, r.designation, r.department) for r in known_page(spark).collect())
    assert got == sorted(KNOWN_CHUNKS)
    edges = sync.department_edges(sync.card_listings(known_page(spark), _OWN)).collect()
    assert sorted(map(tuple, edges)) == sorted([("http://u.edu/faculty/a", "physics"), (_LISTING, "physics")])


_VOCABULARY = ["department", "electronics", "communication", "faculty", "placement", "hostel", "scholarship", "the", "who"]
SPELLED = [("who is in the deparment", "who is in the department"), ("electroncs facultty", "electronics faculty"), ("schlarship and hostel", "scholarship and hostel"), ("zzzzqqq", "zzzzqqq"), ("", "")]



def test_known_spelling(spark):
    q = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(SPELLED)], "query_id int, text string")
    v = spark.createDataFrame([(w, 5) for w in _VOCABULARY], "word string, n int")
    got = {r.query_id: r.corrected for r in spelling.corrected(q, spelling.correct(spelling.unknown(q, v), v)).collect()}
    assert got == {i: c for i, (_, c) in enumerate(SPELLED)}


MARKED = [
    # answer, sources, band, message
    ("# Fees\n\n**Bold** and *it* [1]\n- a\n* b", ["http://x"], "high", "_Fees_\n\n*Bold* and _it_\n• a\n• b\n\n*Source:*\nhttp://x"),
    ("See [site](https://x.y) and `c`", [], "high", "See site (https://x.y) and ```c```"),
    ("Fine", ["a", "b", "c", "d"], "medium", "Fine\n\n_This one I'm less sure about — worth confirming._\n\n*Sources:*\na\nb\nc"),
    ("I don't have that information.", ["a"], "medium", "I don't have that information."),
    ("a\n\n\n\n\nb", [], "low", "a\n\nb"),
]



def test_known_markup(spark):
    df = spark.createDataFrame([m[:3] for m in MARKED], "answer string, sources array<string>, band string")
    got = [r[0] for r in df.select(tx.markup(F.col("answer"), F.col("sources"), F.col("band"), tx.declined(F.col("answer")))).collect()]
    assert got == [m[3] for m in MARKED]


@pytest.mark.parametrize(("golden", "profile"), [("GOLDEN", "web"), ("GOLDEN_UPLOAD", "upload")])
def test_golden_pools_against_plain_formulas(spark, golden, profile):
    import math

    from tests import golden as g

    vectors, p = getattr(g, golden), rules.PROFILES[profile]
    rows = [(k, i, s) for k, v in vectors.items() for i, s in enumerate(v, 1)]
    found = scoring.signals(spark.createDataFrame(rows, "q string, pos int, score double"), ["q"], rules.TOP_K, profile)
    got = {r.q: r for r in scoring.confidence(found, F.lit(False), F.lit(0.6), profile).collect()}
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    for k, v in vectors.items():
        rest = v[rules.TOP_K :] or v[1:]
        a = sigmoid((max(v) - p["abs_mid"]) / p["abs_temp"])
        s = sigmoid((math.log10((v[0] + 1e-4) / (sum(rest) / len(rest) + 1e-4)) - p["sep_mid"]) / p["sep_temp"]) if p["use_sep"] and rest else 0.0
        final = (max(a, s) if p["use_sep"] else a) * (0.7 + 0.3 * 0.6)
        assert got[k]["final"] == pytest.approx(final, rel=1e-9) and got[k]["band"] == ("high" if final >= 0.7 else "medium" if final >= 0.35 else "low")


def test_departments_match(spark):
    names = [*rules.DEPARTMENT_SCHOOL, "", None]
    df = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    canon = lambda d: rules.DEPARTMENT_ALIASES.get(d, d)
    for r in df.select("a", "b", tx.departments_match(F.col("a"), F.col("b")).alias("same")).collect():
        x, y = canon(r.a), canon(r.b)
        assert r.same == bool(r.a and r.b and (x == y or x in y or y in x))


def test_file_kinds(spark):
    df = spark.createDataFrame([("a.PDF",), ("b.md",), ("c.tar.gz",), ("d",), ("e.xlsx",), ("x.y/f",)], "path string")
    assert [r[0] for r in df.select(file_kind(F.col("path"))).collect()] == [".pdf", ".md", None, None, ".xlsx", None]
