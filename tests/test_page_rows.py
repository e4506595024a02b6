"""Pages as rows against the page parser, on odd pages and on all pages of the table."""

import random

import pyarrow as pa

from tests.test_known import KNOWN_PAGE
from tidemill.functions import html
from tidemill.operators import page_rows
from tidemill.plans import corpus

SCHEMA = "url string, title string, html string"
ODD = [
    KNOWN_PAGE, "<p>a<p>b</div></b>", None, "", "no element at all",
    "<table><tr><td>x<table><tr><td>in</td><td> </td></tr></table></td><th>y</th></tr></table><div class=fc-item><div class=fc-item>q<img src=a.png></div><table><tr><td>t</td></tr></table></div>"
    "<div class=fc-item><h2> </h2></div><p>after</p><h3>H<script>s</script></h3><ul><li><b>May 2020</b></li><li>x<p>y</p></li></ul><script>z</script><div class='fac-inner-left'><img src='//h/p.jpg'></div>",
    "<h1>Out</h1><article><h2></h2><p>one</p><h2>Two</h2><table><tr><td>a</td></tr><tr></tr></table><li>b</li></article><article><p>second</p></article><img class='wp-post-image' src='x.png'>",
    "<main><nav><p>gone</p><table><tr><td>gone</td></tr></table></nav><table><td>no row</td></table><p>kept</p></main>",
    "<div id=content><a class=fc-item href='javascript:x'>C<img></a><li><strong>June 2021</strong></li><li></li><p> </p><h4>End</h4></div>",
]


def chunks(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_rows_equal_the_parser_on_odd_pages(spark):
    rng = random.Random(3)
    bits = ["<p>", "</p>", "<li>", "<b>", "</b>", "May 2020", "word", "<h2>", "</h2>", "<table>", "<tr>", "<td>", "</table>", "<div class=fc-item>", "</div>", "<main>", "<nav>", "</nav>", "<a href=/f>", "<img src=i.png>", "<br>", " "]
    made = ["".join(rng.choice(bits) for _ in range(rng.randrange(5, 60))) for _ in range(120)]
    rows = [(f"http://u.edu/{i}", None if i % 9 == 8 else "T", h) for i, h in enumerate([*ODD, *made])] + [(None, "T", "<p>x</p>"), ("http://u.edu/1", "T", "<p>same url</p>")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert chunks(page_rows.extract(df, ["oakfield"])) == chunks(html.extract(df, ["oakfield"]))
    assert page_rows.extract(df.limit(0)).count() == 0


def test_rows_equal_the_parser_on_all_pages(spark, sf_dir):
    df = corpus._pages(spark, sf_dir)
    got = chunks(page_rows.extract(df))
    assert got == chunks(html.extract(df)) and got


def test_intervals_nest(spark):
    found = list(page_rows.nodes(1, "http://u", "T", KNOWN_PAGE, frozenset()))
    assert [r[3] for r in found] == list(range(len(found)))
    for r in found:
        assert all(found[a][3] < r[3] and r[4] <= found[a][4] for a, _ in r[14]) and r[4] >= r[3]


def test_rows_are_shuffled_once(spark):
    rows = [("http://u.edu/1", "T", KNOWN_PAGE)] * 3 + [("http://u.edu/2", None, KNOWN_PAGE)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    out = page_rows.extract(df, ["oakfield"])
    assert chunks(out) == chunks(html.extract(df, ["oakfield"])), "equal pages are pages of their own"
    plan = page_rows.extract(spark.createDataFrame(rows, SCHEMA), ["oakfield"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_nodes_of_many_pages_are_given_back_together():
    pages = [{"page": i, "copy": i, "url": f"http://u.edu/{i}", "title": None if i % 3 else "T", "html": ODD[i % len(ODD)]} for i in range(400)]
    batch = pa.RecordBatch.from_pylist(pages, pa.schema([("page", pa.int64()), ("copy", pa.int64()), ("url", pa.string()), ("title", pa.string()), ("html", pa.string())]))
    found = list(page_rows._numbered(frozenset())(iter([batch, batch.slice(0, 1), batch.slice(0, 0)])))
    assert len(found) <= 2 + sum(b.num_rows for b in found) // page_rows.AT_ONCE
    rows = [r for b in found[:-1] for r in b.to_pylist()]
    for p in pages:
        want = [(r[3], r[4], r[5], r[6]) for r in page_rows.nodes(0, p["url"], "", p["html"], frozenset())]
        own = [r for r in rows if r["page"] == p["page"]]
        assert [(r["pre"], r["post"], r["name"], r["text"]) for r in own] == want
        assert [r["url"] for r in own] == [p["url"]] + [None] * (len(own) - 1)
