"""Pages as rows: every element and text of a page with its interval, so that the page's structure is windows.

A parser flattens each page once: `pre` is a node's place in document order and `post` the
place of the last node below it. What lies below a node is between its pre and post, so
"inside noise, a table or a card" is a running maximum of posts over the rows in order, the
heading of a row is the last one before it, and sections are runs between boundaries. As a
page's places are dense, the nodes below an element are a slice of the page's nodes in order,
and texts meet the elements that hold them without a join. Chunks are those of
functions.html.page_chunks, row by row.

A page is one group of rows by its nature. Rows are dealt over the tasks by page once; every
window and group below keeps to a page, so that nothing is shuffled, or written, again.

Edge cases: a page without html has no nodes and no chunks; repeated urls are told apart by
their html, and wholly equal rows by their place in the input; equal chunks of a page are one,
the last; nested tables, rows and cards count for each that holds them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from tidemill.functions import html, roles, rules

NODE = "page long, copy long, url string, title string, pre int, post int, name string, text string, noise boolean, content boolean, card boolean, portrait_class boolean, portrait_side boolean, src string, href string"
#: Nodes of whole pages that a worker gives back together.
AT_ONCE = 4096
HEADINGS = ("h1", "h2", "h3", "h4")
ENTRY = rf"^\s*(?:{'|'.join(rules.MONTHS)})\s+\d{{4}}"


def nodes(page: int, url: str, title: str, text: str | None, ids: frozenset[str]) -> Iterator[tuple]:
    """The rows of one page. src and href are full urls; empty if they are no web addresses, null if there are none."""
    out: list[list] = []

    def web(n: html.Node, attr: str) -> str | None:
        return html._web(url, n.attrs[attr]) if attr in n.attrs else None

    stack: list[tuple] = [(html.parse(text or ""), [])]
    while stack:
        n, up = stack.pop()
        if n is None:  # all below the node has been numbered
            out[up][4] = len(out) - 1
            continue
        pre = len(out)
        if isinstance(n, str):
            out.append([page, url, title, pre, pre, "#text", n.strip(), False, False, False, False, False, None, None, up])
            continue
        classes = n.classes()
        out.append([page, url, title, pre, pre, n.name, None, html._noise(n, ids), "content" in classes or n.attrs.get("id") == "content", "fc-item" in classes, "wp-post-image" in classes, "fac-inner-left" in classes, web(n, "src"), web(n, "href"), up])
        stack.append((None, pre))
        below = [*up, (pre, n.name)]
        stack += [(c, below) for c in reversed(n.children)]
    return map(tuple, out)


def _numbered(ids: frozenset[str]) -> Callable:
    """Pages to the nodes of many pages at once: a table a page costs more than parsing it."""
    kinds = to_arrow_schema(_parse_datatype_string(NODE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for at, (page, copy, url, title, text) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True), 1):
                for row in nodes(page, url or "", title or "", text, ids):
                    named = row[1:3] if row[3] == 0 else (None, None)
                    found.append((page, copy, *named, *row[3:-1]))
                if len(found) >= AT_ONCE or at == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds.types, strict=True)], kinds.names)
                    found = []

    return run


def flattened(pages: DataFrame, own_names: Sequence[str] = ()) -> DataFrame:
    """The nodes of all pages, dealt over the tasks by page; url and title are with a page's root only."""
    ids = frozenset([*rules.NOISE_IDS, *(f"why-{name}-sec" for name in own_names)])
    keyed = pages.select(F.xxhash64("url", "title", "html").alias("page"), F.monotonically_increasing_id().alias("copy"), "url", "title", "html")
    return keyed.mapInArrow(_numbered(ids), NODE).repartition("page")


#: A page's rows; `page` alone says which task has them, whatever number a copy is given.
PAGE = ("page", "copy")


def up_to(offset: int) -> WindowSpec:
    """The rows of a page up to this one (0) or before it (-1)."""
    return Window.partitionBy(*PAGE).orderBy("pre").rowsBetween(Window.unboundedPreceding, offset)


def inside(kind: Column, itself: bool = True) -> Column:
    """Whether a row lies in (or is) a node of the kind: one that began before has not ended yet."""
    return F.coalesce(F.max(F.when(kind, F.col("post"))).over(up_to(0 if itself else -1)) >= F.col("pre"), F.lit(False))


def marked(rows: DataFrame) -> DataFrame:
    """What a page's rows are and lie in; those in noise lose their name and text, but keep their place."""
    name = F.col("name")
    rows = rows.withColumn("gone", inside(F.col("noise")))
    rows = rows.withColumns({"name": F.when(F.col("gone"), "").otherwise(name), "text": F.when(~F.col("gone"), F.nullif("text", F.lit("")))})
    rows = rows.withColumns({c: F.col(c) & ~F.col("gone") for c in ("content", "card")})
    rows = rows.withColumn("silent", inside(name.isin(*html.SILENT), itself=False))
    main = (name.isin("main", "article") | F.col("content")) & (name != "#text")
    rows = rows.withColumn("body", F.min(F.when(main, F.struct("pre", "post"))).over(Window.partitionBy(*PAGE)))
    portrait = (name == "img") & F.col("src").isNotNull() & (F.col("portrait_class") | inside(F.col("portrait_side"), itself=False))
    rows = rows.withColumn("portrait", F.when(portrait, F.struct("pre", "src")))
    in_body = F.col("body").isNull() | ((F.col("pre") > F.col("body.pre")) & (F.col("pre") <= F.col("body.post")))
    rows = rows.withColumn("in_body", in_body & (F.col("pre") > 0)).drop("body")
    rows = rows.withColumn("in_table", inside((name == "table") & F.col("in_body")))
    rows = rows.withColumn("card", F.col("card") & F.col("in_body") & ~F.col("in_table"))
    outer = F.last(F.when(F.col("card") & ~inside(F.col("card"), itself=False), F.struct("pre", "post")), ignorenulls=True).over(up_to(0))
    rows = rows.withColumn("outer", outer)
    rows = rows.withColumn("outer", F.when(F.col("outer.post") >= F.col("pre"), F.col("outer")))  # the outermost card around a row
    above = F.last(F.when(name.isin(*HEADINGS), F.struct("pre", "post")), ignorenulls=True).over(up_to(-1))
    rows = rows.withColumns({"text": F.when(~F.col("silent"), F.col("text")), "above": F.when(name == "table", above)})
    rows = rows.withColumn("loose", F.when(~F.col("in_table"), F.col("text")))  # a text outside tables
    rows = rows.withColumn("plain", F.when(F.col("in_body") & F.col("outer").isNull(), F.col("loose")))  # and cards: a card that holds a text is one with a text
    return rows.withColumn("said", F.count("loose").over(up_to(0)))


def _below(n: Column) -> Column:
    return F.slice("nodes", n["pre"] + 2, n["post"] - n["pre"])


def _text(n: Column, kind: str, glue: str) -> Column:
    """The texts of a kind below a node, in order."""
    return F.array_join(_below(n)[kind], glue)


def _named(*names: str):
    return lambda n: n["name"].isin(*names)


def _item(step: int, at: Column, line: Column, head: Column, cut: Column, photo: Column | None, profile: Column | None) -> Column:
    values = {"step": F.lit(step), "at": at, "line": line, "head": head, "cut": cut, "photo": photo, "profile": profile}
    return F.struct(*[(F.lit(None) if v is None else v).cast({"step": "int", "at": "int", "cut": "int"}.get(k, "string")).alias(k) for k, v in values.items()])


def _table(t: Column) -> Column:
    cell = lambda c: F.nullif(_text(c, "text", " "), F.lit(""))
    row = lambda r: F.nullif(F.array_join(F.transform(F.filter(_below(r), _named("td", "th")), cell), " | "), F.lit(""))
    line = F.array_join(F.transform(F.filter(_below(t), _named("tr")), row), "\n")
    return _item(0, t["pre"], line, F.when(t["above"].isNotNull(), _text(t["above"], "text", "")), F.lit(1), None, None)


def _card(c: Column) -> Column:
    line = F.trim(F.regexp_replace(_text(c, "loose", " "), r"(?U)\s+", " "))
    first = lambda name, web: F.get(F.filter(_below(c), lambda n: (n["name"] == name) & n[web].isNotNull() & ~n["in_table"]), F.lit(0))[web]
    return _item(1, c["pre"], line, F.lit("Faculty"), F.lit(1), first("img", "src"), first("a", "href"))


def _in_card(n: Column) -> Column:
    """In a card with a text: more texts have been said at its end than at its start."""
    said = lambda place: F.get(F.col("nodes"), place)["said"]
    return n["outer"].isNotNull() & (said(n["outer"]["post"]) > said(n["outer"]["pre"]))


def _rest(n: Column) -> Column:
    return n["in_body"] & ~n["in_table"] & ~_in_card(n)


def _piece(n: Column) -> Column:
    is_head, is_item = n["name"].isin(*HEADINGS), n["name"] == "li"
    line = F.when(~is_head, F.nullif(_text(n, "plain", " "), F.lit("")))
    line = F.when(is_item, F.concat(F.lit("* "), line)).otherwise(line)
    bold = F.get(F.filter(_below(n), lambda b: b["name"].isin("strong", "b") & _rest(b)), F.lit(0))
    dated = is_item & line.isNotNull() & F.coalesce(F.rlike(_text(bold, "plain", ""), F.lit(ENTRY)), F.lit(False))
    return _item(2, n["pre"], line, F.when(is_head, _text(n, "plain", "")), (is_head | dated), None, None)


def chunk_rows(pages: DataFrame, own_names: Sequence[str] = ()) -> DataFrame:
    """page, copy, url, title, step, at, kind, heading, content, photo, profile: every chunk of pages(url, title, html)."""
    node = F.struct("pre", "post", "name", "text", "loose", "plain", "src", "href", "card", "in_body", "in_table", "outer", "above", "said")
    whole = marked(flattened(pages, own_names)).groupBy(*PAGE).agg(
        F.max("url").alias("url"), F.max("title").alias("title"), F.coalesce(F.min("portrait")["src"], F.lit("")).alias("portrait"), F.array_sort(F.collect_list(node)).alias("nodes")
    )
    tables = F.transform(F.filter("nodes", lambda n: (n["name"] == "table") & n["in_body"]), _table)
    cards = F.transform(F.filter("nodes", lambda n: n["card"]), _card)
    pieces = F.transform(F.filter("nodes", lambda n: n["name"].isin("li", "p", *HEADINGS) & _rest(n)), _piece)
    items = whole.select(*PAGE, "url", "title", "portrait", F.inline(F.concat(tables, cards, pieces)))
    order = Window.partitionBy(*PAGE, "step").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    items = items.withColumns({"section": F.sum("cut").over(order), "heading": F.last("head", ignorenulls=True).over(order)})
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("at", "line")))), lambda x: x["line"]), "\n")
    found = items.groupBy(*PAGE, "step", "section").agg(
        *[F.max(c).alias(c) for c in ("url", "title", "portrait", "heading", "photo", "profile")], F.min("at").alias("at"), F.regexp_replace(lines, r"(?U)^\s+|\s+$", "").alias("said")
    ).where("said <> ''")
    named = F.coalesce(F.nullif("heading", F.lit("")), F.lit("General"))
    profile = F.coalesce("profile", F.lit(""))
    table = F.concat(named, F.lit("\n\nThe following table shows "), F.lower(named), F.lit(" details for "), "title", F.lit(", including the data below:\n\n"), "said")
    card = F.concat(F.lit("Faculty\n\n"), "said", F.when(profile != "", F.concat(F.lit(" Profile: "), profile)).otherwise(""))
    text = F.concat(F.when(F.coalesce("heading", F.lit("")) != "", F.concat("heading", F.lit("\n\n"))).otherwise(""), "said")
    of = lambda *by: F.get(F.array(*by), F.col("step"))
    return found.select(
        *PAGE, "url", "title", "step", "at", of(F.lit("table"), F.lit("faculty_card"), F.lit("text")).alias("kind"), "heading",
        F.when(F.col("step") == 0, table).when(F.col("step") == 1, card).otherwise(text).alias("content"), F.coalesce(F.nullif("photo", F.lit("")), "portrait").alias("photo"), profile.alias("profile"),
    )


def extract(pages: DataFrame, own_names: Sequence[str] = ()) -> DataFrame:
    """The columns of functions.html.extract, from rows."""
    found = chunk_rows(pages, own_names)
    stripped = F.regexp_replace("content", r"(?U)^\s+|\s+$", "")
    found = found.withColumn("chunk_id", F.concat_ws("::", "url", "kind", F.substring(F.sha2(stripped, 256), 1, 16)))
    last = Window.partitionBy(*PAGE, "chunk_id").orderBy(F.desc("step"), F.desc("at"))
    kept = found.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    words = F.regexp_count("content", F.lit(r"(?U)\S+"))
    chunks = kept.select("chunk_id", F.col("url").alias("source_url"), "title", "heading", F.col("kind").alias("chunk_type"), "content", F.expr("0L").alias("token_estimate"), F.col("photo").alias("photo_url"), F.col("profile").alias("profile_url"))
    chunks = chunks.withColumn("token_estimate", F.floor(words * 13 / 10).cast("long"))
    return roles.metadata(chunks, "content", "source_url", "chunk_type", own_names)
