"""Queries over answers: prompts, models in turn, presentation, metadata, coverage, recent conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import rules
from tidemill.functions import html as pages
from tidemill.functions import text as tx
from tidemill.operators import chat, chunking, evaluation, generation, page_rows, retrieval, scoring, sync
from tidemill.plans.registry import ORACLE_SQL, lit, query, sql_collapse, sql_strip
from tidemill.plans.retrieval import EVERY
from tidemill.plans.texts import EXAMPLES_SQL, questions
from tidemill.session import scratch, table
from tidemill.sources import files

# Answers -------------------------------------------------------------------

_RULES, _MODES = "Use the context only.", {"assert": "\nOne source matches.", "disambiguate": "\nSeveral sources match."}
_REFUSAL, _FAILURE = "I don't have that information.", "No model could be reached."


def _first(prompts: list[str]) -> list[str | None]:
    return [f"See [2], also [1] {len(p)} " if len(p) % 3 == 0 else None for p in prompts]


def _second(prompts: list[str]) -> list[str | None]:
    raise ConnectionError("never there")


def _third(prompts: list[str]) -> list[str | None]:
    return [None if len(p) % 5 == 0 else "I don't have that information. [1]" if len(p) % 2 == 0 else "In [3] and [1]." for p in prompts]


_MODELS = [("a/first", _first), ("b/second", _second), ("c/third", _third)]
_RESULTS = f"""
  SELECT doc_id, coalesce(text, '') AS question, CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') || '?' END AS rewritten,
    CASE WHEN n_chars >= 2000 THEN 'high' WHEN n_chars >= 200 THEN 'medium' ELSE 'low' END AS band, CASE WHEN doc_id % 3 = 0 THEN 'assert' WHEN doc_id % 3 = 1 THEN 'disambiguate' END AS mode,
    substr({sql_collapse("coalesce(text, '')")}, 1, 1400) AS context, CASE WHEN doc_id % 11 <> 0 THEN ['u1', 'u2', 'u1'] ELSE CAST([] AS VARCHAR[]) END AS urls FROM documents"""


@query(f"""
WITH r AS ({_RESULTS}), c AS (SELECT *, band <> 'low' AND len(urls) > 0 AS llm_called FROM r), p AS (
  SELECT *, length({lit(_RULES)} || CASE WHEN mode = 'assert' THEN {lit(_MODES["assert"])} ELSE {lit(_MODES["disambiguate"])} END || chr(10) || chr(10) || 'Context:' || chr(10) || chr(10) || context
    || chr(10) || chr(10) || 'Question: ' || coalesce(rewritten, question) || chr(10) || chr(10) || 'Answer:') AS n FROM c
), a AS (
  SELECT *, CASE WHEN NOT llm_called THEN NULL WHEN n % 3 = 0 THEN 'See [2], also [1] ' || n WHEN n % 5 = 0 THEN NULL WHEN n % 2 = 0 THEN 'I don''t have that information. [1]' ELSE 'In [3] and [1].' END AS given,
    CASE WHEN NOT llm_called THEN NULL WHEN n % 3 = 0 THEN 'a/first' WHEN n % 5 <> 0 THEN 'c/third' END AS model FROM p
)
SELECT doc_id, llm_called, model, CASE WHEN NOT llm_called THEN {lit(_REFUSAL)} ELSE coalesce(given, {lit(_FAILURE)}) END AS answer, given IS NULL OR contains(given, 'don''t have') AS declined,
  CASE WHEN given LIKE 'See%' THEN 'u1,u2' WHEN given LIKE 'In%' THEN 'u1' ELSE '' END AS sources,
  CASE WHEN NOT llm_called THEN 'confidence below threshold — generation skipped' WHEN given IS NULL THEN 'all generation models failed' END AS reason,
  CASE WHEN llm_called AND n % 3 <> 0 THEN 1 ELSE 0 END::INTEGER AS failures FROM a""")
def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a question with its context; stand-ins for models, of which one is never there."""
    d = table(spark, sf_dir, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    results = d.select(
        "doc_id", F.col("text").alias("question"), F.when(F.col("doc_id") % 2 == 0, F.concat("text", F.lit("?"))).alias("rewritten"),
        F.when(F.col("n_chars") >= 2000, "high").when(F.col("n_chars") >= 200, "medium").otherwise("low").alias("band"),
        F.when(F.col("doc_id") % 3 == 0, "assert").when(F.col("doc_id") % 3 == 1, "disambiguate").alias("mode"), F.substring(tx.collapse(F.col("text")), 1, 1400).alias("context"),
        F.when(F.col("doc_id") % 11 != 0, F.array(F.lit("u1"), F.lit("u2"), F.lit("u1"))).otherwise(F.array().cast("array<string>")).alias("urls"),
    )
    out = generation.answers(results, _MODELS, _RULES, _MODES, _REFUSAL, _FAILURE)
    return out.select("doc_id", "llm_called", "model", "answer", "declined", F.array_join("sources", ",").alias("sources"), "reason", "failures")


def _embed(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count("a"))] for t in texts]


def _fickle(texts: list[str]) -> list[int]:
    if any("|" in t for t in texts):
        raise ValueError("a bar")
    return [len(t) for t in texts]


@query("SELECT doc_id, CASE WHEN NOT contains(text, '|') THEN CAST(length(text) AS BIGINT) END AS said, CASE WHEN contains(text, '|') THEN 'ValueError: a bar' END AS error FROM documents WHERE text IS NOT NULL")
def batched_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents through a model that raises for some of them, texts of like length together."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    return generation.with_model(d, _fickle, "text", "said", "bigint", budget=200_000, errors="error").drop("text")


@query("SELECT conv_id, turn, CAST(length(text) AS DOUBLE) AS length, CAST(length(text) - length(replace(text, 'a', '')) AS DOUBLE) AS a FROM conversations WHERE text IS NOT NULL")
def embedded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through a plugged-in embedding model, here one that counts letters."""
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "text")
    out = generation.with_model(c, _embed, "text", "vector", "array<double>")
    return out.select("conv_id", "turn", F.col("vector")[0].alias("length"), F.col("vector")[1].alias("a"))


def _standalone(texts: list[str]) -> list[str | None]:
    return [f"about {t}" if t else None for t in texts]


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND text <> '' THEN 'about ' || text ELSE text END AS asked FROM conversations")
def rewritten_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rewriting model sees flagged questions only; without an output the question stays."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("turn") % 2 == 0).alias("follows"))
    return generation.with_model(c, _standalone, "text", "rewritten", where="follows").select("conv_id", "turn", F.coalesce("rewritten", "text").alias("asked"))


# Presentation --------------------------------------------------------------

_STYLES = {"high": ("#0a0", "HIGH"), "medium": ("#aa0", "MEDIUM"), "low": ("#a00", "LOW")}
_STYLE = "clear:both;font-size:0.85em;color:#666;margin-top:8px"


@query(f"""
WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS band, doc_id % 4 = 0 OR doc_id % 4 = 1 AS called, doc_id % 3 = 0 AS declined,
  CASE WHEN doc_id % 5 = 0 THEN 'x/y/model-z' END AS model, lang, source FROM documents)
SELECT doc_id, '<div style=''{_STYLE}''><span style=''color:' || CASE band WHEN 'high' THEN '#0a0' WHEN 'medium' THEN '#aa0' ELSE '#a00' END || ';font-weight:600''>'
  || CASE band WHEN 'high' THEN 'HIGH' WHEN 'medium' THEN 'MEDIUM' ELSE 'LOW' END || ' 0.5</span> &nbsp;·&nbsp; ' || coalesce(nullif(lang, 'en'), 'plain search') || ' &nbsp;·&nbsp; '
  || CASE WHEN NOT coalesce(called, FALSE) THEN 'LLM skipped — no cost incurred' WHEN declined THEN CASE WHEN model IS NULL THEN 'no answer in the sources' ELSE 'model-z found no answer in the sources' END
    WHEN model IS NULL THEN 'LLM called' ELSE 'generated by model-z' END || '</div>' AS badge,
  CASE WHEN doc_id % 7 = 0 THEN '' ELSE chr(10) || chr(10) || '**Sources**' || chr(10) || '- [' || substr('h/' || doc_id || '/' || repeat('p', 80), 1, 70) || '](https://h/' || doc_id || '/' || repeat('p', 80) || ')' || chr(10) || '- [plain](plain)' END AS listed,
  '![N ' || doc_id || '](p.png)' || chr(10) || '**N ' || doc_id || '**' || chr(10) || chr(10) || '![](q.png)' || chr(10) || chr(10) AS photos FROM d""")
def answer_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Badge, source list and photo strip of an answer, for every document."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    band = F.when(i % 4 == 0, "high").when(i % 4 == 1, "medium").when(i % 4 == 2, "low")
    model = F.when(i % 5 == 0, "x/y/model-z")
    route = F.when(~F.col("lang").eqNullSafe("en"), F.col("lang"))
    urls = F.when(i % 7 != 0, F.array(F.concat(F.lit("https://h/"), i.cast("string"), F.lit("/" + "p" * 80)), F.lit("plain"))).otherwise(F.array().cast("array<string>"))
    photo = lambda url, name: F.struct(F.lit(url).alias("url"), name.alias("name"))
    photos = F.array(photo("p.png", F.concat(F.lit("N "), i.cast("string"))), photo("q.png", F.lit("")))
    badge = generation.badge(band, F.lit(0.5), route, (i % 4 == 0) | (i % 4 == 1), i % 3 == 0, model, _STYLES)
    return d.select("doc_id", badge.alias("badge"), generation.source_list(urls).alias("listed"), generation.photo_strip(photos).alias("photos"))


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS s,
  sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) AS n
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, greatest(0.0, least(1.0, round(s / n, 9))) AS score FROM s), p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS pos FROM r)
SELECT query_id, CAST(pos AS INTEGER) AS pos, 'v' || vec_id AS source_url, CASE WHEN label % 2 = 0 THEN 'h' || label END AS heading, CASE WHEN vec_id % 3 = 0 THEN 'x.png' ELSE '' END AS photo_url,
  round(score, 6) AS rerank_score, substr(repeat('word ' || vec_id || ' ', 60), 1, 300) AS preview FROM p WHERE pos <= 5""")
def score_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scored question returns: the kept chunks, flat, with a preview."""
    v = table(spark, sf_dir, "embeddings")
    q = v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    pool = retrieval.pools(q, v, rules.TOP_K, carry=["label"])
    i = F.col("vec_id").cast("string")
    content = F.repeat(F.concat(F.lit("word\n "), i, F.lit("  ")), 60)
    pool = pool.withColumns({"source_url": F.concat(F.lit("v"), i), "heading": F.when(F.col("label") % 2 == 0, F.concat(F.lit("h"), F.col("label").cast("string"))), "designation": F.lit(None).cast("string"), "photo_url": F.when(F.col("vec_id") % 3 == 0, "x.png"), "content": content})
    out = generation.response_chunks(pool, "query_id").select("query_id", F.inline("chunks"))
    return out.select("query_id", "pos", "source_url", "heading", "photo_url", F.round("rerank_score", 6).alias("rerank_score"), "preview")


# Corpus --------------------------------------------------------------------


@query("""
SELECT doc_id, key, value FROM (SELECT doc_id, coalesce(CAST(lang AS VARCHAR), '') AS lang, coalesce(CAST(source AS VARCHAR), '') AS source, coalesce(CAST(n_chars AS VARCHAR), '') AS n_chars FROM documents)
UNPIVOT (value FOR key IN (lang, source, n_chars))""")
def chunk_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All columns but the reserved ones as metadata: filled scalars."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.explode(sync.metadata(d, ["doc_id", "text"])).alias("key", "value"))


@query("""
WITH h AS (SELECT source FROM documents), g AS (SELECT source, count(*) AS heads FROM h WHERE trim(coalesce(source, '')) <> '' GROUP BY source)
SELECT 'crowded' AS warning, source AS grp, heads FROM g WHERE heads > 2 UNION ALL
SELECT 'unnamed', NULL, count(*) FROM h WHERE trim(coalesce(source, '')) = '' HAVING count(*) > 0 UNION ALL
SELECT 'none', NULL, 0 WHERE NOT EXISTS (SELECT * FROM g)""")
def head_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents play the heads, sources the departments."""
    return evaluation.head_warnings(table(spark, sf_dir, "documents"), "source")


@query("""
WITH p AS (SELECT unnest(CASE WHEN len(string_split_regex(text, '\\n\\s*\\n')) > 1 THEN string_split_regex(text, '\\n\\s*\\n') ELSE string_split(text, chr(10)) END) AS t FROM documents)
SELECT CASE WHEN contains(t, ' | ') THEN 'table' ELSE 'text' END AS kind, count(*) AS blocks FROM p WHERE trim(replace(t, chr(160), ' '), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') <> '' GROUP BY 1""".replace("\\\\", "\\"))
def block_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("title", F.lit(""))
    blocks = chunking.text_blocks(docs).select(F.explode("blocks").alias("b")).select(F.when(F.contains("b.text", F.lit(" | ")), "table").otherwise("text").alias("kind"))
    return blocks.groupBy("kind").agg(F.count("*").alias("blocks"))


@query("""
WITH m AS (SELECT conv_id, count(*) AS messages, arg_min(text, turn) FILTER (role = 'user') AS title, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
SELECT conv_id, messages, title, last_turn, CAST(row_number() OVER (ORDER BY last_turn DESC NULLS LAST, conv_id) AS INTEGER) AS place FROM m ORDER BY place LIMIT 50""")
def recent_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 conversations last active, turns standing in for times."""
    c = table(spark, sf_dir, "conversations")
    return chat.recent(chat.overview(c.select("conv_id").distinct(), c), F.desc_nulls_last("last_turn"), F.asc("conv_id"))


@query("""
WITH t AS (SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id)
SELECT count(*) AS created, count(*) AS ids, 36 AS width, count(*) AS equal_times FROM t""")
def created_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New conversations have random ids of one form, all different, and both times equal."""
    c = chat.create(table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("now", F.current_timestamp()), F.col("now"), seed=7)
    return c.agg(F.count("*").alias("created"), F.count_distinct("id").alias("ids"), F.max(F.length("id")).alias("width"), F.count_if(F.col("created_at") == F.col("last_active_at")).alias("equal_times"))


# Pages with every element that the parser knows, built around the whole text of each document. -----

#: A card's role as written, its role and whether it is a head's, its department as written and as known.
CARDS = [
    ("HOD", "head_of_department", True, "Electronics and Communication", "electronics and communication"), ("Vice-Chairperson", "deputy_head", False, "Mechanical Engineering", "mechanical"),
    ("Associate Professor", "associate_professor", False, "Computer Science and Engineering", "computer science"), ("Chairperson", "head_of_department", True, "EEE", "electrical and electronics"),
    ("Professor Emeritus", "professor_emeritus", False, "Physics", "physics"), ("Lab Technician", "staff", False, "CSE", "computer science"), ("Assistant Professor", "assistant_professor", False, "Civil", "civil"),
]
_OWN = ["oakfield"]
_PAGE = [
    '<html><nav>menu</nav><div class="breadcrumb">x</div><div id="why-oakfield-sec">choose us</div><main><h1>Page ', "id", "</h1><p>", "text",
    "</p>\n<h2>Fees</h2><table><tr><th>Year</th><th>", "lang", "</th></tr><tr><td>", "id", "</td><td> ", "n", '\n</td></tr><tr><td></td></tr></table><table><tr><td> </td></tr></table><div class="fc-item"><img src="/p', "id",
    '.png"><a href="/faculty/', "id", '">Dr. A  Rao ', "role", " Department of ", "dept", ' Oakfield</a></div><div class="fc-item"><a href="mailto:x">C</a></div><ul><li><b>June 2020</b> first ', "id",
    "</li><li>second</li><li><strong>May 2021</strong> third</li></ul><h3>Empty</h3></main><footer>f</footer></html>",
]


def _built_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, n = table(spark, sf_dir, "documents"), F.col("doc_id") % len(CARDS)
    escaped = F.replace(F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    of = lambda i: F.get(F.array(*[F.lit(c[i]) for c in CARDS]), n)
    values = {"id": F.col("doc_id").cast("string"), "text": escaped, "lang": F.coalesce("lang", F.lit("")), "n": F.coalesce(F.col("n_chars").cast("string"), F.lit("")), "role": of(0), "dept": of(3)}
    return d.select(F.concat(F.lit("http://u.edu/pages/"), "doc_id").alias("url"), F.concat(F.lit("Title "), "doc_id").alias("title"), F.concat(*[values.get(x, F.lit(x)) for x in _PAGE]).alias("html"))


def _of_card(i: int) -> str:
    return "CASE doc_id % 7 " + " ".join(f"WHEN {k} THEN {lit(c[i]) if isinstance(c[i], str) else str(c[i]).upper()}" for k, c in enumerate(CARDS)) + " END"


_BUILT = f"""
WITH d AS (SELECT *, 'http://u.edu/pages/' || doc_id AS url, {sql_strip("coalesce(text, '')")} AS body FROM documents), c AS (
  SELECT url, 'table' AS chunk_type, 'Fees' AS heading, 'Fees' || chr(10) || chr(10) || 'The following table shows fees details for Title ' || doc_id || ', including the data below:' || chr(10) || chr(10) || concat_ws(' | ', 'Year', nullif(lang, ''))
    || chr(10) || concat_ws(' | ', doc_id, n_chars) AS content, '' AS photo_url, '' AS profile_url, '' AS designation, '' AS designation_raw, FALSE AS is_department_head, '' AS department FROM d
  UNION ALL SELECT url, 'faculty_card', 'Faculty', 'Faculty' || chr(10) || chr(10) || 'Dr. A Rao ' || {_of_card(0)} || ' Department of ' || {_of_card(3)} || ' Oakfield Profile: http://u.edu/faculty/' || doc_id,
    'http://u.edu/p' || doc_id || '.png', 'http://u.edu/faculty/' || doc_id, {_of_card(1)}, {_of_card(0)}, {_of_card(2)}, {_of_card(4)} FROM d
  UNION ALL SELECT url, 'faculty_card', 'Faculty', 'Faculty' || chr(10) || chr(10) || 'C', '', '', '', '', FALSE, '' FROM d
  UNION ALL SELECT url, 'text', 'Page ' || doc_id, 'Page ' || doc_id || chr(10) || chr(10) || body, '', '', '', '', FALSE, '' FROM d WHERE body <> ''
  UNION ALL SELECT url, 'text', 'Fees', 'Fees' || chr(10) || chr(10) || '* June 2020 first ' || doc_id || chr(10) || '* second', '', '', '', '', FALSE, '' FROM d
  UNION ALL SELECT url, 'text', 'Fees', 'Fees' || chr(10) || chr(10) || '* May 2021 third', '', '', '', '', FALSE, '' FROM d
)
SELECT url || '::' || chunk_type || '::' || substr(sha256(content), 1, 16) AS chunk_id, chunk_type, heading, photo_url, profile_url, designation, designation_raw, is_department_head, department FROM c"""


@query(_BUILT)
def built_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise, headings, tables, cards with roles and departments, sections and dated entries around every whole document."""
    out = pages.extract(_built_pages(spark, sf_dir), _OWN)
    return out.select("chunk_id", "chunk_type", "heading", "photo_url", "profile_url", "designation", "designation_raw", "is_department_head", "department")


@query(_BUILT)
def built_page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same chunks from the pages' nodes as rows."""
    out = page_rows.extract(_built_pages(spark, sf_dir), _OWN)
    return out.select("chunk_id", "chunk_type", "heading", "photo_url", "profile_url", "designation", "designation_raw", "is_department_head", "department")


@query(f"""
WITH l AS (SELECT page_id, 'http://u.edu/bengaluru/' || CASE page_id % 3 WHEN 0 THEN 'physics' WHEN 1 THEN 'EEE' ELSE 'school' END || '/faculty/?p=' || page_id AS url, CASE page_id % 3 WHEN 0 THEN 'physics' WHEN 1 THEN 'electrical and electronics' END AS department FROM pages)
SELECT url AS source_url, department FROM l WHERE department IS NOT NULL
UNION ALL SELECT 'http://u.edu/faculty/' || page_id || x, department FROM l, (VALUES ('a'), ('b')) t(x) WHERE department IS NOT NULL""")
def listing_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages with two cards each, one for every page of the table; cards give their profiles the listing's department."""
    i = F.col("page_id").cast("string")
    name = F.when(F.col("page_id") % 3 == 0, "physics").when(F.col("page_id") % 3 == 1, "EEE").otherwise("school")
    card = lambda x: F.concat(F.lit('<div class="fc-item"><a href="/faculty/'), i, F.lit(f'{x}">Dr. {x}</a></div>'))
    listings = table(spark, sf_dir, "pages").select(F.concat(F.lit("http://u.edu/bengaluru/"), name, F.lit("/faculty/?p="), i).alias("url"), F.lit("T").alias("title"), F.concat(card("a"), card("b")).alias("html"))
    return sync.department_edges(sync.card_listings(pages.extract(listings, _OWN), _OWN))


@query(f"""
WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))
  / (sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))) AS s
  FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id WHERE q.vec_id % {EVERY} = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY greatest(0.0, least(1.0, round(s, 9))) DESC, vec_id) AS pos FROM s)
SELECT query_id, CAST(pos AS INTEGER) AS pos, vec_id, 'document ' || label || ' (page ' || (vec_id % 9 + 1) || ')' AS source_url, 'document ' || label AS heading FROM p WHERE pos <= 15""")
def upload_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pool of uploaded documents, which have a title and a page for a source."""
    v = table(spark, sf_dir, "embeddings").withColumns({"title": F.concat(F.lit("document "), F.col("label").cast("string")), "page": F.col("vec_id") % 9 + 1})
    q = v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    return retrieval.upload_sources(retrieval.pools(q, v, rules.POOL, carry=["title", "page"])).select("query_id", "pos", "vec_id", "source_url", "heading")


# Files ---------------------------------------------------------------------


@query("SELECT doc_id, lang, n_chars FROM documents")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes out as JSON lines comes back."""
    path, d = scratch(spark, "lines"), table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    files.write_json(d, path)
    return spark.read.schema(d.schema).json(path)


@query("SELECT coalesce(source, '') AS doc_id, source AS title, count(*)::INTEGER AS chunks, max(coalesce(nullif(doc_id % 12, 0), 1))::INTEGER AS pages FROM documents GROUP BY source")
def registry_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of sources, written as one JSON object and read again."""
    path = scratch(spark, "registry")
    r = sync.registry(table(spark, sf_dir, "documents").withColumn("page", F.expr("nullif(doc_id % 12, 0)")), "source", "page")
    nothing = F.lit(None).cast("string")
    files.write_registry(r.select(F.coalesce("source", F.lit("")).alias("doc_id"), F.col("source").alias("title"), nothing.alias("filename"), "chunks", "pages", nothing.alias("uploaded_at")), path)
    return files.read_registry(spark, path).select("doc_id", "title", "chunks", "pages")


@query("SELECT DISTINCT url FROM pages WHERE url IS NOT NULL")
def seed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urls written as JSON arrays, read as the distinct seeds."""
    path = scratch(spark, "seeds")
    files.write_seeds(table(spark, sf_dir, "pages").select("url").where("url is not null"), path)
    return files.read_seeds(spark, path)


# Voters --------------------------------------------------------------------


def _voter(texts: list[str]) -> list[str | None]:
    return [None if len(t) % 3 == 0 else "I think\nthe category is Faculty." if len(t) % 3 == 1 else "fees" for t in texts]


@query(f"""
WITH k AS ({ORACLE_SQL["keyword_category"]}), q AS (SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM {EXAMPLES_SQL}),
v AS (
  SELECT conv_id, turn, 1 AS pos, category AS label FROM k UNION ALL
  SELECT conv_id, turn, 2, CASE length(coalesce(text, '')) % 3 WHEN 1 THEN 'faculty' WHEN 2 THEN 'fees' END FROM q UNION ALL
  SELECT conv_id, turn, 3, 'general_info' FROM q WHERE conv_id % 2 = 0
), c AS (SELECT conv_id, turn, label, count(*) AS n, min(pos) AS first FROM v WHERE label IS NOT NULL GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY conv_id, turn) AS total, row_number() OVER (PARTITION BY conv_id, turn ORDER BY n DESC, first, label) AS r FROM c)
SELECT conv_id, turn, label, n, CAST(total AS BIGINT) AS total, round(n / greatest(5, total), 4) AS agreement FROM r WHERE r = 1""")
def ensemble_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule, a plugged-in model that fails at times and a voter that abstains decide a question's category."""
    q = questions(spark, sf_dir).withColumn("text", F.coalesce("text", F.lit("")))
    asked = generation.with_model(q, _voter, "text", "said")
    each = F.array(tx.keyword_category(F.col("text")), tx.parse_category(F.col("said")), F.when(F.col("conv_id") % 2 == 0, "general_info"))
    votes = asked.select("conv_id", "turn", F.posexplode(each).alias("pos", "label"))
    return scoring.votes(votes, ["conv_id", "turn"], "label", "pos")
