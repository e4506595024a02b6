"""Queries over text: cleaning, identity, predicates, routing, vocabulary, roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import roles, rules
from tidemill.functions import text as tx
from tidemill.operators import chunking, spelling
from tidemill.plans.registry import lit, query, sql_any, sql_clean, sql_collapse, sql_lookup, sql_match, sql_strip, sql_whole
from tidemill.session import stored, table
from tidemill.sources import files


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"SELECT doc_id, 'doc::text::' || substr(sha256({sql_strip('text')}), 1, 16) AS chunk_id, length(text) AS n FROM documents")
def chunk_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.chunk_id(F.lit("doc"), F.lit("text"), F.col("text")).alias("chunk_id"), F.length("text").cast("long").alias("n"))


@query(r"SELECT doc_id, CAST(floor(len(regexp_extract_all(text, '\S+')) * 13 / 10) AS BIGINT) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, sha256({sql_clean('text')}) AS cleaned FROM documents")
def block_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(tx.clean(F.col("text")), 256).alias("cleaned"))


@query(f"""
WITH b AS (SELECT doc_id, unnest([{sql_clean('x')} FOR x IN regexp_split_to_array(text, '\\n')]) AS block FROM documents)
SELECT doc_id, count(*) AS blocks, sum(length(block)) AS chars FROM b WHERE block <> '' GROUP BY doc_id""")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts here have no blank lines, so a block is a line."""
    b = F.filter(F.transform(F.split("text", "\n"), tx.clean), lambda x: x != "")
    df = _docs(spark, sf_dir).select("doc_id", F.explode(b).alias("block"))
    return df.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(F.length("block").cast("long")).alias("chars"))


@query(f"""
WITH b AS (SELECT doc_id, unnest([{sql_clean('x')} FOR x IN regexp_split_to_array(text, '\\n\\s*\\n')]) AS block FROM documents)
SELECT doc_id, count(*) AS blocks, min(length(block)) AS least, max(length(block)) AS most FROM b WHERE block <> '' GROUP BY doc_id""")
def paragraph_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("block").cast("long")
    return files.text_blocks(_docs(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.min(n).alias("least"), F.max(n).alias("most"))


_CELLS = f"[{sql_strip('c')} FOR c IN string_split(x, '|')]"
_ROWS = f"[list_aggregate([c FOR c IN {_CELLS} IF c <> ''], 'string_agg', ' | ') FOR x IN string_split(text, chr(10))]"


@query(f"SELECT doc_id, sha256(coalesce(list_aggregate([r FOR r IN {_ROWS} IF r IS NOT NULL AND r <> ''], 'string_agg', chr(10)), '')) AS table_text FROM documents WHERE contains(text, '|')")
def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.transform(F.split("text", "\n"), lambda x: F.split(x, r"\|"))
    return _docs(spark, sf_dir).where(F.contains("text", F.lit("|"))).select("doc_id", F.sha2(tx.table_text(rows), 256).alias("table_text"))


@query(f"SELECT doc_id, substr({sql_collapse('text')}, 1, 300) AS p300, substr(text, 1, 200) AS p200, substr({sql_collapse('text')}, 1, 90) AS p90 FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", tx.preview(t).alias("p300"), F.substring(t, 1, 200).alias("p200"), tx.preview(t, 90).alias("p90"))


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  regexp_replace(replace(regexp_replace(url, '^https?://', ''), '/', '_'), '^_+|_+$', '', 'g') AS dump_name,
  regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_matches(url, '^https?://') AS web, contains(url, '/faculty/') AS listing FROM pages""")
def page_url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", tx.slug(u).alias("slug"), tx.dump_name(u).alias("dump_name"), F.parse_url(u, F.lit("HOST")).alias("host"),
        F.rlike(u, F.lit("^https?://")).alias("web"), F.contains(u, F.lit("/faculty/")).alias("listing"),
    )


@query(r"""
WITH p AS (SELECT page_id, [x FOR x IN string_split(string_split(regexp_replace(split_part(url, '?', 1), '/+$', ''), '/')[-1], '-') IF x <> ''] AS parts FROM pages)
SELECT page_id, coalesce(list_aggregate([CASE WHEN length(x) <= 2 AND regexp_full_match(x, '[A-Za-z]+') THEN list_aggregate([upper(c) FOR c IN string_split(x, '')], 'string_agg', '.') || '.'
  ELSE upper(x[1]) || lower(x[2:]) END FOR x IN parts], 'string_agg', ' '), '') AS display_name FROM p""")
def display_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.display_name(F.substring_index("url", "?", 1)).alias("display_name"))


_IDS = ["http://a.b/c::text::0123456789abcdef", "http://a.b/x::y::table::00", "no separators", "a::b", "::text::1"]


_PARSED = r"SELECT id, CASE WHEN regexp_matches(id, '(?s)^.*::.*::') THEN regexp_extract(id, '(?s)^(.*)::(.*?)::([^:]*)$', 1) END AS url, CASE WHEN regexp_matches(id, '(?s)^.*::.*::') THEN regexp_extract(id, '(?s)^(.*)::(.*?)::([^:]*)$', 2) END AS kind FROM "


@query(_PARSED + f"(SELECT url || '::text::' || substr(sha256({sql_strip('html')}), 1, 16) AS id FROM pages UNION ALL SELECT 'd::' || doc_id || '::table::' || substr(sha256(coalesce(text, '')), 1, 16) FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({lit(i)})" for i in _IDS) + ")) t(id)")
def chunk_id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of all pages' and documents' chunks, and some odd ones."""
    own = spark.createDataFrame([(i,) for i in _IDS], "id string")
    of_pages = table(spark, sf_dir, "pages").select(tx.chunk_id(F.col("url"), F.lit("text"), F.col("html")).alias("id"))
    digest = F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 16)
    of_docs = _docs(spark, sf_dir).select(F.concat(F.lit("d::"), F.col("doc_id").cast("string"), F.lit("::table::"), digest).alias("id"))
    df = of_pages.unionByName(of_docs).unionByName(own)
    url, kind = tx.parse_chunk_id(F.col("id"))
    return df.select("id", url.alias("url"), kind.alias("kind"))


@query("SELECT c_custkey, substr(sha256('salt:' || c_name), 1, 32) AS contact FROM customer")
def contact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", tx.salted_hash(F.col("c_name"), "salt").alias("contact"))


@query("SELECT doc_id, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END, ''), nullif(lang, ''), '(no url)') AS url, format('{} (page {})', coalesce(source, 'document'), coalesce(doc_id % 9, 1)) AS citation FROM documents")
def first_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = tx.first_filled(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")), F.col("lang"), default="(no url)")
    citation = F.format_string("%s (page %d)", F.coalesce("source", F.lit("document")), F.coalesce(F.col("doc_id") % 9, F.lit(1)))
    return _docs(spark, sf_dir).select("doc_id", url.alias("url"), citation.alias("citation"))


_RICH = "'![p](http://x/' || conv_id || '.png) ' || text || ' ![q](http://x/' || turn || '.png)'"


@query(rf"""SELECT DISTINCT conv_id, unnest(regexp_extract_all({_RICH}, '!\[[^\]]*\]\(([^)]*)\)', 1)) AS image FROM conversations WHERE role = 'assistant'""")
def shown_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rich = F.concat(F.lit("![p](http://x/"), F.col("conv_id"), F.lit(".png) "), "text", F.lit(" ![q](http://x/"), F.col("turn"), F.lit(".png)"))
    return df.select("conv_id", F.explode(tx.image_urls(rich)).alias("image")).distinct()


# Predicates ----------------------------------------------------------------

#: Questions that exercise the rules, beside the tables' own texts.
EXAMPLES = [
    "Who is the principal?", "principal of robotics and ai", "Principal, School of Computing", "who heads mechanical",
    "Who is the HOD of ECE?", "vice-chairperson of ECE", "list faculty in computer science", "who teaches physics",
    "what programs does CSE offer", "head of business", "deputy head of the department of chemistry", "chairman of electrical and electronics",
    "staff working on data science", "and its fees?", "what about hostel", "for cse", "fees", "Tell me about the campus library and mess",
    "when is the endsem for btech cse", "see the reval dates, prof", "I don't have that information.", "The page does not mention it. [1]", "", "   ",
    "Aids awareness maintenance", "who is in charge of placements and salary", "headed by the dean", "admission cutoff and entrance fee", "ok", "those two",
]
EXAMPLES_SQL = "(VALUES " + ", ".join(f"({-1 - i}, 0, {lit(e)})" for i, e in enumerate(EXAMPLES)) + ") e(conv_id, turn, text)"
_QUESTIONS = f"(SELECT conv_id, turn, text FROM conversations UNION ALL SELECT * FROM {EXAMPLES_SQL}) q"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(-1 - i, 0, e) for i, e in enumerate(EXAMPLES)], "conv_id long, turn long, text string")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text").unionByName(own)


PRINCIPAL = sql_match("text", sql_whole("principal"))
_DEPUTY = sql_match("text", r"(?:vice[\s\-]*chair(?:person|man)?|deputy\s+(?:hod|head\s+of\s+(?:the\s+)?department)|associate\s+dean)(?:[^\p{L}\p{N}_]|$)")
_HEAD_ROLE = f"({sql_match('text', r'(?:chair(?:person|man)|head\s+of\s+(?:the\s+)?department)(?:[^\p{L}\p{N}_]|$)')} OR {sql_match('text', sql_whole('hod'))})"
HEAD = f"(NOT {_DEPUTY} AND ({_HEAD_ROLE} OR {sql_match('text', sql_whole('|'.join(rules.HEAD_PHRASES)))}))"
ASKS_PEOPLE = sql_match("text", sql_whole(sql_any(rules.PEOPLE_WORDS) + "|" + "|".join(rules.PEOPLE_PHRASES)))
DEPT = "CASE " + " ".join(f"WHEN {sql_match('text', sql_whole(p))} THEN {lit(p)}" for p in sorted(rules.DEPARTMENT_SCHOOL, key=len, reverse=True)) + " END"
SCHOOL = f"CASE WHEN {sql_match('text', sql_whole(sql_any(rules.ENGINEERING_WORDS)))} THEN 'engineering' WHEN {sql_match('text', sql_any(rules.COMPUTING_SCHOOLS))} OR {sql_match('text', sql_whole(sql_any(rules.COMPUTING_WORDS)))} THEN 'computing' ELSE 'engineering' END"
CANON = sql_lookup(rules.DEPARTMENT_ALIASES, "dept", "dept")
TAG = sql_lookup(rules.DEPARTMENT_TAGS, "canon", "canon")


@query(f"""
WITH a AS (SELECT *, {PRINCIPAL} AS principal, {HEAD} AS head, {ASKS_PEOPLE} AS people, {DEPT} AS dept, {SCHOOL} AS school_asked FROM {_QUESTIONS}),
b AS (SELECT *, {CANON} AS canon, {sql_lookup(rules.DEPARTMENT_SCHOOL, 'dept')} AS school FROM a), c AS (SELECT *, {TAG} AS tag FROM b)
SELECT conv_id, turn, principal, head, people, dept, school_asked, school, tag,
  CASE WHEN principal THEN 'principal_' || school_asked WHEN NOT head AND dept IS NOT NULL AND people THEN 'faculty_' || tag
    WHEN head AND dept IS NOT NULL AND school IS NOT NULL THEN 'department_heads' END AS route,
  concat_ws(' ', text, CASE WHEN principal THEN {sql_lookup(rules.SCHOOL_NAMES, 'school_asked')} END) AS rerank_text FROM c""")
def question_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("text")
    wants = {"principal": tx.wants_principal(q), "head": tx.wants_head(q), "people": tx.wants_people(q), "dept": tx.department_in(q), "school_asked": tx.school_in(q)}
    return questions(spark, sf_dir).withColumns(wants).select(
        "conv_id", "turn", *wants, tx.lookup(rules.DEPARTMENT_SCHOOL, F.col("dept")).alias("school"), tx.department_tag(F.col("dept")).alias("tag"),
        tx.route(*map(F.col, wants)).alias("route"), F.when(F.col("principal"), tx.rerank_text(q, F.col("school_asked"))).otherwise(q).alias("rerank_text"),
    )


_FOLLOW = " OR ".join([
    sql_match("s", sql_whole(sql_any(rules.FOLLOW_UP_WORDS))),
    sql_match("s", rf"^\s*(?:{sql_any(rules.FOLLOW_UP_STARTS)})(?:[^\p{{L}}\p{{N}}_]|$)"),
    sql_match("s", rf"^\s*(?:{sql_any(rules.FOLLOW_UP_ASKS)})\s+about(?:[^\p{{L}}\p{{N}}_]|$)"),
    sql_match("s", sql_whole(sql_any(rules.FOLLOW_UP_REFERENCES))),
    sql_match("s", rules.FOLLOW_UP_TAIL.replace(r"[\w-]", r"[\p{L}\p{N}_-]")),
])


@query(rf"""
WITH t AS (SELECT *, {sql_strip("coalesce(text, '')")} AS s FROM {_QUESTIONS})
SELECT conv_id, turn, s <> '' AND ({_FOLLOW} OR len(regexp_extract_all(s, '\S+')) < 3) AS needs_rewrite, length(text) BETWEEN 2 AND 500 AS in_bounds FROM t""")
def rewrite_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("text")
    return questions(spark, sf_dir).select("conv_id", "turn", tx.needs_rewrite(q).alias("needs_rewrite"), F.length(q).between(2, 500).alias("in_bounds"))


@query(f"SELECT conv_id, turn, {' OR '.join(f'contains(lower(text), {lit(d)})' for d in rules.DECLINES)} AS declined FROM {_QUESTIONS}")
def declined_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("conv_id", "turn", tx.declined(F.col("text")).alias("declined"))


_BY_LENGTH = sorted(rules.ABBREVIATIONS.items(), key=lambda kv: -len(kv[0]))
_EXPANSIONS = ", ".join(f"CASE WHEN {sql_match('text', sql_whole(s))} AND NOT contains(lower(text), {lit(f)}) THEN {lit(f)} END" for s, f in _BY_LENGTH)
_FOUND = ", ".join(f"CASE WHEN {sql_match('text', sql_whole(s))} THEN {lit(s)} END" for s, _ in _BY_LENGTH)


@query(f"""
WITH a AS (SELECT *, [x FOR x IN [{_EXPANSIONS}] IF x IS NOT NULL] AS e, [x FOR x IN [{_FOUND}] IF x IS NOT NULL] AS f FROM {_QUESTIONS}),
b AS (SELECT *, [e[i] FOR i IN range(1, len(e) + 1) IF list_position(e, e[i]) = i][1:4] AS d FROM a)
SELECT conv_id, turn, CASE WHEN len(d) > 0 THEN text || ' ' || list_aggregate(d, 'string_agg', ' ') ELSE text END AS expanded, coalesce(list_aggregate(f, 'string_agg', ','), '') AS found FROM b""")
def abbreviation_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("text")
    return questions(spark, sf_dir).select("conv_id", "turn", tx.expand(q).alias("expanded"), F.array_join(tx.abbreviations_in(q), ",").alias("found"))


_SCORES = {c: " + ".join(f"CAST(contains(lower(text), {lit(w)}) AS INTEGER)" for w in ws) for c, ws in rules.KEYWORDS.items()}


@query(f"""
WITH s AS (SELECT conv_id, turn, [{', '.join(_SCORES.values())}] AS n FROM {_QUESTIONS})
SELECT conv_id, turn, CASE WHEN list_max(n) > 0 THEN [{', '.join(map(lit, _SCORES))}][list_position(n, list_max(n))] ELSE 'general_info' END AS category FROM s""")
def keyword_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions(spark, sf_dir).select("conv_id", "turn", tx.keyword_category(F.col("text")).alias("category"))


@query(f"""
WITH s AS (SELECT conv_id, turn, {sql_strip('text')} AS s FROM {_QUESTIONS}), l AS (SELECT *, lower(string_split(s, chr(10))[-1]) AS last FROM s)
SELECT conv_id, turn, CASE WHEN s <> '' THEN CASE {' '.join(f'WHEN contains(last, {lit(c)}) THEN {lit(c)}' for c in rules.CATEGORIES)} ELSE 'general_info' END END AS vote FROM l""")
def parsed_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read as answers of a classifying model; an empty answer is no vote."""
    return questions(spark, sf_dir).select("conv_id", "turn", tx.parse_category(F.col("text")).alias("vote"))


_LISTINGS = [
    "https://u.edu/bengaluru/electronics-and-communication/faculty/", "https://u.edu/school/computing/bengaluru/faculty/", "https://u.edu/school/faculty/",
    "https://u.edu/eee/faculty?x=1", "https://u.edu/faculty/", "https://u.edu/a/b/", "https://u.edu/Mech/coimbatore/faculty/x/",
]
_DEPARTMENTS = [
    "Department of Electronics and Communication", "Electronics and Communication Engineering", "of the Department of Computer Science and Engineering", "EEE",
    "the School of  Mechanical Engineering", "https://x", "a b c d e f g h", "2019 batch", "", "Dept. of CSE ,", "Civil - ", "ECE: x",
]


@query(f"""
WITH u AS (SELECT url, [p FOR p IN string_split(regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', ''), '[?#].*$', ''), '/') IF p <> ''] AS parts FROM (SELECT * FROM (VALUES {', '.join(f'({lit(x)})' for x in _LISTINGS)}) UNION ALL SELECT rtrim(url, '/') || '/faculty/' FROM pages) t(url)),
v AS (SELECT url, list_position(parts, 'faculty') AS pos, [p FOR p IN list_reverse(parts[1:greatest(coalesce(list_position(parts, 'faculty'), 0) - 1, 0)]) IF p NOT IN ({', '.join(map(lit, rules.CAMPUSES))})] AS back FROM u),
w AS (SELECT url, CASE WHEN coalesce(pos, 0) > 0 AND len(back) > 0 AND back[1] <> 'school' THEN lower(replace(back[1], '-', ' ')) END AS name FROM v)
SELECT url, {sql_lookup(rules.DEPARTMENT_ALIASES, 'name', 'name')} AS department FROM w""")
def listing_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url as that of a listing, and some others."""
    own = table(spark, sf_dir, "pages").select(F.concat(F.rtrim("url", F.lit("/")), F.lit("/faculty/")).alias("url"))
    df = spark.createDataFrame([(u,) for u in _LISTINGS], "url string").unionByName(own)
    return df.select("url", tx.listing_department(F.col("url")).alias("department"))


_N = sql_collapse("raw")
for _p in (r"^\s*of\s+(?:the\s+)?", r"^\s*(?:the\s+)?(?:department|dept\.?|dep\.?|school)\s+of\s+", r"\s+engineering\s*$", r"\s+(?:and|&|,)\s*$"):
    _N = f"regexp_replace({_N}, {lit('(?i)' + _p)}, '')"
_N = f"lower(regexp_replace({_N}, '^[ ,|\\-.]+|[ ,|\\-.]+$', '', 'g'))"


@query(rf"""
WITH n AS (SELECT raw, {_N} AS s FROM (SELECT * FROM (VALUES {', '.join(f'({lit(x)})' for x in _DEPARTMENTS)}) UNION ALL SELECT text FROM conversations WHERE text IS NOT NULL UNION ALL SELECT 'Department of ' || source || ' Engineering' FROM documents WHERE source IS NOT NULL) t(raw)), a AS (SELECT raw, {sql_lookup(rules.DEPARTMENT_ALIASES, 's', 's')} AS s FROM n)
SELECT raw, CASE WHEN s <> '' AND len(regexp_extract_all(s, '\S+')) <= 7 AND NOT regexp_matches(s, 'https?://|[:*]|\d{{4}}') AND regexp_matches(s, '[a-z]') THEN s END AS department FROM a""")
def normalized_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names made of the documents' sources, all turns of conversations, of which few can be a department, and some spellings."""
    turns = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("text").alias("raw"))
    sources = table(spark, sf_dir, "documents").where("source IS NOT NULL").select(F.concat(F.lit("Department of "), "source", F.lit(" Engineering")).alias("raw"))
    df = spark.createDataFrame([(u,) for u in _DEPARTMENTS], "raw string").unionByName(turns).unionByName(sources)
    return df.select("raw", tx.normalize_department(F.col("raw")).alias("department"))


_NAMED = [*rules.DEPARTMENT_SCHOOL, ""]


@query(f"""
WITH d AS (SELECT doc_id, [{', '.join(map(lit, _NAMED))}][doc_id % {len(_NAMED)} + 1] AS a, [{', '.join(map(lit, _NAMED))}][(doc_id // {len(_NAMED)}) % {len(_NAMED)} + 1] AS b FROM documents),
c AS (SELECT *, {sql_lookup(rules.DEPARTMENT_ALIASES, 'a', 'a')} AS x, {sql_lookup(rules.DEPARTMENT_ALIASES, 'b', 'b')} AS y FROM d)
SELECT doc_id, a, b, a <> '' AND b <> '' AND (x = y OR contains(x, y) OR contains(y, x)) AS same FROM c""")
def department_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two departments of the rule table for each document."""
    names, i, n = F.array(*map(F.lit, _NAMED)), F.col("doc_id"), len(_NAMED)
    d = _docs(spark, sf_dir).select(i, F.get(names, (i % n).cast("int")).alias("a"), F.get(names, (F.expr(f"doc_id div {n}") % n).cast("int")).alias("b"))
    return d.select("doc_id", "a", "b", tx.departments_match(F.col("a"), F.col("b")).alias("same"))


# Vocabulary ----------------------------------------------------------------

_VOCAB = "SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM (SELECT text FROM documents UNION ALL SELECT text FROM benchmark)) GROUP BY word HAVING count(*) >= 2 AND length(word) >= 3"
_OOV = f"SELECT DISTINCT lower(t) AS token FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM conversations) WHERE length(t) >= 5 AND lower(t) NOT IN (SELECT word FROM ({_VOCAB}))"


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.vocabulary(_docs(spark, sf_dir).select("text").unionByName(table(spark, sf_dir, "benchmark").select("text")))


@query(_VOCAB)
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocab(spark, sf_dir)


@query(_OOV)
def oov_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.unknown(table(spark, sf_dir, "conversations"), _vocab(spark, sf_dir))


@query(f"""
SELECT token, CAST(len AS INTEGER) AS len, words FROM (SELECT token, unnest(range(length(token) - 2, length(token) + 3)) AS len FROM ({_OOV}))
JOIN (SELECT length(word) AS l, count(*) AS words FROM ({_VOCAB}) GROUP BY 1) ON l = len""")
def spell_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vocab(spark, sf_dir)
    return spelling.blocks(spelling.unknown(table(spark, sf_dir, "conversations"), v), v)


# A correction shares its letters in order with the token: 200 * shared / joint length, by bits of the token over
# the word's letters. Pairs whose edit distance is too large can't reach the cutoff and are left out first.
_LCS = """length(t) - bit_count(list_reduce(list_concat([(1::BIGINT << length(t)) - 1], [ascii(c)::BIGINT FOR c IN string_split(w, '')]), lambda f, c:
  ((f + (f & list_sum([CASE WHEN ascii(t[i]) = c THEN 1::BIGINT << (i - 1) ELSE 0 END FOR i IN range(1, length(t) + 1)])::BIGINT)) | (f - (f & list_sum([CASE WHEN ascii(t[i]) = c THEN 1::BIGINT << (i - 1) ELSE 0 END FOR i IN range(1, length(t) + 1)])::BIGINT))) & ((1::BIGINT << length(t)) - 1)))"""
FIXES_SQL = f"""
  SELECT t AS token, w AS word FROM (
    SELECT *, row_number() OVER (PARTITION BY t ORDER BY ratio DESC, length(w), w) AS r FROM (
      SELECT t, w, 200.0::DOUBLE * ({_LCS}) / (length(t) + length(w)) AS ratio FROM (
        SELECT o.token AS t, v.word AS w FROM ({_OOV}) o JOIN ({_VOCAB}) v ON abs(length(v.word) - length(o.token)) <= 2
        WHERE length(o.token) <= 60 AND levenshtein(o.token, v.word) <= 0.18 * (length(o.token) + length(v.word)))) WHERE ratio >= 82) WHERE r = 1"""
_SHAPED = "CASE WHEN word IS NULL THEN part WHEN part = upper(part) THEN upper(word) WHEN part[1] = upper(part[1]) THEN upper(word[1]) || word[2:] ELSE word END"


@query(f"""
WITH f AS ({FIXES_SQL}), p AS (
  SELECT conv_id, turn, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM (SELECT conv_id, turn, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]+') AS parts FROM conversations)
), s AS (SELECT conv_id, turn, string_agg({_SHAPED}, '' ORDER BY i) AS corrected FROM p LEFT JOIN f ON length(part) >= 5 AND lower(part) = f.token GROUP BY conv_id, turn)
SELECT c.conv_id, c.turn, coalesce(corrected, '') AS corrected FROM (SELECT DISTINCT conv_id, turn FROM conversations) c LEFT JOIN s USING (conv_id, turn)""")
def spell_correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with their unknown words corrected."""
    v = stored(_vocab(spark, sf_dir), "vocabulary")
    c = table(spark, sf_dir, "conversations").withColumn("query_id", F.struct("conv_id", "turn"))
    fixes = spelling.correct(stored(spelling.unknown(c, v), "unknown"), v)
    return spelling.corrected(c, fixes).select("query_id.*", "corrected")


# Roles, chunks, markup -----------------------------------------------------

PEOPLE = [
    ("http://u/faculty/a", "text", "Dr. A. Rao HOD, Department of Electronics and Communication, School of Engineering"),
    ("http://u/faculty/b", "faculty_card", "Dr. B. Iyer Vice-Chairperson Department of CSE Profile: http://u/faculty/b"),
    ("http://u/x", "text", "Dr. C. Head of Department"),
    ("http://u/y", "faculty_card", "Prof. D Associate Professor Mechanical Engineering, and Principal"),
    ("http://u/faculty/e", "text", "no title, the director"),
    ("http://u/faculty/f", "text", "Mr. F Professor Assistant Professor (Sl. Gd.)"),
]


@query()
def role_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roles of inline people and of every document as a record of a person."""
    own = spark.createDataFrame([(*p, -1 - i) for i, p in enumerate(PEOPLE)], "url string, kind string, text string, doc_id long")
    docs = _docs(spark, sf_dir).select(F.lit("http://u/faculty/d").alias("url"), F.lit("text").alias("kind"), "text", "doc_id")
    return roles.metadata(own.unionByName(docs), "text", "url", "kind").drop("text")


_CHUNKS = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, CAST(doc_id AS VARCHAR) AS doc_id, coalesce(source, 'document') AS title,
    CASE WHEN len(a) > 1 THEN a ELSE string_split(text, chr(10)) END AS parts FROM (SELECT *, string_split_regex(text, '\n\s*\n') AS a FROM documents)
), l AS (SELECT r, [c FOR c IN [{sql_clean("p")} FOR p IN parts] IF c <> ''] AS parts FROM d
), b AS (SELECT r, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS t FROM l
), m AS (
  SELECT r, i, length(t) AS held, 1 AS g FROM b WHERE i = 1 UNION ALL
  SELECT b.r, b.i, CASE WHEN held < 120 OR held + length(t) <= 1200 THEN held + 2 + length(t) ELSE length(t) END,
    g + CASE WHEN held < 120 OR held + length(t) <= 1200 THEN 0 ELSE 1 END FROM m JOIN b ON b.r = m.r AND b.i = m.i + 1
), s AS (SELECT r, g, string_agg(t, chr(10) || chr(10) ORDER BY i) AS text FROM m JOIN b USING (r, i) GROUP BY r, g
), p AS (SELECT r, g, unnest(range(len(a))) AS k, unnest(a) AS t FROM (SELECT r, g, string_split_regex(text, '\n\s*\n') AS a FROM s WHERE length(text) > 1200)
), n AS (SELECT r, g, k, unnest(range(len(a))) AS line, unnest(a) AS t FROM (SELECT r, g, k, string_split(t, chr(10)) AS a FROM p WHERE length(t) > 1200)
), x AS (SELECT r, g, k, line, t, unnest(range(CAST(greatest(ceil(length(t) / 1200), 1) AS BIGINT))) AS cut FROM n
), u AS (
  SELECT *, row_number() OVER (PARTITION BY r, g ORDER BY k, line, cut) AS i FROM (
    SELECT r, g, k, 0 AS line, 0 AS cut, chr(10) || chr(10) AS glue, t FROM p WHERE length(t) <= 1200 UNION ALL
    SELECT r, g, k, line, cut, CASE WHEN line + cut > 0 THEN chr(10) END, substr(t, cut * 1200 + 1, 1200) FROM x)
), f AS (
  SELECT r, g, i, length(t) AS held, 1 AS piece FROM u WHERE i = 1 UNION ALL
  SELECT u.r, u.g, u.i, CASE WHEN held > 0 AND held + length(glue) + length(t) <= 1200 THEN held + length(glue) + length(t) ELSE length(t) END,
    piece + CASE WHEN held > 0 AND held + length(glue) + length(t) <= 1200 THEN 0 ELSE 1 END FROM f JOIN u ON u.r = f.r AND u.g = f.g AND u.i = f.i + 1
), y AS (
  SELECT r, g, piece, string_agg(CASE WHEN i = least_i THEN t ELSE glue || t END, '' ORDER BY i) AS body
  FROM (SELECT u.*, piece, min(i) OVER (PARTITION BY r, g, piece) AS least_i FROM f JOIN u USING (r, g, i)) GROUP BY r, g, piece
  UNION ALL SELECT r, g, 1, text FROM s WHERE length(text) <= 1200
), z AS (
  SELECT r, g, body, row_number() OVER (PARTITION BY r, g ORDER BY piece) AS part, count(*) OVER (PARTITION BY r, g) AS n_parts,
    row_number() OVER (PARTITION BY r ORDER BY g, piece) - 1 AS place, first_value(body) OVER (PARTITION BY r, g ORDER BY piece) AS head FROM y WHERE body <> ''
), w AS (
  SELECT z.*, CASE WHEN n_parts > 1 AND length(string_split(s.text, chr(10))[1]) <= 1200 THEN {sql_strip("string_split(head, chr(10))[1]")} ELSE '' END AS lead FROM z JOIN s USING (r, g)
)
SELECT 'upload:' || doc_id || ':' || place AS chunk_id, doc_id, title, 1 AS page, 'upload' AS source_type,
  'From ' || title || ', page 1:' || CASE WHEN n_parts > 1 THEN ' (part ' || part || ' of ' || n_parts || ')' ELSE '' END || chr(10) || chr(10)
  || CASE WHEN part > 1 AND lead <> '' AND NOT contains(body, lead) THEN lead || chr(10) ELSE '' END || body AS content FROM w JOIN d USING (r)"""


@query(_CHUNKS)
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("title", F.coalesce("source", F.lit("document")))
    return chunking.chunks(chunking.text_blocks(docs))


_EDGE = r"[^\p{L}\p{N}_]"
_MARKED = "'# Answer' || repeat(chr(10), 2) || '**Note** and *this* [1], see [site](https://x.y)' || chr(10) || '- one' || chr(10) || '* two `code`' || repeat(chr(10), 4) || coalesce(text, '')"
for _pattern, _to in [
    (r"(?m)^#{1,6}\s*(.+)$", r"*\1*"), (r"\*\*(.+?)\*\*", "\x01\\1\x01"), (rf"(^|{_EDGE})\*([^\s*](?:[^*\n]*[^\s*])?)\*($|{_EDGE})", r"\1_\2_\3"), ("\x01", "*"), (r"\[([^\]]+)\]\((https?://[^)]+)\)", r"\1 (\2)"),
    (r"(?m)^[ \t]*[-*][ \t]+", "• "), (r"`([^`]+)`", r"```\1```"), (r"\s*\[\d+\]", ""), (r"\n{3,}", "\n\n"),
]:
    _MARKED = f"regexp_replace({_MARKED}, {lit(_pattern)}, {lit(_to)}, 'g')"
_REFUSED = " OR ".join(f"contains(lower(coalesce(text, '')), {lit(d)})" for d in rules.DECLINES)


@query(f"""
WITH m AS (SELECT conv_id, turn, {sql_strip(_MARKED)} AS t, {_REFUSED} AS refused FROM conversations WHERE role = 'assistant'),
n AS (SELECT conv_id, turn, t || CASE WHEN turn % 2 = 1 AND NOT refused THEN chr(10) || chr(10) || '_This one I''m less sure about — worth confirming._' ELSE '' END
  || CASE WHEN NOT refused THEN chr(10) || chr(10) || '*Sources:*' || chr(10) || 'https://x.y/1' || chr(10) || 'https://x.y/2' ELSE '' END AS t FROM m)
SELECT conv_id, turn, CASE WHEN length(t) > 4096 THEN regexp_replace(substr(t, 1, 4076), '\\s+$', '') || chr(10) || chr(10) || '…(truncated)' ELSE t END AS message FROM n""".replace("\\\\", "\\"))
def markup_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as messenger texts, with heading, bold, italics, link, list and citation put around."""
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    rich = F.concat(F.lit("# Answer\n\n**Note** and *this* [1], see [site](https://x.y)\n- one\n* two `code`\n\n\n\n"), F.coalesce("text", F.lit("")))
    urls = F.array(F.lit("https://x.y/1"), F.lit("https://x.y/2"))
    return c.select("conv_id", "turn", tx.markup(rich, urls, F.when(F.col("turn") % 2 == 1, "medium").otherwise("high"), tx.declined(F.col("text"))).alias("message"))
