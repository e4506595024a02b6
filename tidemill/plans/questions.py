"""The whole path of a question, for every user turn of the conversations, with stand-ins for the models."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import rules
from tidemill.functions import text as tx
from tidemill.operators import chat, questions
from tidemill.plans.answers import _FAILURE, _MODELS, _MODES, _REFUSAL, _RULES
from tidemill.plans.chat import _PAIRS
from tidemill.plans.registry import lit, query, sql_collapse, sql_strip
from tidemill.plans.retrieval import _ROUTED_DEPARTMENTS, _sql_confidence, _sql_leg, _sql_signals, sql_routed
from tidemill.plans.texts import _EXPANSIONS, _FOLLOW, _OOV, _SCORES, _SHAPED, _VOCAB, FIXES_SQL, _vocab
from tidemill.session import stored, table

# Stand-ins for models, each a rule that SQL can say, too ---------------------------


def _rewrite(inputs: list[str]) -> list[str | None]:
    out = []
    for x in map(json.loads, inputs):
        text = x["question"]
        first = x["history"].split("\n")[0][6:]
        out.append(None if len(text) % 5 == 0 else "w " * 50 if len(text) % 7 == 0 else f'"{first} {text}" ')
    return out


def _embed(texts: list[str]) -> list[list[float]]:
    """How often each letter occurs, and a constant."""
    return [[float(t.count(chr(97 + i)) + t.count(chr(65 + i))) for i in range(26)] + [1.0] for t in texts]


def _rerank(pairs: list[str]) -> list[float]:
    """Numbers from 0 to 1 with many ties; short contents are worth less for some questions, and all are for others."""
    sizes = [(len(x.get("query", "")), len(x.get("content", ""))) for x in map(json.loads, pairs)]
    return [(3 * q + c) % 7 * (q % 4) * (q % 3 if c < 1000 else 2) / 36 for q, c in sizes]


def _voters() -> list[Column]:
    return [tx.keyword_category(F.col("text")), F.when(F.length("text") % 2 == 0, "general_info")]


def _sql_letters(text: str) -> str:
    one = [f"CAST(2 * length({text}) - length(replace({text}, '{chr(97 + i)}', '')) - length(replace({text}, '{chr(65 + i)}', '')) AS DOUBLE)" for i in range(26)]
    return f"[{', '.join(one)}, 1.0::DOUBLE]"


# The corpus: documents play web chunks, benchmark items uploads ----------------------

_WEB = f"""SELECT doc_id AS vec_id, coalesce(text, '') AS content, {_sql_letters("coalesce(text, '')")} AS embedding, 'http://d/' || doc_id AS source_url,
  CASE WHEN doc_id % 41 = 3 THEN 'principal' ELSE 'faculty' END AS designation, doc_id % 7 = 5 AS is_department_head,
  CASE doc_id % 11 {' '.join(f"WHEN {i} THEN {lit(d)}" for i, d in enumerate(_ROUTED_DEPARTMENTS))} END AS department,
  CASE doc_id % 10 WHEN 0 THEN 'computing' WHEN 1 THEN 'electronics and communication' WHEN 2 THEN 'mechanical' END AS department_canon FROM documents"""
_UPLOADS = f"""SELECT item_id AS vec_id, coalesce(text, '') AS content, {_sql_letters("coalesce(text, '')")} AS embedding, 'item ' || item_id || ' (page ' || (item_id % 9 + 1) || ')' AS source_url FROM benchmark"""


def _web(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(i, F.coalesce("text", F.lit("")).alias("content"))
    canon = F.when(i % 10 == 0, "computing").when(i % 10 == 1, "electronics and communication").when(i % 10 == 2, "mechanical")
    d = d.select(
        i.alias("vec_id"), "content", F.concat(F.lit("http://d/"), i.cast("string")).alias("source_url"), F.when(i % 41 == 3, "principal").otherwise("faculty").alias("designation"),
        (i % 7 == 5).alias("is_department_head"), F.get(F.array(*map(F.lit, _ROUTED_DEPARTMENTS)), i % 11).alias("department"), canon.alias("department_canon"),
    )
    return stored(questions.embedded(d, _embed, "content", "embedding"), "web")


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("item_id")
    b = table(spark, sf_dir, "benchmark").select(i.alias("vec_id"), F.coalesce("text", F.lit("")).alias("content"), F.concat(F.lit("item "), i.cast("string")).alias("title"), (i % 9 + 1).alias("page"))
    return stored(questions.embedded(b, _embed, "content", "embedding"), "uploads")


_LINE = rf"""'User: ' || question || chr(10) || 'Assistant: ' || substr({sql_collapse(r"regexp_replace(regexp_replace(answer, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '(?s)<div.*?</div>', '', 'g')")}, 1, 300)"""
_OF_ASKED = FIXES_SQL.replace(_OOV, _OOV.replace("(SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS t FROM conversations)", "(SELECT unnest(regexp_extract_all(asked, '[A-Za-z]+')) AS t FROM w)").replace(f"({_VOCAB})", "vocab")).replace(f"({_VOCAB})", "vocab")
_SAID = """regexp_replace(trim(CASE WHEN length(text) % 5 = 0 THEN NULL WHEN length(text) % 7 = 0 THEN repeat('w ', 50) ELSE '"' || split_part(history, chr(10), 1)[7:] || ' ' || text || '" ' END), '^"+|"+$', '', 'g')"""
_RERANKED = """SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieved) AS INTEGER) AS pos FROM (
  SELECT p.query_id, p.vec_id, p.pos AS retrieved, CAST((3 * length({text}) + length(c.content)) % 7 * (length({text}) % 4) * CASE WHEN length(c.content) < 1000 THEN length({text}) % 3 ELSE 2 END AS DOUBLE) / 36 AS score FROM {pool} p JOIN {chunks} c ON c.vec_id = p.vec_id {more})"""


def _sql_side(pool: str, profile: str, filtered: str) -> str:
    signals = _sql_signals(f"SELECT * FROM {pool}", profile)
    with_votes = f"SELECT s.*, coalesce(v.agreement, 0.0) AS agreement, f.filtered FROM ({signals}) s LEFT JOIN votes v ON v.query_id = s.query_id JOIN (SELECT query_id, bool_or({filtered}) AS filtered FROM {pool} GROUP BY 1) f ON f.query_id = s.query_id"
    return f"SELECT query_id, band, final, mode FROM ({_sql_confidence(with_votes, profile, 'filtered', 'agreement')})"


_LEVEL = "CASE {} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END"
_ANSWERED = rf"""
WITH vocab AS MATERIALIZED ({_VOCAB}), webs AS MATERIALIZED ({_WEB}), ups AS MATERIALIZED ({_UPLOADS}),
l AS (SELECT conv_id, turn, {_LINE} AS line FROM ({_PAIRS})),
u AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, turn, text FROM conversations WHERE role = 'user'),
h AS (SELECT query_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM (
  SELECT u.query_id, l.turn, l.line, row_number() OVER (PARTITION BY u.query_id ORDER BY l.turn DESC) AS r FROM u JOIN l ON l.conv_id = u.conv_id AND l.turn < u.turn) WHERE r <= 2 GROUP BY 1),
t AS (SELECT u.query_id, text, coalesce(history, '') AS history, {sql_strip("coalesce(text, '')")} AS s FROM u LEFT JOIN h USING (query_id)),
x AS (SELECT *, CASE WHEN history <> '' AND s <> '' AND ({_FOLLOW} OR len(regexp_extract_all(s, '\S+')) < 3) THEN {_SAID} END AS said FROM t),
w AS MATERIALIZED (SELECT query_id, coalesce(said <> '' AND len(regexp_extract_all(said, '\S+')) <= 40, FALSE) AS was_rewritten, CASE WHEN said <> '' AND len(regexp_extract_all(said, '\S+')) <= 40 THEN said ELSE text END AS asked FROM x),
fixes AS MATERIALIZED ({_OF_ASKED}),
parts AS (SELECT query_id, unnest(parts) AS part, unnest(range(len(parts))) AS i FROM (SELECT query_id, regexp_extract_all(coalesce(asked, ''), '[A-Za-z]+|[^A-Za-z]+') AS parts FROM w)),
spelled AS (SELECT query_id, string_agg({_SHAPED}, '' ORDER BY i) AS text FROM parts LEFT JOIN fixes f ON length(part) >= 5 AND lower(part) = f.token GROUP BY query_id),
e AS (SELECT query_id, text, [x FOR x IN [{_EXPANSIONS}] IF x IS NOT NULL] AS e FROM (SELECT w.query_id, coalesce(s.text, '') AS text FROM w LEFT JOIN spelled s USING (query_id))),
q0 AS MATERIALIZED (SELECT query_id, CASE WHEN len(d) > 0 THEN text || ' ' || list_aggregate(d, 'string_agg', ' ') ELSE text END AS text FROM (
  SELECT *, [e[i] FOR i IN range(1, len(e) + 1) IF list_position(e, e[i]) = i][1:4] AS d FROM e)),
asks AS MATERIALIZED (SELECT query_id, text, {_sql_letters('text')} AS vector FROM q0),
scores AS (SELECT query_id, [{', '.join(_SCORES.values())}] AS n, length(text) AS size FROM q0),
each AS (SELECT query_id, 0 AS pos, CASE WHEN list_max(n) > 0 THEN [{', '.join(map(lit, _SCORES))}][list_position(n, list_max(n))] ELSE 'general_info' END AS label FROM scores
  UNION ALL SELECT query_id, 1, 'general_info' FROM scores WHERE size % 2 = 0),
counted AS (SELECT query_id, label, count(*) AS n, min(pos) AS first FROM each GROUP BY ALL),
votes AS MATERIALIZED (SELECT query_id, label, round(n / greatest(5, total), 4) AS agreement FROM (
  SELECT *, sum(n) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, first, label) AS r FROM counted) WHERE r = 1),
routed AS MATERIALIZED ({sql_routed("SELECT * FROM webs", "SELECT query_id, vector, text FROM asks")}),
found AS MATERIALIZED ({_RERANKED.format(text="p.rerank_text", pool="routed", chunks="webs", more="")}),
web_pool AS MATERIALIZED (SELECT f.*, r.route, r.filtered FROM found f JOIN routed r ON r.query_id = f.query_id AND r.vec_id = f.vec_id),
nearby AS MATERIALIZED ({_sql_leg("SELECT * FROM asks", "q.query_id <> v.vec_id", rules.POOL).replace("JOIN chunks v", "JOIN ups v")}),
up_pool AS MATERIALIZED ({_RERANKED.format(text="a.text", pool="nearby", chunks="ups", more="JOIN asks a ON a.query_id = p.query_id")}),
web AS ({_sql_side("web_pool", "web", "filtered")}), upload AS ({_sql_side("up_pool", "upload", "FALSE")}),
picked AS (SELECT query_id, CASE WHEN {_LEVEL.format('up.band')} > {_LEVEL.format('w.band')} THEN 'upload' WHEN {_LEVEL.format('w.band')} > {_LEVEL.format('up.band')} THEN 'web'
  WHEN up.final >= 0.98::DOUBLE * w.final THEN 'upload' ELSE 'web' END AS store FROM web w FULL JOIN upload up USING (query_id)),
winner AS (SELECT query_id, store, CASE store WHEN 'web' THEN w.band ELSE up.band END AS band, CASE store WHEN 'web' THEN w.final ELSE up.final END AS final,
  CASE store WHEN 'web' THEN w.mode ELSE up.mode END AS mode FROM picked LEFT JOIN web w USING (query_id) LEFT JOIN upload up USING (query_id)),
kept AS (SELECT query_id, pos, c.content, c.source_url, route, 'web' AS store FROM web_pool JOIN webs c USING (vec_id) WHERE pos <= 5
  UNION ALL SELECT query_id, pos, c.content, c.source_url, 'uploaded_documents', 'upload' FROM up_pool JOIN ups c USING (vec_id) WHERE pos <= 5),
context AS (SELECT query_id, any_value(route) AS route, list(source_url ORDER BY pos) AS urls,
  string_agg('[' || pos || '] Source: ' || source_url || chr(10) || substr({sql_collapse('content')}, 1, 1400), chr(10) || chr(10) ORDER BY pos) AS context FROM kept JOIN picked USING (query_id, store) GROUP BY query_id),
r AS (SELECT w.query_id, asked, was_rewritten, a.text AS query, c.route, store, band, final, mode, v.label, urls, band <> 'low' AS called,
  length({lit(_RULES)} || CASE WHEN mode = 'assert' THEN {lit(_MODES["assert"])} ELSE {lit(_MODES["disambiguate"])} END || chr(10) || chr(10) || 'Context:' || chr(10) || chr(10) || context
    || chr(10) || chr(10) || 'Question: ' || a.text || chr(10) || chr(10) || 'Answer:') AS n
  FROM w JOIN asks a USING (query_id) LEFT JOIN winner USING (query_id) LEFT JOIN context c USING (query_id) LEFT JOIN votes v USING (query_id)),
g AS (SELECT *, CASE WHEN NOT called THEN NULL WHEN n % 3 = 0 THEN 'See [2], also [1] ' || n WHEN n % 5 = 0 THEN NULL WHEN n % 2 = 0 THEN 'I don''t have that information. [1]' ELSE 'In [3] and [1].' END AS given,
  CASE WHEN NOT called THEN NULL WHEN n % 3 = 0 THEN 'a/first' WHEN n % 5 <> 0 THEN 'c/third' END AS model FROM r)
SELECT query_id, asked, was_rewritten, query, route, store, band, round(final, 6) AS final, mode, label, CASE WHEN NOT called THEN {lit(_REFUSAL)} ELSE coalesce(given, {lit(_FAILURE)}) END AS answer,
  CASE WHEN given LIKE 'See%' THEN concat_ws(',', urls[1], urls[2]) WHEN given LIKE 'In%' THEN concat_ws(',', urls[1], urls[3]) ELSE '' END AS sources, model,
  given IS NULL OR contains(given, 'don''t have') AS declined, CASE WHEN NOT called THEN 'confidence below threshold — generation skipped' WHEN given IS NULL THEN 'all generation models failed' END AS reason FROM g"""


@query(_ANSWERED)
def answered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with the exchanges before it, through all steps to its answer."""
    turns = chat.histories(table(spark, sf_dir, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text", "history")
    models = questions.Models(_rewrite, _embed, _rerank, _MODELS, _voters())
    wording = {"rules": _RULES, "by_mode": _MODES, "refusal": _REFUSAL, "failure": _FAILURE}
    out = questions.answered(turns, _web(spark, sf_dir), _uploads(spark, sf_dir), stored(_vocab(spark, sf_dir), "vocabulary"), models, wording)
    return out.drop("failures").withColumns({"final": F.round("final", 6), "sources": F.array_join("sources", ",")})
