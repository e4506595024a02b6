"""Queries over vectors: pools, confidence, arbitration, votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import rules
from tidemill.operators import evaluation, ranking, retrieval, routing, scoring, vector_index
from tidemill.plans.registry import lit, query, sql_lookup
from tidemill.plans.texts import ASKS_PEOPLE, CANON, DEPT, EXAMPLES, HEAD, PRINCIPAL, SCHOOL, TAG
from tidemill.session import scratch, table

#: Vectors with an id divisible by this are the stated query set; all others are searched.
EVERY = 100


def _queries(v: DataFrame) -> DataFrame:
    return v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


def _pool(spark: SparkSession, sf_dir: str, filtered: bool = False, n: int = rules.POOL) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return retrieval.pools(_queries(v), v, n, same_label=filtered)


def _sql_pool(filtered: bool = False, n: int = rules.POOL) -> str:
    where = " AND q.label = v.label" if filtered else ""
    return f"""SELECT * FROM (
      SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS pos FROM (
        SELECT q.vec_id AS query_id, v.vec_id, greatest(0.0, least(1.0, round(
          list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))
          / (sqrt(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])))), 9))) AS score
        FROM embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id{where} WHERE q.vec_id % {EVERY} = 0)) WHERE pos <= {n}"""


def _sql_signals(pool: str, profile: str, k: int = 5, key: str = "query_id") -> str:
    p = rules.PROFILES[profile]
    sep = f"CASE WHEN coalesce(tail, others) IS NULL THEN 0.0::DOUBLE ELSE 1 / (1 + exp(-((log_ratio - {p['sep_mid']}::DOUBLE) / {p['sep_temp']}::DOUBLE))) END" if p["use_sep"] else "0.0::DOUBLE"
    return f"""SELECT {key}, pool_size, top1, log_ratio, 1 / (1 + exp(-((top1 - {p['abs_mid']}::DOUBLE) / {p['abs_temp']}::DOUBLE))) AS abs, {sep} AS sep,
      CASE WHEN second IS NULL THEN 1.0::DOUBLE ELSE tanh((first - second) / {rules.RANK_TEMP}::DOUBLE) END AS rank
    FROM (SELECT *, log10((first + 0.0001::DOUBLE) / (coalesce(tail, others) + 0.0001::DOUBLE)) AS log_ratio FROM (
      SELECT {key}, count(*) AS pool_size, max(score) AS top1, max(score) FILTER (pos = 1) AS first, max(score) FILTER (pos = 2) AS second,
        avg(score) FILTER (pos > {k}) AS tail, avg(score) FILTER (pos > 1) AS others FROM ({pool}) GROUP BY {key}))"""


def _sql_confidence(signals: str, profile: str, filtered: str, agreement: str = "1.0", key: str = "query_id") -> str:
    sc = f"CASE WHEN {filtered} THEN greatest(abs, rank) ELSE greatest(abs, sep) END" if rules.PROFILES[profile]["use_sep"] else "abs"
    return f"""SELECT {key}, pool_size, top1, abs, sep, rank, set_confidence, final,
      CASE WHEN final >= 0.70 THEN 'high' WHEN final >= 0.35 THEN 'medium' ELSE 'low' END AS band,
      CASE WHEN rank >= 0.30 THEN 'assert' ELSE 'disambiguate' END AS mode
    FROM (SELECT *, set_confidence * (0.7::DOUBLE + 0.3::DOUBLE * {agreement}) AS final FROM (SELECT *, {sc} AS set_confidence FROM ({signals})))"""


_ROUNDED = ("top1", "abs", "sep", "rank", "set_confidence", "final")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in (names or _ROUNDED) else F.col(c) for c in df.columns])


def _sql_rounded(sql: str, names: tuple[str, ...] = _ROUNDED, keep: str = "* EXCLUDE") -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({n}, 6) AS {n}' for n in names)}) FROM ({sql})"


@query("SELECT query_id, pos, vec_id, round(score, 6) AS score FROM (" + _sql_pool() + ")")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_pool(spark, sf_dir), "score")


@query("SELECT query_id, pos, vec_id, round(score, 6) AS score FROM (" + _sql_pool(True, rules.FILTERED_POOL) + ")")
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metadata filter acts before ranking."""
    return _rounded(_pool(spark, sf_dir, True, rules.FILTERED_POOL), "score")


def _indexed(spark: SparkSession, sf_dir: str, filtered: bool, n: int) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    index = vector_index.VectorIndex.build(v, scratch(spark, "index"))
    return _rounded(index.search(_queries(v), v, n, same_label=filtered), "score")


@query("SELECT query_id, pos, vec_id, round(score, 6) AS score FROM (" + _sql_pool() + ")")
def indexed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index over all vectors, searched until its bounds prove the result."""
    return _indexed(spark, sf_dir, False, rules.POOL)


@query("SELECT query_id, pos, vec_id, round(score, 6) AS score FROM (" + _sql_pool(True, rules.FILTERED_POOL) + ")")
def indexed_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir, True, rules.FILTERED_POOL)


_FRESH = f"SELECT vec_id, CASE WHEN vec_id % 3 = 1 THEN [-x FOR x IN embedding] ELSE embedding END AS embedding, label FROM embeddings WHERE vec_id % {EVERY} = 0 OR vec_id % 7 <> 2"


@query("WITH fresh AS (" + _FRESH + ") SELECT query_id, pos, vec_id, round(score, 6) AS score FROM (" + _sql_pool().replace("JOIN embeddings v", "JOIN fresh v").replace("FROM embeddings q", "FROM fresh q") + ")")
def indexed_topk_after_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the vectors is replaced by its opposites and a seventh deleted, by id, in the built index."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    index = vector_index.VectorIndex.build(v, scratch(spark, "index"))
    turned = v.where("vec_id % 3 = 1").withColumn("embedding", F.transform("embedding", lambda x: -x))
    gone = f"vec_id % {EVERY} <> 0 AND vec_id % 7 = 2"
    index.upsert(turned)
    index.delete(v.where(gone).select("vec_id"))
    now = v.where("vec_id % 3 <> 1").unionByName(turned).where(f"NOT ({gone})")
    return _rounded(index.search(_queries(now), now, rules.POOL), "score")


def _confidence(pool: DataFrame, profile: str, filtered: bool) -> DataFrame:
    return scoring.confidence(scoring.signals(pool, ["query_id"], rules.TOP_K, profile), F.lit(filtered), F.lit(1.0), profile).drop("log_ratio")


# The labels of the first five plain results are the voters.
_VOTES = f"""
  SELECT query_id, round(max(n) / greatest(5, sum(n)), 4) AS agreement FROM (
    SELECT p.query_id, v.label, count(*) AS n FROM ({_sql_pool(n=5)}) p JOIN embeddings v ON v.vec_id = p.vec_id WHERE v.label IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""
_FLAGSHIP = " UNION ALL ".join(
    f"SELECT *, '{name}' AS pool FROM ("
    + _sql_confidence(f"SELECT s.*, coalesce(e.agreement, 0.0) AS agreement FROM ({_sql_signals(_sql_pool(f), 'web')}) s LEFT JOIN ({_VOTES}) e ON e.query_id = s.query_id", "web", str(f), "agreement")
    + ")"
    for name, f in (("plain", False), ("filtered", True))
)


@query(_sql_rounded(_FLAGSHIP))
def flagship_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both pools of each query vector: signals, the voters' agreement, confidence, band and mode."""
    pool = _pool(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    votes = scoring.votes(pool.where("pos <= 5").join(labels, "vec_id"), ["query_id"], "label", "pos").select("query_id", "agreement")

    def scored(pool: DataFrame, filtered: bool) -> DataFrame:
        found = scoring.signals(pool, ["query_id"], rules.TOP_K, "web").join(votes, "query_id", "left")
        return scoring.confidence(found, F.lit(filtered), F.coalesce("agreement", F.lit(0.0)), "web").drop("log_ratio", "agreement")

    plain = scored(pool, False).withColumn("pool", F.lit("plain"))
    filtered = scored(_pool(spark, sf_dir, True), True).withColumn("pool", F.lit("filtered"))
    return _rounded(plain.unionByName(filtered))


# Every question of the examples is asked with every query vector; rules on vec_id give the chunks their metadata.
_ROUTED_DEPARTMENTS = ["Electronics and Communication", "ece", "Mechanical Engineering", "physics", "", "computer science", "business"]
_CHUNKS_SQL = f"""SELECT *, CASE WHEN vec_id % 41 = 3 THEN 'principal' ELSE 'faculty' END AS designation, vec_id % 7 = 5 AS is_department_head,
  CASE vec_id % 11 {' '.join(f"WHEN {i} THEN {lit(d)}" for i, d in enumerate(_ROUTED_DEPARTMENTS))} END AS department,
  CASE label WHEN 0 THEN 'computing' WHEN 1 THEN 'electronics and communication' WHEN 2 THEN 'mechanical' END AS department_canon FROM embeddings"""
_ASKED_SQL = f"""SELECT -(v.vec_id * 100 + e.i) AS query_id, v.embedding AS vector, e.text FROM embeddings v
  CROSS JOIN (VALUES {', '.join(f'({i}, {lit(t)})' for i, t in enumerate(EXAMPLES, 1))}) e(i, text) WHERE v.vec_id % {EVERY} = 0"""


def _sql_leg(asked: str, where: str, n: int) -> str:
    return _sql_pool(n=n).replace("embeddings q JOIN embeddings v ON q.vec_id <> v.vec_id", f"({asked}) q JOIN chunks v ON {where}").replace("q.vec_id AS query_id", "q.query_id").replace("q.embedding", "q.vector").replace(
        f" WHERE q.vec_id % {EVERY} = 0", ""
    )


_ROUTED = f"""
WITH chunks AS (CHUNKS), a AS (
  SELECT *, {PRINCIPAL} AS principal, {HEAD} AS head, {ASKS_PEOPLE} AS people, {DEPT} AS dept, {SCHOOL} AS asked FROM (ASKED)
), b AS (SELECT *, {CANON} AS canon, CASE WHEN principal THEN asked ELSE {sql_lookup(rules.DEPARTMENT_SCHOOL, 'dept')} END AS school FROM a
), q AS (SELECT *, {TAG} AS tag, CASE WHEN principal THEN 'principal' WHEN dept IS NOT NULL AND head THEN 'head' WHEN dept IS NOT NULL AND people THEN 'people' ELSE 'plain' END AS intent FROM b
), people AS ({_sql_leg("SELECT * FROM q WHERE intent = 'people'", "v.department_canon = q.tag", rules.DEPARTMENT_POOL)}
), heads AS ({_sql_leg("SELECT * FROM q WHERE intent = 'head'", "v.is_department_head", rules.FILTERED_POOL)}
), own AS (
  SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY pos) AS INTEGER) AS pos FROM (
    SELECT h.*, q.canon AS x, lower(trim(v.department)) AS d, {sql_lookup(rules.DEPARTMENT_ALIASES, 'lower(trim(v.department))', 'lower(trim(v.department))')} AS y
    FROM heads h JOIN q USING (query_id) JOIN chunks v ON v.vec_id = h.vec_id) WHERE d <> '' AND (x = y OR contains(x, y) OR contains(y, x))
), principals AS ({_sql_leg("SELECT * FROM q WHERE intent = 'principal' OR (intent = 'head' AND school IS NOT NULL AND query_id NOT IN (SELECT query_id FROM own))", "v.designation = 'principal'", rules.FILTERED_POOL)}
), plain AS ({_sql_leg("SELECT * FROM q WHERE query_id NOT IN (SELECT query_id FROM people UNION ALL SELECT query_id FROM own UNION ALL SELECT query_id FROM principals)", "TRUE", rules.POOL)}
), found AS (
  SELECT query_id, pos, vec_id, score, 'people' AS leg FROM people UNION ALL SELECT query_id, pos, vec_id, score, 'own' FROM own
  UNION ALL SELECT query_id, pos, vec_id, score, 'principal' FROM principals UNION ALL SELECT query_id, pos, vec_id, score, 'plain' FROM plain
)
SELECT query_id, pos, vec_id, round(score, 6) AS score, CASE leg WHEN 'people' THEN 'faculty_' || tag WHEN 'own' THEN 'department_heads' WHEN 'principal' THEN 'principal_' || school END AS route,
  leg <> 'plain' AS filtered, CASE WHEN leg = 'principal' THEN concat_ws(' ', text, {sql_lookup(rules.SCHOOL_NAMES, 'school')}) ELSE text END AS rerank_text FROM found JOIN q USING (query_id)"""


def sql_routed(chunks: str, asked: str) -> str:
    return _ROUTED.replace("CHUNKS", chunks).replace("ASKED", asked)


@query(sql_routed(_CHUNKS_SQL, _ASKED_SQL))
def routed_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool each question is sent to, with all fallbacks, for every example question with every query vector."""
    v = table(spark, sf_dir, "embeddings")
    n = F.col("vec_id") % 11
    canon = F.when(F.col("label") == 0, "computing").when(F.col("label") == 1, "electronics and communication").when(F.col("label") == 2, "mechanical")
    chunks = v.withColumns(
        {
            "designation": F.when(F.col("vec_id") % 41 == 3, "principal").otherwise("faculty"),
            "is_department_head": F.col("vec_id") % 7 == 5,
            "department": F.get(F.array(*map(F.lit, _ROUTED_DEPARTMENTS)), n),
            "department_canon": canon,
        }
    )
    asked = F.posexplode(F.array(*map(F.lit, EXAMPLES))).alias("i", "text")
    questions = v.where(F.col("vec_id") % EVERY == 0).select("vec_id", F.col("embedding").alias("vector"), asked)
    questions = questions.select((-(F.col("vec_id") * 100 + F.col("i") + 1)).alias("query_id"), "vector", "text")
    return _rounded(routing.routed_pools(questions, chunks), "score")


@query(_sql_rounded(_sql_confidence(_sql_signals(_sql_pool(), "upload"), "upload", "FALSE")))
def confidence_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_confidence(_pool(spark, sf_dir), "upload", False))


def _half(spark: SparkSession, sf_dir: str, odd: int, profile: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return _confidence(retrieval.pools(_queries(v), v.where(F.col("label") % 2 == odd), rules.POOL), profile, False)


def _sql_half(odd: int, profile: str) -> str:
    return _sql_confidence(_sql_signals(_sql_pool().replace("q.vec_id <> v.vec_id", f"q.vec_id <> v.vec_id AND v.label % 2 = {odd}"), profile), profile, "FALSE")


_LEVEL = "CASE {} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END"


@query(f"""
WITH w AS ({_sql_half(0, 'web')}), u AS ({_sql_half(1, 'upload')}),
j AS (SELECT coalesce(w.query_id, u.query_id) AS query_id, w.band AS band_web, w.final AS fw, u.band AS band_upload, u.final AS fu FROM w FULL JOIN u ON w.query_id = u.query_id)
SELECT query_id, band_web, round(fw, 6) AS final_web, band_upload, round(fu, 6) AS final_upload,
  CASE WHEN {_LEVEL.format('band_upload')} > {_LEVEL.format('band_web')} THEN 'upload' WHEN {_LEVEL.format('band_web')} > {_LEVEL.format('band_upload')} THEN 'web'
    WHEN fu >= 0.98::DOUBLE * fw THEN 'upload' ELSE 'web' END AS store FROM j""")
def arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by parity stand in for two stores, each with its own profile."""
    out = scoring.arbitrate(_half(spark, sf_dir, 0, "web"), _half(spark, sf_dir, 1, "upload"), ["query_id"])
    return _rounded(out, "final_web", "final_upload")


@query(f"""
WITH c AS (SELECT label, list(x ORDER BY i) AS centroid FROM (
  SELECT label, i, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS x FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label),
s AS (SELECT q.vec_id AS query_id, c.label AS category, round(list_inner_product(CAST(q.embedding AS DOUBLE[]), c.centroid), 9) AS score
  FROM embeddings q, c WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, category, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, category) AS r FROM s) WHERE r = 1""")
def nearest_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label whose mean vector is nearest; equal scores go to the first label."""
    v = table(spark, sf_dir, "embeddings")
    c = retrieval.centroids(v).select(F.col("label").alias("category"), F.transform("centroid", lambda x: F.round(x, 9)).alias("centroid"))
    return _rounded(retrieval.nearest_centroid(_queries(v).select("query_id", "vector"), c), "score")


@query("""
WITH c AS (SELECT user_id, event_type AS label, count(*) AS n, min(event_id) AS first FROM events WHERE event_type IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, sum(n) OVER (PARTITION BY user_id) AS total, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first, label) AS r FROM c)
SELECT user_id, label, n, CAST(total AS BIGINT) AS total, round(n / greatest(5, total), 4) AS agreement FROM r WHERE r = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.votes(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query(f"""
WITH p AS ({_sql_pool()}), r AS (
  SELECT query_id, vec_id, pos AS retrieved, CAST((vec_id * 7) % 5 AS DOUBLE) AS score FROM p)
SELECT query_id, vec_id, retrieved, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieved) AS INTEGER) AS pos,
  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, retrieved) <= 5 AS kept FROM r""")
def rerank_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score with many ties shows that equal scores keep their retrieval order."""
    return retrieval.rerank(_pool(spark, sf_dir).drop("score"), ((F.col("vec_id") * 7) % 5).cast("double"))


@query(f"""
WITH scoped AS ({_sql_pool().replace('q.vec_id <> v.vec_id', 'q.vec_id <> v.vec_id AND v.label = q.label AND q.label < 5')}), plain AS ({_sql_pool()})
SELECT query_id, pos, vec_id, round(score, 6) AS score, TRUE AS filtered FROM scoped UNION ALL
SELECT query_id, pos, vec_id, round(score, 6) AS score, FALSE AS filtered FROM plain WHERE query_id NOT IN (SELECT query_id FROM scoped)""")
def empty_pool_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    scoped = retrieval.pools(_queries(v).where("label < 5"), v, rules.POOL, same_label=True)
    return _rounded(retrieval.with_fallback(scoped, _pool(spark, sf_dir)), "score")


@query(f"""
SELECT query_id, round(top1, 6) AS top1, argmax, round(top1 / nullif((s - top1) / nullif(n - 1, 0), 0), 6) AS ratio FROM (
  SELECT query_id, max(score) AS top1, arg_max(pos, (score, -pos)) AS argmax, sum(score) AS s, count(*) AS n FROM ({_sql_pool()}) GROUP BY query_id)""")
def pool_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir).withColumnRenamed("pos", "retrieved")
    return _rounded(evaluation.describe_pool(pool, "query_id"), "top1", "ratio")


@query(f"""
SELECT query_id, round(top1, 6) AS top1, round(top2, 6) AS top2, round(floor, 6) AS floor, round((top1 + 0.0001::DOUBLE) / (floor + 0.0001::DOUBLE), 6) AS ratio FROM (
  SELECT query_id, max(score) FILTER (pos = 1) AS top1, max(score) FILTER (pos = 2) AS top2, avg(score) FILTER (pos > 5) AS floor FROM ({_sql_pool(n=20)}) GROUP BY query_id)""")
def pool_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.probe(_pool(spark, sf_dir, n=20), "query_id"), "top1", "top2", "floor", "ratio")


@query(f"""
SELECT query_id, round(0.6::DOUBLE * a + 0.4::DOUBLE * least(1.0::DOUBLE, (a - coalesce(b, 0)) / 0.1::DOUBLE), 6) AS gap_confidence,
  round(CASE WHEN abs >= coalesce(nullif(sep, 0), rank) THEN abs ELSE coalesce(nullif(sep, 0), rank) END, 6) AS carrier FROM (
  SELECT s.*, p.a, p.b FROM ({_sql_signals(_sql_pool(), 'web')}) s JOIN (
    SELECT query_id, max(score) FILTER (pos = 1) AS a, max(score) FILTER (pos = 2) AS b FROM ({_sql_pool()}) GROUP BY query_id) p ON p.query_id = s.query_id)""")
def carrier_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = _pool(spark, sf_dir)
    tops = evaluation.probe(pool, "query_id").select("query_id", "top1", "top2")
    j = scoring.signals(pool, ["query_id"]).drop("top1").join(tops, "query_id")
    gap = evaluation.gap_confidence(F.col("top1"), F.col("top2"))
    return _rounded(j.select("query_id", gap.alias("gap_confidence"), evaluation.carrier(F.col("abs"), F.col("sep"), F.col("rank")).alias("carrier")), "gap_confidence", "carrier")


@query(f"SELECT query_id, round(log_ratio, 6) AS log_ratio, CAST(row_number() OVER (ORDER BY round(sep, 9) DESC, query_id) AS INTEGER) AS place FROM ({_sql_signals(_sql_pool(), 'web')})")
def log_ratio_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report over the query set, sorted by separation."""
    s = scoring.signals(_pool(spark, sf_dir), ["query_id"]).select("query_id", "log_ratio", F.round("sep", 9).alias("sep"))
    return _rounded(ranking.places(s, F.desc("sep"), F.asc("query_id")).drop("sep"), "log_ratio")


@query(f"""
WITH c AS ({_sql_confidence(_sql_signals(_sql_pool(True), 'web'), 'web', 'TRUE')})
SELECT band, mode, count(*) AS results, count(*) FILTER (band <> 'low') AS llm_calls, CASE WHEN band = 'low' THEN 'refuse' ELSE mode END AS generation FROM c GROUP BY ALL""")
def generation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is generated for which results: low bands are refused without a model call."""
    c = _confidence(_pool(spark, sf_dir, True), "web", True)
    gate = F.when(F.col("band") == "low", "refuse").otherwise(F.col("mode"))
    return c.groupBy("band", "mode").agg(F.count("*").alias("results"), F.count_if(F.col("band") != "low").alias("llm_calls")).withColumn("generation", gate)


@query(f"""
WITH p AS ({_sql_pool()}), h AS (
  SELECT q.vec_id AS query_id, min(p.pos) FILTER (v.label = q.label) AS hit_rank FROM embeddings q LEFT JOIN p ON p.query_id = q.vec_id LEFT JOIN embeddings v ON v.vec_id = p.vec_id
  WHERE q.vec_id % {EVERY} = 0 GROUP BY 1)
SELECT count(*) AS queries, count(*) FILTER (hit_rank = 1) AS rank1, count(*) FILTER (hit_rank <= 5) AS top_k, count(*) FILTER (hit_rank IS NULL) AS missed FROM h""")
def hit_rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    pool = _pool(spark, sf_dir).join(v.select("vec_id", F.col("label").alias("found")), "vec_id")
    q = v.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), F.col("label").alias("expected"))
    ranks = evaluation.hit_ranks(q.join(pool, "query_id", "left"), "query_id", F.col("found") == F.col("expected"))
    return evaluation.hit_summary(ranks)
