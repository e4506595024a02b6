"""Queries over conversations and message streams."""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import text as tx
from tidemill.operators import chat, sync
from tidemill.plans.registry import query, sql_collapse
from tidemill.session import scratch, table
from tidemill.sources.files import envelope_messages
from tidemill.streaming import admission as adm
from tidemill.streaming import messages as ms

#: Where a query needs a present time, it is this one.
NOW = "TIMESTAMP '2024-02-20 00:00:00'"


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


@query("""
WITH m AS (SELECT conv_id, count(*) AS messages, arg_min(text, turn) FILTER (role = 'user') AS title, max(turn) AS last_turn FROM conversations GROUP BY conv_id)
SELECT c.conv_id, coalesce(messages, 0) AS messages, title, last_turn FROM (SELECT DISTINCT conv_id FROM conversations UNION SELECT -1) c LEFT JOIN m ON m.conv_id = c.conv_id""")
def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations with their size and first question; one without messages is listed too."""
    c = _chat(spark, sf_dir)
    ids = c.select("conv_id").distinct().unionByName(spark.range(1).select((-F.col("id") - 1).alias("conv_id")))
    return chat.overview(ids, c)


def _last_sql(n: int) -> str:
    return f"SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= {n}"


@query(_last_sql(4))
def last_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.last_messages(_chat(spark, sf_dir), 4)


@query("SELECT conv_id, turn, role, text FROM conversations")
def all_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit of zero means none."""
    return chat.last_messages(_chat(spark, sf_dir), 0)


_PAIRS = """SELECT conv_id, turn, question, answer FROM (
  SELECT conv_id, turn, role, text AS answer, lag(role) OVER w AS before, lag(text) OVER w AS question FROM conversations WHERE role IN ('user', 'assistant')
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND before = 'user'"""


@query(_PAIRS)
def history_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.exchanges(_chat(spark, sf_dir))


@query(rf"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM ({_PAIRS})),
l AS (SELECT conv_id, turn, 'User: ' || question || chr(10) || 'Assistant: ' || substr({sql_collapse(r"regexp_replace(regexp_replace(answer, '!\[[^\]]*\]\([^)]*\)', '', 'g'), '(?s)<div.*?</div>', '', 'g')")}, 1, 300) AS line FROM p WHERE r <= 2)
SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM l GROUP BY conv_id""")
def rewrite_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.history(_chat(spark, sf_dir))


_ACTIVITY = "SELECT user_id AS conv_id, max(ts) AS last_active_at, count(*) AS n FROM events GROUP BY user_id"


def _activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("ts").alias("created_at"), "value")
    late = e.where("value > 400").withColumn("created_at", F.expr("created_at + INTERVAL 1 DAY"))
    return chat.append(e, late)[1]


_APPENDED = "SELECT user_id AS conv_id, max(CASE WHEN value > 400 THEN ts + INTERVAL 1 DAY ELSE ts END) AS last_active_at FROM events GROUP BY user_id"


@query(f"SELECT conv_id, last_active_at::VARCHAR AS last_active_at FROM ({_APPENDED})")
def append_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last activity after late messages were appended."""
    return _activity(spark, sf_dir).withColumn("last_active_at", F.col("last_active_at").cast("string"))


@query(f"SELECT conv_id FROM ({_APPENDED}) WHERE last_active_at < {NOW} - INTERVAL 30 DAYS + INTERVAL 8 DAYS")
def expired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.expired(_activity(spark, sf_dir), F.expr(NOW + " + INTERVAL 8 DAYS")).select("conv_id")


@query("""
WITH gone AS (SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(*) < 4)
SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM gone)""")
def cleanup_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages left after short conversations were deleted with their messages."""
    c = _chat(spark, sf_dir)
    parents = c.groupBy("conv_id").agg(F.count("*").alias("n"))
    return chat.drop_conversations(parents, c, parents.where("n < 4"))[1].select("conv_id", "turn", "role")


@query("SELECT user_id AS contact, arg_max(event_type, event_id) AS conv_id, min(ts)::VARCHAR AS created_at FROM events GROUP BY user_id")
def contact_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("contact"), F.col("event_type").alias("conv_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"))
    return chat.upsert_contacts(e).withColumn("created_at", F.col("created_at").cast("string"))


@query("SELECT event_id, user_id FROM events e WHERE EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = e.user_id)")
def live_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chat(spark, sf_dir).select(F.col("conv_id").alias("user_id")).distinct()
    return table(spark, sf_dir, "events").select("event_id", "user_id").join(c, "user_id", "left_semi").select("event_id", "user_id")


@query("""
SELECT event_id, CASE WHEN asked IS NULL THEN 'new' WHEN asked IN (SELECT conv_id FROM conversations) THEN 'same' ELSE 'missing' END AS state
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id * 3 END AS asked FROM events)""")
def resolve_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "events").select("event_id", F.expr("CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id * 3 END").alias("conv_id"))
    return chat.resolve(r, _chat(spark, sf_dir)).select("event_id", "state")


# Citations: answers cite the turns before them.
_ANSWERS = "SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, text || ' [1] and [3]' AS answer, conv_id % 7 = 0 AS declined FROM conversations WHERE role = 'assistant'"
_CHUNKS = """SELECT conv_id * 1000 + turn AS answer_id, pos, 'u' || ((conv_id + pos) % 3) AS url, CASE WHEN pos = 3 THEN 'p' || (conv_id % 5) || '.png' ELSE '' END AS photo
  FROM conversations, (SELECT unnest([1, 2, 3, 4]) AS pos) WHERE role = 'assistant'"""
_CITED = f"""SELECT *, row_number() OVER (PARTITION BY answer_id ORDER BY first_pos) AS place FROM (
  SELECT a.answer_id, url, min(pos) AS first_pos, arg_min(photo, pos) AS photo FROM ({_ANSWERS}) a JOIN ({_CHUNKS}) c ON c.answer_id = a.answer_id
  WHERE NOT declined AND contains(answer, '[' || pos || ']') GROUP BY 1, 2)"""


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = _chat(spark, sf_dir).where("role = 'assistant'").withColumn("answer_id", F.col("conv_id") * 1000 + F.col("turn"))
    answers = c.select("answer_id", F.concat("text", F.lit(" [1] and [3]")).alias("answer"), (F.col("conv_id") % 7 == 0).alias("declined"))
    chunks = c.select("answer_id", "conv_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("pos"))
    url = F.concat(F.lit("u"), ((F.col("conv_id") + F.col("pos")) % 3).cast("string"))
    photo = F.when(F.col("pos") == 3, F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string"), F.lit(".png"))).otherwise("")
    return answers, chunks.select("answer_id", "pos", url.alias("url"), photo.alias("photo"))


@query(f"SELECT answer_id, url, first_pos, photo, CAST(place AS INTEGER) AS place FROM ({_CITED})")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.citations(*_answers(spark, sf_dir))


@query(f"SELECT answer_id, photo, min(first_pos) AS first_pos FROM ({_CITED}) WHERE photo <> '' AND (answer_id, photo) NOT IN (SELECT answer_id, 'p1.png' FROM ({_ANSWERS}) WHERE turn > 1) GROUP BY 1, 2")
def citation_photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Photos of citations that weren't shown before."""
    cited = chat.citations(*_answers(spark, sf_dir))
    shown = _chat(spark, sf_dir).where("role = 'assistant' and turn > 1").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer_id"), F.lit("p1.png").alias("photo"))
    return chat.photos(cited, F.lit(True), shown)


@query(rf"""
SELECT conv_id, sha256(string_agg('[' || (turn + 1) || '] Source: ' || role || chr(10) || substr({sql_collapse('text')}, 1, 1400), chr(10) || chr(10) ORDER BY turn)) AS context FROM conversations GROUP BY conv_id""")
def context_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _chat(spark, sf_dir).select("conv_id", (F.col("turn") + 1).alias("pos"), F.col("role").alias("source_url"), F.col("text").alias("content"))
    return chat.context(c, "conv_id").withColumn("context", F.sha2("context", 256))


# Messages ------------------------------------------------------------------

_MESSAGES = "SELECT *, event_id AS ord FROM events UNION ALL SELECT * REPLACE (ts + INTERVAL 90 SECONDS AS ts), event_id + 1000000000 AS ord FROM events WHERE event_id % 10 = 0"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages; every tenth is delivered again later."""
    e = table(spark, sf_dir, "events").withColumn("ord", F.col("event_id"))
    again = e.where("event_id % 10 = 0").withColumn("ts", F.expr("ts + INTERVAL 90 SECONDS")).withColumn("ord", F.col("ord") + 1_000_000_000)
    return e.unionByName(again)


@query(f"SELECT event_id, ord FROM (SELECT event_id, ord, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS r FROM ({_MESSAGES})) WHERE r = 1")
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.first_of_each(_messages(spark, sf_dir), "event_id").select("event_id", "ord")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM events")
def rolling_count_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.rolling_count(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id").select("event_id", "user_id", "recent")


def _sql_admitted(rows: str, limit: int, window: int) -> str:
    """ord, allowed of rows(sender, ord, ts): the times let through so far travel along each sender's messages."""
    return f"""WITH RECURSIVE e AS (
      SELECT sender, ord, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY sender ORDER BY ts, ord) AS i FROM ({rows})
    ), r AS (
      SELECT sender, ord, i, [t] AS kept, TRUE AS allowed FROM e WHERE i = 1 UNION ALL
      SELECT sender, ord, i, CASE WHEN len(k) < {limit} THEN list_append(k, t) ELSE k END, len(k) < {limit}
      FROM (SELECT e.*, [x FOR x IN r.kept IF e.t - x <= {window}] AS k FROM r JOIN e ON e.sender = r.sender AND e.i = r.i + 1)
    ) SELECT ord, allowed FROM r"""


@query(f"SELECT user_id, event_id, allowed FROM events JOIN ({_sql_admitted('SELECT user_id AS sender, event_id AS ord, ts FROM events', 3, 86_400)}) a ON a.ord = event_id")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact limit, over a day so that these sparse events reach it."""
    return ms.rate_limited(table(spark, sf_dir, "events"), "user_id", "event_id", limit=3, window=86_400)


_INBOUND = f"""SELECT ord, CASE WHEN event_id % 17 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS msg_id, user_id AS sender, ts,
  CASE WHEN event_type = 'error' THEN 'image' ELSE 'text' END AS kind, CASE WHEN event_id % 13 = 0 THEN ' ' ELSE props END AS body FROM ({_MESSAGES})"""
_NTH = f"SELECT *, row_number() OVER (PARTITION BY msg_id ORDER BY ord) AS nth FROM ({_INBOUND}) WHERE msg_id <> '' AND sender IS NOT NULL"


_ADMITTED = f"""
SELECT msg_id, ord, CASE WHEN nth > 1 THEN 'duplicate' WHEN kind <> 'text' THEN 'notice' WHEN NOT allowed THEN 'limited' WHEN trim(coalesce(body, '')) = '' THEN 'blank' ELSE 'answer' END AS outcome
FROM ({_NTH}) n LEFT JOIN ({_sql_admitted(f"SELECT sender, ord, ts FROM ({_NTH}) WHERE nth = 1 AND kind = 'text'", 3, 86_400)}) a USING (ord)
UNION ALL SELECT msg_id, ord, 'skip' FROM ({_INBOUND}) WHERE msg_id = '' OR sender IS NULL"""


def _inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir)
    body = F.when(F.col("event_id") % 13 == 0, " ").otherwise(F.col("props"))
    kind = F.when(F.col("event_type") == "error", "image").otherwise("text")
    msg = F.when(F.col("event_id") % 17 == 0, "").otherwise(F.col("event_id").cast("string"))
    return m.select("ord", msg.alias("msg_id"), F.col("user_id").alias("sender"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), body.alias("body"))


@query(_ADMITTED)
def message_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ms.admission(_inbound(spark, sf_dir), limit=3, window=86_400)


#: Writes that the messages arrive in, in order of time; within one, they come in any order, however many files it has.
ARRIVALS = 4
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@query(_ADMITTED)
def streamed_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the stateful stream: all messages as files that arrive one after the other, read in micro-batches.

    A message may come after any other of its arrival, so the watermark stays behind by the longest of them.
    """
    m, folder, key = _inbound(spark, sf_dir), scratch(spark, "stream"), "spark.sql.streaming.stateStore.providerClass"
    cuts = m.where("ts IS NOT NULL").select(F.unix_micros("ts").cast("double").alias("us")).approxQuantile("us", [i / ARRIVALS for i in range(ARRIVALS + 1)], 0.001) or [0.0]
    part = F.lit(0)
    for cut in cuts[1:-1]:
        part = part + (F.unix_micros("ts") > cut).cast("int")
    delay = 60 + int(max((b - a for a, b in pairwise(cuts)), default=0)) // 1_000_000
    # A message from nobody in particular, a day beyond the delay, moves the watermark past all others.
    end = F.timestamp_micros(F.lit(int(cuts[-1]) + (86_400 + delay) * 1_000_000))
    last = spark.createDataFrame([(None, "end", -1, "text", "")], "ord long, msg_id string, sender long, kind string, body string").withColumn("ts", end)
    for i in range(ARRIVALS):
        m.where(part == i).write.parquet(f"{folder}/in/{i}")
    last.select(m.columns).write.parquet(f"{folder}/in/{ARRIVALS}")
    files = max(2, *(len(spark.read.schema(m.schema).parquet(f"{folder}/in/{i}").inputFiles()) for i in range(ARRIVALS)))
    before = spark.conf.get(key, None)
    spark.conf.set(key, _ROCKS)
    try:
        for name, rule in (("known", lambda x: adm.admission_stream(x, limit=3, window=86_400, delay=f"{delay} seconds")), ("skipped", adm.skipped)):
            source = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in/*")
            sink = rule(source).writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/state-{name}")
            sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    read = lambda name: spark.read.schema(adm.RESULT).parquet(f"{folder}/{name}")
    return read("known").where("ord IS NOT NULL").unionByName(read("skipped"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT event_id, 'm' || event_id AS id, CAST(user_id AS VARCHAR) AS sender, event_type AS body FROM events WHERE event_id % 4 <> 0""")
def envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages out of webhook envelopes; every fourth has none, every eighth is broken."""
    inner = F.format_string('{"entry":[{"changes":[{"value":{"messages":[{"id":"m%d","from":"%d","type":"text","text":{"body":"%s"}}]}}]}]}', "event_id", "user_id", "event_type")
    payload = F.when(F.col("event_id") % 8 == 0, '{"entry":[').when(F.col("event_id") % 4 == 0, '{"entry":[{"changes":[{"value":{}}]}]}').otherwise(inner)
    e = table(spark, sf_dir, "events").select("event_id", F.explode(envelope_messages(payload)).alias("m"))
    return e.select("event_id", F.col("m.id").alias("id"), F.col("m.from").alias("sender"), F.col("m.text.body").alias("body"))


@query("SELECT url, min(page_id) AS page_id FROM pages GROUP BY url")
def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sync.keep_last(table(spark, sf_dir, "pages").select("url", "page_id"), ["url"], F.col("page_id"))


@query("SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN text ELSE 'A: ' || text END AS text FROM conversations")
def normalized_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents that are plain, blocks or wrapped in JSON, read as text."""
    c = _chat(spark, sf_dir)
    wrapped = F.when(F.col("turn") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise(F.to_json(F.array(F.struct(F.col("text").alias("text")))))
    read = F.coalesce(F.get_json_object(wrapped, "$.content"), F.get_json_object(wrapped, "$[0].text"))
    return c.select("conv_id", "turn", "role", F.when(F.col("role") == "user", read).otherwise(F.concat(F.lit("A: "), read)).alias("text"))



_SECRET = "a shared secret"
_PAD = {mask: bytes(b ^ mask for b in _SECRET.encode().ljust(64, b"\0")).hex() for mask in (0x36, 0x5C)}


@query(f"""
WITH s AS (SELECT conv_id, turn, sha256(from_hex('{_PAD[0x5C]}') || from_hex(sha256(from_hex('{_PAD[0x36]}') || encode(text)))) AS mac FROM conversations)
SELECT conv_id, turn, mac, turn % 3 = 0 AS accepted FROM s""")
def signature_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed bodies; of three headers one is right, one has no scheme and one is missing."""
    c = _chat(spark, sf_dir).select("conv_id", "turn", "text", tx.hmac_sha256(F.col("text"), _SECRET).alias("mac"))
    header = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("sha256="), "mac")).when(F.col("turn") % 3 == 1, F.col("mac"))
    return c.select("conv_id", "turn", "mac", tx.signed(F.col("text"), header, _SECRET).alias("accepted"))


@query("SELECT conv_id, turn, coalesce(length(text) BETWEEN 2 AND 500, false) AS accepted FROM conversations")
def request_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chat(spark, sf_dir).select("conv_id", "turn", tx.within_bounds(F.col("text")).alias("accepted"))


@query("""
WITH w AS (SELECT event_id, CAST(epoch_us(ts) AS BIGINT) - 250200000000 AS us FROM events)
SELECT event_id, CAST(250200 + 604800 * CAST(ceil(us / 604800000000.0) AS BIGINT) AS BIGINT) AS next_run FROM w""")
def weekly_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next Sunday, 03:00 in Kolkata, as seconds: in UTC weeks that start at second 250200."""
    ts = tx.next_weekly(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp(ts).alias("next_run"))


@query("""
SELECT CASE WHEN conv_id % 4 = 0 THEN 'skipped' WHEN conv_id % 7 = 0 THEN 'no answer' ELSE 'generated' END AS outcome, count(*) AS n
FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def answer_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers by what they cost: no model called, one that found nothing, or one that answered."""
    c = _chat(spark, sf_dir).where("role = 'assistant'")
    return c.groupBy(chat.cost(F.col("conv_id") % 4 != 0, F.col("conv_id") % 7 == 0).alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT user_id) AS conversations, count(*) AS messages, min(ts)::VARCHAR AS oldest, max(ts)::VARCHAR AS newest FROM events")
def conversation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").agg(F.count_distinct("user_id").alias("conversations"), F.count("*").alias("messages"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
    return e.withColumns({c: F.col(c).cast("string") for c in ("oldest", "newest")})
