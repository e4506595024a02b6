"""From a user's turn to an answer: rewrite, correct, expand, embed, route, retrieve, rerank, score, arbitrate, answer.

Every step is an operator of its own; here they are put in the one order in which they work.
A follow-up is made standalone first. It is spelled before abbreviations are expanded, so
that a misspelled one is known. This form is embedded, routed, reranked and answered. Both
stores are scored by their own profiles, the votes of the classifiers weigh both, and the
better one's results become the answer's context.

Models are plugged in (generation.Model): rewriting sees the history and the question,
embedding a text, reranking a pair, answering a prompt. A rewrite that is missing, empty or
longer than MOST_WORDS words leaves the question as it is; an embedding is scaled to length
1, and a missing one leaves the question without results; a missing rerank score counts 0.
The model steps' results are written, so that no model is called twice for a row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import rules
from tidemill.functions import text as tx
from tidemill.operators import chat, generation, retrieval, routing, scoring, spelling
from tidemill.operators.generation import Model
from tidemill.session import shuffled, stored

#: Words of a rewrite beyond which it is taken for a runaway.
MOST_WORDS = 40
VECTOR = "array<double>"


@dataclass
class Models:
    """What is plugged in. voters: column expressions over `text` that give a label or null."""

    rewrite: Model
    embed: Model
    rerank: Model
    answer: list[tuple[str, Model]]
    voters: Sequence[Column] = ()
    query_prefix: str = ""


def standalone(questions: DataFrame, model: Model) -> DataFrame:
    """questions(query_id, text, history) with `asked` and `was_rewritten`.

    Only follow-ups with a history go to the model.
    """
    df = questions.withColumn("_follows", tx.needs_rewrite(F.col("text")) & (F.coalesce("history", F.lit("")) != ""))
    df = df.withColumn("_input", F.to_json(F.struct(F.col("history").alias("history"), F.col("text").alias("question"))))
    df = stored(generation.with_model(df, model, "_input", "_rewritten", where="_follows"), "rewritten")
    said = F.regexp_replace(F.trim("_rewritten"), r'^"+|"+$', "")
    fine = F.coalesce((said != "") & (F.regexp_count(said, F.lit(r"\S+")) <= MOST_WORDS), F.lit(False))
    return df.withColumns({"asked": F.when(fine, said).otherwise(F.col("text")), "was_rewritten": fine}).drop("_follows", "_input", "_rewritten")


def searchable(questions: DataFrame, vocab: DataFrame) -> DataFrame:
    """questions(query_id, asked) with `query`: spelled by the vocabulary, then with its abbreviations expanded."""
    fixes = spelling.correct(stored(spelling.unknown(questions, vocab, "asked"), "unknown"), vocab)
    spelled = spelling.corrected(questions, fixes, column="asked")
    return questions.join(shuffled(spelled.select("query_id", tx.expand(F.col("corrected")).alias("query"))), "query_id")


def unit(vector: Column) -> Column:
    """A vector scaled to length 1; a zero vector as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def embedded(df: DataFrame, model: Model, of: str, to: str, prefix: str = "") -> DataFrame:
    """df with the unit vector of its text, which the model gets behind the prefix; null for null texts."""
    df = df.withColumns({"_text": F.concat(F.lit(prefix), F.col(of)), "_filled": F.col(of).isNotNull()})
    return generation.with_model(df, model, "_text", "_vector", VECTOR, "_filled").withColumn(to, unit(F.col("_vector"))).drop("_text", "_filled", "_vector")


def reranked(pool: DataFrame, chunks: DataFrame, model: Model, text: str, k: int = rules.TOP_K) -> DataFrame:
    """The pool in the order of the model's scores for (text, content), with `kept` for the first k."""
    pairs = pool.join(shuffled(chunks.select("vec_id", "content")), "vec_id").withColumn("_pair", F.to_json(F.struct(F.col(text).alias("query"), "content")))
    scored = stored(generation.with_model(pairs.drop("score"), model, "_pair", "_score", "double").drop("_pair"), "reranked")
    return retrieval.rerank(scored, F.coalesce("_score", F.lit(0.0)), k).drop("_score")


def agreement(questions: DataFrame, voters: Sequence[Column], text: str) -> DataFrame:
    """query_id, label, agreement of the voters; without a vote the agreement is 0."""
    each = F.posexplode(F.array(*voters)).alias("pos", "label")
    found = scoring.votes(questions.withColumn("text", F.col(text)).select("query_id", each), ["query_id"], "label", "pos")
    return questions.select("query_id").join(shuffled(found.select("query_id", "label", "agreement")), "query_id", "left").withColumn("agreement", F.coalesce("agreement", F.lit(0.0)))


def scored(pool: DataFrame, votes: DataFrame, profile: str, filtered: Column) -> DataFrame:
    found = scoring.signals(pool, ["query_id"], rules.TOP_K, profile).join(shuffled(votes.select("query_id", "agreement")), "query_id")
    return scoring.confidence(found.join(shuffled(pool.groupBy("query_id").agg(F.max("filtered").alias("filtered"))), "query_id"), filtered, F.col("agreement"), profile)


def answered(questions: DataFrame, web: DataFrame, uploads: DataFrame, vocab: DataFrame, models: Models, wording: dict) -> DataFrame:
    """query_id, asked, was_rewritten, query, route, store, band, final, mode, label, answer, sources, model, declined, reason.

    questions(query_id, text, history); web(vec_id, embedding, content, source_url and what
    routing reads); uploads(vec_id, embedding, content, title, page); vocab(word, n);
    wording: rules, by_mode, refusal and failure of generation.answers. One row a question.
    """
    q = searchable(standalone(questions, models.rewrite), vocab)
    q = stored(embedded(q, models.embed, "query", "vector", models.query_prefix), "embedded")
    votes = stored(agreement(q, models.voters or [F.lit(None).cast("string")], "query"), "votes")

    ask = q.where("vector IS NOT NULL")
    pool = routing.routed_pools(ask.select("query_id", "vector", F.col("query").alias("text")), web)
    pool = reranked(pool, web, models.rerank, "rerank_text")
    pool = pool.join(shuffled(web.select("vec_id", "source_url")), "vec_id")
    own = retrieval.pools(ask.select("query_id", "vector", F.lit(None).cast("string").alias("label")), uploads.withColumn("label", F.lit(None).cast("string")), rules.POOL)
    own = reranked(own.join(shuffled(ask.select("query_id", "query")), "query_id"), uploads, models.rerank, "query").withColumn("filtered", F.lit(False))
    own = retrieval.upload_sources(own.join(shuffled(uploads.select("vec_id", "title", "page")), "vec_id"))

    sides = {"web": scored(pool, votes, "web", F.col("filtered")), "upload": scored(own, votes, "upload", F.lit(False))}
    sides = {s: stored(d.select("query_id", "band", "final", "mode"), s) for s, d in sides.items()}
    picked = scoring.arbitrate(sides["web"], sides["upload"], ["query_id"]).select("query_id", "store")
    both = sides["web"].withColumn("store", F.lit("web")).unionByName(sides["upload"].withColumn("store", F.lit("upload")))
    winner = both.join(shuffled(picked), ["query_id", "store"])

    kept = pool.where("kept").select("query_id", "pos", "content", "source_url", "route", F.lit("web").alias("store"))
    kept = kept.unionByName(own.where("kept").select("query_id", "pos", "content", "source_url", F.lit("uploaded_documents").alias("route"), F.lit("upload").alias("store")))
    kept = kept.join(shuffled(picked), ["query_id", "store"])
    context = chat.context(kept, "query_id").join(shuffled(_urls(kept)), "query_id")
    results = q.join(shuffled(winner), "query_id", "left").join(shuffled(context), "query_id", "left").join(shuffled(votes.select("query_id", "label")), "query_id", "left")
    results = results.select("query_id", "text", F.col("asked").alias("question"), F.col("query").alias("rewritten"), "was_rewritten", "route", "store", F.coalesce("band", F.lit("low")).alias("band"), F.coalesce("final", F.lit(0.0)).alias("final"), "mode", "label", "context", "urls")
    out = generation.answers(results, models.answer, **wording)
    return out.withColumnsRenamed({"question": "asked", "rewritten": "query"}).drop("text", "context", "urls", "llm_called")


def _urls(kept: DataFrame) -> DataFrame:
    in_order = F.array_sort(F.collect_list(F.struct("pos", "source_url")))
    return kept.groupBy("query_id").agg(F.transform(in_order, lambda c: c["source_url"]).alias("urls"), F.first("route", ignorenulls=True).alias("route"))
