"""Question to pool: a metadata filter where the question names who it is about.

A question's intent is read once, as columns. Each filtered leg is a retrieval over the
chunks its filter keeps, for the questions that may need it only; a question whose leg stays
empty goes on to the next: a department without a head of its own to the principal of its
school, and all that have nothing yet to the plain pool.

Edge cases: a null text has no intent, hence the plain pool; a chunk without department
matches none; a question without vector meets nothing and gets no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import rules
from tidemill.functions import text as tx
from tidemill.operators import blocks, retrieval
from tidemill.session import shuffled, stored


def intents(questions: DataFrame, text: str = "text") -> DataFrame:
    """questions with intent (principal, people, head or plain), dept, tag and school."""
    q = F.col(text)
    df = questions.withColumns({"principal": tx.wants_principal(q), "head": tx.wants_head(q), "people": tx.wants_people(q), "dept": tx.department_in(q), "asked": tx.school_in(q)})
    named = F.col("dept").isNotNull()
    intent = F.when(F.col("principal"), "principal").when(named & F.col("head"), "head").when(named & F.col("people"), "people").otherwise("plain")
    school = F.when(F.col("principal"), F.col("asked")).otherwise(tx.lookup(rules.DEPARTMENT_SCHOOL, F.col("dept")))
    return df.withColumns({"intent": intent, "tag": tx.department_tag(F.col("dept")), "school": school}).drop("principal", "head", "people", "asked")


def routed_pools(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """query_id, pos, vec_id, score, route, filtered, rerank_text of each question's pool.

    questions(query_id, vector, text); chunks(vec_id, embedding, designation, department,
    department_canon, is_department_head).

    Each chunk has a key for every leg that its metadata allow, each question one for every
    leg that it may need, so that all filtered legs are one pass over the chunks. Its result
    is written, as it decides which questions the second pass, the plain one, is for.
    """
    q = stored(intents(questions.select("query_id", "vector", "text")), "questions")
    intent, school = F.col("intent"), F.col("school").isNotNull()
    needs = F.when(intent == "people", F.array(F.concat(F.lit("people|"), "tag"))).when(intent == "principal", F.array(F.lit("principal"))).when((intent == "head") & school, F.array(F.lit("head"), F.lit("principal"))).when(intent == "head", F.array(F.lit("head")))
    allows = F.filter(
        F.array(F.concat(F.lit("people|"), "department_canon"), F.when(F.col("is_department_head"), F.lit("head")), F.when(F.col("designation") == "principal", F.lit("principal"))),
        lambda k: k.isNotNull(),
    )
    asked = q.select("query_id", "vector", F.explode(needs).alias("key"))
    found = blocks.nearest(asked, chunks.select("vec_id", "embedding", F.explode(allows).alias("key")), max(rules.DEPARTMENT_POOL, rules.FILTERED_POOL))
    kind = F.split("key", r"\|")[0]
    about = q.select("query_id", "text", "dept", "tag", "school", "intent")
    found = found.where(F.col("pos") <= F.when(kind == "people", rules.DEPARTMENT_POOL).otherwise(rules.FILTERED_POOL)).withColumn("leg", kind).drop("key")
    found = found.join(shuffled(about), "query_id").join(shuffled(chunks.select("vec_id", "department")), "vec_id", "left")
    found = found.where((F.col("leg") != "head") | tx.departments_match(F.col("dept"), F.col("department")))
    # A head's question takes the principals only if no head of the department is left.
    own = F.max(F.col("leg") == "head").over(Window.partitionBy("query_id"))
    found = found.withColumn("_own", own).where((F.col("leg") == "head") | ~F.col("_own"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))
    route = F.when(F.col("leg") == "people", F.concat(F.lit("faculty_"), "tag")).when(F.col("leg") == "head", "department_heads").otherwise(F.concat(F.lit("principal_"), "school"))
    text = F.when(F.col("leg") == "principal", tx.rerank_text(F.col("text"), F.col("school"))).otherwise(F.col("text"))
    scoped = stored(found.select("query_id", place.alias("pos"), "vec_id", "score", route.alias("route"), F.lit(True).alias("filtered"), text.alias("rerank_text")), "scoped")

    rest = q.join(shuffled(scoped.select("query_id").distinct()), "query_id", "left_anti").withColumn("label", F.lit(None).cast("string"))
    plain = retrieval.pools(rest.select("query_id", "vector", "label"), chunks.withColumn("label", F.col("department_canon")), rules.POOL)
    plain = plain.join(shuffled(about.select("query_id", F.col("text").alias("rerank_text"))), "query_id")
    return scoped.unionByName(plain.select("query_id", "pos", "vec_id", "score", F.lit(None).cast("string").alias("route"), F.lit(False).alias("filtered"), "rerank_text"))
