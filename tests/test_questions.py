"""The steps of the question path: rewriting's fallbacks, spelling before expansion, embeddings of length 1, partial failures."""

import json

from pyspark.sql import functions as F

from tidemill.operators import chat, questions


def test_rewrites_fall_back_to_the_question(spark):
    rows = [
        (1, "what about EEE", "User: x\nAssistant: y"), (2, "who is the head of the department of physics", "User: x\nAssistant: y"), (3, "and hers?", ""), (4, "and hers?", None),
        (5, "and the long one", "h"), (6, "and the empty one", "h"), (7, "and nothing", "h"), (8, None, "h"), (9, "and forty words", "h"),
    ]
    seen = []

    def model(inputs):
        out = []
        for x in map(json.loads, inputs):
            assert x["history"]
            q = x["question"]
            out.append("w " * 41 if "long" in q else '""' if "empty" in q else None if "nothing" in q else "w " * 40 if "forty" in q else f' "{q}, standalone" ')
        return out

    got = {r.query_id: (r.asked, r.was_rewritten) for r in questions.standalone(spark.createDataFrame(rows, "query_id long, text string, history string"), model).collect()}
    same = {i: (t, False) for i, t, _ in rows}
    assert got == same | {1: ("what about EEE, standalone", True), 9: (("w " * 40).strip(), True)} and not seen


def test_spelling_comes_before_expansion(spark):
    vocab = spark.createDataFrame([("endsem", 5), ("hostel", 9), ("the", 9)], "word string, n long")
    q = spark.createDataFrame([(1, "when is the endsemm"), (2, "hostl fees"), (3, None), (4, "")], "query_id long, asked string")
    got = {r.query_id: r.query for r in questions.searchable(q, vocab).collect()}
    assert got[1].startswith("when is the endsem ") and len(got[1]) > len("when is the endsem ") and got[2].startswith("hostel")
    assert got[3] == got[4] == ""


def test_embeddings_have_length_one_and_get_the_prefix(spark):
    def model(texts):
        return [[3.0, 4.0] if t == "query: a" else [0.0, 0.0] if t == "query: " else None for t in texts]

    df = spark.createDataFrame([(1, "a"), (2, ""), (3, None), (4, "other")], "id long, text string")
    got = {r.id: r.v for r in questions.embedded(df, model, "text", "v", "query: ").collect()}
    assert got == {1: [0.6, 0.8], 2: [0.0, 0.0], 3: None, 4: None}


def test_histories_are_those_before_the_turn(spark):
    rows = [(1, 0, "user", "q0"), (1, 1, "assistant", "a0 ![p](x)"), (1, 2, "user", "q1"), (1, 3, "system", "s"), (1, 4, "assistant", "a1"), (1, 5, "user", "q2"), (1, 6, "assistant", "a2"), (1, 7, "user", "q3"), (2, 0, "user", "only")]
    got = {(r.conv_id, r.turn): r.history for r in chat.histories(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    line = lambda i: f"User: q{i}\nAssistant: a{i}"
    assert got == {(1, 0): None, (1, 2): line(0), (1, 5): line(0) + "\n" + line(1), (1, 7): line(1) + "\n" + line(2), (2, 0): None}


def test_questions_without_results_are_refused(spark):
    """An embedding model that is silent, empty stores: one row a question all the same."""
    q = spark.createDataFrame([(1, "who is the principal", None), (2, "fees", "User: a\nAssistant: b")], "query_id long, text string, history string")
    web = spark.createDataFrame([], "vec_id long, embedding array<double>, content string, source_url string, designation string, department string, department_canon string, is_department_head boolean")
    ups = spark.createDataFrame([], "vec_id long, embedding array<double>, content string, title string, page long")
    vocab = spark.createDataFrame([("fees", 3)], "word string, n long")
    models = questions.Models(lambda x: [None] * len(x), lambda x: [None] * len(x), lambda x: [0.0] * len(x), [("m", lambda x: ["never"] * len(x))], [F.lit("general_info")])
    out = questions.answered(q, web, ups, vocab, models, {"rules": "", "by_mode": {"disambiguate": ""}, "refusal": "no", "failure": "failed"}).collect()
    assert sorted((r.query_id, r.answer, r.band, r.declined, r.label) for r in out) == [(1, "no", "low", True, "general_info"), (2, "no", "low", True, "general_info")]
