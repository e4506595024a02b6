"""Answers from scored pools. Models are plugged in; everything around them is columns.

A model is a function from a list of inputs to a list of outputs (None where it has none).
It is called on the workers, a few rows of a batch at a time, and only for rows that need it.

Edge cases: where several models are asked in turn, one that raises is asked again row by
row, and has no output only for the rows that it raises for, which are counted; results without chunks are
refused like those of a low band; a question without history is asked as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StringType, StructType, _parse_datatype_string

from tidemill.functions.text import declined, preview

Model = Callable[[list], list]
#: Rows that a model gets at once.
AT_ONCE = 64
#: What padding may add to a call's texts.
WASTE = 1.2
ANSWER = "struct<text:string,model:string,failures:int>"


def by_length(lengths: list[int], most_rows: int, budget: int | None) -> list[list[int]]:
    """Places of rows in groups of like lengths: at most most_rows rows and, padded to the longest, at most the
    budget (one longer row has a group of its own) and WASTE times what the rows really hold. Without a budget,
    groups in order of arrival."""
    if budget is None:
        return [list(range(i, min(i + most_rows, len(lengths)))) for i in range(0, len(lengths), most_rows)]
    groups: list[list[int]] = []
    held = 0
    for i in sorted(range(len(lengths)), key=lengths.__getitem__):
        size = lengths[i]
        n = len(groups[-1]) + 1 if groups else 0
        if not groups or n > most_rows or n * size > budget or n * size > WASTE * (held + size):
            groups.append([])
            held = 0
        groups[-1].append(i)
        held += size
    return groups


def row_by_row(model: Model, inputs: list) -> tuple[list, list[str | None]]:
    """Outputs and errors: if the model raises on all inputs together, each is asked alone, so that only those that fail are lost."""
    try:
        found = model(inputs)
        if len(found) != len(inputs):
            raise ValueError(f"{len(found)} outputs for {len(inputs)} inputs")
        return list(found), [None] * len(inputs)
    except Exception as error:  # whatever a service raises
        if len(inputs) == 1:
            return [None], [f"{type(error).__name__}: {error}"]
    each = [row_by_row(model, [x]) for x in inputs]
    return [o[0] for o, _ in each], [e[0] for _, e in each]


def with_model(df: DataFrame, model: Model, of: str, to: str, kind: str = "string", where: str | None = None, budget: int | None = None, errors: str | None = None) -> DataFrame:
    """df with the model's output for column `of` as column `to`; null where the flag column `where` isn't true.

    Serves every step that needs a model: rewriting, embedding (kind "array<float>"), voting, answering.
    budget: characters that a call may hold when its texts are padded to the longest; texts of
    like length then go together, whatever their order. errors: a column for what the model
    raised for a row, which then has no output; without it, an error ends the job.
    """
    out = _parse_datatype_string(kind)
    arrow = to_arrow_type(out)
    schema = StructType([*df.schema.fields]).add(to, out)
    if errors:
        schema = schema.add(errors, StringType())
    names = to_arrow_schema(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            inputs = batch.column(names.index(of)).to_pylist()
            wanted = batch.column(names.index(where)).to_pylist() if where else [True] * len(inputs)
            rows = [i for i, w in enumerate(wanted) if w]
            values: list = [None] * len(inputs)
            raised: list = [None] * len(inputs)
            lengths = [len(inputs[i]) if hasattr(inputs[i], "__len__") else 0 for i in rows]
            for group in by_length(lengths, AT_ONCE, budget):
                places = [rows[g] for g in group]
                given = [inputs[i] for i in places]
                found, failed = row_by_row(model, given) if errors else (model(given), [None] * len(given))
                for i, v, e in zip(places, found, failed, strict=True):
                    values[i], raised[i] = v, e
            columns = [*batch.columns, pa.array(values, arrow), *[pa.array(raised, pa.string())] * bool(errors)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return df.mapInArrow(run, schema)


def in_turn(models: list[tuple[str, Model]]) -> Model:
    """One model of several: each input goes to the next model until one has an output; with its name and how many raised before."""

    def call(inputs: list) -> list:
        out: list = [None] * len(inputs)
        failures = [0] * len(inputs)
        for name, model in models:
            left = [i for i, x in enumerate(out) if x is None]
            if not left:
                break
            found, failed = row_by_row(model, [inputs[i] for i in left])
            for i, text, error in zip(left, found, failed, strict=True):
                failures[i] += error is not None
                if text is not None:
                    out[i] = {"text": text.strip(), "model": name, "failures": failures[i]}
        return [x or {"text": None, "model": None, "failures": n} for x, n in zip(out, failures, strict=True)]

    return call


def prompt(question: Column, context: Column, mode: Column, rules: str, by_mode: dict[str, str], other: str) -> Column:
    """The rules, the mode's own rule (that of `other` for unknown modes), the numbered context and the question."""
    own = F.lit(by_mode[other])
    for name, text in by_mode.items():
        own = F.when(mode == name, text).otherwise(own)
    return F.concat(F.lit(rules), own, F.lit("\n\nContext:\n\n"), context, F.lit("\n\nQuestion: "), question, F.lit("\n\nAnswer:"))


def answers(results: DataFrame, models: list[tuple[str, Model]], rules: str, by_mode: dict[str, str], refusal: str, failure: str) -> DataFrame:
    """results with answer, sources, llm_called, model, declined, reason and failures (models that raised).

    results(question, rewritten, band, mode, context, urls): the rewritten question is asked,
    if there is one; urls are the chunks' sources in order. The other columns pass through.
    """
    band, size = F.coalesce("band", F.lit("low")), F.coalesce(F.size("urls"), F.lit(0))
    asked = F.coalesce("rewritten", "question")
    df = results.withColumn("llm_called", (band != "low") & (size > 0))
    df = df.withColumn("_prompt", F.when(F.col("llm_called"), prompt(asked, F.col("context"), F.coalesce("mode", F.lit("disambiguate")), rules, by_mode, "disambiguate")))
    df = with_model(df, in_turn(models), "_prompt", "_out", ANSWER, "llm_called")
    text, called = F.col("_out.text"), F.col("llm_called")
    failed = called & text.isNull()
    no = ~called | failed | declined(text)
    cited = F.filter(F.transform("urls", lambda u, i: F.when(F.instr(text, F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"))) > 0, u)), lambda u: u.isNotNull())
    return df.select(
        *results.columns,
        "llm_called",
        F.when(~called, refusal).when(failed, failure).otherwise(text).alias("answer"),
        F.when(no, F.array().cast("array<string>")).otherwise(F.array_distinct(cited)).alias("sources"),
        F.col("_out.model").alias("model"),
        no.alias("declined"),
        F.when(~called, "confidence below threshold — generation skipped").when(failed, "all generation models failed").alias("reason"),
        F.coalesce("_out.failures", F.lit(0)).alias("failures"),
    )


def badge(band: Column, confidence: Column, route: Column, called: Column, refused: Column, model: Column, styles: dict[str, tuple[str, str]]) -> Column:
    """One line on how an answer came about; styles: colour and label of each band, that of low for others."""
    colour, label = (F.lit(x) for x in styles["low"])
    for name, (c, t) in styles.items():
        colour, label = F.when(band == name, c).otherwise(colour), F.when(band == name, t).otherwise(label)
    short = F.element_at(F.split(F.coalesce(model, F.lit("")), "/"), -1)
    cost = (
        F.when(~F.coalesce(called, F.lit(False)), "LLM skipped — no cost incurred")
        .when(F.coalesce(refused, F.lit(False)), F.when(short != "", F.concat(short, F.lit(" found no answer in the sources"))).otherwise("no answer in the sources"))
        .otherwise(F.when(short != "", F.concat(F.lit("generated by "), short)).otherwise("LLM called"))
    )
    place = F.coalesce(F.nullif(route, F.lit("")), F.lit("plain search"))
    style = "clear:both;font-size:0.85em;color:#666;margin-top:8px"
    return F.concat(
        F.lit(f"<div style='{style}'><span style='color:"), colour, F.lit(";font-weight:600'>"), label, F.lit(" "), F.coalesce(confidence, F.lit(0.0)).cast("string"),
        F.lit("</span> &nbsp;·&nbsp; "), place, F.lit(" &nbsp;·&nbsp; "), cost, F.lit("</div>"),
    )


def source_list(urls: Column, width: int = 70) -> Column:
    """Urls as a list of links, each named by what follows its scheme."""
    line = lambda u: F.concat(F.lit("- ["), F.substring(F.element_at(F.split(u, "//"), -1), 1, width), F.lit("]("), u, F.lit(")"))
    return F.when(F.size(urls) > 0, F.concat(F.lit("\n\n**Sources**\n"), F.array_join(F.transform(urls, line), "\n"))).otherwise("")


def photo_strip(photos: Column) -> Column:
    """Photos (url, name) as markdown images, each with its name below."""
    one = lambda p: F.concat(F.lit("!["), p["name"], F.lit("]("), p["url"], F.lit(")\n"), F.when(p["name"] != "", F.concat(F.lit("**"), p["name"], F.lit("**\n"))).otherwise(""), F.lit("\n"))
    return F.when(F.size(photos) > 0, F.array_join(F.transform(photos, one), "")).otherwise("")


def response_chunks(pool: DataFrame, key: str) -> DataFrame:
    """key, chunks: the kept results of each question in order, as flat structs with a preview of their content."""
    one = F.struct("pos", "source_url", "heading", "designation", F.coalesce("photo_url", F.lit("")).alias("photo_url"), F.col("score").alias("rerank_score"), preview(F.col("content")).alias("preview"))
    return pool.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("chunks"))
