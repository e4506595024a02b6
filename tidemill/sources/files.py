"""Files as sources: saved pages, texts, seeds, registries, envelopes; other kinds by plug-in."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.text import clean, extension

#: Block parsers by extension: bytes to (text, page, kind). Those of office files are in sources.office; a PDF parser is registered by who has one.
PARSERS: dict[str, Callable[[bytes], list[tuple[str, int, str]]]] = {}
TEXT_KINDS = (".txt", ".md")
KNOWN_KINDS = (".pdf", ".pptx", ".docx", ".xlsx", ".xlsm", *TEXT_KINDS)


def parser(*extensions: str):
    """Registers a block parser for extensions."""

    def add(f):
        PARSERS.update(dict.fromkeys(extensions, f))
        return f

    return add


def clean_text(text: str) -> str:
    """As functions.text.clean, on the worker."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", text.replace("\xa0", " "))).strip()


@parser(*TEXT_KINDS)
def parse_text(data: bytes) -> list[tuple[str, int, str]]:
    parts = re.split(r"\n\s*\n", data.decode("utf-8", errors="replace"))
    return [(p, 1, "text") for p in map(clean_text, parts) if p]


def prose_or_tables(prose: str, tables: list[str]) -> list[tuple[str, str]]:
    """What a page of mixed content gives: each table, and prose only if it holds clearly more than the tables."""
    whole = sum(map(len, tables))
    keep = prose and (not whole or len(prose) >= 1.25 * whole)
    return [(t, "table") for t in tables] + ([(prose, "text")] if keep else [])


def table_lines(rows: list[list]) -> str:
    """A table's filled cells, parted by bars, a line for each row that has any."""
    cells = ([clean_text(str(c)).replace("\n", " ") for c in row if c] for row in rows)
    return "\n".join(" | ".join(c for c in row if c) for row in cells if any(row))


def page_parser(*extensions: str):
    """Registers a parser of pages with mixed content, as a PDF's: bytes to (prose, tables as rows of cells) for each page.

    Its prose is cleaned and left out where the tables say the same.
    """

    def add(f: Callable[[bytes], list[tuple[str | None, list[list[list]]]]]):
        def blocks(data: bytes) -> list[tuple[str, int, str]]:
            out = []
            for page, (prose, tables) in enumerate(f(data), start=1):
                texts = [t for t in map(table_lines, tables) if t]
                out += [(text, page, kind) for text, kind in prose_or_tables(clean_text(prose or ""), texts)]
            return out

        parser(*extensions)(blocks)
        return f

    return add


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """path, pos, text, page, kind of every file of a known kind below path; unknown kinds fail."""
    from tidemill.sources import office  # noqa: F401 registers its parsers

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    parsers = dict(PARSERS)  # workers know none that is registered here

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, data in zip(batch["path"], batch["content"], strict=True):
                ext = "." + p.rsplit(".", 1)[-1].lower()
                if ext not in parsers:
                    raise ValueError(f"no parser for {ext}; register one with tidemill.sources.files.parser")
                rows = [(p, i, *b) for i, b in enumerate(parsers[ext](data))]
                yield pd.DataFrame(rows, columns=["path", "pos", "text", "page", "kind"])

    return files.mapInPandas(run, "path string, pos int, text string, page int, kind string")


def read_saved_pages(spark: SparkSession, path: str) -> DataFrame:
    """url, title, html of saved pages that have a .meta.json beside them; others are left out."""
    stem = lambda c, end: F.regexp_replace(c, end, "")
    pages = spark.read.format("binaryFile").option("pathGlobFilter", "*.html").load(path).select(stem(F.col("path"), r"\.html$").alias("stem"), F.decode("content", "UTF-8").alias("html"))
    meta = spark.read.format("binaryFile").option("pathGlobFilter", "*.meta.json").load(path).select(stem(F.col("path"), r"\.meta\.json$").alias("stem"), F.decode("content", "UTF-8").alias("meta"))
    fields = F.from_json("meta", "url string, title string")
    return pages.join(meta, "stem").select(fields["url"].alias("url"), fields["title"].alias("title"), "html")


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """Distinct urls of a JSON array of strings."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "array<string>")).alias("url")).dropDuplicates()


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a JSON object of documents; a missing or broken file is an empty registry."""
    entry = "struct<doc_id:string,title:string,filename:string,chunks:int,pages:int,uploaded_at:string>"
    schema = "doc_id string, title string, filename string, chunks int, pages int, uploaded_at string"
    try:
        raw = spark.read.text(path, wholetext=True)
        return raw.select(F.explode(F.from_json("value", f"map<string,{entry}>")).alias("k", "v")).select("v.*")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def text_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, block: parts of a text between blank lines, cleaned, none blank."""
    parts = F.filter(F.transform(F.split("text", r"\n\s*\n"), clean), lambda b: b != "")
    return docs.select("doc_id", F.posexplode(parts).alias("pos", "block"))


def file_kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(*KNOWN_KINDS), ext)


def envelope_messages(payload: Column) -> Column:
    """Messages of a webhook's JSON, empty if there are none or it is broken."""
    schema = "struct<entry:array<struct<changes:array<struct<value:struct<messages:array<struct<id:string,from:string,type:string,text:struct<body:string>>>>>>>>>"
    found = F.try_element_at(F.try_element_at(F.from_json(payload, schema)["entry"], F.lit(1))["changes"], F.lit(1))["value"]["messages"]
    return F.coalesce(found, F.array().cast("array<struct<id:string,from:string,type:string,text:struct<body:string>>>"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


#: Entries of a registry file, urls of a seed file.
AT_ONCE = 10_000


def write_registry(entries: DataFrame, path: str) -> None:
    """Rewrites the registry: a JSON object of documents for each AT_ONCE entries or so; entries as `read_registry` gives them."""
    names = ["doc_id", "title", "filename", "chunks", "pages", "uploaded_at"]
    key = F.coalesce("doc_id", F.lit(""))
    parts = max(-(-entries.count() // AT_ONCE), 1)
    grouped = entries.groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, F.struct(*names))))).alias("value"))
    grouped.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_seeds(urls: DataFrame, path: str) -> None:
    """Urls as JSON arrays of AT_ONCE or so, one to a file."""
    parts = max(-(-urls.count() // AT_ONCE), 1)
    part = urls.groupBy(F.pmod(F.xxhash64("url"), F.lit(parts)).alias("part")).agg(F.to_json(F.collect_list("url")).alias("value"))
    part.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
