"""Vocabulary of the corpus and typo correction against it."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemill.session import shuffled, stored

CUTOFF, MOST_DELTA, LEAST_FREQUENCY, LEAST_WORD, LEAST_TOKEN = 82, 2, 2, 3, 5


def vocabulary(texts: DataFrame, column: str = "text") -> DataFrame:
    """word, n: lower-case ASCII words of three or more letters that occur twice or more."""
    w = texts.select(F.explode(F.regexp_extract_all(F.lower(column), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    return w.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= LEAST_FREQUENCY) & (F.length("word") >= LEAST_WORD))


def unknown(texts: DataFrame, vocab: DataFrame, column: str = "text") -> DataFrame:
    """Distinct lower-case tokens of five or more letters that the vocabulary lacks."""
    t = texts.select(F.explode(F.regexp_extract_all(column, F.lit("[A-Za-z]+"), F.lit(0))).alias("token")).select(F.lower("token").alias("token"))
    return t.where(F.length("token") >= LEAST_TOKEN).distinct().join(shuffled(vocab), F.col("token") == F.col("word"), "left_anti")


def blocks(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """token, len, words: how many vocabulary words of each length within two letters a token has."""
    sizes = vocab.groupBy(F.length("word").alias("len")).agg(F.count("*").alias("words"))
    t = tokens.select("token", F.explode(F.expr(f"sequence(length(token) - {MOST_DELTA}, length(token) + {MOST_DELTA})")).alias("len"))
    return t.join(sizes, "len").select("token", "len", "words")


#: Edits (letters taken out of either word) that are tried first, and lengths up to which they are. Lengths up to
#: which words with more edits meet by shared subsequences, longer ones by shared pieces.
CLOSE, LONG, SHORT = 2, 30, 18
#: Keys that a worker makes at once; parts of the joint length in which edits are told apart.
AT_ONCE, LEVELS = 1 << 17, 1 << 11


def common(a: Column, b: Column) -> Column:
    """Letters that words of these lengths must share, in order, to reach the cutoff."""
    return F.ceil((a + b) * F.lit(CUTOFF / 200) - F.lit(1e-9)).cast("int")


def drops(length: int, most: int, edits: range, token: bool) -> list[tuple[int, int, int]]:
    """How many letters a token or word of this length loses, what the word of such a pair loses, and the pair's level.

    Of pairs that reach the cutoff within these edits, both up to `most` letters long. The level orders a token's
    pairs as their ratios do, best first; for a word it is 0.
    """
    found = set()
    for other in range(max(1, length - MOST_DELTA), min(most, length + MOST_DELTA) + 1):
        both = length + other
        for k in edits:
            shared, odd = divmod(both - k, 2)
            if not odd and max(1, math.ceil(both * CUTOFF / 200 - 1e-9)) <= shared <= min(length, other):
                found.add((length - shared, other - shared, k * LEVELS // both) if token else (length - shared, length - shared, 0))
    return sorted(found) if length <= most else []


@lru_cache(maxsize=256)
def _left(length: int, drop: int) -> np.ndarray:
    """Places that are left when so many letters are taken out, all ways."""
    return np.array(list(combinations(range(length), length - drop)))


def _keying(most: int, edits: range, token: bool) -> Callable:
    """Words to a key of 96 bits for each subsequence that they may share with one of the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = np.array(batch["text"].to_pylist(), object)
            sizes = np.array([len(w) for w in words], np.int64)
            for size in np.unique(sizes):
                rows, ways = np.flatnonzero(sizes == size), drops(int(size), most, edits, token)
                for own, other, level in ways:
                    left = _left(int(size), own)
                    step = max(1, AT_ONCE // len(left))
                    for part in (rows[at : at + step] for at in range(0, len(rows), step)):
                        letters = words[part].astype(f"U{size}").view(np.uint32).reshape(len(part), -1).astype(np.uint64)
                        key = np.full((len(part), len(left)), 7919 + other, np.uint64)
                        check = key.copy()
                        for place in left.T:
                            key = (key ^ letters[:, place]) * np.uint64(0x9E3779B97F4A7C15)
                            key ^= key >> np.uint64(29)
                            check = check * np.uint64(0x100000001B3) + letters[:, place]
                        order = np.argsort(key, axis=1)
                        key = np.take_along_axis(key, order, axis=1)
                        fresh = np.ones(key.shape, bool)
                        fresh[:, 1:] = key[:, 1:] != key[:, :-1]
                        check = (np.take_along_axis(check, order, axis=1) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)
                        at = part[np.nonzero(fresh)[0]]
                        columns = [pa.array(key[fresh].view(np.int64)), pa.array(check[fresh].astype(np.uint32).view(np.int32)), batch["id"].take(pa.array(at)), pa.array(np.full(len(at), level))]
                        yield pa.RecordBatch.from_arrays(columns, ["key", "check", "id", "level"])

    return run


def _best_pairs(tokens: DataFrame, vocab: DataFrame, most: int, edits: range) -> DataFrame:
    """token, word: of the words(id, word; ids ordered as ties are) within these edits, the best for each token.

    The two share a key for every subsequence of the right length, so that the least edits that
    a key allows are those of the pair.
    """
    # Few small rows become many keys, so the number of tasks goes by the cores, not by the rows' size.
    tasks = 4 * tokens.sparkSession.sparkContext.defaultParallelism
    keys = lambda df, kind, token: df.repartition(tasks, "id").mapInArrow(_keying(most, edits, token), f"key long, check int, id {kind}, level long")
    t = keys(tokens.where(F.length("token") <= most).select(F.col("token").alias("text"), F.col("token").alias("id")), "string", True)
    v = keys(_near(tokens, vocab).where(F.length("word") <= most).select(F.col("word").alias("text"), "id"), "long", False)
    t = t.select("key", "check", F.col("id").alias("token"), F.shiftleft("level", 52).alias("level"))
    pairs = t.join(shuffled(v.select("key", "check", "id")), ["key", "check"])
    best = pairs.groupBy("token").agg(F.min(F.col("level").bitwiseOR(F.col("id"))).alias("best"))
    best = best.select("token", F.col("best").bitwiseAND(F.lit((1 << 52) - 1)).alias("id"))
    return best.join(shuffled(vocab.select("id", "word")), "id").select("token", "word")


def _near(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Words within two letters of a token's length."""
    lengths = F.explode(F.expr(f"sequence(length(token) - {MOST_DELTA}, length(token) + {MOST_DELTA})")).alias("_len")
    near = F.broadcast(tokens.select(lengths).distinct())  # a number for each length of a word
    return vocab.join(near, F.length("word") == F.col("_len"), "left_semi")


def _long_pairs(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Pairs in which a word is long: of k + 1 pieces of the token, k edits leave one whole, moved by k places at most."""
    t = tokens.select("token", F.length("token").alias("a")).where(F.col("a") > SHORT - MOST_DELTA)
    t = t.select("token", "a", F.explode(F.expr(f"sequence(a - {MOST_DELTA}, a + {MOST_DELTA})")).alias("b")).where((F.col("a") > SHORT) | (F.col("b") > SHORT))
    t = t.withColumn("k", F.col("a") + F.col("b") - 2 * common(F.col("a"), F.col("b")))
    t = t.withColumn("p", F.explode(F.expr("transform(sequence(0, k), i -> struct(i * a div (k + 1) + 1 AS at, (i + 1) * a div (k + 1) - i * a div (k + 1) AS size))")))
    t = t.select("token", "b", F.expr("substring(token, p.at, p.size)").alias("piece"), F.explode(F.expr("sequence(greatest(p.at - k, 1), p.at + k)")).alias("at"))
    v = vocab.select("word", F.length("word").alias("b")).where(F.col("b") > SHORT - MOST_DELTA)
    v = v.select("word", "b", F.explode(F.expr("sequence(1, b)")).alias("at"))
    v = v.select("word", "b", "at", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("size")).select("word", "b", "at", F.expr("substring(word, at, size)").alias("piece"))
    return t.join(shuffled(v), ["b", "at", "piece"]).select("token", "word").distinct()


def correct(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """token, word, ratio: the best vocabulary word for each token; ties to the shorter, then alphabetical.

    Candidates meet by equi-joins. The cutoff says how many letters two words of given lengths
    must share in order, so both are reduced to their subsequences of that many letters and
    joined on them. As fewer edits always give the better ratio, up to CLOSE are tried first
    and more only for tokens that have found nothing; of these, words over SHORT letters, of
    which there would be too many subsequences, are joined on pieces and their places.
    """
    vocab = stored(vocab.select("word").orderBy(F.length("word"), "word").withColumn("id", F.monotonically_increasing_id()), "ordered")
    scored = lambda pairs: pairs.withColumn("ratio", indel_ratio("token", "word")).where(F.col("ratio") >= CUTOFF)
    close = stored(scored(_best_pairs(tokens, vocab, LONG, range(CLOSE + 1))), "close")
    # A token near LONG may have a closer word beyond.
    done = close.where(F.length("token") <= LONG - MOST_DELTA).select("token")
    rest = stored(tokens.select("token").join(shuffled(done), "token", "left_anti"), "rest")
    far = _best_pairs(rest, vocab, SHORT, range(CLOSE + 1, 2 * SHORT)).unionByName(_long_pairs(rest, _near(rest, vocab)))
    best = Window.partitionBy("token").orderBy(F.desc("ratio"), F.length("word"), "word")
    return close.unionByName(scored(far)).withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits of a over the letters of b."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        u = free & at.get(c, 0)
        free = ((free + u) | (free - u)) & full
    return len(a) - free.bit_count()


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 * LCS / joint length."""
    return pd.Series([200.0 * lcs(x, y) / max(len(x) + len(y), 1) for x, y in zip(a, b, strict=True)])


def shaped(token: Column, word: Column) -> Column:
    """The word in the token's shape: all upper case, capitalised, or as it is."""
    return F.when(token == F.upper(token), F.upper(word)).when(F.substring(token, 1, 1) == F.upper(F.substring(token, 1, 1)), F.initcap(word)).otherwise(word)


def corrected(queries: DataFrame, fixes: DataFrame, key: str = "query_id", column: str = "text") -> DataFrame:
    """key, corrected: queries with their unknown tokens replaced, everything else as it was."""
    parts = F.regexp_extract_all(F.coalesce(column, F.lit("")), F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0))
    t = queries.select(key, F.posexplode_outer(parts).alias("i", "part"))
    # Only what can have a correction is joined: blanks and short words would be the hottest keys.
    word = F.coalesce(F.rlike("part", F.lit(f"^[A-Za-z]{{{LEAST_TOKEN},}}$")), F.lit(False))
    j = t.where(word).withColumn("token", F.lower("part")).join(shuffled(fixes.select("token", "word")), "token", "left")
    fixed = j.select(key, "i", F.when(F.col("word").isNull(), F.col("part")).otherwise(shaped(F.col("part"), F.col("word"))).alias("p"))
    all_parts = fixed.unionByName(t.where(~word).select(key, "i", F.col("part").alias("p")))
    return all_parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "p"))), lambda s: s["p"]), "").alias("corrected"))
