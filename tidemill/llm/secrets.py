"""Secret scans by a battery of randomness tests (operator 8), with DataFrame functions only.

Base spans (assigned values, access keys, long hex) always stay. What they hold and every
other token of 12 or more encoding characters is tested: its encoding is inferred from the
characters in it, then it is tested for uniform use of that alphabet (chi-squared), for the
share of digits that the alphabet has, for runs above and below the alphabet's middle, and
for serial correlation. The least p-value, times four, says how well the token goes with
randomness; it is rounded down to a step of a fixed grid, so that only counts by class of
length and step travel.

The discoveries are the tokens reported as `random`. Their false-discovery control is by
length class: how random tokens spread over the steps is known from the same battery on
hashes of counted numbers; how many there are follows from the steps of high p-values, which
ordinary tokens hardly reach; and what a bound lets in beyond their share is ordinary. Each
class takes the widest bound at which those are at most RATE of what it reports. The result
says for every span, base ones included, its p-value and the share of ordinary tokens among
all that are at least as random (q).

Edge cases: null text is as empty; repeated rows get a row each and count each; an empty
table gives no rows; very long texts are searched whole; only doc_id and text are read, so
further columns, whatever their names, do no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import materialise, pick
from tidemill.llm.spans import find, has, joined, overlaps

KINDS = ["assign", "access", "hex", "random"]
ASSIGN_RE = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
VALUE_RE = r"[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
ACCESS_RE = r"AKIA[A-Z0-9]+"
HEX_RE = r"[0-9a-f]{32,}"
TOKEN_RE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}+"

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings in the order in which they are tried: pattern of the whole token, alphabet.
ENCODINGS = [
    (r"^[0-9a-f]+$", DIGITS + "abcdef"),
    (r"^[0-9A-F]+$", DIGITS + "ABCDEF"),
    (r"^[A-Z2-7]+=*$", UPPER + "234567"),
    (r"^[0-9a-z]+$", DIGITS + LOWER),
    (r"^[0-9A-Za-z]+$", DIGITS + UPPER + LOWER),
    (r"^[0-9A-Za-z_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
    (r".", UPPER + LOWER + DIGITS + "+/"),
]
RATE, STEPS, CLASSES = 0.1, 80, (12, 20, 28, 40, 64, 128)
#: Random tokens a class is measured on; the last step of the p-values (over one half) that tell how many there are.
MEASURED, SURE = 2000, 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body names it."""
    return F.transform(F.array(value), body)[0]


def upper_tail(z: Column) -> Column:
    """P(Z > z) of a normal variable, by a logistic approximation good to 2e-4."""
    return let(z, lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z)))


def total(a: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))


def battery(token: Column) -> Column:
    """Combined p-value of a token under randomness."""
    alphabet = F.lit(ENCODINGS[-1][1])
    for pattern, letters in reversed(ENCODINGS[:-1]):
        alphabet = F.when(F.rlike(token, F.lit(pattern)), F.lit(letters)).otherwise(alphabet)
    letters_of = lambda body: F.filter(F.split(body, ""), lambda c: c != "")
    codes = lambda body, alphabet: F.transform(letters_of(body), lambda c: F.call_function("instr", alphabet, c).cast("double") - 1)
    return let(alphabet, lambda alphabet: let(F.regexp_replace(token, "=+$", ""), lambda body: let(codes(body, alphabet), lambda code: _combined(body, F.length(alphabet).cast("double"), code))))


def digits_test(body: Column, n: Column, k: Column) -> Column:
    """Whether about 10 of k characters are digits, too few or too many of them alike."""
    share = 10 / k
    found = F.length(F.regexp_replace(body, "[^0-9]", ""))
    return 2 * upper_tail(F.abs(found - n * share) / F.sqrt(n * share * (1 - share)))


def _combined(body: Column, k: Column, code: Column) -> Column:
    n = F.greatest(F.length(body), F.lit(2)).cast("double")
    letters = F.array_distinct(F.filter(F.split(body, ""), lambda c: c != ""))
    squares = F.aggregate(letters, F.lit(0.0), lambda s, c: s + F.pow(F.length(body) - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0)))
    p_digits = digits_test(body, n, k)
    p_chi = upper_tail((k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n))

    least = F.greatest(F.size(code) - 1, F.lit(0))
    steps = lambda f: F.zip_with(F.slice(code, F.lit(1), least), F.slice(code, F.lit(2), least), f)
    high = lambda x: x >= k / 2

    def runs_test(n1: Column) -> Column:
        n2 = F.greatest(n - n1, F.lit(1.0))
        runs = 1 + total(steps(lambda a, b: (high(a) != high(b)).cast("double")))
        of = lambda expected: F.abs(runs - expected) / F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.25)))
        return 2 * upper_tail(let(2 * n1 * n2 / n + 1, of))

    def serial_test(mean: Column) -> Column:
        var = F.greatest(total(code, lambda x: (x - mean) * (x - mean)), F.lit(1e-9))
        lag = total(steps(lambda a, b: (a - mean) * (b - mean)))
        return 2 * upper_tail(F.abs(lag / var + 1 / (n - 1)) * F.sqrt(n - 1))

    p_runs = let(F.greatest(total(code, lambda x: high(x).cast("double")), F.lit(1.0)), runs_test)
    p_serial = let(total(code) / n, serial_test)
    return F.least(F.lit(1.0), 4 * F.least(p_chi, p_digits, p_runs, p_serial))


def step_of(p: Column) -> Column:
    """Grid step of a p-value: p is at most 10 ** (-step / 10)."""
    return F.least(F.lit(STEPS), F.floor(-10 * F.log10(F.greatest(p, F.lit(1e-12))))).cast("int")


def length_class(n: Column) -> Column:
    c = F.lit(0)
    for i, least in enumerate(CLASSES):
        c = F.when(n >= least, i).otherwise(c)
    return c


def by_step(tokens: DataFrame) -> dict[int, list[int]]:
    """By length class, how many tokens(cls, step) there are at each step: a row a class and step at most."""
    out = {c: [0] * (STEPS + 1) for c in range(len(CLASSES))}
    for c, step, n in tokens.groupBy("cls", "step").agg(F.count("*").alias("n")).collect():
        out[c][step] = n
    return out


def random_tokens(spark: SparkSession) -> DataFrame:
    """cls, step of MEASURED random tokens of each class, half of them hexadecimal, half base64."""
    n = F.element_at(F.array(*map(F.lit, CLASSES)), (F.col("id") % len(CLASSES) + 1).cast("int"))
    digest = lambda i: F.sha2(F.concat(F.col("id").cast("string"), F.lit(f":{i}")), 512)
    text = F.when(F.col("id") % 2 == 0, digest(0)).otherwise(F.translate(F.base64(F.unhex(F.concat(digest(0), digest(1)))), "=\r\n", ""))
    rows = spark.range(MEASURED * len(CLASSES)).select(n.alias("n"), F.substring(text, F.lit(1), n).alias("token"))
    return rows.select(length_class(F.col("n")).alias("cls"), step_of(battery(F.col("token"))).alias("step"))


def ordinary_shares(counts: dict[int, list[int]], random: dict[int, list[int]]) -> dict[int, list[float]]:
    """By length class and step: the share of ordinary tokens among those that are at least as random."""
    out = {}
    for c, n in counts.items():
        share = [sum(random[c][: s + 1]) / max(sum(random[c]), 1) for s in range(STEPS + 1)]
        found = min(sum(n[: SURE + 1]) / max(share[SURE], 1e-9), sum(n))
        total = [sum(n[: s + 1]) for s in range(STEPS + 1)]
        out[c] = [max(0.0, t - found * p) / t if t else 1.0 for t, p in zip(total, share, strict=True)]
    return out


def bounds(counts: dict[int, list[int]], random: dict[int, list[int]], rate: float = RATE) -> dict[int, int]:
    """By length class, the first step that isn't reported any more."""
    return {c: max([s + 1 for s, q in enumerate(q_of) if q <= rate], default=0) for c, q_of in ordinary_shares(counts, random).items()}


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `_base` (kind, start, stop; by start, then kind) and `_tokens` (start, stop, cls, step)."""
    text = F.coalesce("text", F.lit(""))
    long_enough = lambda s: F.length(F.regexp_extract(s["text"], VALUE_RE, 1)) >= 8
    cols = {
        "_b0": F.filter(find(text, ASSIGN_RE, has(text, ":") | has(text, "=")), long_enough),
        "_b1": F.filter(find(text, ACCESS_RE, has(text, "AKIA")), lambda s: F.length(s["text"]) >= 16),
        "_b2": find(text, HEX_RE),
        "_t": find(text, TOKEN_RE),
    }
    df = docs.withColumns(cols)

    value = [lambda t: F.regexp_extract(t, VALUE_RE, 1), lambda t: t, lambda t: t]

    def judged(spans: Column, kind: int, token: Callable[[Column], Column] = lambda t: t) -> Column:
        def judge(s: Column) -> Column:
            of = lambda t: F.struct(length_class(F.length(t)).alias("cls"), step_of(battery(t)).alias("step"))
            found = let(token(s["text"]), of)
            return F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), found["cls"].alias("cls"), found["step"].alias("step"))

        return F.transform(spans, judge)

    df = df.withColumn("_base", F.sort_array(F.concat(*[judged(F.col(f"_b{i}"), i, value[i]) for i in range(3)])))
    apart = F.filter("_t", lambda s: ~overlaps(s, F.col("_base")))
    return df.withColumn("_tokens", judged(apart, 3)).drop(*cols)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans, and `scores`, for every row of docs(doc_id, text).

    scores: for each of the spans, in their order, p and q as p:q, comma-joined; tokens under
    12 characters are judged as ones of 12.
    """
    found = materialise(candidates(pick(docs, "doc_id", "text")).drop("text"), "secrets")
    counts = by_step(found.select(F.inline(F.concat("_base", "_tokens"))).select("cls", "step"))
    random = by_step(random_tokens(docs.sparkSession))
    limits, shares = bounds(counts, random), ordinary_shares(counts, random)
    bound = F.array(*[F.lit(limits[i]) for i in range(len(CLASSES))])
    q_of = F.array(*[F.array(*[F.lit(round(min(shares[c][s:]), 6)) for s in range(STEPS + 1)]) for c in range(len(CLASSES))])
    report = F.filter("_tokens", lambda s: s["step"] < bound[s["cls"]])
    out = found.withColumn("_spans", F.sort_array(F.concat("_base", report)))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    score = lambda s: F.concat(F.round(F.pow(F.lit(10.0), -s["step"] / 10), 8).cast("string"), F.lit(":"), q_of[s["cls"]][s["step"]].cast("string"))
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(joined(F.col("_base"), KINDS), 256).alias("base_sha256"),
        joined(F.col("_spans"), KINDS).alias("spans"),
        F.array_join(F.transform("_spans", score), ",").alias("scores"),
    )
