"""Personal data by weak supervision (operator 2), with DataFrame functions only.

Regexes propose spans: the base ones (email, ip, card, phone), which always stay, and
further ones (spelled-out addresses, phones without a plus, social security numbers,
persons after a title, and every other run of seven or more digits). Five labelers vote on
each, base spans included: format, words before it, a gazetteer, its borders, and marks of
numbers that aren't personal. Spans are counted by group (kind and pattern), votes and shape
(long, parted, few different characters): 9 * 3**5 * 8 rows at most. Expectation-maximisation
over that table estimates the labelers' reliabilities (how each votes on personal spans, and
how on others), each group's share of personal spans and each row's probability, and a logistic span classifier is fitted to those on votes, group
and shape. Both run as folds over one row in Spark; the driver sees their numbers only. Every
span gets the classifier's probability; further spans stay if it is 0.5 or more.

Edge cases: null text is as empty; repeated rows and ids get a row each; an empty table
gives no rows; without spans the classifier keeps its starting weights; very long texts are
searched whole; `redact` keeps all columns, the others read only doc_id and text, so further
columns, whatever their names, do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import materialise, pick
from tidemill.llm.spans import find, has, joined, overlaps

KINDS = ["email", "ip", "card", "phone", "ssn", "person"]
EMAIL, IP, CARD, PHONE, SSN, PERSON = range(6)

# The base patterns, written so that no text makes them scan a run twice: a match can only
# start where a run of its first class does, or where the match before it ended.
EMAIL_RE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP_RE = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
OCTET_RE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})?+"
#: Whole runs of 13 to 19 digits with single separators; shorter and longer ones fail anyway.
CARD_RE = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE_RE = r"\+[0-9][ ().0-9-]+[0-9]"

SPELLED_RE = r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,}+ ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,}+(?![A-Za-z0-9])"
LOCAL_PHONE_RE = r"(?<![0-9A-Za-z+().-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
SSN_RE = r"(?<![0-9A-Za-z.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
PERSON_RE = r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora)\.? \p{Lu}\p{Ll}{2,}+(?: \p{Lu}\p{Ll}{2,}+)?"
NUMBER_RE = r"(?<![0-9A-Za-z+(.-])(?<![0-9][ ().-])[0-9](?:[ ().-]?[0-9]){6,}+(?![0-9A-Za-z])"

#: Words that announce a kind, by kind.
CUES = [
    r"(?i)\b(?:e-?mail|mail|contact|write|correo|courriel)\b",
    r"(?i)\b(?:ip|host|server|address|login)\b",
    r"(?i)\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta)\b",
    r"(?i)\b(?:phone|tel|call|mobile|cell|fax|telefon|téléphone|teléfono)\b",
    r"(?i)\b(?:ssn|social|security)\b",
    r"(?i)\b(?:dear|name|by|from|contact|signed)\b",
]
#: Gazetteers: mail hosts, issuers' first digits, countries' dial codes.
MAIL_HOSTS = r"(?i)@(?:[a-z0-9-]+\.)*(?:example\.(?:com|org|net)|gmail\.com|yahoo\.com|outlook\.com|hotmail\.com|web\.de|gmx\.de|orange\.fr)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6)"
DIAL_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[0134-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
NOT_PERSONAL = r"(?i)(?:\bv|\bversion|\bisbn|\border|\bno\.|#|\$|€|£) ?$"

#: What looks like a date or a time.
DATE = r"^(?:(?:19|20)[0-9]{2}[-./ ][0-9]{1,2}[-./ ]|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2})"

VOTERS, ROUNDS, STEPS = 5, 25, 60
#: Groups: the four base patterns, then the further ones; their kinds. Shape flags of a span.
GROUP_KINDS = [EMAIL, IP, CARD, PHONE, EMAIL, PHONE, SSN, PERSON, PHONE]
NUMBER, SHAPES = 8, 3
#: Before the first round: shares of personal spans in the groups; counts of a labeler's votes against, none and for a personal span.
SHARES = [0.9] * 4 + [0.6] * 4 + [0.3]
PSEUDO = (1.0, 3.0, 6.0)
BEFORE = 24


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes; places count from the right."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return total + twice

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def base_spans(text: Column) -> list[Column]:
    """Arrays of base spans, one a kind."""
    digit = F.rlike(text, F.lit("[0-9]"))
    ip = F.filter(find(text, IP_RE, digit), lambda s: F.rlike(s["text"], F.lit(rf"^{OCTET_RE}(?:\.{OCTET_RE}){{3}}$")))
    card = F.filter(find(text, CARD_RE, digit), lambda s: luhn(_digits(s["text"])))
    phone = F.filter(find(text, PHONE_RE, has(text, "+")), lambda s: F.length(_digits(s["text"])).between(9, 15))
    return [find(text, EMAIL_RE, has(text, "@")), ip, card, phone]


def more_spans(text: Column) -> list[tuple[int, Column]]:
    digit = F.rlike(text, F.lit("[0-9]"))
    return [
        (EMAIL, find(text, SPELLED_RE, has(text, "(at)") | has(text, "[at]"))),
        (PHONE, find(text, LOCAL_PHONE_RE, digit)),
        (SSN, find(text, SSN_RE, digit & has(text, "-"))),
        (PERSON, find(text, PERSON_RE)),
        (PHONE, find(text, NUMBER_RE, digit)),
    ]


def _shape(t: Column) -> Column:
    """Flags: over 14 characters, parted by blanks or marks, at most four different characters."""
    few = F.size(F.array_distinct(F.split(t, ""))) <= 4
    return F.array((F.length(t) > 14).cast("int"), F.rlike(t, F.lit(r"[ ()\[\]-]")).cast("int"), few.cast("int"))


def _votes(group: int, s: Column, text: Column) -> Column:
    """What the five labelers say: 1 personal, -1 not, 0 nothing."""
    kind = GROUP_KINDS[group]
    before = F.substring(text, F.greatest(s["start"] - BEFORE + 1, F.lit(1)), F.least(s["start"], F.lit(BEFORE)))
    after = F.substring(text, s["stop"] + 1, F.lit(1))
    t = s["text"]
    like = lambda c, p: F.rlike(c, F.lit(p))
    yes = lambda good, bad: F.when(good, 1).when(bad, -1).otherwise(0)
    never = F.lit(False)
    form = {
        EMAIL: yes(like(t, r"[@)\]].*[.)\]] ?[A-Za-z]{2,10}$"), like(t, r"\.[0-9]+$")),
        IP: yes(like(t, r"^(?:[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}$"), like(t, r"^0\.")),
        CARD: yes(F.length(_digits(t)).isin(13, 15, 16, 19), never),
        PHONE: yes(F.length(_digits(t)).between(10, 13), like(t, r"(?:[0-9] ){6}")),
        SSN: yes(~like(t, r"^(?:000|666|9)|-00-|-0000$"), like(t, r"^(?:000|666|9)|-00-|-0000$")),
        PERSON: yes(like(t, r" \p{Lu}\p{Ll}+ \p{Lu}"), never),
    }[kind]
    gazetteer = {
        EMAIL: yes(like(t, MAIL_HOSTS), never),
        IP: yes(never, like(t, r"^(?:127\.|255\.|0\.)")),
        CARD: yes(like(_digits(t), ISSUERS), ~like(_digits(t), ISSUERS)),
        PHONE: yes(like(t, DIAL_CODES), like(t, r"^\(?[01]")),
        SSN: F.lit(0),
        PERSON: yes(like(t, r"^(?:Dr|Prof)"), never),
    }[kind]
    if group == NUMBER:
        form = yes(F.length(_digits(t)).between(10, 13) & like(t, r"[0-9][ ().-][0-9]") & ~like(t, DATE), F.lit(True))
    cue = yes(like(before, CUES[kind]), never)
    border = yes(like(before, r"(?:^|[\s\"'(\[:,;<])$") & like(after, r"^(?:$|[\s\"'.)\],:;>!?*&%$#])"), like(before, r"[A-Za-z0-9]$") | like(after, r"^[A-Za-z0-9]"))
    number = yes(never, like(before, NOT_PERSONAL) | like(t, DATE))
    return F.array(form, cue, gazetteer, border, number)


def candidates(docs: DataFrame) -> DataFrame:
    """docs with `_base` and `_more`: arrays of (kind, start, stop, group, votes, shape); base spans by kind and start."""
    text = F.coalesce("text", F.lit(""))
    base, more = base_spans(text), more_spans(text)
    cols = {f"_b{i}": c for i, c in enumerate(base)} | {f"_m{i}": c for i, (_, c) in enumerate(more)}
    df = docs.withColumns(cols)

    def judged(group: int, c: Column) -> Column:
        kind = F.lit(GROUP_KINDS[group]).alias("kind")
        return F.transform(c, lambda s: F.struct(kind, s["start"].alias("start"), s["stop"].alias("stop"), F.lit(group).alias("group"), _votes(group, s, text).alias("votes"), _shape(s["text"]).alias("shape")))

    df = df.withColumn("_base", F.concat(*[judged(i, F.col(f"_b{i}")) for i in range(4)]))
    named = F.concat(*[judged(4 + i, F.col(f"_m{i}")) for i in range(4)])
    df = df.withColumn("_named", F.filter(named, lambda s: ~overlaps(s, F.col("_base"))))
    # Other numbers are what none of the patterns above has taken.
    numbers = F.filter(judged(NUMBER, F.col("_m4")), lambda s: ~overlaps(s, F.col("_base")) & ~overlaps(s, F.col("_named")))
    return df.withColumn("_more", F.concat("_named", numbers)).drop(*cols, "_named")


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _total(items: Column, f) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, x: s + f(x))


def _clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def fit(found: DataFrame) -> list[float]:
    """Classifier weights: bias, one a labeler, one a group, one a shape flag. found has _base and _more."""
    each = found.select(F.explode(F.concat("_base", "_more")).alias("s"))
    table = each.groupBy("s.group", "s.votes", "s.shape").agg(F.count("*").cast("double").alias("n"))
    one = table.agg(F.sort_array(F.collect_list(F.struct("group", "votes", "shape", "n"))).alias("t"))  # a row for each pattern at most
    voters, groups, t = range(VOTERS), range(len(GROUP_KINDS)), F.col("t")
    start = lambda counts: F.array(*[F.array(*[F.lit(c / sum(counts)) for c in counts])] * VOTERS)
    state = F.struct(F.array(*[F.lit(p) for p in SHARES]).alias("prior"), start(PSEUDO).alias("yes"), start(PSEUDO[::-1]).alias("no"))

    def belief(s: Column, x: Column) -> Column:
        prior = s["prior"][x["group"]]
        z = F.log(prior / (1 - prior))
        for j in voters:
            z = z + F.log(s["yes"][j][x["votes"][j] + 1] / s["no"][j][x["votes"][j] + 1])
        return _sigmoid(z)

    def round_(s: Column, _: Column) -> Column:
        p = F.transform(t, lambda x: F.struct(x["group"].alias("group"), x["votes"].alias("votes"), (x["n"] * belief(s, x)).alias("yes"), (x["n"] * (1 - belief(s, x))).alias("no")))

        def estimate(b: Column) -> Column:
            def votes(side: str, pseudo: tuple) -> Column:
                mass = _total(b, lambda x: x[side]) + sum(pseudo)
                said = lambda j, v: _total(b, lambda x: F.when(x["votes"][j] == v, x[side]).otherwise(0.0))
                return F.array(*[F.array(*[(said(j, v) + pseudo[v + 1]) / mass for v in (-1, 0, 1)]) for j in voters])

            of = lambda g, *sides: sum((_total(b, lambda x, side=side: F.when(x["group"] == g, x[side]).otherwise(0.0)) for side in sides), F.lit(0.0))
            prior = [_clip((of(g, "yes") + 2 * SHARES[g]) / (of(g, "yes", "no") + 2), 0.02, 0.98) for g in groups]
            return F.struct(F.array(*prior).alias("prior"), votes("yes", PSEUDO).alias("yes"), votes("no", PSEUDO[::-1]).alias("no"))

        return F.transform(F.array(p), estimate)[0]

    em = one.withColumn("em", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, round_)).where(F.size("t") > 0)

    def features(x: Column) -> Column:
        own = F.transform(F.array(*[F.lit(g) for g in groups]), lambda g: (g == x["group"]).cast("double"))
        return F.concat(F.array(F.lit(1.0)), F.transform(x["votes"], lambda v: v.cast("double")), own, F.transform(x["shape"], lambda v: v.cast("double")))

    believed = em.select(F.transform("t", lambda x: F.struct(features(x).alias("f"), belief(F.col("em"), x).alias("p"), F.sqrt(x["n"]).alias("n"))).alias("t"))
    size = 1 + VOTERS + len(GROUP_KINDS) + SHAPES

    def margin(w: Column, x: Column) -> Column:
        return F.aggregate(F.zip_with(w, x["f"], lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def descend(w: Column, _: Column) -> Column:
        mass = _total(t, lambda x: x["n"])
        zero = F.array(*[F.lit(0.0)] * size)
        slope = F.aggregate(t, zero, lambda g, x: F.zip_with(g, F.transform(x["f"], lambda f: f * x["n"] * (_sigmoid(margin(w, x)) - x["p"])), lambda a, b: a + b))
        return F.zip_with(w, slope, lambda a, g: a - 1.5 * (g / mass + 0.002 * a))

    fitted = believed.select(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.array(*[F.lit(0.0)] * size), descend).alias("w")).first()
    return list(fitted[0]) if fitted else [0.0] + [1.0] * VOTERS + [0.0] * (len(GROUP_KINDS) + SHAPES)


def score(span: Column, w: list[float]) -> Column:
    """The classifier's probability that a span is personal."""
    z = F.lit(w[0]) + F.element_at(F.array(*[F.lit(x) for x in w[1 + VOTERS : 1 + VOTERS + len(GROUP_KINDS)]]), span["group"] + 1)
    for j in range(VOTERS):
        z = z + span["votes"][j] * F.lit(w[1 + j])
    for j in range(SHAPES):
        z = z + span["shape"][j] * F.lit(w[1 + VOTERS + len(GROUP_KINDS) + j])
    return _sigmoid(z)


def personal(found: DataFrame, w: list[float]) -> DataFrame:
    """found with `spans`: base spans and further ones that the classifier keeps, by kind and start, each with its probability p."""
    named = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), score(s, w).alias("p"))
    kept = F.concat(F.transform("_base", named), F.filter(F.transform("_more", named), lambda s: s["p"] >= 0.5))
    return found.withColumn("spans", F.sort_array(kept))


def find_personal(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans, and `scores`, for every row of docs(doc_id, text).

    scores: each span's probability, in the order of spans, comma-joined.
    """
    found = materialise(candidates(pick(docs, "doc_id", "text")).drop("text"), "pii")
    out = personal(found, fit(found))
    count = lambda k: F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long")
    return out.select(
        "doc_id",
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)],
        F.sha2(joined(F.col("_base"), KINDS), 256).alias("base_sha256"),
        joined(F.col("spans"), KINDS).alias("spans"),
        F.array_join(F.transform("spans", lambda s: F.round(s["p"], 6).cast("string")), ",").alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by [KIND]; overlapping spans become one, of the first's kind."""
    # The rows travel packed, so that none of their columns meets a working name.
    found = candidates(docs.select(F.struct(*docs.columns).alias("_row"), "text"))
    w = fit(materialise(found.select("_base", "_more").where((F.size("_base") > 0) | (F.size("_more") > 0)), "pii"))
    found = personal(found, w)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("neg"), s["kind"].alias("kind"))))
    table = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        stop = -x["neg"]
        piece = F.array(F.concat(F.substring(F.col("text"), s["at"] + 1, x["start"] - s["at"]), table[x["kind"]]))
        fresh = F.struct(stop.alias("at"), F.concat(s["out"], piece).alias("out"))
        longer = F.struct(F.greatest(s["at"], stop).alias("at"), s["out"].alias("out"))
        return F.when(x["start"] >= s["at"], fresh).otherwise(longer)

    state = F.aggregate("_cuts", start, step)
    whole = F.concat(F.array_join(F.col("_state")["out"], ""), F.substring(F.col("text"), F.col("_state")["at"] + 1, F.length("text")))
    found = found.withColumn("_cuts", by_start).withColumn("_state", F.when(F.size("_cuts") > 0, state))
    text = F.when(F.size("_cuts") > 0, whole).otherwise(F.col("text"))
    return found.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in docs.columns])
