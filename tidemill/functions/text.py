"""Column expressions for text: cleaning, identity, predicates, routing."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemill.functions import rules

#: A word's border: no letter, digit or underscore of any script on the other side.
_W = r"[\p{L}\p{N}_]"


def whole(pattern: str) -> str:
    """The pattern between word borders, in Java's syntax."""
    return rf"(?<!{_W})(?:{pattern})(?!{_W})"


def any_of(words: list[str]) -> str:
    return "|".join(re.sub(r"\\? ", r"\\s+", re.escape(w)) for w in words)


def matches(text: Column, pattern: str) -> Column:
    return F.coalesce(F.rlike(text, F.lit("(?iu)" + pattern)), F.lit(False))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def content_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(strip(text), 256), 1, length)


def words(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def token_estimate(text: Column) -> Column:
    return F.expr("0L") + F.floor(words(text) * F.lit(13) / F.lit(10)).cast("long")


def clean(text: Column) -> Column:
    out = F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), r"[ \t]+", " ")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def display_name(url: Column) -> Column:
    """A person's name from the last part of a url: initials dotted, other words capitalised."""
    last = F.element_at(F.split(F.regexp_replace(url, r"/+$", ""), "/"), -1)
    parts = F.filter(F.split(last, "-"), lambda p: p != "")
    short = lambda p: (F.length(p) <= 2) & F.rlike(p, F.lit(r"^[A-Za-z]+$"))
    dotted = lambda p: F.concat(F.array_join(F.filter(F.split(F.upper(p), ""), lambda c: c != ""), "."), F.lit("."))
    return F.array_join(F.transform(parts, lambda p: F.when(short(p), dotted(p)).otherwise(F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, F.lit(2), F.length(p)))))), " ")


def preview(text: Column, n: int = 300) -> Column:
    return F.substring(collapse(text), 1, n)


def table_text(rows: Column) -> Column:
    """Rows of cells as lines: empty cells and rows go, line breaks in cells become spaces."""
    cells = lambda r: F.filter(F.transform(r, lambda c: strip(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")))), lambda c: c != "")
    lines = F.transform(rows, lambda r: F.array_join(cells(r), " | "))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def chunk_id(url: Column, kind: Column, content: Column) -> Column:
    return F.concat_ws("::", url, kind, content_hash(content))


def parse_chunk_id(cid: Column) -> tuple[Column, Column]:
    """Url and kind, read from the right; null unless there are three parts."""
    p = r"^(?s)(.*)::(.*?)::((?:(?!::).)*)$"
    ok = F.rlike(cid, F.lit(p))
    return F.when(ok, F.regexp_extract(cid, p, 1)), F.when(ok, F.regexp_extract(cid, p, 2))


def salted_hash(key: Column, salt: str, length: int = 32) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key), 256), 1, length)


def hmac_sha256(body: Column, secret: str) -> Column:
    """Hex HMAC of a binary or string column: two nested digests over a padded key, all in the JVM."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ mask for b in key)) for mask in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, body.cast("binary")), 256))
    return F.sha2(F.concat(outer, digest), 256)


def signed(body: Column, header: Column, secret: str | None) -> Column:
    """Whether a header sha256=<hex> signs the raw body; false without a secret, header or body."""
    if not secret:
        return F.lit(False)
    return F.coalesce(header == F.concat(F.lit("sha256="), hmac_sha256(body, secret)), F.lit(False))


def within_bounds(q: Column, least: int = 2, most: int = 500) -> Column:
    """Whether a question's length in characters is allowed; a missing one isn't."""
    return F.coalesce(F.length(q).between(least, most), F.lit(False))


def next_weekly(ts: Column, day: int = 6, hour: int = 3, zone: str = "Asia/Kolkata") -> Column:
    """First weekly run at or after ts: day counts from Monday (0), the hour is local to the zone."""
    local = F.from_utc_timestamp(ts, zone)
    run = F.date_trunc("week", local) + F.make_dt_interval(F.lit(day), F.lit(hour))
    run = F.when(run < local, run + F.make_dt_interval(F.lit(7))).otherwise(run)
    return F.to_utc_timestamp(run, zone)


def first_filled(*cols: Column, default: str) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(default))


def image_urls(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"!\[[^\]]*\]\(([^)]*)\)"), F.lit(1)))


def dump_name(url: Column) -> Column:
    """File name of a raw page: url without scheme, slashes as underscores."""
    return F.regexp_replace(F.replace(F.regexp_replace(url, r"^https?://", ""), F.lit("/"), F.lit("_")), r"^_+|_+$", "")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


# Predicates ----------------------------------------------------------------


def is_person_record(url: Column, kind: Column) -> Column:
    return F.coalesce((kind == "faculty_card") | F.contains(F.lower(url), F.lit("/faculty/")), F.lit(False))


def wants_people(q: Column) -> Column:
    return matches(q, whole(any_of(rules.PEOPLE_WORDS) + "|" + "|".join(rules.PEOPLE_PHRASES)))


def wants_principal(q: Column) -> Column:
    return matches(q, whole("principal"))


_DEPUTY = r"vice[\s\-]*chair(?:person|man)?(?!\w)|deputy\s+(?:hod|head\s+of\s+(?:the\s+)?department)(?!\w)|associate\s+dean(?!\w)"
_HEAD = rf"chair(?:person|man)(?!{_W})|{whole('hod')}|head\s+of\s+(?:the\s+)?department(?!{_W})"


def wants_head(q: Column) -> Column:
    """A head's role or a phrase for it, unless a deputy's is named."""
    return ~matches(q, _DEPUTY.replace(r"(?!\w)", rf"(?!{_W})")) & (matches(q, _HEAD) | matches(q, whole("|".join(rules.HEAD_PHRASES))))


def department_in(q: Column) -> Column:
    """The longest known department phrase in q, ties in table order."""
    out = F.lit(None).cast("string")
    for phrase in reversed(sorted(rules.DEPARTMENT_SCHOOL, key=len, reverse=True)):
        out = F.when(matches(q, whole(re.escape(phrase))), F.lit(phrase)).otherwise(out)
    return out


def school_in(q: Column) -> Column:
    engineering = matches(q, whole(any_of(rules.ENGINEERING_WORDS)))
    computing = matches(q, any_of(rules.COMPUTING_SCHOOLS)) | matches(q, whole(any_of(rules.COMPUTING_WORDS)))
    return F.when(~engineering & computing, "computing").otherwise("engineering")


def lookup(table: dict[str, str], key: Column, default: Column | None = None) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), default if default is not None else F.lit(None).cast("string"))


def canonical(department: Column) -> Column:
    d = F.lower(department)
    return lookup(rules.DEPARTMENT_ALIASES, d, d)


def department_tag(department: Column) -> Column:
    c = canonical(department)
    return lookup(rules.DEPARTMENT_TAGS, c, c)


def departments_match(a: Column, b: Column) -> Column:
    x, y = canonical(F.trim(a)), canonical(F.trim(b))
    filled = (F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")
    return filled & F.coalesce((x == y) | F.contains(x, y) | F.contains(y, x), F.lit(False))


def normalize_department(raw: Column) -> Column:
    """Strips in a fixed order, resolves aliases; null if what is left can't be a department."""
    s = collapse(raw)
    for p in (r"(?i)^\s*of\s+(?:the\s+)?", r"(?i)^\s*(?:the\s+)?(?:department|dept\.?|dep\.?|school)\s+of\s+", r"(?i)\s+engineering\s*$", r"(?i)\s+(?:and|&|,)\s*$"):
        s = F.regexp_replace(s, p, "")
    s = F.lower(F.regexp_replace(s, r"^[ ,|\-.]+|[ ,|\-.]+$", ""))
    s = lookup(rules.DEPARTMENT_ALIASES, s, s)
    good = (s != "") & (words(s) <= rules.DEPARTMENT_MAX_WORDS) & ~F.rlike(s, F.lit(rules.DEPARTMENT_REJECT)) & F.rlike(s, F.lit("[a-z]"))
    return F.when(good, s)


def listing_department(url: Column, own_names: Sequence[str] = ()) -> Column:
    """The nearest part before /faculty/ that is no campus or own name, unless a `school` comes first."""
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    at = F.array_position(parts, F.lit("faculty")).cast("int")
    back = F.filter(F.reverse(F.slice(parts, F.lit(1), F.greatest(at - 1, F.lit(0)))), lambda p: ~p.isin([*rules.CAMPUSES, *own_names]))
    first = F.try_element_at(back, F.lit(1))
    name = F.lower(F.replace(first, F.lit("-"), F.lit(" ")))
    return F.when((at > 0) & (first != "school"), lookup(rules.DEPARTMENT_ALIASES, name, name))


def needs_rewrite(q: Column) -> Column:
    s = strip(F.coalesce(q, F.lit("")))
    follows = (
        matches(s, whole(any_of(rules.FOLLOW_UP_WORDS)))
        | matches(s, rf"^\s*(?:{any_of(rules.FOLLOW_UP_STARTS)})(?!{_W})")
        | matches(s, rf"^\s*(?:{any_of(rules.FOLLOW_UP_ASKS)})\s+about(?!{_W})")
        | matches(s, whole(any_of(rules.FOLLOW_UP_REFERENCES)))
        | F.rlike(s, F.lit("(?iU)" + rules.FOLLOW_UP_TAIL))
    )
    return (s != "") & (follows | (words(s) < rules.STANDALONE_WORDS))


def declined(answer: Column) -> Column:
    low = F.lower(F.coalesce(answer, F.lit("")))
    return F.exists(F.array(*[F.lit(d) for d in rules.DECLINES]), lambda d: F.contains(low, d))


def abbreviations_in(q: Column) -> Column:
    """Abbreviations among the words of q, longest first: one split and one look-up of the words."""
    # Letters that agree with ASCII ones if case doesn't count.
    plain = F.lower(F.translate(F.coalesce(q, F.lit("")), "\u017f\u0131\u0130", "sii"))
    known = F.array(*[F.lit(s) for s in sorted(rules.ABBREVIATIONS, key=len, reverse=True)])
    return F.array_intersect(known, F.regexp_extract_all(plain, F.lit(rf"{_W}+"), F.lit(0)))


def expansions(q: Column, most: int = 4) -> Column:
    """Full forms of abbreviations in q, longest abbreviation first, at most `most`; none that q has already."""
    low = F.lower(q)
    full = F.transform(abbreviations_in(q), lambda s: lookup(rules.ABBREVIATIONS, s))
    return F.slice(F.array_distinct(F.filter(full, lambda x: ~F.contains(low, F.lower(x)))), 1, most)


def expand(q: Column, most: int = 4) -> Column:
    more = expansions(q, most)
    return F.when(F.size(more) > 0, F.concat_ws(" ", q, F.array_join(more, " "))).otherwise(q)


def keyword_category(q: Column) -> Column:
    low = F.lower(F.coalesce(q, F.lit("")))
    scores = [F.struct(sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0)).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, (c, ws) in enumerate(rules.KEYWORDS.items())]
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["c"]).otherwise(rules.FALLBACK_CATEGORY)


def parse_category(output: Column) -> Column:
    """The first category named in the last line of a model's answer; null for an empty answer."""
    s = strip(output)
    last = F.lower(F.element_at(F.split(s, r"\n"), -1))
    out = F.lit(rules.FALLBACK_CATEGORY)
    for c in reversed(rules.CATEGORIES):
        out = F.when(F.contains(last, F.lit(c)), c).otherwise(out)
    return F.when(s != "", out)


def route(principal: Column, head: Column, people: Column, dept: Column, asked: Column) -> Column:
    """Where a question is sent by what its text wants and names; null for the plain pool."""
    school = lookup(rules.DEPARTMENT_SCHOOL, dept)
    return (
        F.when(principal, F.concat(F.lit("principal_"), asked))
        .when(~head & dept.isNotNull() & people, F.concat(F.lit("faculty_"), department_tag(dept)))
        .when(head & dept.isNotNull() & school.isNotNull(), F.lit("department_heads"))
    )


def rerank_text(q: Column, school: Column) -> Column:
    return F.concat_ws(" ", q, lookup(rules.SCHOOL_NAMES, school))


def markup(answer: Column, sources: Column, band: Column, refused: Column, most: int = 4096) -> Column:
    """Markdown to a messenger's markup. The order of steps matters: bold is parked while italics change."""
    t = F.regexp_replace(answer, r"(?m)^#{1,6}\s*(.+)$", r"*$1*")
    t = F.regexp_replace(t, r"\*\*(.+?)\*\*", "\u0000$1\u0000")
    t = F.regexp_replace(t, r"(?U)(?<!\w)\*(?!\s)([^*\n]+?)(?<!\s)\*(?!\w)", r"_$1_")
    t = F.replace(t, F.lit("\u0000"), F.lit("*"))
    t = F.regexp_replace(t, r"\[([^\]]+)\]\((https?://[^)]+)\)", r"$1 ($2)")
    t = F.regexp_replace(t, r"(?m)^[ \t]*[-*][ \t]+", "• ")
    t = F.regexp_replace(t, r"`([^`]+)`", r"```$1```")
    t = F.regexp_replace(t, r"\s*\[\d+\]", "")
    t = strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))
    t = F.when((band == "medium") & ~refused, F.concat(t, F.lit("\n\n_This one I'm less sure about — worth confirming._"))).otherwise(t)
    n = F.size(sources)
    listed = F.concat(t, F.when(n == 1, "\n\n*Source:*").otherwise("\n\n*Sources:*"), F.array_join(F.transform(F.slice(sources, 1, 3), lambda u: F.concat(F.lit("\n"), u)), ""))
    t = F.when((n > 0) & ~refused, listed).otherwise(t)
    return F.when(F.length(t) > most, F.concat(F.regexp_replace(F.substring(t, 1, most - 20), r"\s+$", ""), F.lit("\n\n…(truncated)"))).otherwise(t)
