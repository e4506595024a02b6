"""Plain Python versions of operators that SQL can't express."""

import hashlib
import math
import re
from collections import Counter


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def luhn(d: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c)
        if i % 2:
            v = v * 2 - 9 if v > 4 else v * 2
        total += v
    return total % 10 == 0


def pii_base(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m)) <= 19 and luhn(digits(m))]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m)) <= 15]
    return out


def secret_base(text: str | None) -> list[tuple[str, int, int]]:
    text = text or ""
    out = []
    for m in re.finditer(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(("assign", "access", "hex")[k], s, e) for s, k, e in sorted(out)]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def quality_features(text):
    """The quality classifier's features, one loop each."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [0.0] * 16
    kept = [chr(b) for b in data if b not in b" \t\n\x0b\x0c\r"]
    is_symbol = lambda c: "!" <= c <= "~" and not (c.isascii() and c.isalnum()) and c not in ".,'\"-()"
    symbols = sum(map(is_symbol, kept))
    bars, bangs = kept.count("|"), kept.count("!")
    other = symbols - bars - bangs
    upper = sum("A" <= c <= "Z" for c in kept)
    rest = len(kept) - symbols - sum("0" <= c <= "9" for c in kept)
    n, lines = len(words), data.split(b"\n")
    repeats = sum(words[i] == words[i - 1] for i in range(1, n))
    return [
        symbols / len(kept), math.log1p(other), other / n, math.log1p(bars), bars / n, math.log1p(bangs), bangs / n, upper / max(rest, 1),
        math.log1p(max(upper - 0.2 * n, 0)), repeats / n, math.log1p(repeats), len(set(words)) / n, max(map(words.count, set(words))) / n,
        1 - len(set(lines)) / len(lines), sum(len(x.split()) < 4 for x in lines) / len(lines), math.log1p(n),
    ]


def plain_battery(token):
    """Combined p-value of a token under randomness, test by test."""
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for pattern, letters in [
        ("[0-9a-f]+", digits + "abcdef"), ("[0-9A-F]+", digits + "ABCDEF"), ("[A-Z2-7]+=*", upper + "234567"), ("[0-9a-z]+", digits + lower),
        ("[0-9A-Za-z]+", digits + upper + lower), ("[0-9A-Za-z_-]+=*", upper + lower + digits + "-_"), (".*", upper + lower + digits + "+/"),
    ]:
        if re.fullmatch(pattern, token):
            break
    body = token.rstrip("=")
    n, k = max(len(body), 2), len(letters)
    tail = lambda z: 1 / (1 + math.exp(min(1.5976 * z + 0.07056 * z**3, 700)))
    chi = k / n * sum(body.count(c) ** 2 for c in set(body)) - n
    p_chi = tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
    code = [letters.find(c) for c in body]
    high = [x >= k / 2 for x in code]
    n1 = max(sum(high), 1)
    n2 = max(n - n1, 1)
    runs, expected = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False)), 2 * n1 * n2 / n + 1
    p_runs = 2 * tail(abs(runs - expected) / math.sqrt(max((expected - 1) * (expected - 2) / (n - 1), 0.25)))
    mean = sum(code) / n
    var = max(sum((x - mean) ** 2 for x in code), 1e-9)
    lag = sum((a - mean) * (b - mean) for a, b in zip(code, code[1:], strict=False))
    p_serial = 2 * tail(abs(lag / var + 1 / (n - 1)) * math.sqrt(n - 1))
    share = 10 / k
    p_digits = 2 * tail(abs(sum(c.isdigit() for c in body) - n * share) / math.sqrt(n * share * (1 - share)))
    return min(1, 4 * min(p_chi, p_digits, p_runs, p_serial))


SHARES, PSEUDO = [0.9] * 4 + [0.6] * 4 + [0.3], (1, 3, 6)


def sigmoid(z):
    return 1 / (1 + math.exp(-z))


def plain_features(group, votes, shape):
    return [1.0, *map(float, votes), *(float(g == group) for g in range(len(SHARES))), *map(float, shape)]


def plain_fit(spans, voters=5, rounds=25, steps=60):
    """How labelers vote on personal spans and on others, by expectation-maximisation, then the span classifier's weights; spans: (group, votes, shape)."""
    table = sorted(Counter(spans).items())
    clip = lambda x, lo, hi: max(lo, min(hi, x))
    prior = list(SHARES)
    yes, no = ([[c / sum(p) for c in p] for _ in range(voters)] for p in (PSEUDO, PSEUDO[::-1]))
    belief = lambda g, votes: sigmoid(math.log(prior[g] / (1 - prior[g])) + sum(math.log(yes[j][v + 1] / no[j][v + 1]) for j, v in enumerate(votes)))
    for _ in range(rounds):
        p = [(g, votes, n * belief(g, votes), n * (1 - belief(g, votes))) for (g, votes, _), n in table]
        sides = []
        for at, pseudo in ((2, PSEUDO), (3, PSEUDO[::-1])):
            mass = sum(x[at] for x in p) + sum(pseudo)
            sides.append([[(sum(x[at] for x in p if x[1][j] == v) + pseudo[v + 1]) / mass for v in (-1, 0, 1)] for j in range(voters)])
        prior = [clip((sum(x[2] for x in p if x[0] == g) + 2 * SHARES[g]) / (sum(x[2] + x[3] for x in p if x[0] == g) + 2), 0.02, 0.98) for g in range(len(SHARES))]
        yes, no = sides
    rows = [(plain_features(g, votes, shape), belief(g, votes), math.sqrt(n)) for (g, votes, shape), n in table]
    mass, w = sum(n for *_, n in rows), [0.0] * (1 + voters + len(SHARES) + 3)
    for _ in range(steps):
        slope = [0.0] * len(w)
        for f, p, n in rows:
            miss = n * (sigmoid(sum(a * b for a, b in zip(w, f, strict=True))) - p)
            slope = [g + miss * x for g, x in zip(slope, f, strict=True)]
        w = [a - 1.5 * (g / mass + 0.002 * a) for a, g in zip(w, slope, strict=True)]
    return w
