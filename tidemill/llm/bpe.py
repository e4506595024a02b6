"""BPE encoding and decoding: speculate and verify (operator 7).

For a vocabulary whose merges have one result each (as trained ones do), a token sequence
is the BPE encoding of a word exactly if every adjacent pair is: encoding the pair's joint
text gives the pair back. So each distinct word is first cut by greedy longest match;
the adjacent pairs of all cuts are tested together with numpy, by undoing merges in falling
rank until the pair proves compatible or a better merge across the border shows; and only
words with a failing pair undergo exact merging.

A worker remembers the ids of pieces between white space in two generations of bounded
size, and forgets them when its partition ends.

Edge cases: null is as empty: no tokens, and the digest of an empty string; special
strings inside a text become their ids, as in the library; very long texts are encoded whole,
some GROUP_CHARS characters at a time; repeated rows get a row each; an empty table gives no
rows; only doc_id and text are read, so further columns, whatever their names, do no harm.
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import pick, small_batches

#: Pieces of text, and their characters, that one generation of a worker's memory holds.
MEMO, MEMO_CHARS = 250_000, 5_000_000
#: Characters that are cut, tested and looked up at once.
GROUP_CHARS = 1_000_000


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class SpeculativeBPE:
    """Words to token ids, for a BPE model with a word-end suffix."""

    def __init__(self, model: dict, exact=None):
        """exact: merges a word exactly, to ids; `merge` if there is none."""
        self.vocab: dict[str, int] = model["vocab"]
        self.merge_exactly = exact or self.merge
        self.end: str = model.get("end_of_word_suffix") or ""
        if model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("this model has features that aren't handled")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.size = max(self.vocab.values()) + 1
        #: id: rank of the merge that makes it (-1: none) and that merge's two sides
        self.rank = np.full(self.size, -1, np.int64)
        self.left = np.arange(self.size)
        self.right = np.arange(self.size)
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = self.vocab[a], self.vocab[b], self.vocab[a + b]
            if self.rank[z] >= 0:
                raise ValueError("two merges make the same token")
            self.rank[z], self.left[z], self.right[z] = r, x, y
            self.pairs[x, y] = (r, z)
        keys = np.array([x * self.size + y for x, y in self.pairs], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_rank = np.array([r for r, _ in self.pairs.values()], np.int64)[order]
        #: Only tokens that merging reaches take part in the longest match.
        self.inner = {t: i for t, i in self.vocab.items() if not self.end or not t.endswith(self.end)}
        self.last = {t.removesuffix(self.end): i for t, i in self.vocab.items() if t.endswith(self.end)} if self.end else self.vocab
        #: First two characters of a token that ends no word: length of the longest such token.
        self.most: dict[str, int] = {}
        for t in self.inner:
            self.most[t[:2]] = max(self.most.get(t[:2], 0), len(t))
        self.seen = self.exact = 0

    def greedy(self, word: str) -> list[int]:
        out, at, n = [], 0, len(word)
        while at < n:
            if (x := self.last.get(word[at:])) is not None:
                out.append(x)
                return out
            for to in range(min(n - 1, at + self.most.get(word[at : at + 2], 1)), at, -1):
                if (x := self.inner.get(word[at:to])) is not None:
                    out.append(x)
                    at = to
                    break
            else:
                raise ValueError(f"no token for {word[at]!r}")
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of ids whether merging its joint text keeps the border between them.

        Walks back in time: a border merge of rank r is taken if it came before the merges
        that built the two tokens at its sides. Undoing the later of them exposes the next.
        """
        left, right = a.copy(), b.copy()
        good = np.ones(len(a), bool)
        # Rank at which the present left (right) part was swallowed by a larger one.
        gone_l = np.full(len(a), np.iinfo(np.int64).max)
        gone_r = gone_l.copy()
        live = np.arange(len(a))
        while len(live):
            x, y = left[live], right[live]
            key = x * self.size + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.key_rank[at], np.iinfo(np.int64).max)
            # The left part goes only if its swallowing merge is earlier; at the same rank the
            # leftmost place wins, which is the one inside the left token.
            broken = (rank < gone_l[live]) & (rank <= gone_r[live])
            good[live[broken]] = False
            live, x, y = live[~broken], x[~broken], y[~broken]
            rx, ry = self.rank[x], self.rank[y]
            done = (rx < 0) & (ry < 0)
            live, x, y, rx, ry = live[~done], x[~done], y[~done], rx[~done], ry[~done]
            # Undo the later merge; at equal ranks the right one, as the left place goes first.
            on_left = rx > ry
            i = live[on_left]
            gone_l[i], left[i] = rx[on_left], self.right[x[on_left]]
            i = live[~on_left]
            gone_r[i], right[i] = ry[~on_left], self.left[y[~on_left]]
        return good

    def merge(self, word: str) -> list[int]:
        """Exact merging: the lowest rank, leftmost first, until none is left."""
        ids = [self.vocab[c] for c in word[:-1]] + [self.vocab[word[-1] + self.end]]
        while len(ids) > 1:
            found = [(p[0], i, p[1]) for i, q in enumerate(zip(ids, ids[1:], strict=False)) if (p := self.pairs.get(q))]
            if not found:
                break
            _, i, z = min(found)
            ids[i : i + 2] = [z]
        return ids

    def encode_words(self, words: list[str]) -> list[list[int]]:
        cuts = [self.greedy(w) for w in words]
        self.seen += len(cuts)
        lengths = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter((x for c in cuts for x in c), np.int64, int(lengths.sum()))
        if len(flat) < 2:
            return cuts
        owner = np.repeat(np.arange(len(cuts)), lengths)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        if not len(inside):
            return cuts
        keys, back = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        good = self.compatible(keys // self.size, keys % self.size)[back]
        for i in np.unique(owner[inside[~good]]):
            cuts[i] = self.merge_exactly(words[i])
            self.exact += 1
        return cuts


def _below_u0250(pattern: str) -> str:
    """The split pattern with its classes of letters and numbers spelled out, for characters below U+0250."""
    for kind in "LN":
        held = "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)
        pattern = pattern.replace(f"[\\p{{{kind}}}]", f"[{held}]").replace(f"\\p{{{kind}}}", held)
    return pattern


class WordTokenizer:
    """Whole texts, for tokenizers that split into words and join byte-level symbols."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tok = Tokenizer.from_file(path)
        merge = tok.model.tokenize
        self.model = SpeculativeBPE(spec["model"], lambda word: [t.id for t in merge(word)])
        self.normalise = tok.normalizer.normalize_str if tok.normalizer else str
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens with options aren't handled")
        splits = [s["pattern"]["Regex"] for s in spec["pre_tokenizer"].get("pretokenizers", []) if s["type"] == "Split"]
        if len(splits) != 1:
            raise ValueError("one split pattern is expected")
        self.findall = re.compile(_below_u0250(splits[0])).findall
        #: Where the library's tables of letters or white space could differ from Python's, the library splits.
        self.rare = re.compile(r"[^\x00-\x1B\x20-\u024F]").search
        self.control = re.compile(r"[\x1C-\x1F]").search
        self.gap = re.compile(r"\s+").search
        self.pre = tok.pre_tokenizer.pre_tokenize_str
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.bytes = byte_alphabet()
        self.names = {str(i): t for t, i in [*self.model.vocab.items(), *self.special.items()]}
        self.spell = lambda word: "".join(map(self.bytes.__getitem__, word.encode()))
        plain = {c: bytes([b]) for b, c in enumerate(self.bytes)}
        self.unspell = lambda word: b"".join(map(plain.__getitem__, word)).decode()
        self.forget()

    def forget(self) -> None:
        self.young: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.held = 0

    def words(self, piece: str) -> list[str]:
        """The words of a piece of text that the split pattern finds in it once it is normalised."""
        low = piece.lower()  # below U+0250 all is composed already
        if self.rare(piece) or self.rare(low):
            return [self.unspell(w) for w, _ in self.pre(self.normalise(piece))]
        return [low] if low.isalpha() else self.findall(low)

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that neither generation holds, each distinct word of them once."""
        cut = list(map(self.words, pieces))
        words = list(dict.fromkeys(chain.from_iterable(cut)))
        spelled = [w if w.isascii() and w.isprintable() else self.spell(w) for w in words]
        ids = [" ".join(map(str, x)) for x in self.model.encode_words(spelled)]
        one = dict(zip(words, ids, strict=True))
        for piece, ws in zip(pieces, cut, strict=True):
            self.young[piece] = one[ws[0]] if len(ws) == 1 else " ".join(map(one.__getitem__, ws))

    def known(self, pieces: list[str]) -> list[str]:
        """The ids of pieces, from the memory or computed together.

        What is asked for moves to the young generation; when that is full it becomes the old one.
        """
        new = set(pieces).difference(self.young)
        if new:
            self.held += sum(map(len, new))
            again = new.intersection(self.old)
            self.young.update((x, self.old[x]) for x in again)
            self.learn(list(new - again))
        found = list(map(self.young.__getitem__, pieces))
        if len(self.young) > MEMO or self.held > MEMO_CHARS:
            self.old, self.young, self.held = self.young, {}, 0
        return found

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Lists of pieces between white space, of some GROUP_CHARS characters each.

        No word and no step of normalising reaches across white space. Texts with the
        separators U+001C to U+001F, which Python alone counts as white space, stay whole.
        """
        if self.control(text):
            yield [text]
            return
        at = 0
        while at < len(text):
            gap = self.gap(text, at + GROUP_CHARS)
            to = gap.end() if gap else len(text)
            yield text[at:to].split()
            at = to

    def split(self, text: str) -> list[tuple[str, bool]]:
        """Words in order, and whether each is a special string."""
        if self.at_special is None or "<" not in text:
            return [(text, False)] if text else []
        out, at = [], 0
        for m in self.at_special.finditer(text):
            out += [(text[at : m.start()], False)] if m.start() > at else []
            out.append((m[0], True))
            at = m.end()
        return out + ([(text[at:], False)] if at < len(text) else [])

    def encode(self, texts: list[str]) -> list[str]:
        """The ids of each text, joined by spaces."""
        out: list[list[str]] = []
        waiting: list[tuple[int, list[str]]] = []  # place of a text and some of its pieces
        size = 0

        def settle() -> None:
            nonlocal size
            found = iter(self.known(list(chain.from_iterable(ps for _, ps in waiting))))
            for i, ps in waiting:
                out[i].append(" ".join(islice(found, len(ps))))
            waiting.clear()
            size = 0

        for i, text in enumerate(texts):
            out.append([])
            for part, special in self.split(text):
                if special:
                    settle()  # what stands before it comes first
                    out[i].append(str(self.special[part]))
                    continue
                for pieces in self.pieces(part):
                    waiting.append((i, pieces))
                    size += min(len(part), GROUP_CHARS)
                    if size >= GROUP_CHARS:
                        settle()
        settle()
        return [" ".join(filter(None, x)) for x in out]

    def decode(self, ids: str) -> tuple[int, str]:
        """How many ids there are, and their tokens joined as the library does without a decoder."""
        each = ids.split()
        return len(each), " ".join(map(self.names.__getitem__, each))


@lru_cache(maxsize=2)
def load(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@contextmanager
def no_cycles() -> Iterator[None]:
    """Encoding makes many lists and no cycles, so the collector would only walk through the memory."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(path)
        tok.forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = [x or "" for x in batch.column(1).slice(at, 256).to_pylist()]
                with no_cycles():
                    ids = tok.encode(texts)
                    count, decoded = zip(*map(tok.decode, ids), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), pa.array(count, pa.int64()), pa.array(ids, pa.large_string()).cast(pa.string()), pa.array(decoded, pa.string())],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
        tok.forget()  # the worker lives on

    return run


def bpe_round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by spaces) and decoded text of every row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    slim = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return slim.mapInArrow(_encode(tokenizer), "doc_id long, n_tokens long, ids string, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The SHA-256 columns of a round trip."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def hexdigest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
