"""Pages to chunks with the standard library's parser and an own tree.

Void elements never stay open; an end tag closes up to its nearest open start tag, and one
without a start tag is ignored. Paragraphs and list items are not closed by their siblings,
so nested ones repeat their text, as lenient parsers without such rules do.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame

from tidemill.functions import roles, rules

#: Pages whose chunks are handed back together.
AT_ONCE = 100
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
SILENT = frozenset(["script", "style", "template"])
CHUNK = "chunk_id string, source_url string, title string, heading string, chunk_type string, content string, token_estimate long, photo_url string, profile_url string"


class Node:
    __slots__ = ("attrs", "children", "name", "order", "parent")

    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None, order: int):
        self.name, self.attrs, self.parent, self.order = name, attrs, parent, order
        self.children: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order; a child list may change meanwhile."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def texts(self) -> Iterator[str]:
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                yield x
            elif x.name not in SILENT:
                stack += reversed(x.children)

    def text(self, glue: str = "") -> str:
        return glue.join(s for s in (t.strip() for t in self.texts()) if s)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def drop(self) -> None:
        if self.parent:
            self.parent.children = [c for c in self.parent.children if c is not self]
            self.parent = None

    def first(self, *names: str, attr: str | None = None) -> Node | None:
        return next((n for n in self.walk() if n.name in names and (attr is None or attr in n.attrs)), None)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None, 0)
        self.count = 0

    def handle_starttag(self, tag, attrs):
        self.count += 1
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at, self.count)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        at = self.at
        self.handle_starttag(tag, attrs)
        self.at = at

    def handle_endtag(self, tag):
        node = self.at
        while node.parent and node.name != tag:
            node = node.parent
        if node.parent:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _noise(n: Node, ids: frozenset[str]) -> bool:
    return n.name in rules.NOISE_TAGS or n.attrs.get("id") in ids or any(c in rules.NOISE_CLASSES for c in n.classes())


def _web(base: str, ref: str) -> str:
    try:
        url = urljoin(base, ref)
    except ValueError:
        return ""
    return url if url.startswith(("http://", "https://")) else ""


def starts_entry(li: Node) -> bool:
    strong = li.first("strong", "b")
    return bool(strong and re.match(rf"\s*(?:{'|'.join(rules.MONTHS)})\s+\d{{4}}", strong.text()))


def table_rows(table: Node) -> str:
    rows = ([c.text(" ") for c in tr.walk() if c.name in ("th", "td")] for tr in table.walk() if tr.name == "tr")
    lines = (" | ".join(c for c in r if c) for r in rows)
    return "\n".join(x for x in lines if x)


def page_chunks(html: str | None, url: str, title: str, own_names: Sequence[str] = ()) -> list[dict]:
    """Tables first, then cards, then the running text by section.

    own_names: words of the institution's own name; a block that tells why to choose it is noise.
    """
    root = parse(html or "")
    ids = frozenset([*rules.NOISE_IDS, *(f"why-{name}-sec" for name in own_names)])
    for n in list(root.walk()):
        if _noise(n, ids):
            n.drop()
    body = next((n for n in root.walk() if n.name in ("main", "article") or "content" in n.classes() or n.attrs.get("id") == "content"), root)
    portrait = next((n for n in root.walk() if n.name == "img" and "src" in n.attrs and ("wp-post-image" in n.classes() or _inside(n, "fac-inner-left"))), None)
    photo = _web(url, portrait.attrs["src"]) if portrait else ""
    found: list[dict] = []

    headings = [n for n in root.walk() if n.name in ("h1", "h2", "h3", "h4")]
    for table in [n for n in body.walk() if n.name == "table"]:
        before = [h for h in headings if h.order < table.order]
        heading = before[-1].text() if before else None
        text = table_rows(table)
        if text.strip():
            name = heading or "General"
            found.append({"heading": heading, "kind": "table", "content": f"{name}\n\nThe following table shows {name.lower()} details for {title}, including the data below:\n\n{text}"})
        table.drop()

    for card in [n for n in body.walk() if "fc-item" in n.classes()]:
        text = re.sub(r"\s+", " ", card.text(" ")).strip()
        if not text:
            continue
        img, link = card.first("img", attr="src"), card.first("a", attr="href")
        picture = _web(url, img.attrs["src"]) if img else ""
        profile = _web(url, link.attrs["href"]) if link else ""
        found.append({"heading": "Faculty", "kind": "faculty_card", "content": f"Faculty\n\n{text}" + (f" Profile: {profile}" if profile else ""), "photo": picture, "profile": profile})
        card.drop()

    heading, lines = None, []

    def close() -> None:
        text = "\n".join(lines).strip()
        if text:
            found.append({"heading": heading, "kind": "text", "content": f"{heading}\n\n{text}" if heading else text})
            lines.clear()

    for n in body.walk():
        if n.name in ("h1", "h2", "h3", "h4"):
            close()
            heading = n.text()
        elif n.name == "li" and (text := n.text(" ")):
            if starts_entry(n):
                close()
            lines.append(f"* {text}")
        elif n.name == "p" and (text := n.text(" ")):
            lines.append(text)
    close()

    return [
        {
            "chunk_id": f"{url}::{c['kind']}::{hashlib.sha256(c['content'].strip().encode()).hexdigest()[:16]}",
            "source_url": url,
            "title": title,
            "heading": c["heading"],
            "chunk_type": c["kind"],
            "content": c["content"],
            "token_estimate": len(c["content"].split()) * 13 // 10,
            "photo_url": c.get("photo") or photo,
            "profile_url": c.get("profile") or "",
        }
        for c in found
    ]


def _inside(n: Node, name: str) -> bool:
    while n.parent:
        n = n.parent
        if name in n.classes():
            return True
    return False


def extract(pages: DataFrame, own_names: Sequence[str] = ()) -> DataFrame:
    """Chunks of pages(url, title, html), with roles and departments; of equal ids in a page the last stays."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in CHUNK.split(", ")]
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                part = batch.iloc[at : at + AT_ONCE].itertuples(index=False)
                rows = [c for r in part for c in {c["chunk_id"]: c for c in page_chunks(r.html, r.url or "", r.title or "", own_names)}.values()]
                yield pd.DataFrame(rows, columns=columns)

    chunks = pages.select("url", "title", "html").mapInPandas(run, CHUNK)
    return roles.metadata(chunks, "content", "source_url", "chunk_type", own_names)
