"""Block parsers of office files, which are zipped XML: the standard library reads them.

Documents have one page, slides and sheets are pages of their own. Sheets give stored
values, not formulas; a date is the number that is stored for it.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from tidemill.sources.files import clean_text, parser

Node = ElementTree.Element
Block = tuple[str, int, str]


def _name(node: Node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _below(node: Node, *names: str) -> Iterator[Node]:
    return (n for n in node.iter() if _name(n) in names)


def _attribute(node: Node, name: str) -> str:
    """An attribute of any name space."""
    return next((v for k, v in node.attrib.items() if k.rsplit("}", 1)[-1] == name), "")


class Package:
    """The parts of an office file and the links between them."""

    def __init__(self, data: bytes):
        self.files = zipfile.ZipFile(io.BytesIO(data))

    def part(self, name: str) -> Node:
        return ElementTree.fromstring(self.files.read(name))

    def links(self, name: str) -> dict[str, tuple[str, str]]:
        """id: (kind, part) of what a part points to."""
        folder, base = posixpath.split(name)
        rels = f"{folder}/_rels/{base}.rels"
        if rels not in self.files.namelist():
            return {}
        place = lambda t: t.lstrip("/") if t.startswith("/") else posixpath.normpath(posixpath.join(folder, t))
        return {n.attrib["Id"]: (n.attrib["Type"].rsplit("/", 1)[-1], place(n.attrib["Target"])) for n in self.part(rels)}

    def listed(self, name: str, item: str) -> Iterator[tuple[Node, str]]:
        """The items of a part's list, each with the part its link names."""
        links = self.links(name)
        for n in _below(self.part(name), item):
            target = links.get(n.attrib.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id", ""))
            if target:
                yield n, target[1]


def _paragraph(node: Node) -> str:
    marks = {"br": "\n", "cr": "\n", "tab": "\t"}
    return "".join((n.text or "") if _name(n) == "t" else marks.get(_name(n), "") for n in node.iter())


def _frame(node: Node) -> str:
    return clean_text("\n".join(map(_paragraph, _below(node, "p"))))


def _grid(rows: Iterator[list[str]]) -> str:
    """Rows of cells as lines; what is empty goes, line breaks in cells become spaces."""
    kept = ([c for c in (clean_text(c).replace("\n", " ") for c in row) if c] for row in rows)
    return "\n".join(" | ".join(row) for row in kept if row)


def _table(node: Node) -> str:
    return _grid(["\n".join(map(_paragraph, _below(cell, "p"))) for cell in _below(row, "tc")] for row in _below(node, "tr"))


@parser(".docx")
def parse_document(data: bytes) -> list[Block]:
    """All paragraphs as one block, then each table."""
    body = next(_below(Package(data).part("word/document.xml"), "body"))
    text = "\n".join(filter(None, (clean_text(_paragraph(n)) for n in body if _name(n) == "p")))
    found = [(text, "text"), *((_table(n), "table") for n in body if _name(n) == "tbl")]
    return [(t, 1, kind) for t, kind in found if t]


@parser(".pptx")
def parse_slides(data: bytes) -> list[Block]:
    """A block a slide: its shapes and tables in order, then the speaker's notes."""
    package, out = Package(data), []
    for page, (_, name) in enumerate(package.listed("ppt/presentation.xml", "sldId"), start=1):
        parts = [_frame(n) if _name(n) == "sp" else _table(n) for n in _below(package.part(name), "sp", "tbl")]
        for kind, target in package.links(name).values():
            if kind == "notesSlide":
                notes = [_frame(n) for n in _below(package.part(target), "sp") if any(_attribute(p, "type") == "body" for p in _below(n, "ph"))]
                parts += [f"Speaker notes: {t}" for t in notes if t]
        if any(parts):
            out.append(("\n".join(filter(None, parts)), page, "slide"))
    return out


@parser(".xlsx", ".xlsm")
def parse_sheets(data: bytes) -> list[Block]:
    """A block a sheet: its name and its rows."""
    package = Package(data)
    strings = package.part("xl/sharedStrings.xml") if "xl/sharedStrings.xml" in package.files.namelist() else ()
    shared = [_paragraph(s) for s in strings]

    def value(cell: Node) -> str:
        stored, kind = next((v.text or "" for v in _below(cell, "v")), ""), cell.attrib.get("t")
        if kind == "inlineStr":
            return _paragraph(cell)
        if kind == "s":
            return shared[int(stored)] if re.fullmatch(r"\d+", stored) else ""
        return {"1": "True", "0": "False"}.get(stored, stored) if kind == "b" else stored

    out = []
    for page, (sheet, name) in enumerate(package.listed("xl/workbook.xml", "sheet"), start=1):
        rows = _grid([value(c) for c in _below(row, "c")] for row in _below(package.part(name), "row"))
        if rows:
            out.append((f"Sheet: {sheet.attrib['name']}\n{rows}", page, "sheet"))
    return out
