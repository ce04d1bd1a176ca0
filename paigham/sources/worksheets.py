"""Worksheets of an Office Open XML workbook, read with the standard library: cells as text, blank ones as null."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

# The namespaces of the format.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class NoSheet(Exception):
    """The workbook has no worksheet of that name."""


def _column(reference: str) -> int:
    """``B7`` is column 1."""
    n = 0
    for c in re.match(r"[A-Z]+", reference)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node) -> str:
    """The runs of a string, without the reading aids beside them."""
    return "".join(t.text or "" for part in ([node] if node.find(f"{MAIN}t") is not None else node.findall(f"{MAIN}r")) for t in part.findall(f"{MAIN}t"))


def _value(cell, shared: list[str]) -> str | None:
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        inline = cell.find(f"{MAIN}is")
        return _text(inline) if inline is not None else None
    value = cell.findtext(f"{MAIN}v")
    if value is None or kind == "e":
        return None
    if kind == "s":
        return shared[int(value)]
    return {"0": "FALSE", "1": "TRUE"}.get(value, value) if kind == "b" else value


def read(content: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """The rows of the named worksheet, else of the first; rows without a value are left out."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        names = {s.get("name"): s.get(LINK) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet")}
        if not names or (sheet is not None and sheet not in names):
            raise NoSheet(repr(sheet))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        target = targets[names[sheet] if sheet is not None else next(iter(names.values()))]
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).findall(f"{MAIN}si")]
        rows = []
        for row in ElementTree.fromstring(book.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}")).iter(f"{MAIN}row"):
            values: list[str | None] = []
            for at, cell in enumerate(row.findall(f"{MAIN}c")):
                place = _column(cell.get("r")) if cell.get("r") else at
                values += [None] * (place + 1 - len(values))
                values[place] = _value(cell, shared)
            if any(v is not None for v in values):
                rows.append(values)
        return rows
