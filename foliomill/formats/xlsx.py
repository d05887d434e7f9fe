"""Workbooks to rows of cells, strings, sheets and anchors; operators.sheets makes the tables of them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

from .xml import attr, child, children, every, parse, relationships, text

BOOK = "xl/workbook.xml"


def number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def place(ref: str | None) -> tuple[int, int]:
    """(row, column) of a reference such as AB12; (0, 0) if it is none."""
    m = re.fullmatch("([A-Z]+)([0-9]+)", ref or "")
    return (int(m[2]), number(m[1])) if m else (0, 0)


def sheets(z: zipfile.ZipFile) -> list[tuple[int, str, str]]:
    """(order, name, part) as the workbook lists them; the first worksheet part if it lists none."""
    root = parse(z, BOOK)
    if root is None:
        raise ValueError("no xl/workbook.xml")
    rels = relationships(z, BOOK)
    found = [(k, attr(s, "name") or f"Sheet{k + 1}", rels[attr(s, "id") or ""][1]) for k, s in enumerate(every(root, "sheet")) if attr(s, "id") in rels]
    names = set(z.namelist())
    found = [x for x in found if x[2] in names]
    if not found:
        found = [(0, "Sheet1", p) for p in sorted(names) if re.fullmatch(r"xl/worksheets/sheet\d*\.xml", p)][:1]
    return found


def strings(z: zipfile.ZipFile) -> list[str]:
    root = parse(z, "xl/sharedStrings.xml")
    return [text(si) for si in children(root, "si")]


def cells(z: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str, str, bool]]:
    """(sheet, row, column, type, value, whether a formula gives it). Inline strings come with their text; places that
    references leave out count on."""
    for _, label, part in sheets(z):
        root = parse(z, part)
        if root is None:
            continue
        row = 0
        for r in every(root, "row"):
            row = int(attr(r, "r") or row + 1)
            col = 0
            for c in children(r, "c"):
                at = place(attr(c, "r"))
                col = at[1] or col + 1
                kind = attr(c, "t", "n") or "n"
                value = text(child(c, "is")) if kind == "inlineStr" else text(child(c, "v"))
                yield label, at[0] or row, col, kind, value, child(c, "f") is not None


def anchors(z: zipfile.ZipFile) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, media part) of pictures placed on cells, by relationship from sheet over drawing to part."""
    names = set(z.namelist())
    for _, label, part in sheets(z):
        for kind, drawing in relationships(z, part).values():
            root = parse(z, drawing) if kind == "drawing" else None
            if root is None:
                continue
            rels = relationships(z, drawing)
            for a in every(root, "oneCellAnchor", "twoCellAnchor"):
                start = child(a, "from")
                row, col = (int(text(child(start, x)) or 0) + 1 for x in ("row", "col"))
                for b in every(a, "blip"):
                    target = rels.get(attr(b, "embed") or "", ("", ""))[1]
                    if target in names:
                        yield label, row, col, target


def opened(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))
