"""Word documents to Markdown."""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.etree import ElementTree as ET

from . import mtef, ole, omml
from .xml import attr, child, children, every, name, parse, relationships, text

PART = "word/document.xml"
KIND = {"video": "video", "audio": "audio"}


def table_text(rows: list[list[str]]) -> str:
    """The same Markdown as functions.text.table, for what is already in Python."""
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join([c.replace("|", "\\|").replace("\n", " ") for c in r] + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def media_kind(path: str) -> str:
    from ..functions.media import KINDS

    ext = path.rpartition(".")[2].lower()
    return next((k for k, v in KINDS.items() if ext in v), "other")


def shown(path: str, kind: str, alt: str = "") -> str:
    path = path.replace(" ", "%20")
    if kind in ("video", "audio"):
        title = alt.replace('"', "&quot;").strip()
        return f'<{kind} controls src="{path}"' + (f' title="{title}"' if title else "") + f"></{kind}>"
    return f"![{alt}]({path})"


class Document:
    """One document. After markdown() media has (archive path, kind, new name) in the order of first reference."""

    def __init__(self, data: bytes, stem: str, with_media: bool = True, fix_merge: bool = False):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.stem, self.with_media, self.fix_merge = stem, with_media, fix_merge
        self.rels = relationships(self.zip, PART)
        self.names = set(self.zip.namelist())
        self.media: list[tuple[str, str, str]] = []
        self.numbers: dict[str, int] = {}
        self.lists = self.list_levels()

    def list_levels(self) -> dict[tuple[str, str], str]:
        root = parse(self.zip, "word/numbering.xml")
        if root is None:
            return {}
        kinds = {(attr(a, "abstractNumId"), attr(lv, "ilvl")): attr(child(lv, "numFmt"), "val") for a in children(root, "abstractNum") for lv in children(a, "lvl")}
        out = {}
        for n in children(root, "num"):
            a = attr(child(n, "abstractNumId"), "val")
            for (b, lv), fmt in kinds.items():
                if a == b:
                    out[attr(n, "numId") or "", lv or "0"] = "bullet" if fmt in (None, "bullet", "none") else "ordered"
        return out

    def refer(self, rid: str | None, alt: str = "") -> str:
        if not rid or not self.with_media or rid not in self.rels:
            return ""
        path = next((p for p in (self.rels[rid][1], "word/" + self.rels[rid][1]) if p in self.names), None)
        if path is None:
            return ""
        known = next((m for m in self.media if m[0] == path), None)
        if known is None:
            kind = media_kind(path)
            self.numbers[kind] = self.numbers.get(kind, 0) + 1
            prefix = kind if kind != "other" else "media"
            known = (path, kind, f"{prefix}_{self.numbers[kind]:03d}{posixpath.splitext(path)[1].lower()}")
            self.media.append(known)
        return shown(f"{self.stem}_media/{known[2]}", known[1], alt)

    def formula(self, obj: ET.Element) -> str:
        """An embedded equation's LaTeX, else its preview."""
        for o in every(obj, "OLEObject"):
            rid = attr(o, "id")
            path = self.rels.get(rid or "", ("", ""))[1]
            if path in self.names:
                raw = ole.equation(self.zip.read(path))
                t = mtef.to_latex(raw) if raw else ""
                if t:
                    return f"${t}$"
        picture = next((attr(x, "embed") for x in every(obj, "blip")), None) or next((attr(x, "id") for x in every(obj, "imagedata")), None)
        return self.refer(picture, "formula")

    def run(self, r: ET.Element) -> str:
        if child(r, "rPr", "strike") is not None:
            return ""
        out = []
        for c in r:
            n = name(c)
            if n == "t":
                out.append(c.text or "")
            elif n == "tab":
                out.append("\t")
            elif n in ("br", "cr"):
                out.append("\n")
            else:
                out.append(self.inline(c))
        return "".join(out)

    def inline(self, e: ET.Element, depth: int = 0) -> str:
        n = name(e)
        if depth > 20 or n in ("rPr", "pPr", "del", "moveFrom"):
            return ""
        if n == "r":
            return self.run(e)
        if n == "oMathPara" or n == "oMath":
            t = omml.latex(e)
            return (f"\n$$\n{t}\n$$\n" if n == "oMathPara" else f"${t}$") if t.strip() else ""
        if n == "object":
            return self.formula(e)
        if n in ("drawing", "pict"):
            boxes = [b for b in every(e, "txbxContent")]
            if boxes:
                return "\n".join(filter(None, (self.paragraph(p) for p in children(boxes[0], "p"))))
            video = next((attr(x, "link") or attr(x, "embed") for x in every(e, "videoFile", "audioFile")), None)
            found = self.refer(video) if video else ""
            return found or self.refer(next((attr(x, "embed") or attr(x, "link") for x in every(e, "blip")), None) or next((attr(x, "id") for x in every(e, "imagedata")), None), attr(next(iter(every(e, "docPr")), None), "descr", "") or "")
        if n == "AlternateContent":
            pick = child(e, "Choice")
            return self.inline(child(e, "Fallback") if pick is None else pick, depth + 1) if len(e) else ""
        return "".join(self.inline(c, depth + 1) for c in e)

    def paragraph(self, p: ET.Element, lists: bool = True) -> str:
        t = "".join(self.inline(c) for c in p).strip()
        if not t:
            return ""
        style = attr(child(p, "pPr", "pStyle"), "val", "") or ""
        level = style[7:] if style.lower().startswith("heading") and style[7:].isdigit() else ""
        if level:
            return "#" * min(int(level), 6) + " " + t
        num = attr(child(p, "pPr", "numPr", "numId"), "val")
        if lists and num and num != "0":
            lv = attr(child(p, "pPr", "numPr", "ilvl"), "val", "0") or "0"
            return "  " * int(lv) + ("1. " if self.lists.get((num, lv)) == "ordered" else "- ") + t
        return t

    def table(self, t: ET.Element) -> str:
        rows = []
        for tr in children(t, "tr"):
            cells = []
            for tc in children(tr, "tc"):
                merge = child(tc, "tcPr", "vMerge")
                if merge is not None and (attr(merge, "val") == "continue" or self.fix_merge and attr(merge, "val") is None):
                    continue
                cells.append(" ".join(filter(None, (self.paragraph(p).replace("\n", " ") for p in every(tc, "p")))))
            rows.append(cells)
        return table_text(rows)

    def markdown(self, title: str) -> str:
        root = parse(self.zip, PART)
        if root is None:
            raise ValueError("no word/document.xml")
        seen, out = set(), [f"# {title}"]
        body = child(root, "body")
        for e in [] if body is None else body:
            n = name(e)
            if n == "tbl":
                out.append(self.table(e))
                continue
            for p in [e] if n == "p" else every(e, "p") if n == "sdt" else []:
                t = self.paragraph(p, n == "p")
                if t and t not in seen:
                    seen.add(t)
                    out.append(t)
        return "\n\n".join(filter(None, out))


__all__ = ["Document", "shown", "table_text", "text"]
