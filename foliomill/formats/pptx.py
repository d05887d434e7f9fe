"""Slide decks to Markdown."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

from . import mtef, ole, omml
from .docx import media_kind, shown, table_text
from .xml import attr, child, children, every, name, parse, relationships

DECK = "ppt/presentation.xml"
RANK = {"video": 3, "audio": 2, "image": 1}


class Deck:
    """One deck. media has (archive path, kind, new name), numbered by kind in order of reference; a medium met again with a
    kind of higher rank takes that kind."""

    def __init__(self, data: bytes, stem: str, with_media: bool = True):
        self.zip = zipfile.ZipFile(io.BytesIO(data))
        self.stem, self.with_media = stem, with_media
        self.names = set(self.zip.namelist())
        root = parse(self.zip, DECK)
        if root is None:
            raise ValueError("no ppt/presentation.xml")
        rels = relationships(self.zip, DECK)
        self.slides = [rels.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), ("", ""))[1] for s in every(root, "sldId")]
        self.kinds: dict[str, str] = {}
        for slide in self.slides:
            self.collect(slide)
        count: dict[str, int] = {}
        self.media = []
        for path, kind in self.kinds.items():
            count[kind] = count.get(kind, 0) + 1
            self.media.append((path, kind, f"{kind if kind != 'other' else 'media'}_{count[kind]:03d}{posixpath.splitext(path)[1].lower()}"))
        self.new = {p: (k, n) for p, k, n in self.media}

    def collect(self, slide: str) -> None:
        root = parse(self.zip, slide)
        if root is None:
            return
        rels = relationships(self.zip, slide)
        for e in root.iter():
            found = self.medium(e, rels)
            if found:
                path, kind = found
                if path not in self.kinds or RANK.get(kind, 0) > RANK.get(self.kinds[path], 0):
                    self.kinds[path] = kind

    def medium(self, e: ET.Element, rels: dict) -> tuple[str, str] | None:
        """(archive path, kind) that a picture or player element stands for; a player's icon is none."""
        if name(e) == "pic":
            player = next(iter(every(e, "videoFile", "audioFile")), None)
            inner = next((attr(x, "embed") for x in every(e, "media")), None)
            for rid in (inner, attr(player, "link"), None if player is not None else next((attr(b, "embed") for b in every(e, "blip")), None)):
                kind, path = rels.get(rid or "", ("", ""))
                if path in self.names:
                    found = media_kind(path)
                    return path, kind if kind in ("video", "audio") else found
        return None

    def refer(self, path: str, alt: str = "") -> str:
        if not self.with_media or path not in self.new:
            return ""
        kind, file = self.new[path]
        size = self.zip.getinfo(path).file_size
        if path.lower().endswith((".wmf", ".emf")) and size < 5000:
            return ""
        return shown(f"{self.stem}_media/{file}", kind, alt)

    def run_text(self, p: ET.Element) -> str:
        out = []
        for c in p:
            n = name(c)
            if n in ("r", "fld"):
                out.append("".join(t.text or "" for t in children(c, "t")))
            elif n == "br":
                out.append("\n")
            elif n == "AlternateContent":
                first = child(c, "Choice")
                out += [f"${omml.latex(m)}$" for m in every(first if first is not None else c, "oMath")]
            elif n in ("m", "oMath", "oMathPara"):
                out.append(f"${omml.latex(c)}$")
        return "".join(out).strip()

    def paragraph(self, p: ET.Element) -> str:
        t = self.run_text(p)
        if not t:
            return ""
        pr = child(p, "pPr")
        indent = "  " * int(attr(pr, "lvl", "0") or 0)
        auto = child(pr, "buAutoNum")
        if auto is not None:
            return indent + ("a. " if (attr(auto, "type") or "").lower().startswith("alpha") else "1. ") + t
        return indent + "- " + t if child(pr, "buChar") is not None else t

    def element(self, e: ET.Element, rels: dict, depth: int = 0) -> list[str]:
        n = name(e)
        if depth > 50:
            return []
        if n == "AlternateContent":
            first = child(e, "Choice")
            return [x for c in (first if first is not None else e) for x in self.element(c, rels, depth + 1)]
        if n == "sp":
            return [t for b in every(e, "txBody") for t in ("\n".join(filter(None, map(self.paragraph, children(b, "p")))),) if t]
        if n == "pic":
            found = self.medium(e, rels)
            t = self.refer(found[0], attr(child(e, "nvPicPr", "cNvPr"), "descr", "") or "") if found else ""
            return [t] if t else []
        if n == "graphicFrame":
            tables = every(e, "tbl")
            if tables:
                rows = [[" ".join(filter(None, (self.run_text(p) for p in every(tc, "p")))) for tc in children(tr, "tc")] for tr in children(tables[0], "tr")]
                return [table_text(rows)]
            for o in every(e, "oleObj"):
                path = rels.get(attr(o, "id") or "", ("", ""))[1]
                raw = ole.equation(self.zip.read(path)) if path in self.names else None
                t = mtef.to_latex(raw) if raw else ""
                if t:
                    return [f"${t}$"]
                picture = self.medium(next(iter(every(o, "pic")), o), rels)
                t = self.refer(picture[0], "formula") if picture else ""
                return [t] if t else []
            return []
        if n in ("spTree", "grpSp", "cSld", "sld", "Choice"):
            return [x for c in e for x in self.element(c, rels, depth + 1)]
        return []

    def markdown(self, title: str) -> str:
        out = [f"# {title}"]
        for k, slide in enumerate(self.slides, 1):
            root = parse(self.zip, slide)
            if root is None:
                continue
            out += [f"## Slide {k}", *self.element(root, relationships(self.zip, slide))]
        return re.sub(r"\n{3,}", "\n\n", "\n\n".join(out))
