"""XML without regard to namespaces, so that strict and transitional documents read alike."""

from __future__ import annotations

import posixpath
import zipfile
from xml.etree import ElementTree as ET


def name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def attr(e: ET.Element | None, key: str, default: str | None = None) -> str | None:
    """An attribute by its local name."""
    if e is None:
        return default
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == key), default)


def child(e: ET.Element | None, *path: str) -> ET.Element | None:
    for p in path:
        e = None if e is None else next((c for c in e if name(c) == p), None)
    return e


def children(e: ET.Element | None, tag: str) -> list[ET.Element]:
    return [] if e is None else [c for c in e if name(c) == tag]


def every(e: ET.Element, *tags: str) -> list[ET.Element]:
    """Descendants of these names in document order."""
    return [x for x in e.iter() if name(x) in tags]


def text(e: ET.Element | None) -> str:
    return "" if e is None else "".join(e.itertext())


def parse(z: zipfile.ZipFile, path: str) -> ET.Element | None:
    """Root of a part; None if the archive lacks it or it cannot be read."""
    try:
        return ET.fromstring(z.read(path))
    except (KeyError, ET.ParseError):
        return None


def relationships(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """rid -> (type's last part, target's path in the archive) of a part, in the file's order."""
    folder, file = posixpath.split(part)
    root = parse(z, f"{folder}/_rels/{file}.rels".lstrip("/"))
    out = {}
    for r in children(root, "Relationship"):
        target = (attr(r, "Target") or "").replace("\\", "/")
        if attr(r, "TargetMode") != "External":
            target = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
        out[attr(r, "Id") or ""] = ((attr(r, "Type") or "").rpartition("/")[2], target)
    return out
