"""Files made of table rows, so that the format readers run over whole tables."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def _xml(line: str) -> str:
    return escape("".join(c for c in line if (c >= " " or c in "\t\n\r") and not "\ud800" <= c <= "\udfff" and c not in "￾￿"), {"\r": "&#13;"})


def docx(lines: list[str]) -> bytes:
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_xml(x)}</w:t></w:r></w:p>' for x in lines)
    return _zip({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def pptx(lines: list[str]) -> bytes:
    members = {"ppt/presentation.xml": f'<p:presentation xmlns:p="p" xmlns:r="{RELS}"><p:sldIdLst>' + "".join(f'<p:sldId id="{k}" r:id="r{k}"/>' for k in range(len(lines))) + "</p:sldIdLst></p:presentation>"}
    members["ppt/_rels/presentation.xml.rels"] = "<Relationships>" + "".join(f'<Relationship Id="r{k}" Type="x/slide" Target="slides/s{k}.xml"/>' for k in range(len(lines))) + "</Relationships>"
    for k, x in enumerate(lines):
        members[f"ppt/slides/s{k}.xml"] = f'<p:sld xmlns:p="p" xmlns:a="a"><p:cSld><p:spTree><p:sp><p:txBody><a:p><a:r><a:t>{_xml(x)}</a:t></a:r></a:p></p:txBody></p:sp></p:spTree></p:cSld></p:sld>'
    return _zip(members)


def files(df: DataFrame, key: str, lines: str, kind: str) -> DataFrame:
    """(path, content): a file of kind docx or pptx for each row, of an array of lines."""
    make = {"docx": docx, "pptx": pptx}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": [f"{k}.{kind}" for k in b["k"]], "content": [make(list(x)) for x in b["x"]]})

    return df.select(F.col(key).alias("k"), F.col(lines).alias("x")).mapInPandas(run, "path string, content binary")


def fraction(a: str, b: str) -> str:
    """Office math of a / b."""
    run = lambda t: f"<m:r><m:t>{_xml(t)}</m:t></m:r>"
    return f'<m:oMath xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"><m:f><m:num>{run(a)}</m:num><m:den>{run(b)}</m:den></m:f></m:oMath>'


def equation(base: str, power: str) -> bytes:
    """MathType records of base to the power."""
    char = lambda c: bytes((2, 0, 131)) + ord(c).to_bytes(2, "little")
    line = lambda t: b"\x01\x00" + b"".join(map(char, t)) + b"\x00"
    script = bytes((3, 0, 28, 0, 0)) + line("") + line(power) + b"\x00"
    return b"\x05\x01\x00\x06\x00DSMT6\x00\x00" + b"\x01\x00" + b"".join(map(char, base)) + script + b"\x00\x00"
