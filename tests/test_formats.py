import struct
from xml.etree import ElementTree as ET

import numpy as np
import pytest
from helpers import REL, archive, rels, workbook

from foliomill.formats import html_markdown, image_split, mtef, ole, omml, xlsx
from foliomill.formats.docx import Document
from foliomill.formats.pptx import Deck
from foliomill.sources import files

W = 'xmlns:w="http://purl.oclc.org/ooxml/wordprocessingml/main"'
BLIP = f'<w:drawing><x:blip xmlns:x="x" xmlns:r="{REL}" r:embed="%s"/></w:drawing>'


def docx(body, rel=(), media=()):
    return archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels(*rel)} | {m: b"x" * 9000 for m in media})


def para(inner):
    return f"<w:p>{inner}</w:p>"


def run(t):
    return f"<w:r><w:t>{t}</w:t></w:r>"


def test_docx():
    body = para(run("one")) + para(run("one")) + para(f"<w:r><w:rPr><w:strike/></w:rPr><w:t>gone</w:t></w:r>{run('two')}<w:r>{BLIP % 'r1'}</w:r>") + f"<w:tbl><w:tr><w:tc>{para(run('a|b'))}</w:tc><w:tc><w:tcPr><w:vMerge w:val='continue'/></w:tcPr>{para(run('no'))}</w:tc></w:tr></w:tbl>"
    d = Document(docx(body, [("r1", "image", "media/p 1.PNG")], ["word/media/p 1.PNG"]), "my doc")
    assert d.markdown("t") == "# t\n\none\n\ntwo![](my%20doc_media/image_001.png)\n\n| a\\|b |\n| --- |"
    assert d.media == [("word/media/p 1.PNG", "image", "image_001.png")]
    with pytest.raises(ValueError):
        Document(archive({"x": "y"}), "s").markdown("t")


def equation_records(*records):
    return b"\x05\x01\x00\x06\x00DSMT6\x00\x00" + b"".join(records) + b"\x00"


def ch(c):
    return bytes((2, 0, 131)) + struct.pack("<H", ord(c))


def line(*items):
    return b"\x01\x00" + b"".join(items) + b"\x00"


def compound(stream: bytes) -> bytes:
    """A compound file with one small stream, Equation Native."""
    def entry(name, kind, start, size, child=0xFFFFFFFF):
        raw = name.encode("utf-16-le") + b"\0\0"
        return raw.ljust(64, b"\0") + struct.pack("<HBBIII", len(raw), kind, 1, 0xFFFFFFFF, 0xFFFFFFFF, child) + b"\0" * 36 + struct.pack("<III", start, size, 0)

    mini = stream.ljust(-(-len(stream) // 64) * 64, b"\0")
    n = len(mini) // 64
    sectors = -(-len(mini) // 512)
    fat = [0xFFFFFFFD, 0xFFFFFFFE, 0xFFFFFFFE, *range(4, 3 + sectors), 0xFFFFFFFE]
    fat += [0xFFFFFFFF] * (128 - len(fat))
    mini_fat = [*range(1, n), 0xFFFFFFFE] + [0xFFFFFFFF] * (128 - n)
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10
    head += struct.pack("<IIIIIIII", 1, 1, 0, 4096, 2, 1, 0xFFFFFFFE, 0) + struct.pack("<109I", 0, *[0xFFFFFFFF] * 108)
    directory = entry("Root Entry", 5, 3, len(mini), 1) + entry("Equation Native", 2, 0, len(stream)) + b"\0" * 256
    return head + struct.pack("<128I", *fat) + directory + struct.pack("<128I", *mini_fat) + mini.ljust(sectors * 512, b"\0")


def native(body):
    return struct.pack("<HIHI", 28, 0x20000, 0, len(body)) + b"\0" * 16 + body


def test_mathtype():
    frac = bytes((3, 0, 11, 0, 0)) + line(ch("α")) + line(ch("2")) + b"\x00"
    sup = bytes((3, 0, 28, 0, 0)) + line() + line(ch("n")) + b"\x00"
    body = equation_records(line(ch("x"), sup, ch("+"), frac))
    assert mtef.to_latex(body) == r"x^{n}+\frac{\alpha }{2}"
    assert mtef.to_latex(ole.equation(compound(native(body)))) == r"x^{n}+\frac{\alpha }{2}"
    assert mtef.to_latex(equation_records(line(bytes((3, 0, 36, 0, 0)) + line(ch("x")) + b"\0"))) == ""  # no rule
    assert mtef.to_latex(b"") == "" and mtef.to_latex(b"\x03junk") == "" and ole.equation(b"junk") is None


def test_docx_formula_or_preview():
    obj = f'<w:r><w:object><o:OLEObject xmlns:o="o" xmlns:r="{REL}" r:id="r2"/><v:imagedata xmlns:v="v" xmlns:r="{REL}" r:id="r1"/></w:object></w:r>'
    body = para(run("before") + obj + run("after"))
    rel = [("r1", "image", "media/image1.png"), ("r2", "oleObject", "embeddings/o.bin")]
    good = compound(native(equation_records(line(ch("x")))))
    for data, want in ((good, "before$x$after"), (b"broken", "before![formula](s_media/image_001.png)after")):
        raw = archive({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", "word/_rels/document.xml.rels": rels(*rel), "word/media/image1.png": "p", "word/embeddings/o.bin": data})
        assert Document(raw, "s").markdown("t").endswith(want)


M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'


@pytest.mark.parametrize("xml,want", [
    ("<m:f><m:num><m:r><m:t>a</m:t></m:r></m:num><m:den><m:r><m:t>β</m:t></m:r></m:den></m:f>", r"\frac{a}{\beta}"),
    ("<m:rad><m:deg><m:r><m:t>3</m:t></m:r></m:deg><m:e><m:r><m:t>x</m:t></m:r></m:e></m:rad>", r"\sqrt[3]{x}"),
    ("<m:nary><m:naryPr><m:chr m:val='∑'/></m:naryPr><m:sub><m:r><m:t>i</m:t></m:r></m:sub><m:sup/><m:e><m:r><m:t>i</m:t></m:r></m:e></m:nary>", r"\sum_{i} i"),
    ("<m:d><m:dPr><m:begChr m:val='['/><m:endChr m:val=']'/></m:dPr><m:e><m:m><m:mr><m:e><m:r><m:t>1</m:t></m:r></m:e><m:e><m:r><m:t>2</m:t></m:r></m:e></m:mr></m:m></m:e></m:d>", r"\begin{bmatrix}1 & 2\end{bmatrix}"),
    ("<m:func><m:fName><m:r><m:t>sin</m:t></m:r></m:fName><m:e><m:r><m:t>x</m:t></m:r></m:e></m:func>", r"\sin x"),
    ("<m:acc><m:accPr><m:chr m:val='⃗'/></m:accPr><m:e><m:r><m:t>v</m:t></m:r></m:e></m:acc>", r"\vec{v}"),
    ("<m:box><m:e><m:r><m:t>x≤y</m:t></m:r></m:e></m:box>", r"x\leqy"),
])
def test_omml(xml, want):
    assert omml.latex(ET.fromstring(f"<m:oMath {M}>{xml}</m:oMath>")) == want


def test_xlsx_files(spark, tmp_path):
    rows = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>23602.880000000001</v></c></row><row r="3"><c r="A3" t="inlineStr"><is><t>in</t></is></c><c r="B3"><f>1+1</f><v>2</v></c></row>'
    (tmp_path / "b.XLSX").write_bytes(workbook({"S": rows, "Empty": ""}, ["shared|x"]))
    (tmp_path / "broken.xlsx").write_bytes(b"no zip")
    df = files.files(spark, str(tmp_path), ("xlsx",))
    assert df.count() == 2
    r = sorted(files.workbooks(df).collect(), key=lambda x: x.error is not None)
    assert len(r) == 2 and r[0].error is None and r[1].markdown is None and "zip" in r[1].error.lower()
    assert r[0].markdown == "## Sheet: S\n\n| shared\\|x |  | 23602.880000000001 |\n| --- | --- | --- |\n|  |  |  |\n| in | 2 |  |"
    assert xlsx.place("AB12") == (12, 28) and xlsx.place("12") == (0, 0)


def test_pptx():
    def sp(p):
        return f"<sp><txBody>{p}</txBody></sp>"

    slide = "<sld><cSld><spTree>" + sp("<p><pPr lvl='1'><buChar char='-'/></pPr><r><t>item</t></r></p><p><r><t>text</t></r></p>") + f'<pic><nvPicPr><cNvPr descr="alt"/></nvPicPr><blip xmlns:r="{REL}" r:embed="r1"/></pic>' + "<graphicFrame><tbl><tr><tc><txBody><p><r><t>c</t></r></p></txBody></tc></tr></tbl></graphicFrame></spTree></cSld></sld>"
    raw = archive({
        "ppt/presentation.xml": f'<presentation xmlns:r="{REL}"><sldIdLst><sldId id="9" r:id="a2"/><sldId id="8" r:id="a1"/></sldIdLst></presentation>',
        "ppt/_rels/presentation.xml.rels": rels(("a1", "slide", "slides/s1.xml"), ("a2", "slide", "slides/s2.xml")),
        "ppt/slides/s2.xml": slide, "ppt/slides/_rels/s2.xml.rels": rels(("r1", "image", "../media/p.png")), "ppt/media/p.png": "x",
    })
    assert Deck(raw, "d").markdown("d.pptx") == "# d.pptx\n\n## Slide 1\n\n  - item\ntext\n\n![alt](d_media/image_001.png)\n\n| c |\n| --- |"
    assert "![" not in Deck(raw, "d", False).markdown("d.pptx")


def test_html_markdown():
    page = "<head><title>x</title></head><h1>Head <b>er</b></h1><p>Some <a href='u'>link</a> &amp; <code>c</code></p><ul><li>a</li><li>b<ul><li>c</li></ul></li></ul><pre>x\n  y</pre><table><tr><th>h</th></tr><tr><td>1|2</td></tr></table><script>no</script>"
    assert html_markdown.convert(page) == "# Head **er**\n\nSome [link](u) & `c`\n\n- a\n- b\n  - c\n\n```\nx\n  y\n```\n\n| h |\n| --- |\n| 1\\|2 |"
    assert html_markdown.convert("") == "" and html_markdown.decoded("汉".encode("gbk")) == "汉"


def test_broken_files_are_rows(spark):
    df = spark.createDataFrame([("a.docx", bytearray(b"zip?")), ("b.html", bytearray(b"<h1>x</h1>")), ("c.pptx", bytearray(b""))], "path string, content binary")
    got = {r.path: (r.markdown, r.error is None) for r in files.documents(df).collect()}
    assert got == {"a.docx": (None, False), "b.html": ("# x", True), "c.pptx": (None, False)}


def test_image_split():
    picture = np.random.default_rng(0).integers(0, 255, (600, 100, 3)).astype(np.uint8)
    picture[130:140] = 250
    blank = image_split.blank_rows(picture)
    assert set(np.flatnonzero(blank)) == set(range(130, 140))
    got = image_split.pieces(blank, 100)
    assert got[0] == (0, 132) and got[1] == (132, 282) and got[2][0] == 272 and got[-1][1] == 600
    assert image_split.pieces(blank[:200], 100) == [(0, 200)]


def test_ocr_lines(spark):
    good = '{"result": {"layoutParsingResults": [{"markdown": {"text": "A", "images": {"i/1.png": "u"}}}, {"markdown": {"text": " "}}, {"markdown": {"text": "B"}}]}}'
    df = spark.createDataFrame([("j", 1, good), ("j", 2, "junk"), ("j", 3, "{}")], "job_id string, line_no int, line string")
    r = files.ocr_lines(df).collect()
    assert [(x.markdown, [tuple(i) for i in x.images]) for x in r] == [("A\n\nB", [("i/1.png", "u")])]
