"""Small archives for tests."""

import io
import zipfile

REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def archive(members: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


def rels(*items) -> str:
    return "<Relationships>" + "".join(f'<Relationship Id="{i}" Type="http://x/{t}" Target="{p}"/>' for i, t, p in items) + "</Relationships>"


def workbook(sheets: dict[str, str], strings: list[str] = ()) -> bytes:
    """Sheet name -> rows' XML."""
    members = {
        "xl/workbook.xml": f'<workbook xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1)) + "</sheets></workbook>",
        "xl/_rels/workbook.xml.rels": rels(*((f"rId{k}", "worksheet", f"worksheets/sheet{k}.xml") for k in range(1, len(sheets) + 1))),
        "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>",
    }
    for k, rows in enumerate(sheets.values(), 1):
        members[f"xl/worksheets/sheet{k}.xml"] = f"<worksheet><sheetData>{rows}</sheetData></worksheet>"
    return archive(members)
