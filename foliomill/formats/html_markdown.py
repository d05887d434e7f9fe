"""HTML to Markdown with the standard library's parser. The dialect: ATX or underlined headings, - lists, fenced code, tables with
the first row as head, emphasis, links, pictures; scripts, styles and heads are left out."""

from __future__ import annotations

import re
from html.parser import HTMLParser

from .docx import table_text

SKIP = {"script", "style", "head", "noscript", "template", "svg"}
BLOCK = {"p", "div", "section", "article", "main", "header", "footer", "nav", "aside", "ul", "ol", "li", "table", "blockquote", "figure", "figcaption", "form", "dl", "dt", "dd", "hr", "address"}
MARK = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~"}


class Converter(HTMLParser):
    def __init__(self, images: bool = True, underlined: bool = False):
        super().__init__(convert_charrefs=True)
        self.images, self.underlined = images, underlined
        self.out: list[str] = []
        self.skip = self.pre = self.quote = 0
        self.lists: list[list] = []
        self.links: list[tuple[int, str]] = []
        self.heads: list[tuple[int, int]] = []
        self.tables: list[list[list[str]]] = []
        self.cell: list[int] = []

    def block(self) -> None:
        if self.out and not "".join(self.out[-2:]).endswith("\n\n"):
            self.out.append("\n\n")

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in SKIP:
            self.skip += 1
            return
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag):
            self.block()
            self.heads.append((int(tag[1]), len(self.out)))
        elif tag == "pre":
            self.block()
            self.out.append("```\n")
            self.pre += 1
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in MARK:
            self.out.append(MARK[tag])
        elif tag == "a" and a.get("href"):
            self.links.append((len(self.out), a["href"]))
            self.out.append("[")
        elif tag == "img" and self.images and a.get("src"):
            self.out.append(f"![{a.get('alt') or ''}]({a['src']})")
        elif tag == "br":
            self.out.append("\n")
        elif tag == "hr":
            self.block()
            self.out.append("---\n\n")
        elif tag in ("ul", "ol"):
            if not self.lists:
                self.block()
            self.lists.append([tag, 0])
        elif tag == "li" and self.lists:
            self.lists[-1][1] += 1
            mark = "- " if self.lists[-1][0] == "ul" else f"{self.lists[-1][1]}. "
            if self.out and not self.out[-1].endswith("\n"):
                self.out.append("\n")
            self.out.append("  " * (len(self.lists) - 1) + mark)
        elif tag == "table":
            self.block()
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.cell.append(len(self.out))
        elif tag in ("video", "audio"):
            self.out.append(self.get_starttag_text() or "")
        elif tag in BLOCK and not self.cell and not self.lists:
            self.block()

    def handle_endtag(self, tag):
        if tag in SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if self.skip:
            return
        if re.fullmatch("h[1-6]", tag) and self.heads:
            level, at = self.heads.pop()
            t = re.sub(r"\s+", " ", "".join(self.out[at:])).strip()
            del self.out[at:]
            if t:
                self.out.append(t + "\n" + "=-"[level - 1] * max(3, len(t)) if self.underlined and level < 3 else "#" * level + " " + t)
                self.block()
        elif tag == "pre" and self.pre:
            self.pre -= 1
            self.out.append("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.out.append("`")
        elif tag in MARK:
            self.out.append(MARK[tag])
        elif tag == "a" and self.links:
            at, href = self.links.pop()
            t = re.sub(r"\s+", " ", "".join(self.out[at + 1 :])).strip()
            del self.out[at:]
            self.out.append(f"[{t}]({href})")
        elif tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            if not self.lists:
                self.block()
        elif tag in ("td", "th") and self.cell:
            at = self.cell.pop()
            t = re.sub(r"\s+", " ", "".join(self.out[at:])).strip()
            del self.out[at:]
            self.tables[-1][-1].append(t)
        elif tag == "table" and self.tables:
            rows = [r for r in self.tables.pop() if r]
            self.out.append(table_text(rows))
            self.block()
        elif tag in ("video", "audio"):
            self.out.append(f"</{tag}>")
        elif tag in BLOCK and not self.cell and not self.lists:
            self.block()

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data if self.pre else re.sub(r"\s+", " ", data) if data.strip() or self.out and not self.out[-1].endswith("\n") else "")


def convert(html: str, images: bool = True, underlined: bool = False) -> str:
    c = Converter(images, underlined)
    c.feed(html)
    c.close()
    t = "".join(c.out)
    t = re.sub(r"[ \t]+\n", "\n", t)
    return re.sub(r"\n{3,}", "\n\n", t).strip()


def decoded(raw: bytes) -> str:
    """A page's text: UTF-8, else the Chinese encodings, else Latin-1."""
    for name in ("utf-8", "gbk", "gb2312", "latin-1"):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            continue
    return raw.decode("utf-8", "replace")
