"""The main body of web pages without the site's frame (problem 6).

Method: tree scoring. A page is a tree of sections by heading level, with what stands above the title as a section beside it; of
blocks of neighbouring lines in each, and of lines. Lines that read as text pass points for length and commas, discounted by
link density, to their block; a block passes its points to its section, half of them on to the section around it, and so on up.
The top section with the best score is the container, and its siblings go unless their score comes near. Of the blocks
left those with points of their own stay, and those that carry none (headings, tables, code, lists of files) stay unless they
belong to a list of other pages. No words or phrases are looked for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

LINK = re.compile(r"!?\[([^\]]*)\]\(([^)\s]*)[^)]*\)")
BULLET = re.compile(r"(?:[-*+]|\d+[.)])[ \t]+")
FENCE = re.compile(r"(```|~~~)")
END = re.compile(r"[.。!！?？…;；:：][\"”’»」』)）]*$")
BARS = re.compile(r"\s[|·•»›>/]\s")
LABEL = re.compile(r"\*\*[^*]{1,60}[:：]\*\*\s*\S|\*\*[^*]{1,60}\*\*\s*[:：]\s*\S")
BOLD = re.compile(r"\*\*[^*]{1,60}\*\*$")
HEADING = re.compile(r"#{1,6}\s")
FIGURE = re.compile(r"[:：]\s*[\d.,]+\s*\S{0,3}$")
RELEASE = re.compile(r"(?:\w+\.?\s?\d+|v\d+)\s*[-–—/(].{0,30}$")
def points(line: str) -> float:
    """A line's points as text: none for what is short and ends without a stop, or is mostly links or bars."""
    links = LINK.findall(line) if "](" in line else ()
    bare = LINK.sub(lambda m: m[1], line) if links else line
    weight = (len(bare) + len(bare.encode("utf-8", "replace"))) // 2  # a Chinese character counts as two
    if weight < 160 and "©" in bare:
        return 0.0
    if not (weight >= 56 or weight >= 20 and END.search(bare)):
        return 0.0
    if weight < 100 and BARS.search(bare) and not re.search(r"[.。;；]", bare):
        return 0.0
    density = sum(len(t) for t, _ in links) / max(len(bare), 1)
    commas = sum(map(bare.count, ",，、;；"))
    return (1 + commas + min(weight / 100, 3)) * (1 - density)


class Block:
    """Neighbouring lines; kind: heading, code, table, list, picture or text."""

    def __init__(self, kind: str, first: int, lines: list[str]):
        self.kind, self.first, self.lines = kind, first, lines
        self.items = [BULLET.sub("", x.strip(), count=1) if kind == "list" else x.strip() for x in lines]
        self.points = sum(points(x) for x in self.items) if kind in ("list", "text") else 0.0

    def pages_listed(self) -> bool:
        """Whether the lines are titles of or links to other pages rather than text or files."""
        return self.points < 0.5 * len(self.items) and not all(re.search(r"/files?/|\.\w{2,4}$", u) for x in self.items for _, u in LINK.findall(x) or [("", "")])


def blocks(lines: list[str], start: int) -> list[Block]:
    """Blocks of lines[start:]. A line of another kind opens a block of its own, unless blank lines did already."""
    out: list[Block] = []
    k, n = start, len(lines)
    while k < n:
        x = lines[k].strip()
        if not x:
            k += 1
            continue
        first = k
        if m := FENCE.match(x):
            k += 1
            while k < n and not lines[k].strip().startswith(m[1]):
                k += 1
            k = min(k + 1, n)
            out.append(Block("code", first, lines[first:k]))
            continue
        kind = kind_of(x)
        k += 1
        if kind not in ("heading", "picture"):
            while k < n and lines[k].strip() and kind_of(lines[k].strip()) == kind and not FENCE.match(lines[k].strip()):
                k += 1
        out.append(Block(kind, first, lines[first:k]))
    return out


def kind_of(x: str) -> str:
    if HEADING.match(x):
        return "heading"
    if x.startswith("|"):
        return "table"
    if x.startswith("!["):
        return "picture"
    return "list" if BULLET.match(x) else "text"


SIBLING = 2.0  # times the container's score, that the part above the title must have to stay


class Section:
    """A heading's section; points include halves of those of the sections in it."""

    def __init__(self, level: int, around: "Section | None" = None):
        self.level, self.around, self.points = level, around, 0.0

    def take(self, points: float) -> None:
        at: Section | None = self
        while at is not None and points:
            at.points += points
            at, points = at.around, points / 2


def sections(parts: list[Block]) -> tuple[Section, Section]:
    """The section above the title and the one of the title, with the points of all blocks."""
    above, titled = Section(1), Section(1)
    at, begun = above, False
    for b in parts:
        if b.kind == "heading":
            level = len(b.items[0]) - len(b.items[0].lstrip("#"))
            if level == 1:
                at, begun = titled, True
            elif begun:
                while at.around is not None and at.level >= level:
                    at = at.around
                at = Section(level, at)
        at.take(b.points)
    return above, titled


def frame_lines(markdown: str) -> list[int]:
    """Numbers, from 1, of the lines that are no part of the page's own content. Blank lines are never among them."""
    lines = markdown.split("\n")
    title = next((k for k, x in enumerate(lines) if x.startswith("# ")), None)
    drop: set[int] = set()
    if title is not None:
        parts = blocks(lines, 0)
        above, below = [b for b in parts if b.first < title], [b for b in parts if b.first >= title]
        beside, container = sections(parts)
        if beside.points <= SIBLING * container.points + 1:
            drop |= {b.first + i for b in above for i in range(len(b.lines))}
        else:
            below = above + below
    else:
        below = blocks(lines, 0)
    kept: list[bool] = []
    for k, b in enumerate(below):
        before = below[k - 1] if k else None
        touching = before is not None and before.first + len(before.lines) == b.first
        keep = True
        if b.kind == "heading" or b.kind in ("code", "table", "picture"):
            after = below[k + 1] if k + 1 < len(below) else None
            joined = after is not None and b.first + 1 == after.first
            if b.kind == "heading" and b.first != title and joined and after.kind in ("list", "text") and after.pages_listed():
                keep = False
        elif touching and before.kind in ("heading", "text") and not kept[-1] and b.pages_listed():
            keep = False
        elif b.kind == "list":
            titles = BOLD.match(before.items[-1]) if touching and before.kind == "text" else None
            links = [u for x in b.items for _, u in LINK.findall(x)]
            if titles and b.pages_listed():
                keep = False
                kept[-1] = False
            elif b.points < 0.5 * len(b.items) and len(links) >= 0.6 * len(b.items) and not all(re.search(r"/files?/|\.\w{2,4}$", u) for u in links):
                keep = False
        elif len(b.items) == 1:
            x = b.items[0]
            opening = before is not None and before.first == title
            keep = b.points > 0 or bool(LABEL.match(x)) or bool(FIGURE.search(x)) or opening and bool(RELEASE.match(x)) or x.startswith(">") or bool(re.fullmatch(r"[-*_=—─]{3,}", x))
        else:
            texts = sum(1 for x in b.items if points(x) > 0)
            keep = 2 * texts > len(b.items) or any(LABEL.match(x) for x in b.items[:1])
        kept.append(keep)
    for b, keep in zip(below, kept):
        if not keep:
            drop |= {b.first + i for i, x in enumerate(b.lines)}
    return sorted(k + 1 for k in drop if lines[k].strip())


def main_content(df: DataFrame, key: str = "result_id", text: str = "markdown") -> DataFrame:
    """(key, main STRING, dropped ARRAY<INT>) of each row: the text without its frame and the numbers of the lines taken out.
    Null gives null and no numbers. Runs of blank lines left behind become one. One pass, without a shuffle but
    of an input with fewer partitions than cores."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            main, dropped = [], []
            for t in b["t"]:
                numbers = frame_lines(t) if t else []
                dropped.append(numbers)
                if t and numbers:
                    gone = set(numbers)
                    t = re.sub(r"\n{3,}", "\n\n", "\n".join(x for k, x in enumerate(t.split("\n"), 1) if k not in gone)).strip("\n")
                main.append(t)
            yield pd.DataFrame({"k": b["k"], "main": main, "dropped": dropped})

    kind = df.schema[key].dataType.simpleString()
    done = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInPandas(run, f"k {kind}, main string, dropped array<int>")
    return done.withColumnRenamed("k", key)


def web_pages(results: DataFrame, sources: DataFrame) -> DataFrame:
    """The results whose source's path begins with https://."""
    ids = sources.where(F.col("source_path").startswith("https://")).select("source_id").distinct()
    return results.select("result_id", "source_id", "markdown").join(ids, "source_id", "left_semi")
