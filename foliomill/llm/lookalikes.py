"""One consistent form for texts that look the same (problem 2).

Method: confusables skeleton. Decompose, replace every character by its prototype from a table of look-alikes, decompose
again; texts with equal skeletons look the same. What prints nothing is dropped and a run of blanks becomes one blank.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread, staged
from .within import pairs_within

# A prototype, then letters and signs of other scripts and code blocks drawn with the same shape.
PROTOTYPES = """
A Α А Ꭺ ᗅ ꓮ Ⲁ
B Β В Ᏼ ᗷ ꓐ Ⲃ
C С Ϲ Ꮯ ꓚ Ⲥ
D Ꭰ ᗞ ꓓ
E Ε Е Ꭼ ꓰ Ⲉ ⴹ
F Ϝ ᖴ ꓝ
G Ԍ Ꮐ ꓖ
H Η Н Ꮋ ᕼ ꓧ Ⲏ
I Ι І Ӏ Ⲓ ꓲ
J Ј Ϳ Ꭻ ᒍ ꓙ
K Κ К Ꮶ ꓗ Ⲕ
L Ꮮ ᒪ ꓡ
M Μ М Ϻ Ꮇ ᗰ ꓟ Ⲙ
N Ν ꓠ Ⲛ
O Ο О Օ ꓳ Ⲟ
P Ρ Р Ꮲ ᑭ ꓑ Ⲣ
Q Ԛ
R Ꭱ Ꮢ ᖇ ꓣ
S Ѕ Տ Ꮪ ꓢ
T Τ Т Ꭲ ꓔ Ⲧ
U Ս ᑌ ꓴ
V Ѵ Ꮩ ᐯ ꓦ
W Ԝ Ꮃ Ꮤ ꓪ
X Χ Х ꓫ Ⲭ
Y Υ Ү Ꭹ ꓬ Ⲩ
Z Ζ Ꮓ ꓜ
a а ɑ α
c с ϲ ⲥ ᴄ
d ԁ
e е
g ɡ ց
h һ հ
i і ı ɩ ι
j ј ϳ
k κ ĸ
l ӏ ǀ
n ո ռ
o ο о օ ᴏ ⲟ
p р ρ ⲣ
q ԛ գ
s ѕ ꜱ
u ս ʋ υ
v ν ѵ ᴠ
w ԝ ᴡ ѡ
x х ᕁ
y у ү ყ
z ᴢ
Γ Г
Π П
Φ Ф
Λ Л
ε є
Ə Ә
ə ә ǝ
Æ Ӕ
æ ӕ
þ ϸ
Þ Ϸ
- ‐ ‑ ⁃ ˗ ۔
– ‒ −
— ― ─ ━
' ʹ ˈ
’ ʼ ᾽
‘ ʽ ʻ
, ‚ ꓹ
. ․ ꓸ
· • ∙ ⋅ ᛫ ・ ･ ⸱
: ∶ ꞉ ׃ ː ᛬
! ǃ
/ ∕ ⁄ ╱ ⟋
\\ ∖ ⧵ ╲
| ∣ ⏐ │ ￨
~ ∼ ˜ ～
* ∗ ⁎
< ‹ ˂
> › ˃
^ ˄ ˆ
` ˋ
″ ˮ 〃
° ˚
× ⨯ ✕
工 エ
口 ロ 囗
二 ニ
八 ハ
力 カ
夕 タ
卜 ト
千 チ
一 ー
へ ヘ
り リ
ぺ ペ
べ ベ
"""
# Compatibility decompositions that keep the shape. Raised, lowered and encircled forms and fractions look different.
SAME_SHAPE = ("<wide>", "<narrow>", "<compat>", "<font>", "<noBreak>", "<isolated>", "<initial>", "<medial>", "<final>", "<small>")
BLANKS = re.compile("[ \t\x0b\x0c\x85\x1c-\x1f]+")
INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0}


# Small letters of a script whose capitals look like Latin ones are drawn as small capitals; of these only the following
# look like small Latin letters.
SMALL_CAPITALS = {c: chr(x) for c, x in zip("ABCDEGHIJKLMNOPRTUVWYZS", (0x1D00, 0x299, 0x63, 0x1D05, 0x1D07, 0x262, 0x29C, 0x26A, 0x1D0A, 0x1D0B, 0x29F, 0x1D0D, 0x274, 0x6F, 0x1D18, 0x280, 0x1D1B, 0x1D1C, 0x76, 0x77, 0x28F, 0x7A, 0x73))}


def table() -> dict[str, str]:
    out = {}
    for line in PROTOTYPES.split("\n"):
        first, *others = line.split() or [""]
        out.update((o, first) for o in others if o != first)
    for code in range(0xAB70, 0xABC0):  # small Cherokee letters, which are small capitals of the large ones
        first = out.get(chr(code).upper())
        if first in SMALL_CAPITALS:
            out[chr(code)] = SMALL_CAPITALS[first]
    return out


def published(path: str) -> dict[str, str]:
    """The look-alikes of a file in the form of Unicode's confusables data ("source ; target ; class # comment", in hexadecimal), to
    be used beside those above, which cover common scripts only. Those above go first. Digits and letters stay apart, as
    do sources or targets of several characters, which an exchange of single characters cannot reach."""
    own, out = look_alikes(), {}
    with open(path, encoding="utf-8-sig") as f:
        for line in f:
            source, _, rest = line.partition("#")[0].partition(";")
            target = rest.partition(";")[0].split()
            if len(source.split()) != 1 or len(target) != 1:
                continue
            a, b = chr(int(source, 16)), chr(int(target[0], 16))
            if a not in own and a.isascii() is False and a.isdigit() == b.isdigit():
                out[a] = own.get(b, b)
    return out


@lru_cache(maxsize=1)
def look_alikes() -> dict[str, str]:
    return table()


def of_char(c: str) -> str:
    """What one character becomes: decomposed, its parts replaced by prototypes and decomposed again."""
    cat, code = unicodedata.category(c), ord(c)
    if c in "\n\r":
        return c
    if cat == "Cf" or code in INVISIBLE or 0xFE00 <= code <= 0xFE0F or 0xE0000 <= code <= 0xE0FFF:
        return ""
    if cat in ("Zs", "Zl", "Zp") or c in "\t\x0b\x0c\x85⠀":
        return " "
    if cat == "Cc":
        return "" if code < 0x80 else c
    d = unicodedata.decomposition(c)
    if d.startswith("<"):
        kind, *codes = d.split()
        parts = "".join(chr(int(x, 16)) for x in codes)
        if kind not in SAME_SHAPE or parts.startswith(" "):  # a spacing accent is a shape of its own
            return look_alikes().get(c, c)
        return "".join(of_char(p) for p in parts)
    parts = unicodedata.normalize("NFD", c)
    if parts != c:
        return "".join(of_char(p) for p in parts)
    return look_alikes().get(c, c)


class Skeleton(dict):
    """Translation table that fills itself as characters are met. more: look-alikes beside those of this module."""

    def __init__(self, more: dict[str, str] | None = None):
        super().__init__()
        self.more = more or {}

    def __missing__(self, code: int) -> str | int:
        s = "".join(self.more.get(c, c) for c in of_char(chr(code)))
        self[code] = s = code if s == chr(code) else s
        return s


TABLE = Skeleton()
DIRTY = re.compile(r"[^\n -~]")


def skeleton(text: str, by: Skeleton = TABLE) -> str:
    """The text's consistent form: characters by prototype, letters and accents composed where a composed letter exists,
    no invisible characters, single blanks, none at the ends of lines, no empty lines at the ends."""
    if DIRTY.search(text):
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(by))
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = BLANKS.sub(" ", text)
    return text.replace(" \n", "\n").replace("\n ", "\n").strip(" \n")


# Latin letters and the Cyrillic ones of the same shape, for words that must be Cyrillic.
TO_CYRILLIC = str.maketrans("ABCEHIJKMOPSTXYaceijopsxy", "АВСЕНІЈКМОРЅТХУасеіјорѕху")
WORD = re.compile(r"[^\W\d_]+")
CYRILLIC = re.compile("[\u0400-\u04ff]")


def readable(skel: str) -> str:
    """A skeleton with words given back to their script: a word that holds a letter only Cyrillic has is written in
    Cyrillic throughout, and in a mainly Cyrillic text so is a word of letters that both scripts have. The result depends on
    the skeleton alone, so texts that look the same stay equal."""
    if not CYRILLIC.search(skel):
        return skel
    both = TO_CYRILLIC
    words = [w for w in WORD.findall(skel) if any(ord(c) not in both for c in w)]
    mainly = 2 * sum(1 for w in words if CYRILLIC.search(w)) > len(words)
    return WORD.sub(lambda m: m[0].translate(both) if CYRILLIC.search(m[0]) or mainly and all(ord(c) in both for c in m[0]) else m[0], skel)


def canonical(df: DataFrame, key: str = "result_id", text: str = "markdown", out: str = "canonical", confusables: str | None = None) -> DataFrame:
    """(key, out, look BIGINT, stored BIGINT) of every row: the consistent form and 64-bit hashes of the skeleton and of the
    text as stored. Null stays null; an empty text stays empty. One pass, without a shuffle but of an input with fewer partitions
    than cores. confusables: a file that published() reads on the driver, some thousand entries."""
    more = published(confusables) if confusables else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        def h(t: str | None) -> int | None:
            return None if t is None else int(np.uint64(xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass"))).astype(np.int64))

        by = Skeleton(more) if more else TABLE
        for b in batches:
            s = [None if t is None else skeleton(t, by) for t in b["t"]]
            yield pd.DataFrame({"k": b["k"], "s": [t and readable(t) for t in s], "look": pd.array([h(t) for t in s], "Int64"), "stored": pd.array([h(t) for t in b["t"]], "Int64")})

    kind = df.schema[key].dataType.simpleString()
    done = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInPandas(run, f"k {kind}, s string, look bigint, stored bigint")
    return done.select(F.col("k").alias(key), F.col("s").alias(out), "look", "stored")


def pairs(df: DataFrame, key: str = "result_id", text: str = "markdown", confusables: str | None = None) -> DataFrame:
    """(key_a, key_b), key_a < key_b: different rows whose texts differ as stored and have equal skeletons. Null texts and
    texts that show nothing are in no pair. Rows equal in key count once."""
    rows = canonical(df, key, text, "s", confusables).where((F.col("s") != "") & F.col(key).isNotNull()).select(F.col(key).alias("k"), "look", "stored")
    rows = staged(rows, "looks").distinct()  # three numbers a row, read several times below
    mixed = rows.groupBy("look").agg(F.min("stored").alias("low"), F.max("stored").alias("high")).where("low <> high").select("look")
    # Only texts that are stored in several ways remain, a small part.
    met = pairs_within(rows.join(mixed, "look"), "look", "k", "stored")
    return met.select(F.col("p").alias(f"{key}_a"), F.col("q").alias(f"{key}_b")).distinct()
