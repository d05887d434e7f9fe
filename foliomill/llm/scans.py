"""Continuous readable paragraphs from the text of scanned pages (problem 5).

Method: the words of the corpus that are in at least ``LEAST`` texts make a trie; a
Levenshtein automaton of each other word is intersected with it, which gives all words within one edit (a pair of letters
read as one, or one as a pair, counts as an edit). Candidates are weighed by how common they are and by whether scanners
are known for the edit. Where a word has several, each occurrence is decided by its neighbours: how often the corpus has each
candidate after the word before it and before the word after it. In Chinese, where words have no limits, the words are runs of
three characters, so a candidate must fit its neighbours on both sides. Then page furniture is removed and lines are joined to paragraphs.

VOCABULARY bounds what is sent to the workers at once, whatever the corpus's size: the most common words as one trie, all others as
slices of a shuffle that each word visits where it may find an original. Corrections of words and counts of neighbours are matched
with texts by joins.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged

LEAST = 6  # texts that a word must be in to be a candidate
VOCABULARY = 300_000  # candidates sent to the workers at once, at most
SLICE = 200_000  # rows of a slice of the other candidates and of the words that visit them, about
RATIO = 8  # times that a candidate must be as common as the word it replaces; its square for an edit that scanners are not known for
USUAL = 4.0  # what a known edit adds to a candidate's weight, the logarithm of its count
SCANNED = 0.6  # of the texts with a misread word are scans, at least; what other files hold as well is a word
RUNNING = 110  # characters of a running header, at most
TIMES = 2  # events of one kind that make a text noisy

# What scanners' software takes a letter or pair for (read, meant).
MISREAD = {(a, b) for a, b in (x.split(">") for x in "c>e í>i o>a 0>o 0>O 1>l I>l l>I 1>i 1>I 9>g 6>é 6>b b>h h>b t>f f>t v>y B>ß B>8 5>S 8>B 2>Z ii>u rn>m m>rn cl>d d>cl li>h h>li n>ri ri>n vv>w w>vv nn>m u>ii iii>m in>m ni>m c>o e>o o>e e>c a>o u>n n>u".split())}
# The same for Chinese characters of nearly equal shape.
MISREAD_ZH = {x[0]: x[1] for x in "问间 间问 顷项 二工 工二 杳查 侧测 测侧 木本 申由 仵件 吉告 末未 未末 士土 现规 甩用 讦计 书节 节书 规现 令今 筹第 期其 其期 己已 已己 人入 入人 目日 日目 田由 千干 干千 天夫 大太 贝见 儿几 比北 于干 佰伯 拔拨 折拆 巳已 往住 住往 侯候 嬴赢 乌鸟 壁璧".split()}

# A character that may be misread between two neighbours; figures stand as 0.
HAN = re.compile(f"(?=([一-鿿，。；、》0][{''.join(sorted(set(MISREAD_ZH) | set(MISREAD_ZH.values())))}][一-鿿，。；、0]))")
DIGIT = re.compile("[1-9]")
TOKEN = re.compile(r"[^\W_]+")
BROKEN = re.compile(r"(?<=[^\W\d_])[-‐¬\xad][ \t]*\n[ \t]*(?=([^\W\d_]))")
NUMBERISH = re.compile(r"(?<![A-Za-z0-9_])(?=[\dOlI.,]*\d)(?=[\d.,]*[OlI])[\dOlI]+(?:[.,][\dOlI]+)*(?![A-Za-z0-9_])")
PAGE_NO = re.compile(
    r"(?:[-–—·|\[(]\s*)?(?:(?:page|seite|página|pág|pag|стр|страница|лист|sheet|blatt|p|s)\.?\s*)?\d{1,4}(?:\s*(?:/|of|von|sur|de|из|\|)\s*\d{1,4})?(?:\s*[-–—·|\])])?"
    r"|[-–—·]?\s*[ivxl]{1,7}\s*[-–—·]?|第\s*\d{1,4}\s*页(?:\s*[,，/]?\s*共\s*\d{1,4}\s*页)?|—\d{1,4}—",
    re.I,
)
ONE_SCRIPT = re.compile("[a-zß-öø-ÿœ0-9]+|[а-яё0-9]+")
STOP = re.compile(r"[.。!！?？:：;；…][\"”’»」』)）]*$")
OWN = re.compile(r"#|\||```|[-*+] |\d+[.)] |!\[|<!--|源文件|提取页|字符总数")
PAGE_PART = re.compile(r"^[\dOl]{1,4}\s*\||\|\s*[\dOl]{1,4}$|(?:\b(?:page|seite|página|pág|p)\.?|стр\.?)\s*[\dOl]{1,4}|[-–—·\[(]\s*[\dOl]{1,4}\s*[-–—·\])]|\b[\dOl]{1,4}\s*/\s*[\dOl]{1,4}\b|第\s*\d+\s*页", re.I)
# Letters by their strokes, so that a line and its misreadings come out alike.
STROKES = str.maketrans({"a": "o", "e": "o", "c": "o", "0": "o", "l": "i", "1": "i", "í": "i", "t": "i", "f": "i", "u": "ii", "h": "ii", "b": "ii", "6": "ii", "é": "ii", "d": "oi", "n": "ri", "m": "rri", "w": "vv", "9": "g", "y": "v", "|": ""} | {x: min(x, y) for x, y in MISREAD_ZH.items()} | {y: min(x, y) for x, y in MISREAD_ZH.items()})


def outline(line: str) -> str:
    """What a running header looks like without page numbers, figures and scanners' mistakes."""
    return re.sub(r"[\W\d_]+", "", PAGE_PART.sub(" ", line).lower().translate(STROKES))


class Trie:
    """Vocabulary by letters; the automaton's states are rows of the edit matrix cut to one edit, kept implicitly as the
    remaining suffix of the word and whether the edit is spent."""

    def __init__(self, words: dict[str, int]):
        self.root: dict = {}
        for w, n in words.items():
            self.add(w, n)

    def add(self, word: str, n: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = n

    def near(self, word: str) -> list[tuple[str, str, str, int]]:
        """(candidate, read, meant, count) of every vocabulary word one edit away: one letter changed, left out or put in, or one
        of the pairs of MISREAD."""
        out = []
        pairs = PAIRS
        node, n = self.root, len(word)
        for k in range(n + 1):  # the first k letters agree
            rest = word[k:]
            if rest:
                c = rest[0]
                for a, child in node.items():
                    if a and a != c:
                        if (m := follow(child, rest[1:])) is not None:
                            out.append((word[:k] + a + rest[1:], c, a, m))
                if (m := follow(node, rest[1:])) is not None:
                    out.append((word[:k] + rest[1:], c, "", m))
                for read, meant in pairs:
                    if rest.startswith(read) and (m := follow(node, meant + rest[len(read) :])) is not None:
                        out.append((word[:k] + meant + rest[len(read) :], read, meant, m))
            for a, child in node.items():
                if a and (not rest or a != rest[0]) and (m := follow(child, rest)) is not None:
                    out.append((word[:k] + a + rest, "", a, m))
            if k == n or word[k] not in node:
                break
            node = node[word[k]]
        return out


PAIRS = [(a, b) for a, b in MISREAD if len(a) != 1 or len(b) != 1]


def follow(node: dict, rest: str) -> int | None:
    for c in rest:
        node = node.get(c)
        if node is None:
            return None
    return node.get("")


def words_of(text: str) -> set[str]:
    """Distinct words of at least 4 characters, and runs of three Chinese characters around one that may be misread."""
    text = joined(text)
    out = {w for w in TOKEN.findall(text) if len(w) >= 4 and not w.isdigit() and (w.isascii() or max(w) < "⺀")}
    if max(text, default="") >= "一":
        out.update(HAN.findall(DIGIT.sub("0", text.replace("\n", ""))))
    return out


def joined(text: str) -> str:
    """Text with words broken at line ends put together."""
    return BROKEN.sub(lambda m: "" if m[1].islower() else m[0], text)


def is_scan(file_type, file_name):
    """Whether a result is of a PDF or an image: by its type, where that is null by its name's extension."""
    ext = F.lower(F.regexp_extract(F.coalesce(file_name, F.lit("")), r"\.(\w+)$", 1))
    return F.coalesce(F.lower(file_type).isin("pdf", "image"), ext.isin("pdf", "png", "jpg", "jpeg", "bmp", "tif", "tiff", "gif", "webp", "jp2"))


def counted(df: DataFrame) -> DataFrame:
    """(w, n, s): in how many of the texts t, and of the scans among them, each word is. Counts are added up in each batch before
    they are shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter[str] = Counter()
            s: Counter[str] = Counter()
            for t, scan in zip(b["t"], b["scan"]):
                words = words_of(t)
                n.update(words)
                if scan:
                    s.update(words)
            yield pd.DataFrame({"w": list(n), "n": list(n.values()), "s": [s[w] for w in n]})

    return df.where("t IS NOT NULL AND t <> ''").mapInPandas(run, "w string, n bigint, s bigint").groupBy("w").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def candidates(trie: Trie, word: str, n: int) -> list[tuple[str, float]]:
    """(candidate, weight), the best first, for a word that n texts contain. Any edit counts; one that is not in the tables only in
    words of six small letters and more, inside them, and if the candidate is far more common. A letter of another script in a word is no
    scanner's mistake but a look-alike or a wrong encoding, which have operators of their own."""
    if len(word) == 3 and "一" <= word[1] <= "鿿":
        meant = MISREAD_ZH.get(word[1])
        c = meant and word[0] + meant + word[2]
        m = c and follow(trie.root, c)
        return [(c, math.log(m))] if m and m >= RATIO * n else []
    found: dict[str, float] = {}
    plain = len(word) >= 6 and word.islower() and ONE_SCRIPT.fullmatch(word)
    for c, read, meant, m in trie.near(word):
        usual = (read, meant) in MISREAD
        if m >= RATIO * n and (usual or plain and m >= RATIO * RATIO * n and c[0] == word[0] and c[-1] == word[-1] and ONE_SCRIPT.fullmatch(c)):
            found[c] = max(found.get(c, 0.0), math.log(m) + USUAL * usual)
    return sorted(found.items(), key=lambda x: (-x[1], x[0]))


READ, MEANT = (max(len(x[k]) for x in MISREAD) for k in (0, 1))


def ends(word: str, original: bool) -> set[str]:
    """Keys of which a word and each original one edit away share one at least. The letters before an edit and those behind it are all
    of the original's but MEANT, so of its n letters the first or the last (n - MEANT) / 2 stand in the word as well."""
    if len(word) == 3 and "一" <= word[1] <= "鿿":
        return {word if original else word[0] + MISREAD_ZH.get(word[1], "") + word[2]}
    n = len(word)
    sizes = {max(1, (m - MEANT + 1) // 2) for m in ([n] if original else range(n - READ + 1, n + MEANT))}
    return {x for h in sizes for x in ("^" + word[:h], "$" + word[-h:])}


def floor(words: DataFrame) -> int:
    """The least count with which a word is among the VOCABULARY most common ones. Counts above 4096 are told apart by powers of two only, so the
    histogram has few rows."""
    n = F.when(F.col("n") < 4096, F.col("n")).otherwise(F.expr("cast(pow(2, floor(log2(n))) as bigint)")).alias("n")
    left, low = VOCABULARY, LEAST
    for r in sorted(words.where(F.col("n") >= LEAST).groupBy(n).agg(F.count("*").alias("c")).collect(), reverse=True):
        if r["c"] > left:
            low = 2 * r["n"] if r["n"] >= 4096 else r["n"] + 1
            break
        left -= r["c"]
    return low


def corrections(words: DataFrame) -> DataFrame:
    """(w, v ARRAY<STRUCT<v, weight>>): words of the corpus that may be misreadings, and of what, the likeliest first."""
    low = floor(words)
    common = {r["w"]: r["n"] for r in words.where(F.col("n") >= low).collect()}  # at most VOCABULARY
    sent = words.sparkSession.sparkContext.broadcast(common)
    misread = words.where(f"s >= {SCANNED} * n")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(sent.value)
        for b in batches:
            v = [candidates(trie, w, n) for w, n in zip(b["w"], b["n"])]
            some = [k for k, x in enumerate(v) if x]
            yield pd.DataFrame({"w": b["w"].iloc[some], "v": pd.Series([[{"v": c, "weight": x} for c, x in v[k]] for k in some], dtype=object, index=some)})

    out = misread.mapInPandas(run, "w string, v array<struct<v: string, weight: double>>")
    if low == LEAST:
        return out
    every = out.select("w", F.inline("v")).union(from_slices(words.where((F.col("n") >= LEAST) & (F.col("n") < low)), misread))
    best = F.array_sort(F.collect_set(F.struct((-F.col("weight")).alias("less"), "v")))
    return every.groupBy("w").agg(F.transform(best, lambda x: F.struct(x["v"].alias("v"), (-x["less"]).alias("weight"))).alias("v"))


def from_slices(originals: DataFrame, words: DataFrame) -> DataFrame:
    """(w, v, weight), some rows more than once: the candidates among originals, however many these are, of each of the words. Both are
    shuffled by their ends; a worker has the trie of one slice at a time."""
    sizes = [x.count() for x in (originals, words)]
    slices = max((2 * sizes[0] + 6 * sizes[1]) // SLICE + 1, words.sparkSession.sparkContext.defaultParallelism)

    def sliced(rows: DataFrame, original: bool) -> DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = [(k, not original, w, n) for w, n in zip(b["w"], b["n"]) for k in {zlib.crc32(x.encode("utf-8", "replace")) % slices for x in ends(w, original)}]
                yield pd.DataFrame(out, columns=["slice", "visits", "w", "n"])

        return rows.select("w", "n").mapInPandas(run, "slice int, visits boolean, w string, n bigint")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, trie = None, Trie({})
        for b in batches:
            out = []
            for k, visits, w, n in zip(b["slice"], b["visits"], b["w"], b["n"]):
                if k != at:
                    at, trie = k, Trie({})
                if visits:
                    out += [(w, *x) for x in candidates(trie, w, n)]
                else:
                    trie.add(w, n)
            yield pd.DataFrame(out, columns=["w", "v", "weight"])

    both = sliced(originals, True).union(sliced(words, False)).repartition(slices, "slice").sortWithinPartitions("slice", "visits")
    return both.mapInPandas(found, "w string, v string, weight double")


def neighbours(texts: DataFrame, fixes: DataFrame) -> DataFrame | None:
    """(v, x, after BOOLEAN, c): how often the word x stands after or before v in all texts, for each candidate v of a word with
    several; None if there is none. Each pass over the texts counts about VOCABULARY candidates at most."""
    every = fixes.where("size(v) > 1").select(F.explode("v.v").alias("v")).distinct()
    passes = -(-every.count() // VOCABULARY)
    if not passes:
        return None

    def counts(wanted: set[str]) -> DataFrame:
        sent = texts.sparkSession.sparkContext.broadcast(wanted)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                n: Counter[tuple[str, str, bool]] = Counter()
                for t in b["t"]:
                    words = TOKEN.findall(joined(t))
                    if sent.value.isdisjoint(words):
                        continue
                    for x, y in zip(words, words[1:]):
                        if x in sent.value:
                            n[x, y, True] += 1
                        if y in sent.value:
                            n[y, x, False] += 1
                yield pd.DataFrame([(*k, c) for k, c in n.items()], columns=["v", "x", "after", "c"])

        return texts.where("t <> ''").select("t").mapInPandas(run, "v string, x string, after boolean, c bigint")

    parts = [counts({r["v"] for r in every.where(F.expr(f"pmod(xxhash64(v), {passes}) = {k}")).collect()}) for k in range(passes)]
    return reduce(DataFrame.union, parts).groupBy("v", "x", "after").agg(F.sum("c").alias("c"))


def decided(rows: DataFrame, counts: DataFrame, kind: str) -> DataFrame:
    """(k, w, before, behind, v): of each place in a text where a word has several candidates the one that goes best with its
    neighbours. rows: (k, t, f)."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, t, f in zip(b["k"], b["t"], b["f"]):
                several = {x["w"]: x["v"] for x in f if len(x["v"]) > 1} if f is not None and t else {}
                if several:
                    words = ["", *TOKEN.findall(body_of(t)[0]), ""]
                    for p in {(x, w, y) for x, w, y in zip(words, words[1:], words[2:]) if w in several}:
                        out += [(k, p[1], p[0], p[2], c["v"], c["weight"]) for c in several[p[1]]]
            yield pd.DataFrame(out, columns=["k", "w", "before", "behind", "v", "weight"])

    at = rows.mapInPandas(places, f"k {kind}, w string, before string, behind string, v string, weight double")
    side = lambda after, x, c: counts.where(F.col("after") == after).select("v", F.col("x").alias(x), F.col("c").alias(c))
    at = at.join(side(True, "behind", "c1"), ["v", "behind"], "left").join(side(False, "before", "c2"), ["v", "before"], "left")
    fit = F.col("weight") + 2 * (F.log1p(F.coalesce("c1", F.lit(0))) + F.log1p(F.coalesce("c2", F.lit(0))))
    return at.groupBy("k", "w", "before", "behind").agg(F.max_by("v", F.struct(fit.alias("fit"), "v")).alias("v"))


def furniture(lines: list[str]) -> tuple[set[int], set[int]]:
    """Indices of running headers and of page numbers among the text."""
    numbers, heads, seen = set(), set(), {}
    fence = False
    for k, x in enumerate(lines):
        s = x.strip()
        if s.startswith("```"):
            fence = not fence
        if not s or fence or OWN.match(s) or len(s) > RUNNING:
            continue
        if PAGE_NO.fullmatch(s.replace("O", "0").replace("l", "1")) or PAGE_NO.fullmatch(s):
            numbers.add(k)
        elif not STOP.search(s):
            key = outline(s)
            if len(key) >= 5:
                seen.setdefault(key, []).append(k)
    for key, ks in seen.items():
        if len(ks) >= 2:
            heads.update(ks)
    return heads, numbers


def body_of(text: str) -> tuple[str, int, int, int]:
    """(text without furniture and with broken words joined, broken words, running headers, page numbers)."""
    lines = re.split(r"\r\n|\r|\n", text)
    heads, numbers = furniture(lines)
    body = "\n".join(x for k, x in enumerate(lines) if k not in heads and k not in numbers)
    return joined(body), sum(1 for m in BROKEN.finditer(body) if m[1].islower()), len(heads), len(numbers)


def clean(text: str, fixes: dict[str, str], places: dict[tuple[str, str, str], str] | None = None) -> tuple[str, int, int, int, int]:
    """(repaired text, broken words, misread words, running headers, page numbers). places: the corrections of words between two
    others, which go before those in fixes."""
    body, broken, heads, numbers = body_of(text)
    misread = 0
    latin = {w: v for w, v in fixes.items() if ord(w[1]) < 0x2E80}
    if latin:
        found = list(TOKEN.finditer(body))
        out, at = [], 0
        for k, m in enumerate(found):
            if (v := latin.get(m[0])) is None:
                continue
            if places:
                v = places.get((found[k - 1][0] if k else "", m[0], found[k + 1][0] if k + 1 < len(found) else ""), v)
            out += [body[at : m.start()], v]
            at, misread = m.end(), misread + 1
        body = "".join(out) + body[at:]
    for w, v in fixes.items():
        if ord(w[1]) >= 0x2E80:
            a, b, c = ("[0-9]" if x == "0" else x for x in w)
            body, n = re.subn(f"(?<={a})(\n?){b}(?=\n?{c})|(?<={a}\n){b}(?=\n?{c})", lambda m, v=v: (m[1] or "") + v[1], body)
            misread += n
    figures = [m for m in NUMBERISH.finditer(body) if sum(c.isdigit() for c in m[0]) >= 1 and len(m[0]) >= 2]
    misread += len(figures)
    body = NUMBERISH.sub(lambda m: m[0].replace("O", "0").replace("l", "1").replace("I", "1") if len(m[0]) >= 2 else m[0], body)
    return reflow(body), broken, misread, heads, numbers


def reflow(text: str) -> str:
    """Lines of a paragraph joined by a blank, in Chinese by nothing; headings, lists, tables and code keep their lines."""
    out: list[str] = []
    fence, open_ = False, False
    for x in text.split("\n"):
        s = x.strip()
        if s.startswith("```"):
            fence = not fence
            out.append(x)
            open_ = False
        elif fence or not s or OWN.match(s):
            if s or not out or out[-1].strip():
                out.append(x.rstrip() if fence else s)
            open_ = False
        elif open_:
            han = ord(out[-1][-1]) >= 0x2E80 and ord(s[0]) >= 0x2E80
            code = out[-1][-1] == "-" and s[0].isdigit()  # a number cut at its hyphen
            out[-1] += ("" if han or code else " ") + s
        else:
            out.append(s)
            open_ = True
    return "\n".join(out).strip("\n")


def repaired(results: DataFrame, key: str = "result_id", text: str = "markdown") -> DataFrame:
    """(key, repaired, broken, misread, headers, numbers) of each scanned result, rows of one key once.

    Vocabulary, corrections and neighbours come from all results, each key once. Null and empty texts come out as they are, with
    zeros. results needs file_type and file_name.
    """
    kind = results.schema[key].dataType.simpleString()
    scan = is_scan(F.col("file_type"), F.col("file_name"))
    every = results.select(F.col(key).alias("k"), F.col(text).alias("t"), scan.alias("scan")).groupBy("k").agg(F.first("t").alias("t"), F.max("scan").alias("scan"))
    every = staged(every, "texts")
    words = staged(counted(every), "words")
    fixes = staged(corrections(words), "fixes")
    rows = every.where("scan").select("k", "t")

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(k, w) for k, t in zip(b["k"], b["t"]) if t for w in words_of(t)]
            yield pd.DataFrame(found, columns=["k", "w"])

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            done = []
            for t, f, p in zip(b["t"], b["f"], b["p"]):
                fix = {x["w"]: x["v"][0]["v"] for x in f} if f is not None else {}
                done.append(clean(t, fix, {(x["before"], x["w"], x["behind"]): x["v"] for x in p} if p is not None else None) if t else (t, 0, 0, 0, 0))
            yield pd.concat([b[["k"]].reset_index(drop=True), pd.DataFrame(done, columns=["repaired", "broken", "misread", "headers", "numbers"])], axis=1)

    # A text's corrections are no more than its words.
    per = rows.mapInPandas(own, f"k {kind}, w string").join(fixes, "w").groupBy("k").agg(F.collect_list(F.struct("w", "v")).alias("f"))
    both = rows.join(per, "k", "left")
    counts = neighbours(every, fixes)
    if counts is None:
        both = both.withColumn("p", F.lit(None).cast("array<struct<w: string, before: string, behind: string, v: string>>"))
    else:
        chosen = decided(both, staged(counts, "neighbours"), kind).groupBy("k").agg(F.collect_list(F.struct("w", "before", "behind", "v")).alias("p"))
        both = both.join(chosen, "k", "left")
    done = both.mapInPandas(finish, f"k {kind}, repaired string, broken int, misread int, headers int, numbers int")
    return done.withColumnRenamed("k", key)


def noisy(df: DataFrame, times: int = TIMES) -> DataFrame:
    """The rows of repaired() with noise of at least one kind, times over."""
    return df.where(F.greatest("broken", "misread", "headers", "numbers") >= times)
