"""Text that was decoded with the wrong encoding or character table (problem 4).

Method: from every distinct clean word of the corpus the forms are made that it takes under every chain of right and wrong
encoding; the words of the texts that look wrong are joined with this table by hash, and a form found is replaced by its
original. A Chinese word is a pair of neighbouring characters, since its runs have no limits. Around a verified form the whole
run is turned back through the form's chain, which is kept if the result is clean.

Where a decoder put U+FFFD for what it could not read, the bytes are lost; such words come back only if their form has one
original, but the field counts as affected.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import staged
from .lookalikes import skeleton

SINGLE = ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "iso8859-15", "cp1253", "cp1254")
DOUBLE = ("gbk", "big5", "shift_jis", "euc_kr", "euc_jp")
# (right, wrong) for words of letters and signs, of Chinese and of Cyrillic; "a+b" applies two chains in a row.
LATIN_CHAINS = [("utf-8", x) for x in SINGLE + DOUBLE] + [(r, w) for r in ("cp1252", "cp850", "mac_roman", "cp437") for w in ("cp1252", "mac_roman", "cp850", "cp437", "cp1251", "koi8-r", "cp866", "cp1250", "cp1253", "utf-8", "gbk", "big5", "shift_jis") if r != w]
TWICE = [("utf-8", a, "utf-8", b) for a in ("cp1252", "latin-1") for b in ("cp1252", "latin-1")]
CYRILLIC_CHAINS = [("utf-8", x) for x in SINGLE + DOUBLE] + [(r, w) for r in ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic") for w in ("latin-1", "cp1252", "cp1251", "koi8-r", "cp866", "mac_roman", "cp437", "cp850", "mac_cyrillic", "iso8859-5", "utf-8", "gbk") if r != w]
HAN_CHAINS = [("utf-8", x) for x in SINGLE + DOUBLE] + [(r, w) for r in ("gbk", "big5") for w in ("latin-1", "cp1252", "cp437", "cp850", "mac_roman", "cp1251", "koi8-r", "cp866", "gbk", "big5", "shift_jis", "euc_kr", "utf-8") if r != w]
FONT = ("font", "font")  # a PDF font whose Latin letters lie in row A0 of its table instead of row A3

LOWER, UPPER = "a-zà-öø-ÿœšžß", "A-ZÀ-ÖØ-ÞŒŠŽŸ"
SIGNS = "“”‘’„‚«»‹›–—…°€£§·•¿¡²³⁰¹⁴-⁹№℃、。，；：！？（）《》〈〉【】「」『』〔〕％￥～×÷±µ→←−≤≥ªº½¼¾©®™　    ​-‍⁠﻿­‐-―"
PART = re.compile(rf"(?P<han>[㐀-鿿豈-﫿]+)|(?P<lat>(?:[{UPPER}](?=[{LOWER}’])|[{UPPER}]+(?![{LOWER}])|)[{LOWER}]+|[{UPPER}]+)|(?P<cyr>[А-ЯЁ]?[а-яё]+|[А-ЯЁ]+)|(?P<num>[0-9]+)|(?P<sign>[{SIGNS}]+)|(?P<other>.)", re.S)
RUN = re.compile(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WIDE = re.compile(r"[^\x00-\x7f]+")
NON_ASCII = re.compile(r"[^\x00-\x7f]")
LOST = "�"
OTHER_SCRIPT = re.compile("[\u0400-\u04ff]+|[㐀-鿿]+")
FOUNDER = re.compile("[犀-狿]+")
# Accented pairs with which UTF-8 read as a Western encoding begins, and which no clean word holds.
FOREIGN = re.compile("[à-öø-ÿ]{3,}|[À-ÖØ-Þ]{4,}|[а-яё][À-ÿ]", re.I)  # no clean word has so many accents in a row
CYRILLIC_OR_GREEK = re.compile("[Ͱ-Ͽ\u0400-\u04ff]+")
LEADS = re.compile("[ÂÃ][^\x00-\x7fàáâãäçèéêíóôõúÀ-Üœ]|Ã[\u0080-ÿœ‚ƒ„…†‡ˆ‰Š‹Œ‘’“”•–—˜™š›ž]|[âÐÑ][€\u0080-¿‚„…†‡ˆ‰‹]")


@lru_cache(maxsize=1)
def common_han() -> frozenset[str]:
    """The first level of the simplified character set, its 3,755 most used characters."""
    out = set()
    for lead in range(0xB0, 0xD8):
        for trail in range(0xA1, 0xFF):
            try:
                out.add(bytes((lead, trail)).decode("gb2312"))
            except UnicodeDecodeError:
                pass
    return frozenset(out)


def rare(run: str) -> int:
    return sum(1 for c in run if c not in common_han())


def is_clean(token: str) -> bool:
    """Whether a token is written as words are: one script, capitals in front or throughout, known signs."""
    before = ""
    parts = [(m.lastgroup, m[0]) for m in PART.finditer(token)]
    for k, (kind, s) in enumerate(parts):
        if kind == "other":
            return False
        if kind == "lat" and before == "lat" and not (s.isascii() and parts[k - 1][1].isascii()):
            return False
        if kind == "cyr" and before in ("lat", "cyr") or kind == "lat" and before == "cyr":
            return False
        if kind == "han":
            beside = "lat" in (before, parts[k + 1][0] if k + 1 < len(parts) else "")
            if beside and len(s) <= 3 and (rare(s) or before == "lat" and parts[k - 1][1][-1].islower()):
                return False
            r = rare(s)
            if r >= 2 and 3 * r >= len(s):
                return False
        before = kind
    return not LEADS.search(token) and not FOREIGN.search(token)


def core_of(token: str) -> str:
    """A token without the signs around it."""
    return token.strip("“”‘’„«»–—…·¿¡‹›  ")


def words_in(token: str) -> Iterator[str]:
    """The clean words of a clean token: words with letters beyond ASCII or between signs, signs, Chinese pairs."""
    kinds = {m.lastgroup for m in PART.finditer(token)}
    if kinds <= {"lat", "sign", "num"}:
        core = core_of(token)
        if NON_ASCII.search(core) and (len(core) >= 3 or core[0] in SIGNS) or core.isascii() and len(core) >= 3:
            yield core
    for m in PART.finditer(token):
        s = m[0]
        if m.lastgroup == "cyr" and len(s) >= 3:
            yield s
        elif m.lastgroup == "sign":
            yield from s
        elif m.lastgroup == "han":
            yield from (s[k : k + 2] for k in range(len(s) - 1))


def odd_tokens(token: str) -> Iterator[tuple[str, bool]]:
    """What a token that is not clean is looked up by: itself, its stretches beyond ASCII, and pieces of these as long as the
    forms of two Chinese characters, wrong once or twice. True for all but the pieces, which may be words as a whole."""
    yield token, True
    for m in FOUNDER.finditer(token):
        yield m[0], True
    for m in WIDE.finditer(token):
        s = m[0]
        if s != token and CYRILLIC_OR_GREEK.fullmatch(s):  # look-alike letters within a word
            continue
        if len(s) >= 2 and s != token:
            yield s, True
        for width in (2, 3, 4, 6, 12):
            for shift in (0, 1) if width < 4 else (0,):
                for k in range(shift, len(s) - width + 1, width):
                    yield s[k : k + width], False
    if not token.isascii():
        core = token.strip("“”‘’„«»–—…·")
        if core != token and len(core) >= 2:
            yield core, True


def decode(raw: bytes, name: str) -> str:
    """Decode as careless software does: bytes without a character stand for themselves in single-byte tables and become
    U+FFFD in others."""
    if name in SINGLE or name.startswith(("iso", "mac")):
        try:
            return raw.decode(name)
        except UnicodeDecodeError:
            return "".join(_byte(b, name) for b in raw)
    return raw.decode(name, "replace")


@lru_cache(maxsize=8192)
def _byte(b: int, name: str) -> str:
    try:
        return bytes((b,)).decode(name)
    except UnicodeDecodeError:
        return chr(b)


def encode(s: str, name: str) -> bytes | None:
    """The bytes that decode gave s from, or None."""
    try:
        return s.encode(name)
    except UnicodeEncodeError:
        if not (name in SINGLE or name.startswith(("iso", "mac"))):
            return None
    out = bytearray()
    for c in s:
        try:
            out += c.encode(name)
        except UnicodeEncodeError:
            if ord(c) > 255:
                return None
            out.append(ord(c))
    return bytes(out)


def form(word: str, chain: tuple[str, ...]) -> str | None:
    """What a word looks like after a chain, or None if the chain cannot hold it."""
    if chain == FONT:
        out = "".join(chr(ord(c) + 0xFEE0) for c in word).encode("gbk", "ignore")
        return bytes(0xA0 if b == 0xA3 and not k % 2 else b for k, b in enumerate(out)).decode("gbk", "ignore") if word.isascii() and word.isalpha() else None
    for right, wrong in zip(chain[::2], chain[1::2]):
        try:
            word = decode(word.encode(right), wrong)
        except UnicodeEncodeError:
            return None
    return word


def undo(s: str, chain: tuple[str, ...]) -> str | None:
    """The original of a run, or None if it cannot have come about by the chain."""
    if chain == FONT:
        raw = s.encode("gbk", "ignore")
        full = bytes(0xA3 if b == 0xA0 and not k % 2 else b for k, b in enumerate(raw)).decode("gbk", "ignore")
        return "".join(chr(ord(c) - 0xFEE0) for c in full) if all(0xFF01 <= ord(c) <= 0xFF5E for c in full) else None
    for right, wrong in reversed(list(zip(chain[::2], chain[1::2]))):
        raw = encode(s, wrong)
        if raw is None:
            return None
        try:
            s = raw.decode(right)
        except UnicodeDecodeError:
            return None
    return s


def chains_of(word: str) -> list[tuple[str, ...]]:
    if word.isascii():
        return [FONT]
    c = next(c for c in word if ord(c) > 127)
    if "㐀" <= c <= "鿿":
        return HAN_CHAINS + TWICE
    if "Ѐ" <= c <= "ӿ":
        return CYRILLIC_CHAINS + TWICE
    both = LATIN_CHAINS + TWICE
    # Chinese signs are written by Chinese encodings, all others by Western ones.
    return HAN_CHAINS + TWICE if c in "、。，；：！？（）《》【】「」『』％￥" else both


def forms(word: str) -> dict[str, tuple[str, ...]]:
    out: dict[str, tuple[str, ...]] = {}
    for chain in chains_of(word):
        s = form(word, chain)
        if s and s != word and len(s) >= 2 and not s.isascii() and (s.count(LOST) < len(s) - 1 or not LOST in s):
            out.setdefault(s, chain)
    return out


# Chains by the encoding they end with, and what they may turn back into: one Latin or Cyrillic word and signs around it.
BY_WRONG: dict[str, list[tuple[str, ...]]] = {}
for _chain in dict.fromkeys(LATIN_CHAINS + TWICE + CYRILLIC_CHAINS):
    BY_WRONG.setdefault(_chain[-1], []).append(_chain)
ONE_WORD = re.compile(rf"[{SIGNS}]*(?:[{LOWER}{UPPER}0-9’]+|[а-яёА-ЯЁ]+)[{SIGNS}]*")


def origins(token: str) -> Iterator[tuple[str, str, tuple[str, ...]]]:
    """(core, original, chain): the clean words that an odd token as a whole may have been, with the signs around them, and the
    word that vouches for each if it is one of the corpus. A word with look-alike letters of another script is none."""
    if len(token) < 3 or LOST in token or token.isascii() or is_clean(token) or skeleton(token).isascii():
        return
    for wrong, chains in BY_WRONG.items():
        raw = encode(token, wrong)
        if raw is None:
            continue
        for chain in chains:
            try:
                o = raw.decode(chain[-2])
            except UnicodeDecodeError:
                continue
            if len(chain) > 2:
                o = undo(o, chain[:-2])
            if o and o != token and ONE_WORD.fullmatch(o) and is_clean(o) and form(o, chain) == token:
                core = core_of(o)
                if len(core) >= 3 and core[0].isalpha():
                    yield core, o, chain


def field_texts(markdown: str | None, metadata: str | None) -> Iterator[tuple[str, str]]:
    if markdown:
        yield "markdown", markdown
    if metadata:
        yield "metadata", "\n".join(values(metadata))


def values(metadata: str) -> list[str]:
    """Strings among a JSON document's values, unescaped; a text that is no JSON is its own value."""
    try:
        todo = [json.loads(metadata)]
    except ValueError:
        return [metadata]
    out = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif isinstance(x, dict):
            todo.extend(x.values())
        elif isinstance(x, list):
            todo.extend(x)
    return out


@lru_cache(maxsize=1)
def plain_han() -> re.Pattern:
    """Tokens of the most used Chinese characters, signs, figures and capitals, which need no closer look."""
    return re.compile(f"[0-9A-Z{SIGNS}{''.join(sorted(common_han()))}]+")


@lru_cache(maxsize=100_000)
def judged(token: str) -> tuple[tuple[str, ...], tuple[tuple[str, bool], ...]]:
    if is_clean(token):
        odd = ((token, True),) if len(token) >= 3 and token.isupper() and "\u0400" <= token[0] <= "\u04ff" else ()
        return tuple(words_in(token)), odd
    return (), tuple(odd_tokens(token))


def scanned(text: str) -> tuple[set[str], dict[str, bool]]:
    """(clean words, odd tokens) of a text; true for odd tokens that may be words as a whole."""
    clean: set[str] = set()
    odd: dict[str, bool] = {}
    han, simple = [], plain_han().fullmatch
    for token in set(RUN.findall(text)):
        if token.isascii():
            if token.isalpha():
                clean.add(token)
        elif simple(token):
            han.append(token)
        else:
            words, odds = judged(token) if len(token) <= 24 else judged.__wrapped__(token)
            clean.update(words)
            for x, whole in odds:
                odd[x] = whole or odd.get(x, False)
    if han:
        x = "\n".join(han)
        common = common_han()
        clean.update(a + b for a, b in set(zip(x, x[1:])) if a in common and b in common)
        clean.update(set(x).intersection(SIGNS))
    return clean, odd


SALTS, HEAVY = 64, 1000  # a token with more than 1 / HEAVY of all odd tokens' rows is spread over SALTS keys


def delivered(results: DataFrame, key: str) -> DataFrame:
    """(k, m, j): key, markdown and metadata of each key once."""
    return results.select(F.col(key).alias("k"), "markdown", "metadata").groupBy("k").agg(F.first("markdown").alias("m"), F.first("metadata").alias("j"))


def matched(odd: DataFrame, made: DataFrame) -> DataFrame:
    """odd (k, field, w) joined with made (w, original, chain). A token that a large part of all texts holds is met under
    several keys; there are fewer than HEAVY of these, so their hashes may be broadcast."""
    count = odd.groupBy("w").agg(F.count("*").alias("c"))
    made = made.join(count, "w")
    total = count.agg(F.sum("c")).head()[0] or 0
    heavy = F.broadcast(count.where(F.col("c") * HEAVY > total).select(F.xxhash64("w").alias("h"), F.lit(True).alias("heavy")))
    odd = odd.withColumn("h", F.xxhash64("w")).join(heavy, "h", "left").withColumn("salt", F.expr(f"if(heavy, pmod(xxhash64(k), {SALTS}), 0)").cast("int"))
    made = made.withColumn("salt", F.explode(F.expr(f"if(c * {HEAVY} > {total}, sequence(0, {SALTS} - 1), array(0))")))
    return odd.join(made, ["w", "salt"]).select("k", "field", "w", "original", "chain")


def evidence(results: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, field, token, original, chain): the odd tokens of each row's markdown and metadata that are forms of a clean word of any
    text, or that turn back as a whole into one with signs around it. A token with U+FFFD comes with a null original, too."""
    kind = results.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: Counter[str] = Counter()
            rows: list[tuple] = []
            for k, m, j in zip(b["k"], b["m"], b["j"]):
                for field, t in field_texts(m, j):
                    if t.isascii():
                        n.update({x for x in RUN.findall(t) if x.isalpha()})
                        continue
                    clean, odd = scanned(t)
                    n.update(clean)
                    rows += [(k, field, x, -1 if whole else 0) for x, whole in odd.items()]
                    if LOST in t and not any(LOST in x for x in odd):
                        rows.append((k, field, LOST, 0))
            yield pd.DataFrame(rows + [(None, None, w, c) for w, c in n.items()], columns=["k", "field", "w", "n"])

    def table(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, w, "+".join(c), n) for w, n in zip(b["w"], b["n"]) for s, c in forms(w).items()]
            yield pd.DataFrame(rows, columns=["w", "original", "chain", "m"])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            # A form that is written as clean words are needs an original of two texts, without rare Chinese characters.
            keep = [not is_clean(w) or m > 1 and not ("㐀" <= max(o) <= "鿿" and rare(o)) for w, o, m in zip(b["w"], b["original"], b["m"])]
            yield b.loc[keep, ["w", "original", "chain"]]

    def back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(w, core, o, "+".join(c)) for w in b["w"] for core, o, c in origins(w)]
            yield pd.DataFrame(rows, columns=["w", "core", "original", "chain"])

    seen = staged(delivered(results, key).mapInPandas(scan, f"k {kind}, field string, w string, n bigint"), "tokens")
    every = seen.where("n > 0").groupBy("w").agg(F.sum("n").alias("n"))
    odd = seen.where("n <= 0").select("k", "field", "w")
    whole = seen.where("n < 0").select("w").distinct().mapInPandas(back, "w string, core string, original string, chain string")
    whole = whole.join(every.select(F.col("w").alias("core"), F.col("n").alias("m")), "core").select("w", "original", "chain", "m")
    made = every.mapInPandas(table, "w string, original string, chain string, m bigint").unionByName(whole).groupBy("w").agg(F.max(F.struct("m", "original", "chain")).alias("best"))
    # A form that is itself a clean word as common as its original is no evidence.
    made = made.join(every, "w", "left").where("n IS NULL OR n * 4 < best.m").select("w", "best.*")
    made = made.join(odd.select("w").distinct(), "w", "left_semi").mapInPandas(judge, "w string, original string, chain string")
    lost = odd.where(F.col("w").contains(LOST)).select("k", "field", "w", F.lit(None).cast("string").alias("original"), F.lit(None).cast("string").alias("chain"))
    return matched(odd, made).unionByName(lost).select(F.col("k").alias(key), "field", F.col("w").alias("token"), "original", "chain")


def restore(text: str, hits: list[tuple[str, str | None, str | None]]) -> str:
    """The text with affected runs turned back: a run whole, if one of the field's chains gives a clean one, else form by form."""
    chains = [tuple(c.split("+")) for c, _ in Counter(c for _, _, c in hits if c).most_common()]
    direct = {t: o for t, o, _ in hits if o}

    def fix(m: re.Match) -> str:
        s = m[0]
        if s.isascii():
            return s
        if s in direct:
            return direct[s]
        if is_clean(s):
            # In an affected field a word of accents alone may be one of another script.
            if not any(ord(c) < 128 for c in s):
                for chain in chains:
                    o = undo(s, chain)
                    if o and OTHER_SCRIPT.fullmatch(o):
                        return o
            return s
        for chain in chains:
            o = undo(s, chain)
            if o is not None and o != s and is_clean(o):
                return o
        for t in sorted(direct, key=len, reverse=True):
            if len(t) > 1 and t in s:
                s = s.replace(t, direct[t])
        return s

    return RUN.sub(fix, text) if chains else text


def restored(results: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, field, restored, n_tokens, complete): the affected fields, named, with their text as far as it can be had back. For
    metadata the restored text is that of its values, one a line. Rows of one key come out once; null and empty fields never."""
    hits = evidence(results, key).groupBy(key, "field").agg(F.collect_list(F.struct("token", "original", "chain")).alias("hits"))
    rows = delivered(results, key).select(F.col("k").alias(key), F.col("m").alias("markdown"), F.col("j").alias("metadata")).join(hits, key)
    kind = results.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, m, j, field, h in zip(b[key], b["markdown"], b["metadata"], b["field"], b["hits"]):
                t = restore(dict(field_texts(m, j))[field], [(x["token"], x["original"], x["chain"]) for x in h])
                out.append((k, field, t, len({x["token"] for x in h}), LOST not in t))
            yield pd.DataFrame(out, columns=[key, "field", "restored", "n_tokens", "complete"])

    return rows.mapInPandas(run, f"{key} {kind}, field string, restored string, n_tokens int, complete boolean")


def affected(results: DataFrame, key: str = "result_id") -> DataFrame:
    """(key, field) of the fields with at least one verified form or lost character."""
    return evidence(results, key).select(key, "field").distinct()
