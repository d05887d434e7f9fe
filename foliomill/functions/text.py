"""Column functions for text and Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
RARE_HAN = r"[\x{20000}-\x{2FA1F}\x{30000}-\x{323AF}]"
FOUNDER_HAN = r"[\x{7280}-\x{72FF}]"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def matches(c: Column, pattern: str) -> Column:
    """Number of code points that the pattern of single characters matches."""
    return F.length(c) - F.length(F.regexp_replace(c, pattern, ""))


def garble_counts(c: Column) -> dict[str, Column]:
    """founder: characters where one maker's fonts misplace Latin letters; rare: characters beyond the usual planes; total: all
    but white space."""
    c = F.coalesce(c, F.lit(""))
    return {"founder": matches(c, FOUNDER_HAN), "rare": matches(c, RARE_HAN), "total": F.length(F.regexp_replace(c, SPACE, ""))}


def garble_warning(founder: Column, rare: Column, total: Column, least: float = 0.005) -> Column:
    """'founder', 'rare' or null: which kind reaches the share; the first wins."""
    return F.when((total > 0) & (founder / total >= least), "founder").when((total > 0) & (rare / total >= least), "rare")


def word_count(markdown: Column) -> Column:
    """Words between white space once Markdown's signs are taken out."""
    return F.regexp_count(F.translate(markdown, "#*`_[](){}|>!-", ""), F.lit(SPACE.replace("[", "[^", 1) + "+"))


def strip_data_images(markdown: Column) -> Column:
    """Pictures held as data: addresses become [图片] in Markdown and vanish as tags; three or more line ends become two."""
    t = F.regexp_replace(markdown, r"!\[([^\]]*)\]\((data:[^)]+)\)", "[图片]")
    return F.regexp_replace(F.regexp_replace(t, r'(?i)<img[^>]*\bsrc="(data:[^"]+)"[^>]*>', ""), r"\n{3,}", "\n\n")


def strip_image_tags(markdown: Column) -> Column:
    """As strip_data_images, but every img tag vanishes. Video and audio stay."""
    t = F.regexp_replace(markdown, r"!\[([^\]]*)\]\((data:[^)]+)\)", "[图片]")
    return F.regexp_replace(F.regexp_replace(t, r"(?i)<img\b[^>]*>", ""), r"\n{3,}", "\n\n")


def redact(text: Column, secrets: Column) -> Column:
    """Every occurrence of each non-empty secret as [REDACTED], in the array's order."""
    return F.aggregate(F.filter(secrets, lambda s: s.isNotNull() & (s != "")), text, lambda acc, s: F.replace(acc, s, F.lit("[REDACTED]")))


def mask(key: Column) -> Column:
    """*** for keys of fewer than 8 characters, else the first and last four."""
    return F.when(F.coalesce(F.length(key), F.lit(0)) < 8, "***").otherwise(F.concat(F.substring(key, 1, 4), F.lit("..."), F.right(key, F.lit(4))))


def rewrite_media(markdown: Column, local: Column, stem: Column) -> Column:
    """Media addresses of a service (the map's keys) as {stem}_media/{last part of the local path}, blanks encoded: in src
    attributes and in Markdown references, whose titles stay."""
    def one(acc: Column, e: Column) -> Column:
        rel = F.replace(F.concat(stem, F.lit("_media/"), F.element_at(F.split(e["value"], "/"), -1)), F.lit(" "), F.lit("%20"))
        quoted = F.concat(F.lit("\\Q"), F.replace(e["key"], F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        safe = F.replace(F.replace(rel, F.lit("\\"), F.lit("\\\\")), F.lit("$"), F.lit("\\$"))
        acc = F.replace(acc, F.concat(F.lit('src="'), e["key"], F.lit('"')), F.concat(F.lit('src="'), rel, F.lit('"')))
        acc = F.regexp_replace(acc, F.concat(F.lit(r"\]\(\s*"), quoted, F.lit(r"""\s+["']([^"']*)["']\s*\)""")), F.concat(F.lit("]("), safe, F.lit(' "$1")')))
        return F.regexp_replace(acc, F.concat(F.lit(r"\]\(\s*"), quoted, F.lit(r"\s*\)")), F.concat(F.lit("]("), safe, F.lit(")")))

    return F.aggregate(F.map_entries(local), markdown, one)


def display_source(source: Column) -> Column:
    return F.when(source.rlike("^https?://"), "<remote-url>").otherwise(F.element_at(F.split(source, "/"), -1))


def safe_stem(source: Column) -> Column:
    """Name for files made from a source: a web address's host with _ for dots, or the file's stem, 50 characters at most,
    without signs that file systems refuse."""
    host = F.replace(F.regexp_extract(source, r"^https?://(?:[^/?#@]*@)?([^/?#]*)", 1), F.lit("."), F.lit("_"))
    stem = F.regexp_replace(F.element_at(F.split(source, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return F.substring(F.regexp_replace(F.when(source.rlike("^https?://"), host).otherwise(stem), r'[<>:"/\\|?*]', "_"), 1, 50)


def language_code(lang: Column) -> Column:
    """ch for the usual names of Chinese, others as they are."""
    return F.when(F.lower(lang).isin("zh", "zh-cn", "zh-hans", "chinese"), "ch").otherwise(lang)


def clean_latex(c: Column) -> Column:
    """Single blanks, none at the ends, no dollar signs around."""
    return F.regexp_replace(strip(F.regexp_replace(c, r"\s+", " ")), r"^\$+|\$+$", "")


def restore_heading(markdown: Column, original: Column, converted: Column) -> Column:
    """A leading '# converted' as '# original'."""
    head = F.concat(F.lit("# "), converted)
    return F.when(F.startswith(markdown, head), F.concat(F.lit("# "), original, F.substr(markdown, F.length(head) + 1))).otherwise(markdown)


def frontmatter(metadata: Column) -> Column:
    """A map as lines between ---; values with YAML's signs are quoted. '' for an empty map."""
    special = r"[:#{}\[\],&*?|<>=!%@`-]"
    line = lambda e: F.concat(e["key"], F.lit(": "), F.when(e["value"].rlike(special), F.concat(F.lit('"'), e["value"], F.lit('"'))).otherwise(e["value"]))
    body = F.array_join(F.transform(F.map_entries(metadata), line), "\n")
    return F.when(F.size(metadata) > 0, F.concat(F.lit("---\n"), body, F.lit("\n---\n\n"))).otherwise("")


def table(rows: Column) -> Column:
    """A Markdown table of ARRAY<ARRAY<STRING>>: padded to the widest row, bars escaped, line ends as blanks, the first row as
    head. '' without rows."""
    width = F.array_max(F.transform(rows, lambda r: F.size(r)))
    cell = lambda x: F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    lines = F.transform(rows, line)
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))), "\n")).otherwise("")


def prefix(text: Column, most: int) -> Column:
    """The longest start of a text that fits in most UTF-8 bytes. A cut inside a character steps back over up to three
    continuation bytes."""
    raw = F.encode(text, "UTF-8")

    def inside(k: int) -> Column:
        b = F.conv(F.hex(F.substring(raw, k, 1)), 16, 10).cast("int")
        return (b >= 128) & (b < 192)

    end = F.when(~inside(most + 1), most).when(~inside(most), most - 1).when(~inside(most - 1), most - 2).otherwise(most - 3)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substring(raw, F.lit(1), end), "UTF-8"))


def longest_overlap(tail: Column, head: Column, window: int = 100, least: int = 11) -> Column:
    """Length of the longest end of tail (its last window characters) that head (its first) begins with, least at least; else 0."""
    t, h = F.right(tail, F.lit(window)), F.left(head, F.lit(window))
    sizes = F.filter(F.sequence(F.lit(window), F.lit(least), F.lit(-1)), lambda n: (n <= F.length(t)) & (n <= F.length(h)) & (F.right(t, n) == F.left(h, n)))
    # Without head's first least characters in tail there is nothing to try.
    return F.when(F.contains(t, F.left(h, F.lit(least))), F.coalesce(F.get(sizes, F.lit(0)), F.lit(0))).otherwise(0)


def merge_overlapping(parts: Column, window: int = 100, least: int = 11) -> Column:
    """Parts in order as one text: where a part repeats the end of what came before, the repetition is dropped from the
    former and the part follows directly; else a blank line stands between."""
    def step(acc: Column, part: Column) -> Column:
        n = longest_overlap(acc, part, window, least)
        return F.when(acc == "", part).when(n > 0, F.concat(F.left(acc, F.length(acc) - n), part)).otherwise(F.concat(acc, F.lit("\n\n"), part))

    return F.aggregate(F.filter(parts, lambda p: F.coalesce(p, F.lit("")) != ""), F.lit(""), step)
