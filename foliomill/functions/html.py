"""Column functions for HTML. Patterns are those by which the pages' parts are defined; no HTML is repaired."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .media import classify, suffix
from .text import strip

LINK = r"""(?is)<a\s+[^>]*href=["']([^"']+)["'][^>]*>(.*?)</a>"""
HEADING = r"(?is)<(h[1-6])[^>]*>(.*?)</\1>"
CODE = r'(?is)<pre[^>]*>\s*<code[^>]*(?:class="([^"]*)")?[^>]*>(.*?)</code>\s*</pre>'


def _all(html: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(html, F.lit(pattern), F.lit(group))


def untagged(c: Column) -> Column:
    return strip(F.regexp_replace(c, "<[^>]+>", ""))


def title(html: Column) -> Column:
    """Body of the first title; null without one."""
    pattern = r"(?is)<title[^>]*>(.*?)</title>"
    return F.when(html.rlike(pattern), strip(F.regexp_extract(html, pattern, 1)))


def _named(html: Column, attribute: str, name: str) -> Column:
    pattern = rf'(?i)<meta\s+(?:{attribute}="\Q{name}\E"[^>]*content="([^"]*)"|content="([^"]*)"[^>]*{attribute}="\Q{name}\E")'
    return F.coalesce(*(F.nullif(F.regexp_extract(html, pattern, k), F.lit("")) for k in (1, 2)))


def meta(html: Column, name: str) -> Column:
    """content of the meta tag of that name, on either side of it; null if absent or empty."""
    return _named(html, "name", name)


def og(html: Column, name: str) -> Column:
    return _named(html, "property", name)


def canonical(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'(?i)<link\s+rel="canonical"\s+href="([^"]*)"', 1), F.lit(""))


def metadata(html: Column) -> dict[str, Column]:
    """Title and description, '' if absent; author, keywords, cover and canonical address, null if absent."""
    empty = F.lit("")
    return {
        "标题": F.coalesce(og(html, "og:title"), F.nullif(title(html), empty), empty),
        "描述": F.coalesce(og(html, "og:description"), meta(html, "description"), empty),
        "作者": meta(html, "author"),
        "关键词": meta(html, "keywords"),
        "封面图": og(html, "og:image"),
        "原始链接": canonical(html),
    }


def links(html: Column) -> Column:
    """ARRAY<STRUCT<url, text>> in order; addresses within the page and scripts are left out."""
    pairs = F.arrays_zip(_all(html, LINK, 1).alias("url"), _all(html, LINK, 2).alias("text"))
    pairs = F.transform(pairs, lambda x: F.struct(x["url"].alias("url"), untagged(x["text"]).alias("text")))
    return F.filter(pairs, lambda x: ~x["url"].startswith("#") & ~x["url"].startswith("javascript:"))


def headings(html: Column) -> Column:
    """ARRAY<STRUCT<level, text>> of headings with text."""
    pairs = F.arrays_zip(_all(html, HEADING, 1).alias("tag"), _all(html, HEADING, 2).alias("text"))
    pairs = F.transform(pairs, lambda x: F.struct(F.substring(x["tag"], 2, 1).cast("int").alias("level"), untagged(x["text"]).alias("text")))
    return F.filter(pairs, lambda x: x["text"] != "")


def code_blocks(html: Column) -> Column:
    """ARRAY<STRUCT<language, code>> with entities resolved: lt, gt, amp, quot in that order. The pattern's greedy part takes the
    class, so language is always ''."""
    def plain(c: Column) -> Column:
        for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"')):
            c = F.replace(c, F.lit(entity), F.lit(sign))
        return strip(c)

    return F.transform(_all(html, CODE, 2), lambda x: F.struct(F.lit("").alias("language"), plain(x).alias("code")))


def _path_kind(src: Column) -> Column:
    return classify(suffix(F.regexp_replace(F.regexp_replace(src, r"[?#].*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?", "")))


def media(html: Column) -> Column:
    """ARRAY<STRUCT<src, kind, tag, poster>>: pictures, then video, then audio; of equal addresses the first. Video and audio without
    an address of their own take that of their first source. Kinds go by extension, else by tag; pictures of unknown
    extension are other."""
    src = lambda tag: rf"""(?is)<{tag}\b[^>]*\bsrc=["']([^"']+)["']"""
    first = lambda x, p: F.nullif(F.regexp_extract(x, p, 1), F.lit(""))
    item = lambda s, kind, tag, poster: F.struct(s.alias("src"), kind.alias("kind"), F.lit(tag).alias("tag"), F.coalesce(poster, F.lit("")).alias("poster"))
    images = F.transform(_all(html, r"""(?i)<img\b[^>]*\bsrc=["']([^"']+)["'][^>]*>""", 1), lambda s: item(s, _path_kind(s), "img", F.lit("")))

    def tags(tag: str) -> Column:
        whole = _all(html, rf"(?is)<{tag}\b[^>]*>(?:.*?)</{tag}>", 0)
        def one(x: Column) -> Column:
            s = F.coalesce(first(x, src(tag)), first(x, src("source")))
            kind = _path_kind(s)
            poster = first(x, r"""(?i)\bposter=["']([^"']+)["']""") if tag == "video" else F.lit("")
            return item(s, F.when(kind == "other", tag).otherwise(kind), tag, poster)

        return F.filter(F.transform(whole, one), lambda x: x["src"].isNotNull())

    every = F.concat(images, tags("video"), tags("audio"))
    none = F.expr("cast(array() as array<struct<src: string, kind: string, tag: string, poster: string>>)")
    return F.aggregate(every, none, lambda acc, x: F.when(F.exists(acc, lambda y: y["src"] == x["src"]), acc).otherwise(F.array_append(acc, x)))


def statistics(html: Column, words: Column) -> dict[str, Column]:
    """Figures of a page: words, headings, links, media and code blocks."""
    return {"字数": words, "标题数": F.size(headings(html)), "链接数": F.size(links(html)), "媒体数": F.size(media(html)), "代码块数": F.size(code_blocks(html))}


def substitute_sources(markdown: Column, local: Column) -> Column:
    """Addresses of media (the map's keys) as the last part of their local path, in tags and in Markdown."""
    def one(acc: Column, e: Column) -> Column:
        name = F.element_at(F.split(e["value"], "/"), -1)
        acc = F.replace(acc, F.concat(F.lit('src="'), e["key"], F.lit('"')), F.concat(F.lit('src="'), name, F.lit('"')))
        return F.replace(acc, F.concat(F.lit("]("), e["key"], F.lit(")")), F.concat(F.lit("]("), name, F.lit(")")))

    return F.aggregate(F.map_entries(local), markdown, one)


def restore_players(markdown: Column) -> Column:
    """Links to video and audio files as players, outside code. Of .ogg the video list has the say. An empty text, or one that
    is the address, becomes the file's stem."""
    video = r"\[([^\]]*)\]\((https?://[^)\s]+\.(?:mp4|mov|webm|m4v|avi|wmv|ogg))\)"
    audio = r"\[([^\]]*)\]\((https?://[^)\s]+\.(?:mp3|wav|m4a|flac|aac))\)"

    def players(t: Column) -> Column:
        for pattern, tag in ((video, "video"), (audio, "audio")):
            t = F.regexp_replace(t, r"(?i)(?<!!)" + pattern, f'<{tag} controls src="$2" title="$1"></{tag}>')
        t = F.regexp_replace(t, r'src="([^"]*/([^"/]+)\.\w+)" title="(?:\1)?"', 'src="$1" title="$2"')
        return t

    # Code spans and fences are every second part.
    code = _all(markdown, r"(?s)```.*?```|`[^`\n]*`", 0)
    rest = F.split(F.regexp_replace(markdown, r"(?s)```.*?```|`[^`\n]*`", "\x00"), "\x00")
    return F.array_join(F.transform(rest, lambda t, k: F.concat(players(t), F.coalesce(F.get(code, k), F.lit("")))), "")
