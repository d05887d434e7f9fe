"""Column functions for media: kinds by extension, file names, references in Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions by kind.
KINDS = {
    "image": ("png", "jpg", "jpeg", "gif", "bmp", "webp", "tif", "tiff", "svg", "emf", "wmf", "wdp"),
    "video": ("mp4", "mov", "webm", "m4v", "avi", "wmv"),
    "audio": ("mp3", "wav", "m4a", "ogg", "flac", "aac"),
}
# File types by extension.
FILE_TYPES = {
    "pdf": ("pdf",), "image": ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp", "gif"), "docx": ("docx",), "doc": ("doc",),
    "pptx": ("pptx",), "ppt": ("ppt",), "xlsx": ("xlsx",), "xls": ("xls",), "xlsm": ("xlsm",), "html": ("html", "htm"),
}


def _pick(value: Column, table: dict[str, tuple[str, ...]], other: str) -> Column:
    out = F
    for k, (name, members) in enumerate(table.items()):
        out = (F if k == 0 else out).when(value.isin(*members), name)
    return out.otherwise(other)


def suffix(path: Column) -> Column:
    """Extension in lower case without its dot, of the last part of a path; '' if there is none. A leading dot opens no extension."""
    return F.lower(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"^.+\.([^.]*)$", 1))


def classify(ext: Column) -> Column:
    """image, video, audio or other, by an extension with or without dot. Null and blank are other."""
    return _pick(F.regexp_replace(F.lower(F.trim(F.coalesce(ext, F.lit("")))), r"^\.", ""), KINDS, "other")


def file_type(source: Column) -> Column:
    """Type of a source: web addresses are html, files go by extension, others are unknown."""
    return F.when(source.rlike("^https?://"), "html").otherwise(_pick(suffix(F.coalesce(source, F.lit(""))), FILE_TYPES, "unknown"))


def coarse_type(source: Column) -> Column:
    """pdf, image, office, html or unknown."""
    t = file_type(source)
    return F.when(t.isin("docx", "doc", "pptx", "ppt", "xlsx", "xls", "xlsm"), "office").otherwise(t)


def supported(source: Column) -> Column:
    return file_type(F.regexp_replace(source, "^https?://", "")) != "unknown"


def file_name(kind: Column, number: Column, ext: Column) -> Column:
    """image_001.png and so on; kinds that cannot be shown are media_..."""
    e = F.lower(F.trim(F.coalesce(ext, F.lit(""))))
    e = F.when((e == "") | e.startswith("."), e).otherwise(F.concat(F.lit("."), e))
    prefix = F.when(kind.isin("image", "video", "audio"), kind).otherwise("media")
    return F.concat(prefix, F.lit("_"), F.when(number < 1000, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")), e)


def encoded(path: Column) -> Column:
    """Blanks of a path as %20; nothing else is encoded."""
    return F.replace(path, F.lit(" "), F.lit("%20"))


def reference(path: Column, kind: Column, alt: Column) -> Column:
    """How a medium is shown in Markdown: pictures as such, video and audio as tags whose title escapes double quotes."""
    alt = F.coalesce(alt, F.lit(""))
    title = F.trim(F.replace(alt, F.lit('"'), F.lit("&quot;")))
    title = F.when(title == "", "").otherwise(F.concat(F.lit(' title="'), title, F.lit('"')))
    tag = F.concat(F.lit("<"), kind, F.lit(' controls src="'), encoded(path), F.lit('"'), title, F.lit("></"), kind, F.lit(">"))
    return F.when(kind.isin("video", "audio"), tag).otherwise(F.concat(F.lit("!["), alt, F.lit("]("), encoded(path), F.lit(")")))


def relative(stem: Column, name: Column) -> Column:
    """{stem}_media/{last part of the path}."""
    return F.concat(stem, F.lit("_media/"), F.element_at(F.split(name, "/"), -1))


def guide(counts: dict[str, Column], saved: Column) -> Column:
    """The sentence that asks to read the media first; '' without media. counts: number by kind."""
    icon = {"image": "📷", "video": "🎬", "audio": "🎵", "other": "📎"}
    label = {"image": "图片", "video": "视频", "audio": "音频", "other": "媒体"}
    parts = F.filter(F.array(*(F.when(counts[k] > 0, F.concat(F.lit(icon[k] + " "), counts[k].cast("string"), F.lit(" " + label[k]))) for k in icon)), lambda x: x.isNotNull())
    total = sum((counts[k] for k in icon), F.lit(0))
    detail = F.when(F.size(parts) > 1, F.concat(F.lit("（"), F.array_join(parts, "、"), F.lit("）"))).otherwise("")
    text = F.concat(F.lit("\n\n---\n\n📎 提取了 "), total.cast("string"), F.lit(" 个媒体文件"), detail, F.when(saved, "，已保存到本地").otherwise(""), F.lit("。请先阅读以上媒体，再结合文档内容回复。"))
    return F.when(total > 0, text).otherwise("")
