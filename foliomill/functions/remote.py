"""Remote and embedded media: which addresses may be fetched, and what data: addresses hold."""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .media import KINDS, file_name

# Extension by what a MIME type holds, the first that fits.
MIME = (("svg", "image", ".svg"), ("webm", "video", ".webm"), ("video/ogg", "video", ".ogv"), ("quicktime", "video", ".mov"), ("video", "video", ".mp4"), ("audio/mpeg", "audio", ".mp3"), ("audio/mp3", "audio", ".mp3"), ("audio/ogg", "audio", ".ogg"), ("wav", "audio", ".wav"), ("aac", "audio", ".aac"), ("audio", "audio", ".mp3"), ("png", "image", ".png"), ("jpeg", "image", ".jpg"), ("jpg", "image", ".jpg"), ("gif", "image", ".gif"), ("webp", "image", ".webp"))
DATA = r"!\[([^\]]*)\]\((data:[^)]+)\)"
SMALL_SVG = 10240


def fetchable(url: Column) -> Column:
    """Web addresses with a host; data, fragments and paths are skipped."""
    return F.coalesce(url.rlike(r"^https?://[^/?#\s]+"), F.lit(False))


def public_host(resolve: Callable[[str], list[str]] | None = None):
    """A column function: whether a web address's host is public, that is all its addresses are global. Without resolve only
    hosts that are addresses themselves, and localhost, can be judged; other names then do not count as public."""

    def ok(url: str | None) -> bool:
        from urllib.parse import urlsplit

        try:
            u = urlsplit(url or "")
            host = u.hostname
        except ValueError:
            return False
        if u.scheme not in ("http", "https") or not host or host == "localhost" or host.endswith(".localhost"):
            return False
        try:
            return ipaddress.ip_address(host).is_global
        except ValueError:
            pass
        if resolve is None:
            return False
        try:
            found = resolve(host)
        except OSError:
            return False
        return bool(found) and all(ipaddress.ip_address(a).is_global for a in found)

    @F.pandas_udf("boolean")
    def run(url: pd.Series) -> pd.Series:
        return url.map(ok)

    return run


def first_media(media: DataFrame, doc: str, order: str, most: int = 100) -> DataFrame:
    """The first most different fetchable addresses of each document."""
    one = media.where(fetchable(F.col("src"))).groupBy(doc, "src").agg(F.min(order).alias(order))
    n = F.row_number().over(Window.partitionBy(doc).orderBy(order))
    return one.withColumn("number", n).where(F.col("number") <= most)


def url_extension(url: Column) -> Column:
    """Extension of the address's path if it is one of a medium, else .bin."""
    exts = [e for v in KINDS.values() for e in v if e not in ("emf", "wmf", "wdp")]
    found = F.regexp_extract(F.lower(F.regexp_replace(url, r"[?#].*$", "")), rf"(\.(?:{'|'.join(exts)}))$", 1)
    return F.when(found == "", ".bin").otherwise(found)


def mime_kind(mime: Column) -> tuple[Column, Column]:
    """(kind, extension) of a MIME type; null for others."""
    kind = ext = F
    for key, k, e in MIME:
        hit = F.contains(mime, F.lit(key))
        kind, ext = kind.when(hit, k), ext.when(hit, e)
    return kind, ext


def embedded(docs: DataFrame, doc: str, markdown: str) -> DataFrame:
    """(doc, pos, alt, mime, kind, name, data BINARY) of the pictures, video and audio that a document's Markdown holds as data: addresses.
    Unknown types and small vector icons have a null name: their references are dropped."""
    x = docs.select(doc, F.posexplode(F.arrays_zip(F.regexp_extract_all(markdown, F.lit(DATA), F.lit(1)).alias("alt"), F.regexp_extract_all(markdown, F.lit(DATA), F.lit(2)).alias("url"))).alias("pos", "m"))
    x = x.select(doc, "pos", F.col("m.alt").alias("alt"), F.regexp_extract("m.url", r"^data:([^;]+);base64,", 1).alias("mime"), F.try_to_binary(F.regexp_extract("m.url", r"^data:[^;]+;base64,([A-Za-z0-9+/=]+)", 1), F.lit("base64")).alias("data"))
    kind, ext = mime_kind(F.col("mime"))
    x = x.withColumn("kind", kind).withColumn("_e", ext).withColumn("_keep", F.col("kind").isNotNull() & ~((F.col("_e") == ".svg") & (F.octet_length("data") < SMALL_SVG)))
    n = F.sum(F.col("_keep").cast("int")).over(Window.partitionBy(doc, "kind").orderBy("pos"))
    return x.withColumn("name", F.when(F.col("_keep"), file_name(F.col("kind"), n, F.col("_e")))).drop("_e", "_keep")
