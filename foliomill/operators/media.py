"""Media of documents: order, numbers, kinds, and the joins that find them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import media as M


def numbered(media: DataFrame, doc: str, kind: str, order: list[Column], ext: str, start: Column | None = None) -> DataFrame:
    """Adds number and new_name: media count on within their document and kind, in the given order."""
    n = F.row_number().over(Window.partitionBy(doc, kind).orderBy(*order))
    n = n if start is None else n + start
    return media.withColumn("number", n).withColumn("new_name", M.file_name(F.col(kind), F.col("number"), F.col(ext)))


PRIORITY = {"video": 3, "audio": 2, "image": 1}


def upgraded(media: DataFrame, keys: list[str], kind: str, pos: str) -> DataFrame:
    """One row per key: its first place and its kind of highest rank (video, audio, image, others)."""
    rank = F.coalesce(*(F.when(F.col(kind) == k, v) for k, v in PRIORITY.items()), F.lit(0))
    return media.groupBy(*keys).agg(F.min(pos).alias(pos), F.max_by(kind, F.struct(rank, kind)).alias(kind))


def by_reference(media: DataFrame, refs: DataFrame, keys: list[str], pos: str, name: str) -> DataFrame:
    """Adds place: media in the order of their first reference, those without one last, by name."""
    first = refs.groupBy(*keys).agg(F.min(pos).alias("_first"))
    doc = [k for k in keys if k != name] or [F.lit(1)]
    return media.join(first, keys, "left").withColumn("place", F.row_number().over(Window.partitionBy(*doc).orderBy(F.col("_first").asc_nulls_last(), name))).drop("_first")


def candidates(target: Column, base: str = "word/") -> Column:
    """Paths in the archive that a relationship's target may mean, the likeliest first, each once."""
    t = F.regexp_replace(F.replace(target, F.lit("\\"), F.lit("/")), "^/+", "")
    plain = F.regexp_replace(t, r"^(\.\./)+", "")
    return F.array_distinct(F.array(F.when(t.startswith(base), t).otherwise(F.concat(F.lit(base), plain)), plain, t))


def resolved(rels: DataFrame, media: DataFrame, keys: list[str], base: str = "word/") -> DataFrame:
    """rels (keys, rid, target) with path: the first candidate that is among media (keys, path); null if none is."""
    wide = rels.select("*", F.posexplode(candidates(F.col("target"), base)).alias("_k", "path"))
    hit = wide.join(media.select(*keys, "path").distinct(), [*keys, "path"]).groupBy(*keys, "rid").agg(F.min_by("path", "_k").alias("path"))
    return rels.join(hit, [*keys, "rid"], "left")


def without_previews(media: DataFrame, ext: str, size: str, most: int = 5000) -> DataFrame:
    """Leaves out small wmf and emf files, which are previews of formulas; unknown sizes stay."""
    small = F.regexp_replace(F.lower(F.col(ext)), r"^\.", "").isin("wmf", "emf") & (F.col(size) < most)
    return media.where(~F.coalesce(small, F.lit(False)))


def formula_or_preview(objects: DataFrame, formulas: DataFrame, previews: DataFrame, keys: list[str]) -> DataFrame:
    """Each embedded formula's text: its LaTeX between dollar signs, else its preview picture, else ''."""
    out = objects.join(formulas.select(*keys, "latex"), keys, "left").join(previews.select(*keys, "preview"), keys, "left")
    some = F.nullif(F.trim(F.coalesce("latex", F.lit(""))), F.lit(""))
    return out.withColumn("text", F.coalesce(F.concat(F.lit("$"), some, F.lit("$")), F.concat(F.lit("![formula]("), F.col("preview"), F.lit(")")), F.lit("")))


def list_types(paragraphs: DataFrame, nums: DataFrame, levels: DataFrame) -> DataFrame:
    """paragraphs (doc, num_id, ilvl, ...) with their list's type through nums (doc, num_id, abstract_id) and levels (doc,
    abstract_id, ilvl, type); bullet where either is missing; null without num_id. prefix is the Markdown for it."""
    out = paragraphs.join(nums, ["doc", "num_id"], "left").join(levels, ["doc", "abstract_id", "ilvl"], "left")
    kind = F.when(F.col("num_id").isNotNull(), F.coalesce("type", F.lit("bullet")))
    mark = F.when(kind == "ordered", "1. ").otherwise("- ")
    out = out.withColumn("type", kind).withColumn("prefix", F.when(kind.isNull(), "").otherwise(F.concat(F.repeat(F.lit("  "), F.coalesce("ilvl", F.lit(0))), mark)))
    return out.drop("abstract_id")


def returned_paths(paths: Column, most: Column | int) -> tuple[Column, Column]:
    """(paths, count): the paths if there are at most most of them, else only their number."""
    n = F.size(paths)
    return F.when(n <= most, paths), F.when(n > most, n)
