"""What is handed back: statuses, paths, summaries, merged chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SEPARATOR = "\n\n---\n\n"


def merged_chunks(rows: DataFrame, key: str, order: str, text: str, backend: str | None = None) -> DataFrame:
    """(key, markdown, used_backends): a document's chunks in order, blank ones left out, and the backends used, each once."""
    some = F.when(T.strip(F.coalesce(F.col(text), F.lit(""))) != "", F.struct(F.col(order), F.col(text).alias("md")))
    aggs = [F.array_join(F.transform(F.array_sort(F.collect_list(some)), lambda x: x["md"]), SEPARATOR).alias("markdown")]
    if backend:
        aggs.append(F.array_sort(F.collect_set(backend)).alias("used_backends"))
    return rows.groupBy(key).agg(*aggs)


def overlap_merged(rows: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, markdown): parts in order, with what one part repeats of the end of the text before it taken out."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(text).alias("md")))), lambda x: x["md"])
    return rows.groupBy(key).agg(parts.alias("_p")).select(key, T.merge_overlapping(F.col("_p")).alias("markdown"))


def absolute_media(paths: Column, media_dir: Column) -> Column:
    """Absolute paths as they are, others put into media_dir by their last part; blank ones, and relative ones without a folder,
    are dropped."""
    some = F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.trim(F.coalesce(p, F.lit(""))) != "")
    full = F.transform(some, lambda p: F.when(p.startswith("/"), p).otherwise(F.concat(media_dir, F.lit("/"), F.element_at(F.split(p, "/"), -1))))
    return F.filter(full, lambda p: p.isNotNull())


def media_folder(given: Column, paths: Column, md_path: Column, output_dir: Column, source: Column) -> Column:
    """A result's media folder: the one given, that of the first absolute path, or derived from the Markdown file's or the
    source's name. The derived ones only if there are media."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    first = F.regexp_extract(F.get(F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda p: p.startswith("/")), F.lit(0)), "^(.*)/[^/]*$", 1)
    stem = lambda c: F.regexp_replace(F.regexp_replace(F.element_at(F.split(c, "/"), -1), r"\.md$", ""), r"(?<=.)\.[^.]*$", "")
    from_md = F.concat(F.regexp_extract(blank(md_path), "^(.*)/[^/]*$", 1), F.lit("/"), stem(md_path), F.lit("_media"))
    from_out = F.concat(blank(output_dir), F.lit("/"), stem(source), F.lit("_media"))
    some = F.size(F.coalesce(paths, F.array().cast("array<string>"))) > 0
    return F.coalesce(blank(given), blank(first), F.when(some, F.coalesce(from_md, from_out)))


def status(ok: Column, save_status: Column, conversion_status: Column) -> Column:
    """failed if extraction, saving or conversion failed; warnings do not fail a file."""
    bad = lambda c: F.coalesce(c == "failed", F.lit(False))
    return F.when(~F.coalesce(ok, F.lit(False)) | bad(save_status) | bad(conversion_status), "failed").otherwise("success")


def summary_line(name: Column, state: Column, error: Column) -> Column:
    return F.when(state == "success", F.concat(F.lit("✅ "), name)).otherwise(F.concat(F.lit("❌ "), name, F.lit(" — "), F.coalesce(error, F.lit("解析失败"))))


def batch_summary(rows: DataFrame, key: str, state: str = "status") -> DataFrame:
    """Per batch: files, successes and failures, and the sentence for it."""
    out = rows.groupBy(key).agg(F.count("*").alias("files"), F.count(F.when(F.col(state) == "success", 1)).alias("success"), F.count(F.when(F.col(state) != "success", 1)).alias("failed"))
    return out.withColumn("summary", F.concat(F.lit("处理完成："), F.col("success").cast("string"), F.lit("/"), F.col("files").cast("string"), F.lit(" 个文件成功")))


def return_mode(text: Column, saved: Column, summary_only: Column, block_bytes: int, block_count: int, complete: Column | None = None) -> Column:
    """summary if asked for; full if the text fits; saved_summary if files were saved; else truncated."""
    fits = F.octet_length(F.coalesce(text, F.lit(""))) <= block_bytes * block_count if complete is None else complete
    return F.when(summary_only, "summary").when(fits, "full").when(saved, "saved_summary").otherwise("truncated")


def output_folder(explicit: Column, auto_save: Column, auto_path: Column, summary_only: Column, summary_path: Column) -> Column:
    """The folder asked for, else that of automatic saving, else that of summaries, else null."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    return F.coalesce(blank(explicit), F.when(auto_save, blank(auto_path)), F.when(summary_only, blank(summary_path)))


def saved_json(markdown: Column, fields: dict[str, Column], stem: Column, media: Column) -> Column:
    """The JSON text that is kept beside the Markdown: content, and metadata with media paths relative to the file."""
    from ..functions.media import relative

    paths = F.transform(F.coalesce(media, F.array().cast("array<string>")), lambda p: relative(stem, p))
    return F.to_json(F.struct(markdown.alias("content"), F.struct(*(c.alias(k) for k, c in fields.items()), paths.alias("mediaPaths")).alias("metadata")))


def agent_text(markdown: Column, guide: Column, paths: Column, warnings: Column) -> Column:
    """Markdown, the guide to its media, their paths, and the warnings as a list."""
    warned = F.when(F.size(warnings) > 0, F.concat(F.lit("\n\n⚠️ 警告:\n"), F.array_join(F.transform(warnings, lambda w: F.concat(F.lit("- "), w)), "\n"))).otherwise("")
    return F.concat(F.coalesce(markdown, F.lit("")), guide, F.when(F.size(paths) > 0, F.concat(F.lit("\n媒体路径: "), F.array_join(paths, ", "))).otherwise(""), warned)


def readable(rows: DataFrame, key: str, order: str, name: str, text: str) -> DataFrame:
    """(key, text): a single file's Markdown as it is, several under their names."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n"), F.coalesce(F.col(text), F.lit("")).alias("t"))))
    many = F.array_join(F.transform("_p", lambda x: F.concat(F.lit("## "), x["n"], F.lit("\n\n"), x["t"])), "\n\n")
    return rows.groupBy(key).agg(parts.alias("_p")).select(key, F.when(F.size("_p") == 1, F.col("_p")[0]["t"]).otherwise(many).alias("text"))


def path_block(name: Column, state: Column, error: Column, fields: dict[str, Column]) -> Column:
    """One file's paths as JSON; keys without a value are left out."""
    return F.to_json(F.struct(name.alias("name"), state.alias("status"), error.alias("error"), *(c.alias(k) for k, c in fields.items())))


def error_envelope(name: Column, message: Column, code: Column, causes: Column) -> Column:
    """An error and its causes, the nearest first, as JSON."""
    return F.to_json(F.struct(F.lit(False).alias("ok"), F.struct(name.alias("name"), message.alias("message"), code.alias("code"), causes.alias("causes")).alias("error")))


def unresolved(paths: Column, found: Column) -> Column:
    """How many media have no usable path: those given, blank ones aside, less those found."""
    some = F.filter(F.coalesce(paths, F.array().cast("array<string>")), lambda p: F.trim(F.coalesce(p, F.lit(""))) != "")
    return F.greatest(F.size(some) - F.size(found), F.lit(0))
