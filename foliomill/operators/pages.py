"""Pages: selection, chunks, statistics, and pictures placed among text blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def selected(spec: Column, total: Column) -> Column:
    """Ascending pages of a range such as '1-3, 5, 2-2': reversed ranges are turned, pages beyond 1 .. total dropped, each page
    once. A null or blank range is all pages. Null without total."""
    spec = F.regexp_replace(F.coalesce(spec, F.lit("")), r"\s", "")
    parts = F.filter(F.split(spec, ","), lambda x: x.rlike("^[0-9]+(-[0-9]+)?$"))

    def bounds(x: Column) -> Column:
        ends = F.transform(F.split(x, "-"), lambda y: F.least(y.cast("decimal(38,0)"), F.lit(2_000_000_000)).cast("int"))
        low, high = F.array_min(ends), F.array_max(ends)
        return F.when((F.greatest(low, F.lit(1)) <= F.least(high, total)), F.sequence(F.greatest(low, F.lit(1)), F.least(high, total))).otherwise(F.array().cast("array<int>"))

    every = F.when(total >= 1, F.sequence(F.lit(1), total)).otherwise(F.array().cast("array<int>"))
    return F.when(total.isNull(), F.lit(None)).when(spec == "", every).otherwise(F.array_sort(F.array_distinct(F.flatten(F.transform(parts, bounds)))))


def chunks(df: DataFrame, total: str, name: str, size: int) -> DataFrame:
    """One row per chunk of size pages of each document with more pages than that: chunk_index from 1, start_page and end_page,
    both included, and chunk_name. Documents that fit, or of unknown length, give none."""
    n = F.ceil(F.col(total) / size).cast("int")
    out = df.where(F.col(total) > size).withColumn("chunk_index", F.explode(F.sequence(F.lit(1), n)))
    stem = F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")
    return out.withColumn("start_page", (F.col("chunk_index") - 1) * size + 1).withColumn("end_page", F.least(F.col("chunk_index") * size, F.col(total))).withColumn("chunk_name", F.concat(stem, F.lit("_chunk_"), F.lpad(F.col("chunk_index").cast("string"), 3, "0"), F.lit(".pdf")))


def statistics(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Per key: pages, pages without text, characters, and characters but white space. df has one row per page."""
    plain = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s", "")
    return df.groupBy(*keys).agg(F.count("*").alias("pages"), F.count(F.when(plain == "", 1)).alias("empty_pages"), F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("chars"), F.sum(F.length(plain)).alias("non_blank"))


def placed(images: DataFrame, doc: str = "source_id") -> DataFrame:
    """Pictures in reading order: of each xref of a page the first box, sorted by page, row (y0 in steps of 5, half to even), x0.
    number counts a document's pictures on over its pages, before the sort, by page, xref. Boxes that are null in y0 or x0
    are left out; boxes turned inside out are turned back."""
    ok = images.where("y0 IS NOT NULL AND x0 IS NOT NULL")
    ok = ok.withColumn("top", F.least("y0", F.coalesce("y1", "y0"))).withColumn("left", F.least("x0", F.coalesce("x1", "x0")))
    first = Window.partitionBy(doc, "page", "xref").orderBy("top", "left", F.coalesce("ext", F.lit("")))
    one = ok.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    one = one.withColumn("number", F.row_number().over(Window.partitionBy(doc).orderBy("page", "xref")))
    visual = Window.partitionBy(doc, "page").orderBy(F.bround(F.col("top") / 5), "left", "xref")
    return one.withColumn("place", F.row_number().over(visual))


def interleaved(blocks: DataFrame, images: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, xref, before): for each picture the number of the first block in reading order that begins below it; null puts it
    after the last block. Blocks have block_no and y0, pictures xref and top. Pages are small, so that their blocks travel
    as one array per page and no pair is made."""
    arrays = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block_no", "y0"))).alias("_b"))
    out = images.join(arrays, keys, "left")
    return out.withColumn("before", F.get(F.filter("_b", lambda b: b["y0"] > F.col("top")), F.lit(0))["block_no"]).drop("_b")


def assembled(pages: DataFrame, doc: str, title: str, offset: int = 0) -> DataFrame:
    """One Markdown text per document of page rows (doc, title, page, text): a heading block, then each page under its number;
    pages without text as a comment."""
    body = F.when(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s", "") == "", F.concat(F.lit("<!-- page "), (F.col("page") + offset).cast("string"), F.lit(" is empty -->"))).otherwise(F.col("text"))
    one = F.struct(F.col("page"), F.concat(F.lit("## Page "), (F.col("page") + offset).cast("string"), F.lit("\n\n"), body).alias("md"))
    out = pages.groupBy(doc).agg(F.min(title).alias("_title"), F.array_sort(F.collect_list(one)).alias("_p"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("_chars"))
    head = F.concat(F.lit("# PDF 本地提取结果\n\n源文件: "), F.coalesce("_title", F.lit("")), F.lit("\n提取页: "), F.size("_p").cast("string"), F.lit("\n字符总数: "), F.col("_chars").cast("string"), F.lit("\n\n"))
    return out.select(doc, F.concat(head, F.array_join(F.transform("_p", lambda x: x["md"]), "\n\n")).alias("markdown"))
