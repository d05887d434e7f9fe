"""Spreadsheets: sparse cells to Markdown tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import table

KEYS = ["doc", "sheet"]
ICON = {"image": "📷", "video": "🎬", "audio": "🎵"}


def resolved(cells: DataFrame, strings: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """Cells (doc, sheet, row, col, type, value, is_formula) with their text. Cells of type s take the shared string (doc, idx,
    text) of their number, or keep the number where there is none. overrides (doc, sheet, row, col, text) hold for numbers
    that no formula gives."""
    out = cells.withColumn("_i", F.when(F.col("type") == "s", F.expr("try_cast(value as int)")))
    s = strings.select(F.col("doc"), F.col("idx").alias("_i"), F.col("text").alias("_s"))
    out = out.join(s, ["doc", "_i"], "left").withColumn("text", F.when(F.col("type") == "s", F.coalesce("_s", "value")).otherwise(F.col("value"))).drop("_i", "_s")
    if overrides is not None:
        o = overrides.select("doc", "sheet", "row", "col", F.col("text").alias("_o"))
        out = out.join(o, ["doc", "sheet", "row", "col"], "left")
        out = out.withColumn("text", F.when(F.coalesce("is_formula", F.lit(False)) | (F.coalesce("type", F.lit("n")) != "n"), F.col("text")).otherwise(F.coalesce("_o", "text"))).drop("_o")
    return out


def anchored(cells: DataFrame, anchors: DataFrame) -> DataFrame:
    """Media references appended to their cells. anchors: (doc, sheet, row, col, kind, path). A place without a cell gets one."""
    icon = F.coalesce(*(F.when(F.col("kind") == k, v) for k, v in ICON.items()), F.lit("📎"))
    refs = anchors.groupBy("doc", "sheet", "row", "col").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", icon.alias("icon")))), lambda x: F.concat(F.lit("["), x["icon"], F.lit("]("), x["path"], F.lit(")"))), " ").alias("_refs"))
    out = cells.join(refs, ["doc", "sheet", "row", "col"], "full")
    return out.withColumn("text", F.concat_ws(" ", F.nullif("text", F.lit("")), "_refs")).drop("_refs")


def sheet_tables(cells: DataFrame, max_rows: int = 100, max_cols: int = 50) -> DataFrame:
    """(doc, sheet, markdown, rows_cut, cols_cut) of each sheet with content, from cells (doc, sheet, row, col, text).

    Cells without text do not count. Limits of 0 mean none. Rows between are kept empty, so that a row's number is its place. A
    sheet whose content lies wholly beyond the limits keeps its heading and a note.
    """
    if max_rows < 0 or max_cols < 0:
        raise ValueError("a limit must not be negative")
    some = cells.where(F.coalesce("text", F.lit("")) != "")
    extent = some.groupBy(*KEYS).agg(F.max("row").alias("rows"), F.max("col").alias("cols"))
    kept = some.where(((F.lit(max_rows) == 0) | (F.col("row") <= max_rows)) & ((F.lit(max_cols) == 0) | (F.col("col") <= max_cols)))
    width = kept.groupBy(*KEYS).agg(F.max("row").alias("h"), F.max("col").alias("w"))
    lines = kept.groupBy(*KEYS, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("m"))
    lines = lines.join(width, KEYS).select(*KEYS, "row", "h", F.transform(F.sequence(F.lit(1), "w"), lambda c: F.coalesce(F.col("m")[c], F.lit(""))).alias("line"))
    grid = lines.groupBy(*KEYS).agg(F.max("h").alias("h"), F.map_from_entries(F.collect_list(F.struct("row", "line"))).alias("m"))
    grid = grid.select(*KEYS, table(F.transform(F.sequence(F.lit(1), "h"), lambda r: F.coalesce(F.col("m")[r], F.array(F.lit(""))))).alias("table"))
    cut_rows, cut_cols = (F.lit(max_rows) > 0) & (F.col("rows") > max_rows), (F.lit(max_cols) > 0) & (F.col("cols") > max_cols)
    out = extent.join(grid, KEYS, "left").withColumn("rows_cut", cut_rows).withColumn("cols_cut", cut_cols)
    note = F.concat_ws("\n", F.when(F.col("rows_cut"), f"*已截断到 {max_rows} 行*"), F.when(F.col("cols_cut"), f"*已截断到 {max_cols} 列*"))
    body = F.concat(F.lit("## Sheet: "), F.col("sheet"), F.lit("\n\n"), F.coalesce("table", F.lit("*未保留内容*")), F.when(note != "", F.concat(F.lit("\n\n"), note)).otherwise(""))
    return out.select(*KEYS, body.alias("markdown"), "rows_cut", "cols_cut")


def unanchored(media: DataFrame, anchors: DataFrame) -> DataFrame:
    """Media (doc, path, ...) that no cell holds."""
    return media.join(anchors.select("doc", "path").distinct(), ["doc", "path"], "left_anti")


def workbook(sheets: DataFrame, order: DataFrame, rest: DataFrame | None = None) -> DataFrame:
    """(doc, markdown): sheet texts in the workbook's order (doc, sheet, ord), with media that no cell holds after the last."""
    one = F.struct("ord", "sheet", "markdown")
    out = sheets.join(order, KEYS).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["markdown"]), "\n\n").alias("markdown"))
    if rest is None:
        return out
    refs = rest.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list("path")), lambda p: F.concat(F.lit("- ![]("), p, F.lit(")"))), "\n").alias("_rest"))
    return out.join(refs, "doc", "left").select("doc", F.concat("markdown", F.coalesce(F.concat(F.lit("\n\n### 其他媒体\n\n"), "_rest"), F.lit(""))).alias("markdown"))
