"""Files as DataFrames: (path, content) in, rows of parts or Markdown out. A file that cannot be read gives a row with its error."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.media import FILE_TYPES


def files(spark: SparkSession, folder: str, types: tuple[str, ...] = tuple(FILE_TYPES)) -> DataFrame:
    """(path, modificationTime, length, content) of a folder's own files of the given types; extensions in either case."""
    exts = [e for t in types for e in FILE_TYPES[t]]
    glob = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e) for e in exts) + "}"
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "false").load(folder)


def _stem(path: str) -> tuple[str, str]:
    name = path.rstrip("/").rpartition("/")[2]
    return name, name.rpartition(".")[0] or name


def documents(df: DataFrame, with_media: bool = True) -> DataFrame:
    """(path, format, markdown, media ARRAY<STRUCT<original, kind, name>>, error) of Word files, decks and pages. A file of another
    kind, whatever it holds, gives an error and no Markdown."""
    pages = set(FILE_TYPES["html"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..formats.docx import Document
        from ..formats.html_markdown import convert, decoded
        from ..formats.pptx import Deck

        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                name, stem = _stem(path)
                kind = name.rpartition(".")[2].lower()
                try:
                    if kind == "docx":
                        d = Document(raw, stem, with_media)
                        md, media = d.markdown(name), d.media
                    elif kind == "pptx":
                        d = Deck(raw, stem, with_media)
                        md, media = d.markdown(name), d.media
                    elif kind not in pages:
                        raise ValueError(f"no decoder for .{kind} files")
                    else:
                        md, media = convert(decoded(raw), with_media), []
                    rows.append((path, kind, md, [dict(zip(("original", "kind", "name"), m)) for m in media], None))
                except Exception as e:  # a broken file is a row, not a failed job
                    rows.append((path, kind, None, [], f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "format", "markdown", "media", "error"])

    return df.select("path", "content").mapInPandas(run, "path string, format string, markdown string, media array<struct<original: string, kind: string, name: string>>, error string")


def _parts(df: DataFrame, schema: str, read) -> DataFrame:
    """Rows that read(ZipFile) gives, each behind its file's path; unreadable files give none (see workbook_errors)."""
    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..formats import xlsx

        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                try:
                    rows += [(path, *r) for r in read(xlsx, xlsx.opened(raw))]
                except Exception:
                    continue
            yield pd.DataFrame(rows, columns=names)

    return df.select("path", "content").mapInPandas(run, schema)


def workbook_cells(df: DataFrame) -> DataFrame:
    return _parts(df, "doc string, sheet string, row int, col int, type string, value string, is_formula boolean", lambda x, z: x.cells(z))


def workbook_sheets(df: DataFrame) -> DataFrame:
    return _parts(df, "doc string, ord int, sheet string, part string", lambda x, z: x.sheets(z))


def workbook_strings(df: DataFrame) -> DataFrame:
    return _parts(df, "doc string, idx int, text string", lambda x, z: enumerate(x.strings(z)))


def workbook_anchors(df: DataFrame) -> DataFrame:
    return _parts(df, "doc string, sheet string, row int, col int, path string", lambda x, z: x.anchors(z)).withColumn("kind", F.lit("image"))


def workbook_media(df: DataFrame) -> DataFrame:
    """(doc, path) of all media in the archives, on a sheet or not."""
    return _parts(df, "doc string, path string", lambda x, z: [(n,) for n in z.namelist() if n.startswith("xl/media/") and not n.endswith("/")])


def workbook_errors(df: DataFrame) -> DataFrame:
    """(path, error) of the files that are no readable workbooks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..formats import xlsx

        for b in batches:
            rows = []
            for path, raw in zip(b["path"], b["content"]):
                try:
                    z = xlsx.opened(raw)
                    for read in (xlsx.sheets, xlsx.strings, xlsx.cells, xlsx.anchors):
                        for _ in read(z):
                            pass
                except Exception as e:
                    rows.append((path, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(rows, columns=["path", "error"])

    return df.select("path", "content").mapInPandas(run, "path string, error string")


def workbooks(df: DataFrame, max_rows: int = 100, max_cols: int = 50) -> DataFrame:
    """(path, markdown, warnings, error) of every file: parsed in Python, assembled by joins and aggregates. Media that no cell
    holds follow the last sheet. A file that cannot be read has an error and no Markdown, one without content neither."""
    from ..operators import sheets

    cells = sheets.resolved(workbook_cells(df), workbook_strings(df))
    anchors = workbook_anchors(df)
    cells = sheets.anchored(cells.select("doc", "sheet", "row", "col", "text"), anchors)
    tables = sheets.sheet_tables(cells, max_rows, max_cols)
    warned = tables.groupBy("doc").agg(F.array_sort(F.collect_list(F.when(F.col("rows_cut") | F.col("cols_cut"), F.concat(F.col("sheet"), F.lit(": 已截断"))))).alias("warnings"))
    rest = sheets.unanchored(workbook_media(df), anchors)
    read = sheets.workbook(tables, workbook_sheets(df), rest).join(warned, "doc").select(F.col("doc").alias("path"), "markdown", "warnings")
    failed = workbook_errors(df)
    return df.select("path").distinct().join(failed, "path", "left").join(read, "path", "left").select("path", F.when(F.col("error").isNull(), F.col("markdown")).alias("markdown"), "warnings", "error")


def ocr_lines(lines: DataFrame, key: str = "job_id", order: str = "line_no", text: str = "line") -> DataFrame:
    """(key, markdown, images) from an OCR service's JSON lines: lines that are no JSON or have no result are skipped, as are
    blank texts; pages are joined by blank lines, pictures kept in order."""
    schema = "result STRUCT<layoutParsingResults: ARRAY<STRUCT<markdown: STRUCT<text: STRING, images: MAP<STRING, STRING>>>>>"
    x = lines.select(key, order, F.from_json(text, schema).alias("j")).where("j.result IS NOT NULL")
    x = x.select(key, order, F.posexplode("j.result.layoutParsingResults").alias("k", "p"))
    one = F.struct(F.col(order), F.col("k"), F.col("p.markdown.text").alias("t"), F.map_entries(F.coalesce("p.markdown.images", F.create_map().cast("map<string,string>"))).alias("i"))
    x = x.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("ps"))
    texts = F.filter(F.transform("ps", lambda p: p["t"]), lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")
    return x.select(key, F.array_join(texts, "\n\n").alias("markdown"), F.flatten(F.transform("ps", lambda p: p["i"])).alias("images"))


def long_pictures(images: DataFrame, threshold: float = 2.0) -> DataFrame:
    """(origin, piece, top, bottom) of pictures as Spark's image source gives them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from ..formats import image_split as s

        for b in batches:
            rows = []
            for o, h, w, c, d in b.itertuples(index=False):
                blank = s.blank_rows(s.from_spark_image(h, w, c, d)) if h > w * threshold else [True] * h
                rows += [(o, k, a, z) for k, (a, z) in enumerate(s.pieces(blank, w, threshold), 1)]
            yield pd.DataFrame(rows, columns=["origin", "piece", "top", "bottom"])

    return images.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "origin string, piece int, top int, bottom int")
