import pytest
from pyspark.sql import functions as F

from foliomill.operators import chain, media, pages, report, rows, sheets


def test_latest_keeps_the_last_delivery(spark):
    import datetime as dt

    t = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(1, "a", t), (1, "b", t + dt.timedelta(1)), (2, "c", None)], "k long, v string, arrived_at timestamp_ntz")
    assert {(r.k, r.v) for r in rows.latest(df, "k").collect()} == {(1, "b"), (2, "c")}
    assert rows.latest(df.limit(0), "k").count() == 0


@pytest.mark.parametrize("spec,total,want", [("1-3, 5, 2-2", 5, [1, 2, 3, 5]), ("5-3", 4, [3, 4]), (None, 3, [1, 2, 3]), (" ", 2, [1, 2]), ("9", 3, []), ("x,2", 3, [2]), ("1", None, None), ("1-99999999999999999999", 2, [1, 2])])
def test_page_range(spark, spec, total, want):
    df = spark.createDataFrame([(spec, total)], "s string, n int")
    assert df.select(pages.selected(F.col("s"), F.col("n"))).head()[0] == want


def test_interleave_takes_reading_order_not_height(spark):
    b = spark.createDataFrame([(1, 1, 10.0), (1, 2, 300.0), (1, 3, 50.0)], "page int, block_no int, y0 double")
    i = spark.createDataFrame([(1, 7, 40.0), (1, 8, 400.0), (2, 9, 1.0)], "page int, xref int, top double")
    assert {(r.xref, r.before) for r in pages.interleaved(b, i, ["page"]).collect()} == {(7, 2), (8, None), (9, None)}


def test_placed_images_count_over_pages(spark):
    df = spark.createDataFrame([(1, 1, 7, 0.0, 9.0, 1.0, 10.0, "png"), (1, 1, 7, 0.0, 1.0, 1.0, 2.0, "png"), (1, 2, 3, 0.0, 1.0, 1.0, 0.0, "jpeg"), (1, 2, 4, None, 1.0, 1.0, 0.0, "jpeg")], "source_id long, page int, xref int, x0 double, y0 double, x1 double, y1 double, ext string")
    assert {(r.page, r.xref, r.number, r.top) for r in pages.placed(df).collect()} == {(1, 7, 1, 1.0), (2, 3, 2, 0.0)}


def test_first_success(spark):
    df = spark.createDataFrame([(1, 1, "a", False, "boom"), (1, 2, "b", True, None), (1, 3, "c", False, "late"), (2, 1, "a", False, None)], "k long, ord int, backend string, ok boolean, reason string")
    got = {r.k: (r.used_backend, r.in_chain, r.failures) for r in chain.first_success(df, "k").collect()}
    assert got == {1: ("b", True, ["a: boom"]), 2: (None, False, ["a: "])}


def test_cascade_asks_each_backend_only_for_what_is_left(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    asked = []

    def backend(name, good):
        def run(rest):
            asked.append((name, sorted(r.k for r in rest.collect())))
            return rest.select("k", F.when(F.col("k").isin(*good), f"by {name}").alias("markdown"), F.array().cast("array<string>").alias("media"))

        return name, run

    got = {r.k: r.used_backend for r in chain.cascade(df, "k", [backend("a", [1]), backend("b", [1, 2])]).collect()}
    assert got == {1: "a", 2: "b", 3: None} and asked == [("a", [1, 2, 3]), ("b", [2, 3])]


def test_credentials(spark):
    df = spark.createDataFrame([("g", 1, "k1", False, "401"), ("g", 2, "k2", True, None), ("g", 3, "k3", False, "boom")], "g string, o int, c string, ok boolean, r string")
    assert tuple(chain.failover(df, "g", "o", "c", "ok", "r").head()) == ("g", 3, 1, 2, "k2")
    nxt = spark.range(1).select(chain.next_credential(F.array(*map(F.lit, "abc")), F.array(F.lit("c")), F.lit(2)))
    assert nxt.head()[0] == "a"


def cells(spark, data):
    return spark.createDataFrame([("d", "S", *x) for x in data], "doc string, sheet string, row int, col int, text string")


def test_sheet_limits(spark):
    c = cells(spark, [(1, 1, "1"), (1, 3, "3"), (3, 1, "303"), (9, 26, "")])
    r = sheets.sheet_tables(c, 2, 2).head()
    assert r.markdown.startswith("## Sheet: S\n\n| 1 |\n| --- |") and r.rows_cut and r.cols_cut
    r = sheets.sheet_tables(c, 0, 0).head()
    assert "| 303 |  |  |" in r.markdown and not r.rows_cut and not r.cols_cut
    far = sheets.sheet_tables(cells(spark, [(101, 1, "x")])).head()
    assert "未保留" in far.markdown and far.rows_cut
    with pytest.raises(ValueError):
        sheets.sheet_tables(c, -1, 0)


def test_anchor_without_cell(spark):
    a = spark.createDataFrame([("d", "S", 2, 2, "image", "m.png")], "doc string, sheet string, row int, col int, kind string, path string")
    got = {(r.row, r.col): r.text for r in sheets.anchored(cells(spark, [(1, 1, "x")]), a).collect()}
    assert got == {(1, 1): "x", (2, 2): "[📷](m.png)"}


def test_media_joins(spark):
    m = spark.createDataFrame([(1, "a", "image", 2), (1, "a", "video", 5), (1, "b", "other", 1)], "d int, p string, kind string, pos int")
    assert {tuple(r) for r in media.upgraded(m, ["d", "p"], "kind", "pos").collect()} == {(1, "a", 2, "video"), (1, "b", 1, "other")}
    s = spark.createDataFrame([(".emf", 100), (".png", 100), ("wmf", None), ("wmf", 9000)], "ext string, size long")
    assert media.without_previews(s, "ext", "size").count() == 3
    rel = spark.createDataFrame([("r1", "../media/x.png"), ("r2", "gone.png")], "rid string, target string").withColumn("doc", F.lit(1))
    have = spark.createDataFrame([(1, "media/x.png")], "doc int, path string")
    assert {(r.rid, r.path) for r in media.resolved(rel, have, ["doc"]).collect()} == {("r1", "media/x.png"), ("r2", None)}


def test_reports(spark):
    df = spark.createDataFrame([(1, 2, "b", "y"), (1, 1, "a", "x"), (1, 3, "  ", "x"), (2, 1, None, None)], "k int, o int, t string, b string")
    got = {r.k: (r.markdown, r.used_backends) for r in report.merged_chunks(df, "k", "o", "t", "b").collect()}
    assert got == {1: ("a\n\n---\n\nb", ["x", "y"]), 2: ("", [])}
    assert {r.k: r.text for r in report.readable(df.where("k = 2"), "k", "o", "b", "t").collect()} == {2: ""}
