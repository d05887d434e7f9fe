from pyspark.sql import functions as F

from foliomill.functions import budget, cells, html
from foliomill.functions import media as M
from foliomill.functions import text as T


def one(spark, *columns):
    return spark.range(1).select(*columns).head()


def test_media(spark):
    rows = spark.createDataFrame([("a b.PNG",), ("x/.hidden",), ("v.mp4",), (None,), ("",), ("https://h/x.zip",)], "p string")
    got = [tuple(r) for r in rows.select(M.classify(M.suffix(F.col("p"))), M.file_type(F.col("p"))).collect()]
    assert got == [("image", "image"), ("other", "unknown"), ("video", "unknown"), ("other", "unknown"), ("other", "unknown"), ("other", "html")]
    r = one(spark, M.file_name(F.lit("image"), F.lit(7), F.lit("PNG")), M.file_name(F.lit("x"), F.lit(1234), F.lit(None)), M.reference(F.lit("a b.mp4"), F.lit("video"), F.lit('say "hi" ')), M.reference(F.lit("a%20b c.png"), F.lit("image"), F.lit(None)))
    assert list(r) == ["image_007.png", "media_1234", '<video controls src="a%20b.mp4" title="say &quot;hi&quot;"></video>', "![](a%20b%20c.png)"]


def test_columns_round_trip(spark):
    df = spark.range(1, 18279).select(F.col("id").cast("int").alias("n"))
    df = df.withColumn("s", cells.column_letters(F.col("n")))
    assert df.where(cells.column_number(F.col("s")) != F.col("n")).count() == 0
    assert [r.s for r in df.where("n in (1, 26, 27, 702, 703, 18278)").orderBy("n").collect()] == ["A", "Z", "AA", "ZZ", "AAA", "ZZZ"]
    assert list(one(spark, cells.column_number(F.lit("ab1")), cells.row_number(F.lit("AB12")), cells.row_number(F.lit("12")))) == [0, 12, 0]
    assert list(one(spark, cells.number_text(F.lit(100000.0)), cells.number_text(F.lit(68460.1)))) == ["100000", "68460.1"]


def test_table(spark):
    r = one(spark, T.table(F.array(F.array(F.lit("a"), F.lit("b|c")), F.array(F.lit("x\ny")))), T.table(F.expr("cast(array() as array<array<string>>)")))
    assert list(r) == ["| a | b\\|c |\n| --- | --- |\n| x y |  |", ""]


def test_text(spark):
    r = one(spark, T.mask(F.lit("1234567")), T.mask(F.lit("12345678")), T.redact(F.lit("a key b key"), F.array(F.lit("key"), F.lit(None), F.lit(""))), T.safe_stem(F.lit("https://u@a.b.c/x?y")), T.safe_stem(F.lit("/d/a:b.tar.gz")), T.word_count(F.lit(" # a  b\n")), T.word_count(F.lit("")))
    assert list(r) == ["***", "1234...5678", "a [REDACTED] b [REDACTED]", "a_b_c", "a_b.tar", 2, 0]
    assert one(spark, T.restore_heading(F.lit("# t.docx\nx"), F.lit("o.doc"), F.lit("t.docx")))[0] == "# o.doc\nx"
    assert one(spark, T.frontmatter(F.create_map(F.lit("a"), F.lit("x: y"))))[0] == '---\na: "x: y"\n---\n\n'


def test_prefix_keeps_characters(spark):
    for text in ("aé漢😀" * 40, "x" * 50, ""):
        for most in (5, 17, 18, 19, 20):
            got = one(spark, T.prefix(F.lit(text), most))[0]
            assert got == budget.head(text, most)


def test_overlap(spark):
    a, b = "x" * 50 + "the shared middle", "the shared middle and more"
    r = one(spark, T.merge_overlapping(F.array(F.lit(a), F.lit(None), F.lit(""), F.lit(b), F.lit("new"))))
    assert r[0] == "x" * 50 + b + "\n\nnew"
    assert one(spark, T.longest_overlap(F.lit("abc0123456789"), F.lit("0123456789x")))[0] == 0  # ten are too few


def test_budget():
    text = "".join(f"line {k} 漢字\n" for k in range(900))
    blocks, complete = budget.cut_blocks(text, 4096, 9)
    assert complete and "".join(blocks) == text and all(len(b.encode()) <= 4096 for b in blocks)
    assert not budget.cut_blocks(text, 4096, 1)[1]
    short = budget.fit(text, 4096, 2, "notice")
    assert short.endswith("notice") and budget.MARKER in short and budget.cut_blocks(short, 4096, 2)[1]
    assert budget.head_tail("abc", 10) == "abc"


def test_clamp(spark):
    values = [None, 1.0, 5000.7, 1e9, float("nan"), float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(budget.clamp(F.col("x"), budget.BLOCK_BYTES)).collect()] == [28672, 4096, 5000, 30720, 28672, 28672]


def test_html(spark):
    page = """<TITLE> a
    b </TITLE><a href='#x'>no</a><a class=k href="u">go <b>there</b></a><h2>T <i>x</i></h2><h3> </h3><img src="a.png"><img src="a.png">
    <video poster="p.png"><source src="m.mp4"></video><pre><code class="py">1 &lt; 2</code></pre>"""
    h = F.lit(page)
    r = one(spark, html.title(h), html.links(h), html.headings(h), html.media(h), html.code_blocks(h))
    assert r[0].split() == ["a", "b"]
    assert [tuple(x) for x in r[1]] == [("u", "go there")]
    assert [tuple(x) for x in r[2]] == [(2, "T x")]
    assert [tuple(x) for x in r[3]] == [("a.png", "image", "img", ""), ("m.mp4", "video", "video", "p.png")]
    assert [tuple(x) for x in r[4]] == [("", "1 < 2")]
