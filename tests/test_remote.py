import base64

from helpers import archive
from pyspark.sql import functions as F

from foliomill.functions import register, remote
from foliomill.sources import legacy


def test_public_hosts(spark):
    urls = ["http://localhost/x", "http://127.0.0.1/", "http://10.0.0.1/", "ftp://a.b/", "https://8.8.8.8/x", "https://inside.example/", "https://outside.example/", "", None, "http://[::1]/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    judge = remote.public_host(lambda h: ["10.1.1.1"] if h.startswith("inside") else ["8.8.4.4"])
    assert [r[0] for r in df.select(judge(F.col("u"))).collect()] == [False, False, False, False, True, False, True, False, False, False]

    assert not any(r[0] for r in df.where("u LIKE '%example%'").select(remote.public_host()(F.col("u"))).collect())  # no resolver, no trust


def test_embedded(spark):
    png, icon, big = (base64.b64encode(x).decode() for x in (b"p", b"<svg/>", b"<svg>" + b" " * 11000))
    md = f"![a](data:image/png;base64,{png}) ![b](data:image/svg+xml;base64,{icon}) ![c](data:image/svg+xml;base64,{big}) ![d](data:text/x;base64,{png})"
    got = {r.alt: (r.name, bytes(r.data)[:5]) for r in remote.embedded(spark.createDataFrame([(1, md), (2, None)], "d int, m string"), "d", "m").collect()}
    assert got["a"] == ("image_001.png", b"p") and got["b"][0] is None and got["c"] == ("image_002.svg", b"<svg>") and got["d"][0] is None


def test_first_media(spark):
    df = spark.createDataFrame([(1, k, f"https://h/{k % 3}.png") for k in range(9)] + [(1, 9, "/x.png"), (1, 10, None)], "d int, pos int, src string")
    assert {(r.src, r.number) for r in remote.first_media(df, "d", "pos", 2).collect()} == {("https://h/0.png", 1), ("https://h/1.png", 2)}
    assert [r[0] for r in df.limit(1).select(remote.url_extension(F.lit("https://h/a.MP4?x=.png"))).collect()] == [".mp4"]


def test_legacy(spark):
    df = spark.createDataFrame([("a.doc", bytearray(b"x")), ("b.pdf", bytearray(b"y")), ("c.xls", bytearray(b"bad"))], "path string, content binary")
    none = {r.path: r.error for r in legacy.converted(df, None).collect()}
    assert none == {"a.doc": "CONVERTER_NOT_AVAILABLE", "b.pdf": None, "c.xls": "CONVERTER_NOT_AVAILABLE"}
    good = archive({"word/document.xml": "<d/>"})
    got = {r.path: (r.status, r.error) for r in legacy.converted(df, lambda raw, old, new: good).collect()}
    assert got == {"a.doc": ("success", None), "b.pdf": (None, None), "c.xls": ("failed", "CONVERSION_OUTPUT_INVALID")}


def test_sql_functions(spark):
    register.register(spark)
    r = spark.sql("SELECT mask_key('123456789'), column_number('AB3'), auth_error('Quota used up'), media_ext('a/b.PNG'), html_to_markdown('<h2>x</h2>'), size(inline_blocks('abc', 4, 2).blocks)").head()
    assert list(r) == ["1234...6789", 28, True, "png", "## x", 1]
