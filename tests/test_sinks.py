from foliomill.settings import Settings, credential, names, secrets
from foliomill.sinks import markdown
from foliomill.streaming import inbox


def test_no_overwrite_and_rollback(spark, tmp_path):
    rows = spark.createDataFrame([("a", "one", "{}"), ("b", None, None)], "name string, markdown string, json string")
    got = {r.name: r.save_status for r in markdown.save(rows, str(tmp_path)).collect()}
    assert got == {"a": "saved", "b": "saved"} and (tmp_path / "a.md").read_text() == "one"
    again = {r.name: r.save_status for r in markdown.save(rows, str(tmp_path)).collect()}
    assert again == got  # the same bytes: a task that runs again
    other = rows.withColumn("markdown", rows["json"])
    (tmp_path / "c.json").write_text("old")
    assert {r.name: r.save_status for r in markdown.save(other, str(tmp_path)).collect()}["a"] == "failed"
    half = spark.createDataFrame([("c", "new", "{}")], "name string, markdown string, json string")
    r = markdown.save(half, str(tmp_path)).head()
    assert r.save_status == "failed" and not (tmp_path / "c.md").exists() and (tmp_path / "c.json").read_text() == "old"
    assert not list(tmp_path.glob(".*tmp"))


def test_inbox(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("a.html", "copy.html"):
        (tmp_path / "in" / n).write_text("<h1>x</h1>")
    (tmp_path / "in" / "b.txt").write_text("no")
    got = []
    stream = inbox.extracted(inbox.once(inbox.inbox(spark, str(tmp_path / "in"))))
    q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.extend(r.markdown for r in df.collect())).start()
    q.processAllAvailable()
    q.stop()
    assert got == ["# x"]


def test_settings():
    assert names("a; b,\nc,,") == ["a", "b", "c"] and secrets("a,b;c") == ["a,b", "c"]
    assert credential("ak:sk:rest") == {"accessKey": "ak", "secretKey": "sk:rest"} and credential("t") == {"token": "t"}
    s = Settings.of({"pdf_backends": "mineru,local", "max_rows": 0, "unknown": 1})
    assert s.pdf_backends == ["mineru", "local"] and s.max_rows == 0 and Settings.of("no").split_pages == 180


def test_two_phase_source(spark, tmp_path):
    import pytest

    from foliomill.sinks import datasource

    datasource.register(spark)
    rows = spark.createDataFrame([(f"n{k}", f"text {k}") for k in range(20)], "name string, markdown string").repartition(4)
    rows.write.format("markdown_files").mode("append").option("path", str(tmp_path)).save()
    assert len(list(tmp_path.glob("*.md"))) == 20 and (tmp_path / "n3.md").read_text() == "text 3"
    assert not list(tmp_path.glob(".staging*"))
    with pytest.raises(Exception, match="exist"):
        rows.union(rows.sparkSession.createDataFrame([("new", "x")], "name string, markdown string")).write.format("markdown_files").mode("append").option("path", str(tmp_path)).save()
    assert not (tmp_path / "new.md").exists() and (tmp_path / "n3.md").read_text() == "text 3" and not list(tmp_path.glob(".staging*"))


def test_arrivals_stream_drops_what_is_too_late(spark, tmp_path):
    import datetime as dt

    def put(name, hours):
        t = dt.datetime(2025, 1, 10, tzinfo=dt.timezone.utc)
        spark.createDataFrame([("k", t + dt.timedelta(hours=h)) for h in hours], "key string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in" / name))

    put("a", [0, 0, 1])
    stream = spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in" / "*"))
    q = inbox.arrivals(stream, "at", "key", late="2 hours").writeStream.outputMode("append").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).start()
    for name, hours in (("b", [9]), ("c", [0]), ("d", [20])):
        q.processAllAvailable()
        put(name, hours)
    q.processAllAvailable()
    q.stop()
    got = {(r.start.hour, r.n) for r in spark.table("seen").collect()}
    assert (0, 2) in got and (9, 1) in got and (0, 3) not in got


def test_media_files(spark, tmp_path):
    from helpers import REL, archive, rels

    from foliomill.sinks import media
    from foliomill.sources import files

    blip = f'<w:p><w:r><w:drawing><x:blip xmlns:x="x" xmlns:r="{REL}" r:embed="%s"/></w:drawing></w:r></w:p>'
    raw = archive({"word/document.xml": '<w:document xmlns:w="w"><w:body>' + blip % "r1" + blip % "r2" + "</w:body></w:document>", "word/_rels/document.xml.rels": rels(("r1", "image", "media/a.png"), ("r2", "image", "media/b.png")), "word/media/a.png": b"A", "word/media/b.png": b"B"})
    df = spark.createDataFrame([("in/d.docx", bytearray(raw)), ("in/broken.docx", bytearray(b"x"))], "path string, content binary")
    out = tmp_path / "d_media"
    out.mkdir()
    (out / "image_002.png").write_bytes(b"other")
    got = {r.name: r.error is None for r in media.save(df, files.documents(df), str(tmp_path)).collect()}
    assert got == {"image_001.png": True, "image_002.png": False}
    assert (out / "image_001.png").read_bytes() == b"A" and (out / "image_002.png").read_bytes() == b"other"
