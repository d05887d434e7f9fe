from foliomill.llm import lookalikes as L
from foliomill.llm.lookalikes import canonical, pairs, readable, skeleton


def same(a, b):
    return skeleton(a) == skeleton(b)


def test_what_looks_the_same():
    assert same("file ﬁle", "file ﬁle") and same("ﬁle", "file") and same("Ｆｕｌｌ：１", "Full:1") and same("é", "é")
    assert same("pаypаl", "paypal") and same("⼯作", "工作") and same("a​b﻿­", "ab") and same("a  b", "a b")
    assert same("a–b", "a–b") and same("non‑stop", "non-stop") and same("ο", "o") and same("x \r\ny", "x\ny") and same("𝐀", "A")


def test_what_looks_different():
    for a, b in (("e", "é"), ("x²", "x2"), ("①", "1"), ("A", "a"), ("½", "1/2"), ("l", "1"), ("a b", "ab"), ("a\nb", "a b"), ("東", "东")):
        assert not same(a, b), (a, b)


def test_readable_keeps_scripts():
    assert readable(skeleton("Склад и насос")) == "Склад и насос" and readable(skeleton("Cклaд и насос")) == "Склад и насос"
    assert readable(skeleton("Pаris")) == "Paris"


def test_pairs(spark):
    from pyspark.sql import functions as F

    rows = [(1, "Paris file"), (2, "Pаris file"), (3, "Paris ﬁle"), (3, "Paris ﬁle"), (4, "Paris file"), (5, None), (6, ""), (7, " "), (8, "Paris  File"), (9, "​"), (10, "Ｐａｒｉｓ　ｆｉｌｅ" + " "), (11, "x" * 100_000), (12, "х" * 100_000), (None, "Paris file")]
    df = spark.createDataFrame(rows, "result_id long, markdown string").withColumn("look", F.lit(1)).withColumn("s", F.lit("z"))
    got = {tuple(r) for r in pairs(df).collect()}
    want = {(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (1, 10), (2, 10), (3, 10), (4, 10), (11, 12)}
    assert got == want
    assert pairs(df.limit(0)).count() == 0
    out = {r.result_id: r.canonical for r in canonical(df.where("result_id in (5, 6, 10)")).collect()}
    assert out == {5: None, 6: "", 10: "Paris file"}


def test_small_cherokee_and_published_table(spark, tmp_path):
    assert L.skeleton("\uabaa\u13da") == L.skeleton("s" + "S") and L.skeleton("\uab7a") == "\u1d00"
    f = tmp_path / "confusables.txt"
    f.write_text("\ufeff# head\n10404 ;\t004F ;\tMA\t# x\n0441 ; 0078 ; MA\n0030 ; 004F ; MA\nFB01 ; 0066 0069 ; MA\n10500 ; 041E ; MA\n", encoding="utf-8")
    assert L.published(str(f)) == {"\U00010404": "O", "\U00010500": "O"}
    df = spark.createDataFrame([(1, "FO\U00010404 bar"), (2, "FOO bar"), (3, "F0O bar")], "result_id long, markdown string")
    assert L.pairs(df).count() == 0
    assert [tuple(r) for r in L.pairs(df, confusables=str(f)).collect()] == [(1, 2)]
