from foliomill.llm import scans as S


def test_automaton_finds_every_word_one_edit_away():
    words = {w: 9 for w in ("storage", "report", "pressure", "modern", "before", "a")}
    t = S.Trie(words)
    for bad, good in (("stora9e", "storage"), ("rcport", "report"), ("pressiire", "pressure"), ("rnodern", "modern"), ("befor", "before"), ("befoore", "before")):
        assert good in {c for c, *_ in t.near(bad)}, bad
    assert t.near("zzzzz") == [] and [c for c, _ in S.candidates(t, "stora9e", 1)] == ["storage"] and S.candidates(t, "befoore", 1) == []


def test_furniture():
    lines = ["Report A – X-1", "Text that goes on and", "Page 3 of 9", "ends here.", "2|Report A – X-1", "More text.", "iv", "第2页 共10页", "# Title", "| 1 |", "- item", "3. third", "12"]
    heads, numbers = S.furniture(lines)
    assert heads == {0, 4} and numbers == {2, 6, 7, 12}


def test_clean():
    text = "# T\n\nThe stor-\nage tank reo¬\npens the pressiire valve\nand well-\nKnown things.\n\nItem 1O6,2 of 9O89.\n\n| a | b |\n| --- | --- |\n\n详见《报\n吉》第"
    out, broken, misread, heads, numbers = S.clean(text, {"pressiire": "pressure"})
    assert out.startswith("# T\n\nThe storage tank reopens the pressure valve and well- Known things.\n\nItem 106,2 of 9089.")
    assert (broken, misread, heads, numbers) == (2, 3, 0, 0) and out.endswith("详见《报吉》第")


def test_repaired(spark):
    words = "storage tank before report during inspection schedule committee confirms".split()
    rows = [(k, " ".join(words[j:] + words[:j]) + ".", "docx", "a.docx") for k, j in enumerate(list(range(9)) * 4)]
    noisy = "The storagc tank bcfore the\nrcport is read.\nPage 1\nMore of it.\nPage 2\n"
    rows += [(100, noisy, "pdf", "x"), (100, noisy, "pdf", "x"), (101, noisy, None, "s.PNG"), (102, noisy, None, "s.html"), (103, None, "pdf", "x"), (104, "", "image", "x"), (105, "w " * 200_000, "pdf", "x")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "result_id long, markdown string, file_type string, file_name string").withColumn("w", F.lit(1)).withColumn("k", F.lit("c"))
    got = {r.result_id: r for r in S.repaired(df).collect()}
    assert set(got) == {100, 101, 103, 104, 105}
    assert got[100].repaired == "The storage tank before the report is read. More of it." and got[100].misread == 3 and got[100].numbers == 2
    assert got[103].repaired is None and got[104].repaired == "" and got[105].misread == 0
    assert {r.result_id for r in S.noisy(S.repaired(df)).collect()} == {100, 101}
    assert S.repaired(df.limit(0)).count() == 0


def test_any_edit_and_several_candidates():
    t = S.Trie({"storage": 900, "casing": 100, "coding": 90, "casting": 80, "хранение": 900, "cat": 500})
    assert [c for c, _ in S.candidates(t, "storzge", 2)] == ["storage"]  # an edit that no table holds
    assert [c for c, _ in S.candidates(t, "хранемие", 2)] == ["хранение"]
    assert S.candidates(t, "storzge", 20) == [] and S.candidates(t, "cqt", 1) == []
    assert {c for c, _ in S.candidates(S.Trie({"house": 90, "horse": 80}), "hoase", 1)} == set()  # five letters, no usual edit


def test_neighbours_decide(spark):
    """One misreading, two originals: the word before and after tells which."""
    rows = [(k, "the loan bank lends money quietly" if k % 2 else "the brown bark peels slowly", "docx", "a.docx") for k in range(60)]
    rows += [(k, "they sell old barn doors and bark too", "docx", "a.docx") for k in range(60, 90)]
    noisy = "They saw brown banh peels and loan banh lends there."
    rows += [(100, noisy, "pdf", "x"), (101, None, "pdf", "x")]
    df = spark.createDataFrame(rows, "result_id long, markdown string, file_type string, file_name string")
    fix = [("banh", [("bark", 4.0), ("bank", 3.0)])]
    kind = "array<struct<v: string, weight: double>>"
    counts = S.neighbours(df.selectExpr("markdown t").where("t IS NOT NULL"), spark.createDataFrame(fix, f"w string, v {kind}"))
    places = spark.createDataFrame([(100, noisy, fix)], f"k long, t string, f array<struct<w: string, v: {kind}>>")
    got = {(r.before, r.w, r.behind): r.v for r in S.decided(places, counts, "bigint").collect()}
    assert got == {("brown", "banh", "peels"): "bark", ("loan", "banh", "lends"): "bank"}
    assert S.clean(noisy, {"banh": "bark"}, got)[0] == "They saw brown bark peels and loan bank lends there."


def test_vocabulary_is_bounded(spark, monkeypatch):
    words = spark.createDataFrame([(f"w{k}", k) for k in range(1, 100)] + [("big", 10_000), ("huge", 9_000)], "w string, n long")
    assert S.floor(words) == S.LEAST
    monkeypatch.setattr(S, "VOCABULARY", 12)
    assert S.floor(words) == 90 and words.where("n >= 90").count() == 12
    monkeypatch.setattr(S, "VOCABULARY", 1)
    assert S.floor(words) == 16384


def test_a_word_shares_an_end_with_each_original():
    for pairs in (S.MISREAD, {(x, y) for x in ("a", "") for y in ("b", "") if x != y}):
        for read, meant in pairs:
            for n in range(10):
                for k in range(n + 1):
                    w, c = "vwxyzabcd"[:k] + read + "efghijklm"[: n - k], "vwxyzabcd"[:k] + meant + "efghijklm"[: n - k]
                    if len(w) >= 4 and len(c) >= 4:
                        assert S.ends(w, False) & S.ends(c, True), (w, c)
    assert S.ends("电问题", False) & S.ends("电间题", True)


def test_words_beyond_the_vocabulary_are_candidates(spark, monkeypatch):
    """The same corrections and counts of neighbours, however few words are sent to the workers at once."""
    usual = ["storage", "pressure", "modern", "before", "report", "casting", "casing", "coding", "schedule", "хранение", "电间题", "pest", "post"]
    rows = [(w, 70 + k, 0) for k, w in enumerate(usual)] + [("the", 9_000, 0), ("storzge", 1, 1), ("pressiire", 2, 2), ("rnodern", 1, 1), ("befor", 1, 1), ("rcport", 3, 3), ("casling", 1, 1), ("schedulc", 1, 1), ("хранемие", 1, 1), ("电问题", 1, 1), ("pcst", 1, 1)]
    words = spark.createDataFrame(rows, "w string, n long, s long")
    texts = spark.createDataFrame([("the pest and the post of it",), ("a post",), ("",)], "t string")
    result = lambda df: sorted((r.asDict(True) for r in df.collect()), key=str)

    whole = result(S.corrections(words))
    counts = result(S.neighbours(texts, S.corrections(words)))
    assert {r["w"] for r in whole} >= {"storzge", "pressiire", "rnodern", "rcport", "schedulc", "хранемие", "电问题", "pcst"} and len(counts) == 5
    for bound in (1, 3, 8):
        monkeypatch.setattr(S, "VOCABULARY", bound)
        assert S.floor(words) > S.LEAST
        fixes = S.corrections(words)
        assert result(fixes) == whole and result(S.neighbours(texts, fixes)) == counts, bound
