import json

from foliomill.llm import mojibake as G

CLEAN = ["Die Prüfmappe ergänzt die Bodenprobe während der Trockenzeit – „Näheres“ über Maß.", "La clôture a été relevée à l’été ; l’échantillon précède.", "Значение выросло несмотря на нехватку, проверка завершена.", "详见《检验报告》，设备状态表确认了独立电源。", "El índice amplía el levantamiento según la partida."]


def garbled(text, *chain):
    return G.form(text, chain)


def test_chains_are_undone():
    for text in CLEAN:
        for chain in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437"), ("utf-8", "cp1252", "utf-8", "cp1252")):
            bad = garbled(text, *chain)
            assert bad != text and G.undo(bad, chain) == text


def test_clean_tokens():
    for t in ("Prüfmappe", "„Näheres“", "SECÇÃO", "été", "l’échantillon", "Значение", "详见《检验报告》，", "20m²", "独立电源PG", "ΩHz"[1:], "São"):
        assert G.is_clean(t), t
    for t in ("PrÃ¼fmappe", "rйduit", "p谩ginas", "tÈcnica", "ïðîâåðåíî", "â€œSel", "Se�n", "╨╜╨░", "K黨lstrecke"):
        assert not G.is_clean(t), t


def test_fields(spark):
    rows = []
    for k in range(6):
        for t in CLEAN:
            rows.append((len(rows) + 1, f"# T{k}\n\n{t}", json.dumps({"a": t, "n": 1})))
    base = len(rows)
    bad = [(garbled(CLEAN[0], "utf-8", "cp1252"), None), (CLEAN[1], json.dumps({"d": garbled(CLEAN[1], "utf-8", "cp850")})), (garbled(CLEAN[2], "cp1251", "latin-1"), "no json " + CLEAN[0]), (garbled(CLEAN[3], "gbk", "latin-1"), "{}"), (garbled(CLEAN[3], "utf-8", "gbk"), None), ("seg�n la partida", json.dumps({"x": None})), (garbled(CLEAN[1], "cp1252", "mac_roman"), None), ("编号犘犌-98506", "[]")]
    for k, (m, j) in enumerate(bad):
        rows.append((base + 1 + k, m, j))
    rows.append((base + 4, *bad[3]))  # delivered twice
    rows += [(900, None, None), (901, "", ""), (902, "x" * 300_000, None), (903, "PG AH codes PG", None), (904, "PG", None), (905, "Übergrößenträger São ±3 °C € 東門 naïve façade 〜 №5", None)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "result_id long, markdown string, metadata string").withColumn("w", F.lit("w")).withColumn("n", F.lit(1))
    got = {(r.result_id - base, r.field) for r in G.affected(df).collect()}
    assert got == {(1, "markdown"), (2, "metadata"), (3, "markdown"), (4, "markdown"), (5, "markdown"), (6, "markdown"), (7, "markdown"), (8, "markdown")}
    text = {(r.result_id - base, r.field): r.restored for r in G.restored(df).collect()}
    assert text[1, "markdown"] == CLEAN[0] and text[2, "metadata"] == CLEAN[1] and text[3, "markdown"] == CLEAN[2] and text[4, "markdown"] == CLEAN[3]
    assert text[6, "markdown"] == "según la partida" and text[8, "markdown"] == "编号PG-98506"
    assert G.affected(df.limit(0)).count() == 0


def test_words_in_quotes_and_rare_words(spark):
    rows = [(1, "Harnimko went, “Pelronko” stayed, ages; la clôturéfin, значимость.", None), (2, "“Harnimko” – 5 °C", None)]
    bad = [garbled("“Harnimko”", "cp1252", "mac_roman"), garbled("„Pelronko", "cp1252", "cp850"), garbled("clôturéfin", "cp1252", "mac_roman"), garbled("значимость", "cp1251", "latin-1"), "naïve façade ìunknownwordî", "\u0440ages"]
    rows += [(10 + k, f"It is 5 °C in {x} now", None) for k, x in enumerate(bad)]
    df = spark.createDataFrame(rows, "result_id long, markdown string, metadata string")
    assert {r.result_id for r in G.affected(df).collect()} == {10, 11, 12, 13}
    got = {r.result_id: r.restored for r in G.restored(df).collect()}
    assert got[10] == "It is 5 °C in “Harnimko” now" and got[13] == "It is 5 °C in значимость now"


def test_long_and_rare_and_twice_wrong(spark):
    """The original occurs once, and its form has 200 characters and more."""
    word = "überaus" + "schönfließend" * 14
    twice = lambda t: garbled(garbled(t, "utf-8", "latin-1"), "utf-8", "latin-1")
    rows = [(1, f"Das Wort {word} steht hier.", None), (2, "значимость величины, 检验报告", None)]
    rows += [(10, garbled(word, "utf-8", "cp1252"), None), (11, twice("значимость"), None), (12, twice("检验报告"), None), (13, "Das Wort", None)]
    df = spark.createDataFrame(rows, "result_id long, markdown string, metadata string")
    assert len(rows[2][1]) > 200 and {r.result_id for r in G.affected(df).collect()} == {10, 11, 12}
    got = {r.result_id: r.restored for r in G.restored(df).collect()}
    assert got[10] == word and got[11] == "значимость" and got[12] == "检验报告"


def test_token_of_most_texts(spark, monkeypatch):
    monkeypatch.setattr(G, "HEAVY", 3)
    rows = [(k, "l’été Ã©tÃ©", None) for k in range(90)] + [(100, "été", None), (101, "SÃ£o", None), (102, "São", None)]
    df = spark.createDataFrame(rows, "result_id long, markdown string, metadata string")
    assert {r.result_id for r in G.affected(df).collect()} == {*range(90), 101}
