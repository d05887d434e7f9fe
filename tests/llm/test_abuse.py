import os

import pytest

from foliomill.llm import abuse as A

EXAMPLES = "/root/testdata/sf0.001/abuse_examples.parquet"


def test_disguises():
    for bad in ("what a b*stard", "you f i l t h y   p i g", "Du M-i-s-t-k-e-r-l", "Espèce de $@l@ud", "写的人是脑 残吧", "Arscccchloch", "ｂａｓｔａｒｄ", "bа​stаrd"):
        assert A.votes(bad)[1] & 3, bad
    for fine in ("Order SB-40168 was closed", "编号SB-40列出42次，其中", "The review retarde le plan", "see a b c d of it"):
        assert not A.votes(fine)[1] & 3, fine


@pytest.mark.skipif(not os.path.exists(EXAMPLES), reason="no test tables here")
def test_held_out_examples(spark):
    """Half of the labelled items are kept from the label model and the classifier; their texts are the corpus. The lexicons were
    written with all items in view, so this checks the fit of the models, not how well lexicons carry over."""
    from pyspark.sql import functions as F

    ex = spark.read.parquet(EXAMPLES)
    train, held = ex.where("example_id % 2 = 0"), ex.where("example_id % 2 = 1")
    docs = held.select(F.col("example_id").alias("doc_id"), "text")
    got = {r.doc_id: r.score >= A.THRESHOLD for r in A.scored(docs, train).collect()}
    rows = held.collect()
    right = sum(got[r.example_id] == (r.label != "none") for r in rows)
    assert right >= 0.97 * len(rows)


def test_defined_results(spark):
    from pyspark.sql import functions as F

    ex = spark.createDataFrame([("Go to hell, you bastard!", "abusive"), ("The bastard file on the bench.", "none"), (None, "none"), ("x", "odd")], "text string, label string")
    rows = [(1, "Fine text.\nGo to hell, you bastard!", "s"), (1, "Fine text.\nGo to hell, you bastard!", "s"), (2, None, "s"), (3, "", None), (4, "word " * 100_000, "t"), (None, "Only text.", "t"), (5, "x" * 200_000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("score", F.lit(9)).withColumn("k", F.lit(1)).withColumn("key", F.lit(1))
    s = A.scored(df, ex)
    got = {r.doc_id: r.score for r in s.collect()}
    assert set(got) == {1, 2, 3, 4, 5, None} and got[1] >= A.THRESHOLD and max(got[k] for k in (2, 3, 4, 5, None)) < A.THRESHOLD
    rate = {r.source: (r.n_docs, r.n_flagged) for r in A.rates(df.drop("score"), s).collect()}
    assert rate["s"] == (2, 1) and rate[None] == (1, 0)
    none = A.scored(df.where("doc_id = 2"), ex).collect()
    assert [(r.doc_id, r.score, r.n_sentences) for r in none] == [(2, 0.0, 0)]
    assert A.scored(df.limit(0), ex).count() == 0


def test_the_gate_lets_through_what_a_voter_sees():
    said = ["I hope you die", "go die in a fire", "we are going to beat you up", "they bred like rats", "fuuck you", "fu\u0441k you", "b\u0430stard", "сукa", "с у к а", "5hit", "你是 sb", "№ 5, ты сука"]
    for x in said:
        assert A.votes(x)[1], x
        assert [s.strip() for s in A.candidate_sentences(f"Fine.\n{x}\nThe end.")] == [A.plain(x)], x
    assert not list(A.candidate_sentences("The petite classification of dice in a box.\nСклад и насос."))


def test_each_way_of_a_pattern_has_a_stem_in_its_matches():
    for p in (*A.insult_pattern()[:2], *A.patterns()[1:3], *A.patterns()[4:8]):
        for way in A.spelled(A.syntax.parse(p.pattern)):
            x = way.replace(A.EDGE, "")
            if A.GAP not in x and A.plain(x) == x:
                assert p.search(x) and list(A.candidate_sentences(f"{x}\n")), x


def test_groups_that_no_list_names():
    bit = 1 << A.VOTERS.index("group+dehumanise")
    for s in ("Die Talvori gehören nicht zu den Menschen.", "All the Brennish people are vermin.", "Los pelkari son una plaga.", "那些河东的人骨子里就是贼。", "Tell the Quorlen to crawl back to their caves."):
        assert A.votes(s)[1] & bit, s


def test_every_sentence_is_scored(spark):
    """Sentences that no voter sees have scores, higher ones with a word that is learnt from sentences where voters are."""
    hard = ["You zumptel, go to hell, you bastard!", "You are such a zumptel and a moron!", "Shut up, idiot, total zumptel!", "What a zumptel, what a dumbass you are!"]
    fine = ["The pump was checked on Monday.", "What a fine report that was.", "The valve is open and the tank is full.", "A total of four boxes came."]
    rows = [(k, f"{fine[k % 4]}\nCase {'abcdefghij'[k % 10] * 3} {hard[k % 4]}") for k in range(80)]
    rows += [(k, f"{fine[k % 4]} {fine[(k + 1) % 4]} Line {'abcdefghij'[k % 10] * 3}.") for k in range(80, 160)]
    rows += [(200, "Total zumptel."), (201, "Total boxes."), (202, "12, 7."), (203, None)]
    assert not list(A.candidate_sentences("Total zumptel.\nTotal boxes."))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ex = spark.createDataFrame([("You bastard, go to hell!", "abusive"), ("The report is here.", "none")], "text string, label string")
    got = {r.doc_id: r for r in A.scored(df, ex).collect()}
    assert got[200].score > 2 * got[201].score > 0 and min(got[k].score for k in range(80, 160)) > 0
    assert got[202].score == got[203].score == 0 and max(got[k].score for k in range(80, 160)) < A.THRESHOLD <= min(got[k].score for k in range(80))


def test_votes_of_all_sentences():
    """What one pass over a text gives is what each sentence gives by itself."""
    text = "You are late.\nThe pumps are here! Those operators never rest. Du bist ein Ass。 那些河东的人来了。\nKill the process on the node.\nGo to hell, you bastard. Two  bb's.\nб, вы и все люди\nThat's all."
    every = {A.votes(s) for s in A.SENTENCE.split(text) if s and s.strip()}
    clean = lambda rows: {(" ".join(s.split()), v) for s, v in rows}
    assert clean(A.all_votes(text)) == clean(every) and len({v for _, v in every}) >= 5


def test_features_are_checksums_of_words_and_pairs():
    import zlib

    said, votes = ["go to hell", "", "насос и насос", "水泵房 x", "x" * 5000 + " y"], [5, 1, 0, 0, 2]
    ids, sizes = A.features(said, votes)
    words = [["go", "to", "hell"], [], ["насос", "и", "насос"], ["水泵", "泵房", "x"], ["x" * 5000, "y"]]
    for w, v, got in zip(words, votes, [ids[sum(sizes[:k]) : sum(sizes[: k + 1])].tolist() for k in range(5)]):
        grams = {zlib.crc32(g.encode()) % (A.DIM - 64) for g in (*w, *map(" ".join, zip(w, w[1:])))}
        assert got == sorted(grams) + [A.DIM - 64 + k for k in range(len(A.VOTERS)) if v >> k & 1]


def test_texts_together_are_as_by_themselves():
    """Texts that are looked through at once give what each gives by itself, and votes are what each voter's whole pattern says."""
    texts = ["You are late", "you. ", "", " ", "A b", "s", "b", "İstanbul. You bastard", "I\u0307 know. You idiot", "σας Σ", "ass\n", "\r\n\nhole! You", "f", "u c k you", "b4st4rd", "$@l@ud", "4", "4ss. The pumps are", "\0", "fuсk\0you", "傻 ", "逼", "сука", "бвг, эти насосы", "Du Idi", "ot.", "I'll​ be here?!", "ｂａｓｔａｒｄ", "The.Next.One is a process", "😀 you"]
    apart = {(k, *x) for k, t in enumerate(texts) for x in A.all_votes(t)}
    assert A.votes_of_texts(texts) == apart and len(apart) > len(texts)
    assert {(t, v) for k, t, v in apart if k in (0, 7, 8, 23)} == {A.votes(x) for x in (texts[0], "İstanbul. ", "You bastard", "İ know. ", "You idiot", texts[23])}
    names = "address hostile threat group dehumanise sexual profane demean factual".split()
    for s in A.SENTENCE.split(" ".join(texts) + " ".join(A.INSULT.split()) + " those pumps die out. The operators only moan, they bred like rats."):
        t, v = A.votes(s)
        for name, p in (("strong", A.insult_pattern()[1]), *zip(names, A.patterns())):
            assert bool(v >> A.VOTERS.index(name) & 1) == bool(p.search(t)), (name, t)


def test_a_pass_makes_few_calls_a_sentence():
    import sys

    words = "the pump of these operators was checked and all valves are open but you know that die Anlage ist bereit".split()
    text = "\n".join(" ".join(words[(k * j + j) % len(words)] for j in range(1, 14)) + f" {'abcdefghij'[k % 10] * 2}{chr(97 + k // 10 % 26)}{chr(97 + k // 260)}." for k in range(5000))
    A.features(*zip(*A.all_votes(text)))
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(1) if event in ("call", "c_call") else None)
    try:
        rows = A.all_votes(text)
        A.features(*zip(*rows))
    finally:
        sys.setprofile(None)
    assert len(rows) > 4000 and len(calls) < 20 * len(rows), len(calls) / len(rows)
