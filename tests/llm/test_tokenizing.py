import os
import random

import pytest

from foliomill.llm import packing, tokenizing

pytestmark = pytest.mark.skipif(not os.path.isdir(tokenizing.TOKENIZERS), reason="no tokenizer files here")
HARD = ["", " ", "\n \t", "a", "don't", "<|endoftext|>", "é" * 300, "漢字カナ" * 20, "—" * 400, "x" * 2000, "😀👨‍👩‍👧", "퟿͸", "á" * 50, "0123456789" * 30, "  leading", "trailing   ", "\x00\x01\x7f\x80", "नमस्ते שלום 안녕하세요", "\r\n\r\n  x"]


def reference(texts):
    import tiktoken

    file, pattern = tokenizing.paths()
    e = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=tokenizing.vocabulary(file), special_tokens={})
    return [e.encode_ordinary(t or "") for t in texts]


def test_ids_equal_the_library(spark):
    r = random.Random(4)
    texts = HARD + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0xA0, 0x500), r.randrange(0x4E00, 0x9FFF), r.randrange(0x1F300, 0x1F700)])) for _ in range(r.randrange(200))) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate([*texts, None])]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("k", F.lit(1)).withColumn("t", F.lit(2)).withColumn("ids", F.lit(3))
    got = {r.doc_id: r.ids for r in tokenizing.token_ids(df).collect()}
    assert [got[k] for k in range(len(rows))] == reference([t for _, t in rows])
    counts = {r.doc_id: r.n for r in tokenizing.token_ids(df, out="n", count_only=True).collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert tokenizing.token_ids(df.limit(0)).count() == 0


def own(**more):
    file, pattern = tokenizing.paths()
    return tokenizing.Bpe(tokenizing.vocabulary(file), pattern, **more)


def test_long_words():
    """One word of a megabyte without a place to cut, and many of some thousand bytes."""
    import resource

    r = random.Random(9)
    one = ["ab" * 500_000, "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(50_000)), "a" * 100_001, "-" * 7_000, "=-" * 901 + "=" * 77, "0123456789" * 3001]
    parts = ["".join(r.choice("etaoinshrdlu") for _ in range(50)) for _ in range(20)]
    many = ["".join(r.choice(parts) for _ in range(100)) for _ in range(4096)]
    b = own()
    assert b.encode_batch(one) == reference(one)
    assert b.encode_batch(many) == reference(many)
    assert not any(len(w) > tokenizing.LONG for w in b.known) and not any(len(p) > tokenizing.LONG for p in b.pieces)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss < 3_000_000  # KB, of the test process as a whole


def test_rounds_without_recursion():
    b = own()
    words = ["ab" * 40, "internationalisation", "xyzzy" * 9]
    assert [list(b.one(w.encode())) for w in words] == reference(words)


def test_portions(monkeypatch):
    monkeypatch.setattr(tokenizing, "BATCH_BYTES", 10)
    assert list(tokenizing.portions([None, "a" * 12, "b", "", "c" * 9])) == [(0, 2), (2, 5)] and list(tokenizing.portions([])) == []


def test_memo_is_bounded():
    b = own(memo=10)
    texts = [f"word{k} and {k * 7} Übergröße{k}" for k in range(60)]
    assert [x for t in texts for x in b.encode_batch([t])] == reference(texts)
    assert len(b.known) < 40


def brute_fullest(counts, capacity):
    best = 0
    first = max(counts)
    reach = {first}
    left = dict(counts)
    left[first] -= 1
    for k, n in left.items():
        for _ in range(n):
            reach |= {x + k for x in reach if x + k <= capacity}
    return max(reach, default=best)


def test_fullest_is_optimal():
    r = random.Random(3)
    for _ in range(200):
        counts = {}
        for _ in range(r.randint(1, 12)):
            k = r.randint(1, 40)
            counts[k] = counts.get(k, 0) + r.randint(1, 3)
        use = packing.fullest(dict(counts), 40)
        assert all(n <= counts[k] for k, n in use.items()) and use[max(counts)] >= 1
        assert sum(k * n for k, n in use.items()) == brute_fullest(counts, 40)


def test_pack(spark):
    r = random.Random(1)
    rows = [(k, r.choice([0, 1, 5, 33, 64, 64, 64, 100, 101, 250, None, -3])) for k in range(3000)] + [(9999, 10), (9999, 10)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, size int").withColumn("n", F.lit("x")).withColumn("salt", F.lit(1))
    got = packing.pack(df, "doc_id", "size", 100, salts=7).collect()
    load = {}
    for x in got:
        load[x.container] = load.get(x.container, 0) + x.n_tokens
    total = sum(max(s or 0, 0) for _, s in rows)
    assert max(load.values()) <= 100 and sum(load.values()) == total
    assert len(load) <= -(-total // 100) * 1.15
    small = packing.pack(spark.createDataFrame([(k, r.randint(1, 60)) for k in range(2000)], "doc_id long, size int"), "doc_id", "size", 100).collect()
    assert len({x.container for x in small}) <= -(-sum(x.n_tokens for x in small) // 100) + 2
    pieces = {}
    for x in got:
        pieces.setdefault(x.doc_id, []).append((x.piece, x.start, x.n_tokens))
    for k, s in rows[:-2]:
        p = sorted(pieces[k])
        assert sum(n for _, _, n in p) == max(s or 0, 0) and len(p) == max(1, -(-max(s or 0, 0) // 100)) and [a for _, a, _ in p] == [100 * i for i in range(len(p))]
    assert len(pieces[9999]) == 2
    assert packing.pack(df.limit(0), "doc_id", "size", 100).count() == 0
    assert {x.container for x in packing.pack(df.where("size = 0"), "doc_id", "size", 100).collect()} == {0}
    with pytest.raises(ValueError):
        packing.pack(df, "doc_id", "size", 0)
