import random

import pytest

from foliomill.llm import splitting as S


def check(data, start, end, limit=300, page_limit=4, overlap=40):
    pages, over, parts = S.pieces(data, start, end, limit, page_limit, overlap)
    at = 0
    for k, (a, z, x, y) in enumerate(parts):
        assert y - x <= limit and 1 <= z - a + 1 <= page_limit
        assert x == 0 if k == 0 else at - overlap <= x <= at
        assert not k or not data or y > at or x == y == len(data)
        at = y
    if data:
        assert at == len(data)
    assert parts and over == (len(data or b"") > limit or pages > page_limit)
    return parts


def test_random_texts():
    r = random.Random(2)
    for n in range(150):
        alphabet = r.choice(["ab ", "abc. \n", "漢字。é😀", "x", "a\f \r\n", "日本 . \f"])
        data = "".join(r.choice(alphabet) for _ in range(r.randrange(1500))).encode()
        s = r.choice([None, 1, 3])
        e = r.choice([None, 1, 9, s])
        for a, z, x, y in check(data, s, e):
            data[x:y].decode()  # no character is broken
    for raw in (b"\x80" * 900, bytes(range(256)) * 5, b"\xff\xfe" * 400):
        check(raw, 1, 1)


def test_boundaries_by_strength():
    data = ("w" * 30 + ". " + "v" * 60 + "\n" + "u" * 60 + "\f" + "t" * 60).encode()
    cuts = [x[3] for x in check(data, 1, 2, 140, 9, 0)]
    assert cuts[0] == data.index(b"\f") + 1 or data[cuts[0] - 1 : cuts[0]] in (b"\f", b"\n")


def test_overlap_repeats_the_end():
    data = b"word " * 400
    parts = check(data, 1, 1, 300, 9, 50)
    assert all(0 < p[3] - q[2] <= 50 for p, q in zip(parts, parts[1:]))


def test_defined_results(spark):
    rows = [(1, 1, 9, None), (2, 9, 1, bytearray(b"")), (3, None, None, bytearray(b"a\fb\fc\fd\fe")), (4, 1, 1, bytearray(b"x" * 9000)), (4, 1, 1, bytearray(b"x" * 9000)), (None, 1, 1, bytearray(b"y")), (6, None, 7, bytearray(b"p\fq"))]
    df = spark.createDataFrame(rows, "chunk_id long, start_page int, end_page int, data binary")
    from pyspark.sql import functions as F

    got = S.split(df.withColumn("k", F.lit(0)).withColumn("s", F.lit(0)), 300, 4, 40).collect()
    by = {}
    for r in got:
        by.setdefault(r.chunk_id, []).append(r)
    assert [(r.start_page, r.end_page, r.data) for r in by[1]] == [(1, 4, None), (5, 8, None), (9, 9, None)] and all(r.over for r in by[1])
    assert [r.data for r in by[2]] == [b"", b"", b""]
    assert [(r.start_page, r.end_page) for r in by[3]] == [(1, 4), (4, 5)] or by[3][-1].end_page == 5
    assert len(by[4]) == 2 * by[4][0].n_pieces and not by[None][0].over
    assert (by[6][0].start_page, by[6][0].end_page) == (6, 7)
    assert S.split(df.limit(0), 300, 4, 40).count() == 0
    with pytest.raises(ValueError):
        S.split(df, 4, 4, 0)
    with pytest.raises(ValueError):
        S.split(df, 100, 4, 51)


def test_weakest_boundary_goes_first():
    """Atoms are words; a sentence's end outlives all word boundaries around it."""
    data = b"aa bb cc. dd ee ff gg. hh ii jj kk ll mm. nn oo pp."
    ends, strength = S.atoms(data, 64)
    assert len(ends) == 16 and strength.count(2) == 3
    assert [data[x:y] for _, _, x, y in check(data, 1, 1, 24, 9, 0)] == [b"aa bb cc. dd ee ff gg. ", b"hh ii jj kk ll mm. ", b"nn oo pp."]


def test_over_means_several_pieces():
    r = random.Random(8)
    for _ in range(80):
        data = "".join(r.choice("ab \f\n.") for _ in range(r.randrange(900))).encode()
        pages, over, parts = S.pieces(data, r.choice([None, 1]), r.choice([None, 2, 8]), 300, 4, 40)
        assert over == (len(parts) > 1)


def test_overlap_keeps_room_for_its_page():
    data = b"\f".join(b"page words here " * 3 for _ in range(12))
    parts = check(data, 1, 12, 4000, 4, 20)
    assert all(q[3] > p[2] for q, p in zip(parts, parts[1:]))
