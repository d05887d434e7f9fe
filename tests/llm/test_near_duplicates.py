import random

import numpy as np

from foliomill.llm import near_duplicates as N


def likeness(a, b):
    x, y = ({t[k : k + 5] for k in range(len(t) - 4)} for t in (N.plain(a), N.plain(b)))
    return len(x & y) / len(x | y)


def brute(rows, percent=70):
    rows = sorted({(k, t) for k, t in rows if k is not None and t and len(N.plain(t)) >= 200})
    return {(a[0], b[0]) for i, a in enumerate(rows) for b in rows[i + 1 :] if a[0] != b[0] and likeness(a[1], b[1]) * 100 >= percent}


def corpus(seed=1, families=30):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(500)] + ["漢字", "é", "Straße"]
    rows, k = [], 1
    for _ in range(families):
        base = [r.choice(words) for _ in range(r.randint(60, 300))]
        for share in (0, 0, 0.02, 0.05, 0.08, 0.12, 0.3):
            t = [r.choice(words) if r.random() < share else w for w in base]
            if r.random() < 0.3:
                cut = r.randrange(len(t))
                t = t[cut:] + t[:cut]
            rows.append((k, " ".join(t)))
            k += 1
    return rows


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    odd = [(1001, None), (1002, ""), (1003, "short"), (None, rows[0][1]), (1004, "z" * 199), (1005, "z" * 200), (1006, "Z Z" + "z" * 198), (1007, "퟿😀" * 150)]
    rows += odd + rows[:3]  # repeated rows count once
    rows += [(rows[0][0], rows[40][1]), (rows[41][0], rows[80][1])]  # keys with a second text
    rows.append((1008, " ".join(str(x) for x in range(60_000))))  # a very long text
    df = spark.createDataFrame(rows, "result_id long, markdown string")
    from pyspark.sql import functions as F

    wide = df.withColumn("k", F.lit("x")).withColumn("h", F.lit(1)).withColumn("t", F.lit("y"))  # names the operator uses itself
    got = [tuple(r) for r in N.pairs(wide).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert (1005, 1006) in set(got)


def test_hot_group_is_tiled(spark):
    """A third of all rows in one group of near copies, more than a tile holds."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = []
    for k in range(400):
        t = list(base)
        t[k % 120] = f"x{k}"
        rows.append((k, " ".join(t)))
    got = {tuple(x) for x in N.pairs(spark.createDataFrame(rows, "result_id long, markdown string")).collect()}
    assert got == {(a, b) for a in range(400) for b in range(a + 1, 400)}


def test_empty(spark):
    df = spark.createDataFrame([], "result_id long, markdown string")
    assert N.pairs(df).count() == 0 and N.groups(df).count() == 0


def test_groups(spark):
    rows = corpus(3, 8) + [(900, None), (901, "short")]
    parent = {k: k for k, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    pairs = brute(rows)
    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.result_id: (r.group, r.n_links) for r in N.groups(spark.createDataFrame(rows, "result_id long, markdown string")).collect()}
    assert {k: g for k, (g, _) in got.items()} == {k: find(k) for k in parent}
    assert got[900] == (900, 0) and got[901] == (901, 0)


def test_signatures():
    s = N.shingles(N.plain("The quick brown fox jumps over the lazy dog. " * 3))
    assert (np.diff(s.astype(object)) > 0).all() and len(N.band_keys(s)) == N.BANDS and len(N.bitmap(s)) == N.BITS // 8
    assert len(N.shingles("abcd")) == 0
