from foliomill.llm.within import pairs_within


def test_groups_of_any_size(spark):
    rows = [(0, k, k % 3) for k in range(150)] + [(1, 500, 0), (2, 600, 1), (2, 601, 1), (2, 602, 2)]
    df = spark.createDataFrame(rows, "g int, k int, s int")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]}
    got = [tuple(r) for r in pairs_within(df, "g", "k", tile=20).collect()]
    assert len(got) == len(want) and set(got) == want
    differ = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[2] != b[2]}
    assert {tuple(r) for r in pairs_within(df, "g", "k", "s", tile=20).collect()} == differ
    assert pairs_within(df.limit(0), "g", "k").count() == 0
