from foliomill.llm import boilerplate as B

PAGE = """We use cookies to improve your visit. [Accept all](#) [Reject](#)

Home
Products
Log in

Home » Products » Pump

# Pump

Rev. 4 / Fenbre

The pump confirms the storage tank during the dry season, and the committee reviews it.

ADVERTISEMENT

**Contact for this project:** Murvel, room 6

- [Data sheet](/files/AB-1)
- [Drawing](/files/AB-1)

The contract text is protected by copyright and may not be passed on without consent.

## Schedule 4

| a | b |
| --- | --- |
| 1 | 2 |

```
x = 1
run | pipe
```

Was this page helpful? Yes / No

**Related**
Storage tank Kap
Pump Elf

## Latest posts
- [Tank](/12)
- [Pump](/13)

- Item one was closed under normal load.
- Item two was closed as agreed in writing.

Share of Murvel in the total: 61.4

Imprint | Privacy | Terms
© 2025 Example. All rights reserved."""


def test_frame_lines():
    lines = PAGE.split("\n")
    out = {lines[k - 1] for k in B.frame_lines(PAGE)}
    assert out == {"We use cookies to improve your visit. [Accept all](#) [Reject](#)", "Home", "Products", "Log in", "Home » Products » Pump", "ADVERTISEMENT", "Was this page helpful? Yes / No", "**Related**", "Storage tank Kap", "Pump Elf", "## Latest posts", "- [Tank](/12)", "- [Pump](/13)", "Imprint | Privacy | Terms", "© 2025 Example. All rights reserved."}


def test_defined_results(spark):
    rows = [(1, PAGE), (1, PAGE), (2, None), (3, ""), (4, "# Only a title"), (5, "\n\n \n"), (6, "No title here, but a sentence that is long enough to count as text."), (7, "word " * 100_000), (8, "```\nunclosed")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "result_id long, markdown string").withColumn("main", F.lit(1)).withColumn("k", F.lit(2))
    got = {r.result_id: (r.main, r.dropped) for r in B.main_content(df).collect()}
    assert got[2] == (None, []) and got[3] == ("", []) and got[4][1] == [] and got[5][1] == [] and got[6][1] == [] and got[7][1] == [] and got[8][1] == []
    assert got[1][0].startswith("# Pump\n\nRev. 4") and "cookies" not in got[1][0]
    assert B.main_content(df.limit(0)).count() == 0


def test_web_pages(spark):
    r = spark.createDataFrame([(1, 10, "a"), (2, 11, "b"), (3, None, "c")], "result_id long, source_id long, markdown string")
    s = spark.createDataFrame([(10, "https://x/"), (10, "https://x/"), (11, "/d/x.html"), (12, None)], "source_id long, source_path string")
    assert [x.result_id for x in B.web_pages(r, s).collect()] == [1]
