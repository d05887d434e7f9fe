"""Queries over whole texts: what stands far behind in a text counts, and their SQL agrees."""

import datetime as dt

import duckdb
import pytest

from foliomill.plans.queries import ORACLE, QUERIES

LONG = "Zeile – 线路 – строка\n" * 40
RESULT = "result_id long, source_id long, file_name string, file_type string, ok boolean, markdown string, warnings array<string>, media_paths array<string>, output_dir string, md_path string, arrived_at timestamp"


def result(k, markdown, warnings=None, paths=None):
    return (k, k, f"f{k}", "pdf", True, markdown, warnings, paths, "/out", None, dt.datetime(2025, 1, 1))


@pytest.fixture
def run(spark, tmp_path):
    """Writes a table and gives the query's rows by key, after a comparison with its SQL."""

    def rows(name, table, data, schema):
        spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        got = QUERIES[name](spark, str(tmp_path)).collect()
        con = duckdb.connect()
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        want = con.execute(f"SELECT {', '.join(got[0].__fields__)} FROM ({ORACLE[name]})").fetchall()
        assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
        return {r[0]: r for r in got}

    return rows


def test_images_far_behind_are_stripped(run):
    tail = '![b](data:image/png;base64,CC)<img src="data:x"><img src="y.png">\n\n\n\nend'
    got = run("strip_images_whole", "results", [result(1, LONG + tail), result(2, None), result(3, "")], RESULT)
    assert got[1].data_stripped.endswith(LONG + '[图片]<img src="y.png">\n\nend') and got[1].all_stripped.endswith(LONG + "[图片]\n\nend")


def test_payloads_carry_the_markdown_and_its_guide(run):
    text = LONG + 'a "quoted" \\ tab\t\r\nend \u2028'
    got = run("agent_payload_whole", "results", [result(1, text, ["w"], ["/o/a.png", "/o/b.mp4"]), result(2, None), result(3, "", [])], RESULT)
    assert got[1].payload.startswith(text + "\n\n---\n\n📎 提取了 2 个媒体文件（") and got[1].payload.endswith("\n媒体路径: /o/a.png, /o/b.mp4\n\n⚠️ 警告:\n- w")
    assert got[2].payload == got[3].payload == ""


def test_saved_json_carries_the_markdown(run):
    text = LONG + 'a "quoted" \\ tab\t\r\nend \u2028'
    got = run("saved_json_whole", "results", [result(1, text, None, ["/o/a.png"]), result(2, None), result(3, "")], RESULT)
    assert (got[1].content, got[1].first_path, got[2].content, got[3].content) == (text, "doc_media/a.png", None, "")


def test_ocr_results_carry_the_chunks(run):
    rows = [(k, s, k, 1, 2, "name", None if t is None else t.encode()) for k, s, t in ((1, 1, LONG), (2, 1, None), (3, 1, "  "), (4, 1, 'b "q" \\ \r\n'), (5, 2, None))]
    got = run("ocr_results_whole", "chunks", rows + rows[:1], "chunk_id long, source_id long, chunk_index int, start_page int, end_page int, chunk_name string, data binary")
    assert got[1].markdown == LONG + '\n\nb "q" \\ \r\n' and got[2].markdown == ""


TEXT = "Größe 12 m², <b> & \"x\"\r\n\n  线路\t一\x0b二 \nстрока\rdrei\nстрока\rdrei\n\ufffe"


@pytest.mark.parametrize("kind,want", [("docx", ["线路\t一二", "строка\rdrei"]), ("pptx", ["## Slide 2", "## Slide 3", "线路\t一二", "## Slide 4", "строка\rdrei", "## Slide 5", "строка\rdrei", "## Slide 6"])])
def test_office_files_hold_whole_texts(run, kind, want):
    got = run(f"{kind}_extract_whole", "documents", [(1, TEXT), (2, ""), (3, None), (4, "long " * 50_000)], "doc_id long, text string")
    first = ["# 1." + kind] + ["## Slide 1"] * (kind == "pptx") + ['Größe 12 m², <b> & "x"']
    assert got[1].markdown == "\n\n".join(first + want)
    assert set(got) == {1, 2, 4} and len(got[4].markdown) > 249_000


def test_references_on_odd_pages_count(run, spark, tmp_path):
    run("media_by_reference_whole", "page_images", [(1, 3, 7), (1, 1, 9), (1, 2, 8)], "source_id long, page int, xref int")
    got = QUERIES["media_by_reference_whole"](spark, str(tmp_path)).collect()
    assert {r.xref: r.place for r in got} == {9: 1, 8: 2, 7: 3}
