"""Queries of the engine's own operators, each over its whole tables, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import budget, cells, html
from ..functions import media as M
from ..functions import text as T
from ..operators import chain, media, pages, report, rows, sheets
from ..session import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with the SQL for it."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def results(s: SparkSession, d: str) -> DataFrame:
    return rows.latest(read(s, d, "results"), "result_id")


def attempts(s: SparkSession, d: str) -> DataFrame:
    return rows.latest(read(s, d, "attempts"), "attempt_id")


def sources(s: SparkSession, d: str, *more: str) -> DataFrame:
    """Sources once, with their path and the columns asked for; repeated rows are equal throughout."""
    return read(s, d, "sources").select("source_id", "source_path", *more).distinct()


def as_text(c):
    """An array of numbers as text, which both engines write alike."""
    return F.array_join(c.cast("array<string>"), ",")


# SQL fragments.
RES = "(SELECT * FROM results QUALIFY row_number() OVER (PARTITION BY result_id ORDER BY arrived_at DESC) = 1)"
ATT = "(SELECT * FROM attempts QUALIFY row_number() OVER (PARTITION BY attempt_id ORDER BY arrived_at DESC) = 1)"
SRC = "(SELECT DISTINCT * FROM sources)"
IMAGE, VIDEO, AUDIO = (", ".join(f"'{e}'" for e in M.KINDS[k]) for k in ("image", "video", "audio"))
SUFFIX = "lower(regexp_extract(list_last(string_split({0}, '/')), '^.+\\.([^.]*)$', 1))"
TYPE = "CASE " + " ".join(f"WHEN {{0}} IN ({', '.join(repr(e) for e in v)}) THEN '{k}'" for k, v in M.FILE_TYPES.items()) + " ELSE 'unknown' END"
KIND = f"CASE WHEN {{0}} IN ({IMAGE}) THEN 'image' WHEN {{0}} IN ({VIDEO}) THEN 'video' WHEN {{0}} IN ({AUDIO}) THEN 'audio' ELSE 'other' END"
WS = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query(f"""SELECT result_id, file_type, ok, coalesce(len(media_paths), 0) AS n_media, coalesce(len(warnings), 0) AS n_warnings, coalesce(length(markdown), 0) AS chars,
  length(regexp_replace(coalesce(markdown, ''), '{WS}', '', 'g')) AS non_blank FROM {RES}""")
def result_overview(s, d):
    r = results(s, d)
    g = T.garble_counts(F.col("markdown"))
    return r.select("result_id", "file_type", "ok", F.coalesce(F.size("media_paths"), F.lit(0)).alias("n_media"), F.coalesce(F.size("warnings"), F.lit(0)).alias("n_warnings"), F.coalesce(F.length("markdown"), F.lit(0)).alias("chars"), g["total"].alias("non_blank"))


@query(f"SELECT source_path, count(*) AS n, CASE WHEN regexp_matches(source_path, '^https?://') THEN 'html' ELSE {TYPE.format(SUFFIX.format('source_path'))} END AS detected, CASE WHEN detected IN ('docx','doc','pptx','ppt','xlsx','xls','xlsm') THEN 'office' ELSE detected END AS coarse FROM sources GROUP BY source_path")
def file_types(s, d):
    x = F.col("source_path")
    return read(s, d, "sources").groupBy("source_path").agg(F.count("*").alias("n")).select("source_path", "n", M.file_type(x).alias("detected"), M.coarse_type(x).alias("coarse"))


@query(f"SELECT source_id, array_to_string(list_sort(list_distinct(list_filter(generate_series(1, total_pages), lambda p: len(list_filter(string_split(regexp_replace(coalesce(page_range, ''), '\\s', '', 'g'), ','), lambda x: regexp_full_match(x, '[0-9]+(-[0-9]+)?') AND p BETWEEN least(try_cast(string_split(x, '-')[1] AS HUGEINT), try_cast(list_last(string_split(x, '-')) AS HUGEINT)) AND greatest(try_cast(string_split(x, '-')[1] AS HUGEINT), try_cast(list_last(string_split(x, '-')) AS HUGEINT)))) > 0 OR regexp_replace(coalesce(page_range, ''), '\\s', '', 'g') = ''))), ',') AS pages FROM {SRC} WHERE total_pages IS NOT NULL")
def page_selection(s, d):
    x = sources(s, d, "page_range", "total_pages").where("total_pages IS NOT NULL")
    return x.select("source_id", as_text(pages.selected(F.col("page_range"), F.col("total_pages"))).alias("pages"))


@query(f"""SELECT source_id, g AS chunk_index, (g - 1) * 20 + 1 AS start_page, least(g * 20, total_pages) AS end_page,
  regexp_replace(list_last(string_split(source_path, '/')), '(.)\\.[^.]*$', '\\1') || '_chunk_' || lpad(g::VARCHAR, 3, '0') || '.pdf' AS chunk_name
  FROM (SELECT *, unnest(generate_series(1, ceil(total_pages / 20.0)::INT))::INT AS g FROM {SRC} WHERE total_pages > 20)""")
def page_chunks(s, d):
    return pages.chunks(sources(s, d, "total_pages"), "total_pages", "source_path", 20).select("source_id", "chunk_index", "start_page", "end_page", "chunk_name")


PLACED = """(WITH b AS (SELECT *, least(y0, coalesce(y1, y0)) AS top, least(x0, coalesce(x1, x0)) AS lft FROM page_images WHERE y0 IS NOT NULL AND x0 IS NOT NULL),
 o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source_id, page, xref ORDER BY top, lft, coalesce(ext, '')) = 1),
 n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY page, xref) AS number FROM o)
 SELECT *, row_number() OVER (PARTITION BY source_id, page ORDER BY round_even(top / 5, 0), lft, xref) AS place FROM n)"""


@query(f"SELECT source_id, page, xref, number::INT AS number, place::INT AS place, 'image_' || CASE WHEN number < 1000 THEN lpad(number::VARCHAR, 3, '0') ELSE number::VARCHAR END || CASE WHEN coalesce(ext, '') = '' THEN '' WHEN starts_with(ext, '.') THEN lower(ext) ELSE '.' || lower(ext) END AS name FROM {PLACED}")
def placed_images(s, d):
    x = pages.placed(read(s, d, "page_images"))
    return x.select("source_id", "page", "xref", "number", "place", M.file_name(F.lit("image"), F.col("number"), F.col("ext")).alias("name"))


BLOCKS = "(SELECT page_no, block_no, y0 FROM (SELECT unnest(generate_series(1, 12))::INT AS block_no, unnest(generate_series(1, 12)) * 61.0 - (unnest(generate_series(1, 12)) % 3) * 40.0 AS y0, 1 AS page_no))"


@query(f"""SELECT i.source_id, i.page, i.xref, (SELECT min(b.block_no) FROM {BLOCKS} b WHERE b.y0 > i.top) AS before FROM {PLACED} i""")
def image_interleave(s, d):
    img = pages.placed(read(s, d, "page_images")).withColumn("page_no", F.lit(1)).select("source_id", "page", "xref", "top", "page_no")
    blocks = img.select("source_id", "page").distinct().withColumn("block_no", F.explode(F.sequence(F.lit(1), F.lit(12))))
    blocks = blocks.withColumn("y0", F.col("block_no") * 61.0 - (F.col("block_no") % 3) * 40.0)
    return pages.interleaved(blocks, img, ["source_id", "page"]).select("source_id", "page", "xref", "before")


CHUNKS = "(SELECT DISTINCT chunk_id, source_id, chunk_index, start_page, end_page, chunk_name, decode(data) AS body FROM chunks WHERE data IS NOT NULL)"


def chunk_pages(s, d):
    c = read(s, d, "chunks").distinct().where("data IS NOT NULL")
    return c.select("chunk_id", "source_id", "chunk_index", F.posexplode(F.split(F.decode("data", "UTF-8"), "\f")).alias("k", "text")).withColumn("page", F.col("k") + 1)


@query(f"""SELECT chunk_id, count(*) AS pages, count(*) FILTER (WHERE regexp_replace(p, '[ \\t\\n\\v\\f\\r]', '', 'g') = '') AS empty_pages, sum(length(p))::BIGINT AS chars, sum(length(regexp_replace(p, '[ \\t\\n\\v\\f\\r]', '', 'g')))::BIGINT AS non_blank
  FROM (SELECT chunk_id, unnest(string_split(body, chr(12))) AS p FROM {CHUNKS}) GROUP BY chunk_id""")
def page_statistics(s, d):
    return pages.statistics(chunk_pages(s, d), ["chunk_id"], "text")


@query(f"""SELECT chunk_id, '# PDF 本地提取结果' || chr(10) || chr(10) || '源文件: ' || coalesce(chunk_name, '') || chr(10) || '提取页: ' || len(ps) || chr(10) || '字符总数: ' || list_sum(list_transform(ps, lambda x: length(x))) || chr(10) || chr(10) ||
  array_to_string(list_transform(ps, lambda x, i: '## Page ' || i || chr(10) || chr(10) || CASE WHEN regexp_replace(x, '[ \\t\\n\\v\\f\\r]', '', 'g') = '' THEN '<!-- page ' || i || ' is empty -->' ELSE x END), chr(10) || chr(10)) AS markdown
  FROM (SELECT chunk_id, chunk_name, string_split(body, chr(12)) AS ps FROM {CHUNKS})""")
def page_assembly(s, d):
    c = read(s, d, "chunks").distinct().where("data IS NOT NULL")
    p = c.select("chunk_id", "chunk_name", F.posexplode(F.split(F.decode("data", "UTF-8"), "\f")).alias("k", "text")).withColumn("page", F.col("k") + 1)
    return pages.assembled(p, "chunk_id", "chunk_name")


MEDIA = f"(SELECT result_id, md_path, file_name, p AS path, k AS pos, {KIND.format(SUFFIX.format('p'))} AS kind, {SUFFIX.format('p')} AS ext FROM (SELECT *, unnest(media_paths) AS p, generate_subscripts(media_paths, 1) AS k FROM {RES} WHERE media_paths IS NOT NULL) WHERE p IS NOT NULL)"


def media_rows(s, d):
    r = results(s, d).select("result_id", "md_path", "file_name", F.posexplode("media_paths").alias("pos", "path")).where("path IS NOT NULL")
    return r.withColumn("pos", F.col("pos") + 1).withColumn("ext", M.suffix(F.col("path"))).withColumn("kind", M.classify(F.col("ext")))


@query(f"SELECT result_id, count(*) FILTER (WHERE kind = 'image') AS image, count(*) FILTER (WHERE kind = 'video') AS video, count(*) FILTER (WHERE kind = 'audio') AS audio, count(*) FILTER (WHERE kind = 'other') AS other FROM {MEDIA} GROUP BY result_id")
def media_kind_counts(s, d):
    return media_rows(s, d).groupBy("result_id").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in ("image", "video", "audio", "other")))


@query(f"SELECT result_id, path, number::INT AS number, CASE WHEN kind = 'other' THEN 'media' ELSE kind END || '_' || CASE WHEN number < 1000 THEN lpad(number::VARCHAR, 3, '0') ELSE number::VARCHAR END || CASE WHEN ext = '' THEN '' ELSE '.' || ext END AS new_name FROM (SELECT *, row_number() OVER (PARTITION BY result_id, kind ORDER BY pos) AS number FROM {MEDIA})")
def media_numbering(s, d):
    return media.numbered(media_rows(s, d), "result_id", "kind", [F.col("pos")], "ext").select("result_id", "path", "number", "new_name")


@query(f"""SELECT result_id, pos, CASE WHEN kind IN ('video', 'audio') THEN '<' || kind || ' controls src="' || replace(path, ' ', '%20') || '"' || CASE WHEN trim(replace(file_name, '"', '&quot;'), ' ') = '' THEN '' ELSE ' title="' || trim(replace(file_name, '"', '&quot;'), ' ') || '"' END || '></' || kind || '>' ELSE '![' || coalesce(file_name, '') || '](' || replace(path, ' ', '%20') || ')' END AS reference FROM {MEDIA}""")
def media_references(s, d):
    return media_rows(s, d).select("result_id", "pos", M.reference(F.col("path"), F.col("kind"), F.col("file_name")).alias("reference"))


@query(f"SELECT result_id, CASE WHEN len(media_paths) <= 2 THEN array_to_string(media_paths, '|') END AS paths, CASE WHEN len(media_paths) > 2 THEN len(media_paths) END AS n FROM {RES} WHERE media_paths IS NOT NULL")
def media_path_limit(s, d):
    p, n = media.returned_paths(F.col("media_paths"), 2)
    return results(s, d).where("media_paths IS NOT NULL").select("result_id", F.array_join(p, "|").alias("paths"), n.alias("n"))


def guide_of(r):
    """The guide to the media of results' rows, '' without any."""
    some = F.filter(F.coalesce("media_paths", F.array().cast("array<string>")), lambda p: p.isNotNull())
    kinds = F.transform(some, lambda p: M.classify(M.suffix(p)))
    return M.guide({k: F.size(kinds) - F.size(F.array_remove(kinds, k)) for k in ("image", "video", "audio", "other")}, F.col("output_dir").isNotNull())


@query(f"""SELECT result_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) || '📎 提取了 ' || n || ' 个媒体文件' || CASE WHEN len(parts) > 1 THEN '（' || array_to_string(parts, '、') || '）' ELSE '' END || CASE WHEN output_dir IS NOT NULL THEN '，已保存到本地' ELSE '' END || '。请先阅读以上媒体，再结合文档内容回复。' AS guide
  FROM (SELECT r.result_id, r.output_dir, n, list_filter([CASE WHEN i > 0 THEN '📷 ' || i || ' 图片' END, CASE WHEN v > 0 THEN '🎬 ' || v || ' 视频' END, CASE WHEN a > 0 THEN '🎵 ' || a || ' 音频' END, CASE WHEN o > 0 THEN '📎 ' || o || ' 媒体' END], lambda x: x IS NOT NULL) AS parts
    FROM {RES} r JOIN (SELECT result_id, count(*) AS n, count(*) FILTER (WHERE kind = 'image') AS i, count(*) FILTER (WHERE kind = 'video') AS v, count(*) FILTER (WHERE kind = 'audio') AS a, count(*) FILTER (WHERE kind = 'other') AS o FROM {MEDIA} GROUP BY 1) m USING (result_id))""")
def media_guide(s, d):
    r = results(s, d).where(F.size("media_paths") > 0)
    return r.select("result_id", guide_of(r).alias("guide")).where("guide <> ''")


@query("SELECT source_id, xref, min(page)::INT AS page, arg_max(kind, rank) AS kind FROM (SELECT source_id, xref, page, CASE WHEN lower(ext) IN ('png','jpeg','jpg') THEN 'image' WHEN lower(ext) IN ('bmp') THEN 'video' ELSE 'other' END AS kind, CASE WHEN lower(ext) IN ('png','jpeg','jpg') THEN 1 WHEN lower(ext) IN ('bmp') THEN 3 ELSE 0 END AS rank FROM page_images) GROUP BY source_id, xref")
def media_kind_upgrade(s, d):
    e = F.lower("ext")
    x = read(s, d, "page_images").withColumn("kind", F.when(e.isin("png", "jpeg", "jpg"), "image").when(e.isin("bmp"), "video").otherwise("other"))
    return media.upgraded(x, ["source_id", "xref"], "kind", "page")


DETECT = f"CASE WHEN regexp_matches(source_path, '^https?://') THEN 'html' ELSE {TYPE.format(SUFFIX.format('source_path'))} END"


@query(f"SELECT source_id, t AS file_type, array_to_string(c, ',') AS chain, CASE WHEN t IN ('doc', 'xls', 'ppt') THEN 'legacy' WHEN c = ['local'] THEN 'local' ELSE 'api' END AS pool FROM (SELECT source_id, t, CASE t WHEN 'pdf' THEN ['mineru', 'paddleocr', 'local'] WHEN 'image' THEN ['paddleocr'] ELSE ['local'] END AS c FROM (SELECT source_id, {DETECT} AS t FROM {SRC}))")
def backend_chain(s, d):
    x = sources(s, d).select("source_id", M.file_type(F.col("source_path")).alias("file_type"))
    x = x.withColumn("c", chain.chain(F.col("file_type"), F.lit(None).cast("string"), F.array(F.lit("mineru"), F.lit("paddleocr"), F.lit("local"))))
    return x.select("source_id", "file_type", F.array_join("c", ",").alias("chain"), chain.pool(F.col("file_type"), F.col("c")).alias("pool"))


@query(f"""WITH a AS (SELECT * FROM {ATT}), w AS (SELECT result_id, min(ord) FILTER (WHERE ok AND backend IS NOT NULL) AS used_ord FROM a GROUP BY 1)
  SELECT w.result_id, max(a.backend) FILTER (WHERE a.ord = w.used_ord) AS used_backend, w.used_ord, w.used_ord IS NOT NULL AS in_chain,
  coalesce(string_agg(coalesce(a.backend, '?') || ': ' || coalesce(a.reason, ''), chr(10) ORDER BY a.ord, a.backend NULLS FIRST, a.reason NULLS FIRST) FILTER (WHERE NOT coalesce(a.ok, false) AND (w.used_ord IS NULL OR a.ord < w.used_ord)), '') AS failures
  FROM w JOIN a USING (result_id) GROUP BY w.result_id, w.used_ord""")
def first_success(s, d):
    return chain.first_success(attempts(s, d), "result_id").withColumn("failures", F.array_join("failures", "\n"))


@query(f"SELECT result_id, coalesce(markdown, '') <> '' AND NOT starts_with(markdown, '# 错误') OR coalesce(len(media_paths), 0) > 0 AS success FROM {RES}")
def success_predicate(s, d):
    return results(s, d).select("result_id", chain.succeeded(F.col("markdown"), F.col("media_paths")).alias("success"))


@query(f"SELECT reason, count(*) AS n, coalesce(regexp_matches(lower(reason), 'auth|token|401|403|quota|limit'), false) AS auth FROM {ATT} WHERE NOT ok GROUP BY reason")
def auth_errors(s, d):
    return attempts(s, d).where("NOT ok").groupBy("reason").agg(F.count("*").alias("n")).select("reason", "n", chain.auth_error(F.col("reason")).alias("auth"))


STATUS = "[429, 500, 502, 503, 504, 400, 401, 403, 404, 410, 422, 200][attempt_id % 12 + 1]"


@query(f"SELECT attempt_id, status, CASE WHEN status IN (429,500,502,503,504) THEN true WHEN status IN (400,401,403,404,410,422) THEN false END AS retry, CASE WHEN status = 429 THEN 8000 * 2 ** (ord - 1) WHEN status >= 500 THEN 1000 * 2 ** (ord - 1) END::BIGINT AS wait_ms FROM (SELECT attempt_id, ord, {STATUS} AS status FROM {ATT})")
def retry_policy(s, d):
    codes = F.array(*(F.lit(x) for x in (429, 500, 502, 503, 504, 400, 401, 403, 404, 410, 422, 200)))
    x = attempts(s, d).select("attempt_id", "ord", F.get(codes, (F.col("attempt_id") % 12).cast("int")).alias("status"))
    return x.select("attempt_id", "status", chain.retryable(F.col("status")).alias("retry"), chain.backoff_ms(F.col("status"), F.col("ord") - 1).alias("wait_ms"))


@query(f"""WITH p AS (SELECT batch_id, backend, max(CASE WHEN NOT coalesce(ok, false) AND coalesce(regexp_matches(lower(reason), 'auth|token|401|403|quota|limit'), false) THEN 1 ELSE 0 END) AS bad, min(attempt_id) FILTER (WHERE ok) AS good FROM {ATT} GROUP BY 1, 2)
  SELECT batch_id, count(*) AS total, sum(bad)::BIGINT AS failed, count(*) - sum(bad)::BIGINT AS available, arg_min(backend, good) FILTER (WHERE bad = 0 AND good IS NOT NULL) AS first_good FROM p GROUP BY batch_id""")
def credential_failover(s, d):
    return chain.failover(attempts(s, d), "batch_id", "attempt_id", "backend", "ok", "reason")


@query(f"SELECT result_id, founder, rare, total, CASE WHEN total > 0 AND founder / total >= 0.005 THEN 'founder' WHEN total > 0 AND rare / total >= 0.005 THEN 'rare' END AS warning FROM (SELECT result_id, length(m) - length(regexp_replace(m, '[\\x{{7280}}-\\x{{72FF}}]', '', 'g')) AS founder, length(m) - length(regexp_replace(m, '[\\x{{20000}}-\\x{{2FA1F}}\\x{{30000}}-\\x{{323AF}}]', '', 'g')) AS rare, length(regexp_replace(m, '{WS}', '', 'g')) AS total FROM (SELECT result_id, coalesce(markdown, '') AS m FROM {RES}))")
def garble_warnings(s, d):
    x = results(s, d).select("result_id", *(c.alias(k) for k, c in T.garble_counts(F.col("markdown")).items()))
    return x.withColumn("warning", T.garble_warning(F.col("founder"), F.col("rare"), F.col("total")))


@query(f"SELECT doc_id, CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END AS words FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[#*`_\\[\\](){{}}|>!-]', '', 'g'), '{WS}+', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL)")
def word_counts(s, d):
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", T.word_count(F.col("text")).alias("words"))


DATA_MD = "concat(coalesce(file_name, ''), '![a](data:image/png;base64,AAAA) <IMG src=\"data:image/gif;base64,BB\"> <img src=\"x.png\">', chr(10), chr(10), chr(10), chr(10), coalesce(left(markdown, 200), ''))"


@query(f"""SELECT result_id, regexp_replace(regexp_replace(regexp_replace(m, '!\\[([^\\]]*)\\]\\((data:[^)]+)\\)', '[图片]', 'g'), '<img[^>]*\\bsrc="(data:[^"]+)"[^>]*>', '', 'gi'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS data_stripped,
  regexp_replace(regexp_replace(regexp_replace(m, '!\\[([^\\]]*)\\]\\((data:[^)]+)\\)', '[图片]', 'g'), '<img\\b[^>]*>', '', 'gi'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS all_stripped FROM (SELECT result_id, {DATA_MD} AS m FROM {RES})""")
def strip_images(s, d):
    m = F.expr(DATA_MD.replace("chr(10)", "char(10)"))
    return results(s, d).select("result_id", T.strip_data_images(m).alias("data_stripped"), T.strip_image_tags(m).alias("all_stripped"))


WHOLE_MD = DATA_MD.replace("left(markdown, 200)", "markdown")


@query(ORACLE["strip_images"].replace(DATA_MD, WHOLE_MD))
def strip_images_whole(s, d):
    """As strip_images, over each result's whole Markdown."""
    m = F.expr(WHOLE_MD.replace("chr(10)", "char(10)"))
    return results(s, d).select("result_id", T.strip_data_images(m).alias("data_stripped"), T.strip_image_tags(m).alias("all_stripped"))


@query(f"SELECT attempt_id, replace(replace(coalesce(backend, '') || ' key ' || batch_id || ' ' || coalesce(reason, ''), batch_id, '[REDACTED]'), 'quota', '[REDACTED]') AS message, CASE WHEN coalesce(length(batch_id), 0) < 8 THEN '***' ELSE left(batch_id, 4) || '...' || right(batch_id, 4) END AS masked FROM {ATT}")
def redaction(s, d):
    m = F.concat(F.coalesce("backend", F.lit("")), F.lit(" key "), F.col("batch_id"), F.lit(" "), F.coalesce("reason", F.lit("")))
    return attempts(s, d).select("attempt_id", T.redact(m, F.array(F.col("batch_id"), F.lit("quota"))).alias("message"), T.mask(F.col("batch_id")).alias("masked"))


@query(f"""SELECT source_id, CASE WHEN regexp_matches(source_path, '^https?://') THEN '<remote-url>' ELSE list_last(string_split(source_path, '/')) END AS shown,
  left(regexp_replace(CASE WHEN regexp_matches(source_path, '^https?://') THEN replace(regexp_extract(source_path, '^https?://(?:[^/?#@]*@)?([^/?#]*)', 1), '.', '_') ELSE regexp_replace(list_last(string_split(source_path, '/')), '(.)\\.[^.]*$', '\\1') END, '[<>:"/\\\\|?*]', '_', 'g'), 50) AS stem FROM {SRC}""")
def source_names(s, d):
    x = F.col("source_path")
    return sources(s, d).select("source_id", T.display_source(x).alias("shown"), T.safe_stem(x).alias("stem"))


PAGE = """concat('<html><head><title> ', coalesce(s.source_path, ''), ' </title><meta name="author" content="B', s.source_id, '"><meta content="k', s.source_id % 7, '" name="keywords"><meta property="og:title" content="', CASE WHEN s.source_id % 3 = 0 THEN '' ELSE concat('T', s.source_id) END, '"><link rel="canonical" href="', coalesce(s.source_path, ''), '"></head><body><h1>Head <b>', s.source_id, '</b></h1><H2 class="x"> ', coalesce(s.page_range, ''), ' </H2><a class="n" href="', coalesce(s.source_path, ''), '"> go <i>', s.total_pages, '</i></a><a href=''#top''>top</a><a href="javascript:x()">j</a><img src="/i/', s.source_id, '.PNG" alt="a"><img src="/i/', s.source_id % 5, '.bin"><video poster="p.jpg"><source src="v', s.source_id % 2, '.mp4"></video><audio src="a.xyz"></audio><img src="/i/', s.source_id, '.PNG"><pre><code class="py">a &lt; b &amp;&amp; c</code></pre></body></html>')"""
PAGE = PAGE.replace("s.total_pages", "coalesce(s.total_pages, 0)")


def derived_pages(s, d):
    return sources(s, d, "page_range", "total_pages").alias("s").select("source_id", F.expr(PAGE).alias("html"))


DPAGE = f"(SELECT source_id, {PAGE} AS html FROM {SRC} s)"
TITLE = "regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\\s+|\\s+$', '', 'g')"


def _sql_meta(a: str, n: str) -> str:
    p = f"'(?i)<meta\\s+(?:{a}=\"{n}\"[^>]*content=\"([^\"]*)\"|content=\"([^\"]*)\"[^>]*{a}=\"{n}\")'"
    return f"coalesce(nullif(regexp_extract(html, {p}, 1), ''), nullif(regexp_extract(html, {p}, 2), ''))"


@query(f"""SELECT source_id, coalesce({_sql_meta('property', 'og:title')}, nullif({TITLE}, ''), '') AS title, {_sql_meta('name', 'author')} AS author, {_sql_meta('name', 'keywords')} AS keywords, nullif(regexp_extract(html, '(?i)<link\\s+rel="canonical"\\s+href="([^"]*)"', 1), '') AS canonical FROM {DPAGE}""")
def html_metadata(s, d):
    m = html.metadata(F.col("html"))
    return derived_pages(s, d).select("source_id", m["标题"].alias("title"), m["作者"].alias("author"), m["关键词"].alias("keywords"), m["原始链接"].alias("canonical"))


LINKS = """list_filter(list_zip(regexp_extract_all(html, '(?is)<a\\s+[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 1), regexp_extract_all(html, '(?is)<a\\s+[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', 2)), lambda x: NOT starts_with(x[1], '#') AND NOT starts_with(x[1], 'javascript:'))"""


@query(f"SELECT source_id, array_to_string(list_transform({LINKS}, lambda x: x[1] || '=' || regexp_replace(regexp_replace(x[2], '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g')), ';') AS links FROM {DPAGE}")
def html_links(s, d):
    return derived_pages(s, d).select("source_id", F.array_join(F.transform(html.links(F.col("html")), lambda x: F.concat(x["url"], F.lit("="), x["text"])), ";").alias("links"))


HEADS = "list_filter(list_transform(regexp_extract_all(html, '(?is)<h1[^>]*>.*?</h1>|<h2[^>]*>.*?</h2>|<h3[^>]*>.*?</h3>'), lambda x: x[3] || ':' || regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 2)"


@query(f"SELECT source_id, array_to_string({HEADS}, ';') AS headings FROM {DPAGE}")
def html_headings(s, d):
    return derived_pages(s, d).select("source_id", F.array_join(F.transform(html.headings(F.col("html")), lambda x: F.concat(x["level"].cast("string"), F.lit(":"), x["text"])), ";").alias("headings"))


@query(f"""SELECT source_id, '|image|img|' || '/i/' || source_id || '.PNG;|other|img|/i/' || source_id % 5 || '.bin;p.jpg|video|video|v' || source_id % 2 || '.mp4;|audio|audio|a.xyz' AS media, 'a < b && c' AS code FROM {SRC}""")
def html_media(s, d):
    x = F.transform(html.media(F.col("html")), lambda m: F.concat_ws("|", m["poster"], m["kind"], m["tag"], m["src"]))
    c = F.transform(html.code_blocks(F.col("html")), lambda b: b["code"])
    return derived_pages(s, d).select("source_id", F.array_join(x, ";").alias("media"), F.array_join(c, ";").alias("code"))


PLAYER = "concat('See [clip](https://h.example/v/', s.source_id, '.mp4) and `[x](https://h.example/a.mp3)` and [](https://h.example/b', s.source_id % 3, '.wav)')"


@query(f"""SELECT source_id, 'See <video controls src="https://h.example/v/' || source_id || '.mp4" title="clip"></video> and `[x](https://h.example/a.mp3)` and <audio controls src="https://h.example/b' || source_id % 3 || '.wav" title="b' || source_id % 3 || '"></audio>' AS restored FROM {SRC}""")
def player_restore(s, d):
    return sources(s, d).alias("s").select("source_id", html.restore_players(F.expr(PLAYER)).alias("restored"))


@query("""WITH c AS (SELECT l_returnflag AS sheet, (l_orderkey % 40 + 1)::INT AS r, (l_linenumber + l_partkey % 3)::INT AS c, max(l_quantity)::INT::VARCHAR || '|' || min(l_linestatus) AS t FROM lineitem GROUP BY 1, 2, 3),
 k AS (SELECT * FROM c WHERE r <= 25 AND c <= 6), w AS (SELECT sheet, max(r) AS h, max(c) AS w FROM k GROUP BY 1),
 g AS (SELECT w.sheet, w.w, rr.r, '| ' || string_agg(coalesce(replace(k.t, '|', '\\|'), ''), ' | ' ORDER BY cc.c) || ' |' AS line FROM w, unnest(generate_series(1, w.h)) rr(r), unnest(generate_series(1, w.w)) cc(c) LEFT JOIN k ON k.sheet = w.sheet AND k.r = rr.r AND k.c = cc.c GROUP BY 1, 2, 3)
 SELECT sheet, '## Sheet: ' || sheet || chr(10) || chr(10) || max(line) FILTER (WHERE r = 1) || chr(10) || '| ' || array_to_string(list_transform(generate_series(1, max(w)), lambda x: '---'), ' | ') || ' |' || chr(10) || string_agg(line, chr(10) ORDER BY r) FILTER (WHERE r > 1) || chr(10) || chr(10) || '*已截断到 25 行*' || chr(10) || '*已截断到 6 列*' AS markdown FROM g GROUP BY sheet""")
def sheet_markdown(s, d):
    x = read(s, d, "lineitem")
    c = x.groupBy(F.lit("book").alias("doc"), F.col("l_returnflag").alias("sheet"), (F.col("l_orderkey") % 40 + 1).cast("int").alias("row"), (F.col("l_linenumber") + F.col("l_partkey") % 3).cast("int").alias("col"))
    c = c.agg(F.concat(F.max("l_quantity").cast("int").cast("string"), F.lit("|"), F.min("l_linestatus")).alias("text"))
    return sheets.sheet_tables(c, 25, 6).select("sheet", "markdown")


@query("""SELECT n, chr(65 + ((n - 1) % 26)::INT) AS last_letter, n AS back FROM (SELECT DISTINCT (l_partkey % 18278 + 1)::INT AS n FROM lineitem)""")
def column_letters(s, d):
    x = read(s, d, "lineitem").select((F.col("l_partkey") % 18278 + 1).cast("int").alias("n")).distinct()
    x = x.withColumn("ref", cells.column_letters(F.col("n")))
    return x.select("n", F.right("ref", F.lit(1)).alias("last_letter"), cells.column_number(F.col("ref")).alias("back"))


@query("""SELECT o.o_orderkey AS id, coalesce(n.n_name, (o.o_custkey % 40)::VARCHAR) AS text FROM orders o LEFT JOIN nation n ON n.n_nationkey = o.o_custkey % 40""")
def shared_strings(s, d):
    c = read(s, d, "orders").select(F.lit("b").alias("doc"), F.lit("s").alias("sheet"), F.col("o_orderkey").alias("row"), F.lit(1).alias("col"), F.lit("s").alias("type"), (F.col("o_custkey") % 40).cast("string").alias("value"), F.lit(False).alias("is_formula"))
    n = read(s, d, "nation").select(F.lit("b").alias("doc"), F.col("n_nationkey").cast("int").alias("idx"), F.col("n_name").alias("text"))
    return sheets.resolved(c, n).select(F.col("row").alias("id"), "text")


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 OR c.c_custkey IS NULL THEN 'v' || o_orderkey ELSE 'o' || c.c_nationkey END AS text FROM orders LEFT JOIN customer c ON c.c_custkey = o_orderkey""")
def numeric_override(s, d):
    c = read(s, d, "orders").select(F.lit("b").alias("doc"), F.lit("s").alias("sheet"), F.col("o_orderkey").alias("row"), F.lit(1).alias("col"), F.lit("n").alias("type"), F.concat(F.lit("v"), F.col("o_orderkey")).alias("value"), (F.col("o_orderkey") % 3 == 0).alias("is_formula"))
    o = read(s, d, "customer").select(F.lit("b").alias("doc"), F.lit("s").alias("sheet"), F.col("c_custkey").alias("row"), F.lit(1).alias("col"), F.concat(F.lit("o"), F.col("c_nationkey")).alias("text"))
    none = c.select("doc", F.col("row").cast("int").alias("idx"), F.col("value").alias("text")).limit(0)
    return sheets.resolved(c, none, o).select(F.col("row").alias("id"), "text")


@query("""WITH r AS (SELECT o_orderkey AS rid, o_custkey % 50 AS doc, '../media/image' || o_custkey % 9 || '.png' AS target FROM orders), m AS (SELECT DISTINCT c_custkey % 50 AS doc, CASE WHEN c_custkey % 2 = 0 THEN 'word/' ELSE '' END || 'media/image' || c_custkey % 9 || '.png' AS path FROM customer)
  SELECT r.rid, r.doc, coalesce(a.path, b.path) AS path FROM r LEFT JOIN m a ON a.doc = r.doc AND a.path = 'word/' || substr(r.target, 4) LEFT JOIN m b ON b.doc = r.doc AND b.path = substr(r.target, 4)""")
def relationship_join(s, d):
    r = read(s, d, "orders").select(F.col("o_orderkey").alias("rid"), (F.col("o_custkey") % 50).alias("doc"), F.concat(F.lit("../media/image"), F.col("o_custkey") % 9, F.lit(".png")).alias("target"))
    m = read(s, d, "customer").select((F.col("c_custkey") % 50).alias("doc"), F.concat(F.when(F.col("c_custkey") % 2 == 0, "word/").otherwise(""), F.lit("media/image"), F.col("c_custkey") % 9, F.lit(".png")).alias("path"))
    return media.resolved(r, m, ["doc"]).select("rid", "doc", "path")


@query("""SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN s.s_nationkey % 2 = 0 THEN 'ordered' ELSE 'bullet' END AS type, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE repeat('  ', (o_orderkey % 3)::INT) || CASE WHEN s.s_nationkey % 2 = 0 THEN '1. ' ELSE '- ' END END AS prefix FROM orders LEFT JOIN supplier s ON s.s_suppkey = o_custkey % 12 AND o_orderkey % 3 < 2 AND o_custkey % 5 <> 0""")
def list_prefixes(s, d):
    p = read(s, d, "orders").select(F.lit(1).alias("doc"), F.col("o_orderkey").alias("id"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 12).alias("num_id"), (F.col("o_orderkey") % 3).cast("int").alias("ilvl"))
    n = read(s, d, "supplier").where("s_suppkey < 12").select(F.lit(1).alias("doc"), F.col("s_suppkey").alias("num_id"), F.col("s_suppkey").alias("abstract_id"))
    lv = read(s, d, "supplier").where("s_suppkey < 12").select(F.lit(1).alias("doc"), F.col("s_suppkey").alias("abstract_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ilvl"), F.when(F.col("s_nationkey") % 2 == 0, "ordered").otherwise("bullet").alias("type"))
    return media.list_types(p, n, lv).select("id", "type", "prefix")


@query("""SELECT o_orderkey AS id, CASE WHEN s.s_nationkey % 2 = 0 THEN 'ordered' ELSE 'bullet' END AS type, repeat('  ', (o_orderkey % 3)::INT) || CASE WHEN s.s_nationkey % 2 = 0 THEN '1. ' ELSE '- ' END AS prefix FROM orders LEFT JOIN supplier s ON s.s_suppkey = o_custkey AND o_orderkey % 3 < 2""")
def list_prefixes_whole(s, d):
    """As list_prefixes, with all suppliers as definitions; customers without a supplier of their number have none."""
    p = read(s, d, "orders").select(F.lit(1).alias("doc"), F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("num_id"), (F.col("o_orderkey") % 3).cast("int").alias("ilvl"))
    n = read(s, d, "supplier").select(F.lit(1).alias("doc"), F.col("s_suppkey").alias("num_id"), F.col("s_suppkey").alias("abstract_id"))
    lv = read(s, d, "supplier").select(F.lit(1).alias("doc"), F.col("s_suppkey").alias("abstract_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("ilvl"), F.when(F.col("s_nationkey") % 2 == 0, "ordered").otherwise("bullet").alias("type"))
    return media.list_types(p, n, lv).select("id", "type", "prefix")


@query(f"""SELECT source_id, array_to_string(list_transform(list_sort(list(struct_pack(o := chunk_index, m := body))), lambda x: x.m), chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS markdown FROM {CHUNKS} WHERE regexp_replace(body, '^{WS}+|{WS}+$', '', 'g') <> '' GROUP BY source_id""")
def chunk_merge(s, d):
    c = read(s, d, "chunks").distinct().where("data IS NOT NULL").select("source_id", "chunk_index", F.decode("data", "UTF-8").alias("body"))
    return report.merged_chunks(c, "source_id", "chunk_index", "body").where("markdown <> ''")


@query("""SELECT doc_id, left(text, n // 2) || '⟦seam of ' || doc_id || ' here⟧' || substr(text, n // 2 + 1) || chr(10) || chr(10) || 'end' AS merged FROM (SELECT doc_id, text, length(text) AS n FROM documents WHERE text IS NOT NULL AND length(text) >= 2)""")
def overlap_merge(s, d):
    """Each text in two parts that share a seam, and a third part that shares nothing."""
    seam = F.concat(F.lit("⟦seam of "), F.col("doc_id"), F.lit(" here⟧"))
    x = read(s, d, "documents").where("text IS NOT NULL AND length(text) >= 2").withColumn("h", F.expr("cast(length(text) div 2 as int)"))
    parts = F.array(F.concat(F.expr("left(text, h)"), seam), F.concat(seam, F.expr("substring(text, h + 1)")), F.lit("end"))
    x = x.select("doc_id", F.posexplode(parts).alias("k", "p"))
    return report.overlap_merged(x, "doc_id", "k", "p").select("doc_id", F.col("markdown").alias("merged"))


@query("""SELECT doc_id, CASE WHEN n <= 256 THEN text ELSE decode(b[1:CASE WHEN c1 NOT BETWEEN 128 AND 191 THEN 256 WHEN c0 NOT BETWEEN 128 AND 191 THEN 255 WHEN cm NOT BETWEEN 128 AND 191 THEN 254 ELSE 253 END]) END AS head
  FROM (SELECT doc_id, text, strlen(text) AS n, encode(text) AS b, ('0x' || hex(encode(text)[257:257]))::INT AS c1, ('0x' || hex(encode(text)[256:256]))::INT AS c0, ('0x' || hex(encode(text)[255:255]))::INT AS cm FROM documents WHERE text IS NOT NULL AND strlen(text) > 256 UNION ALL SELECT doc_id, text, strlen(text), NULL, NULL, NULL, NULL FROM documents WHERE strlen(text) <= 256)""")
def utf8_prefix(s, d):
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", T.prefix(F.col("text"), 256).alias("head"))


@query()
def inline_blocks(s, d):
    """Blocks of the default size; checked by tests, as SQL has no such loop."""
    x = read(s, d, "documents").where("text IS NOT NULL").select("doc_id", budget.blocks()(F.col("text"), F.lit(4096), F.lit(4)).alias("b"))
    return x.select("doc_id", F.size("b.blocks").alias("n"), F.col("b.complete").alias("complete"), F.transform("b.blocks", lambda t: F.octet_length(t)).cast("array<int>").alias("sizes"))


@query()
def head_tail(s, d):
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", budget.head_tail_column(F.col("text"), 2048).alias("shortened"))


@query(f"SELECT result_id, CASE WHEN result_id % 10 = 0 THEN 'summary' WHEN strlen(coalesce(markdown, '')) <= 4096 THEN 'full' WHEN md_path IS NOT NULL THEN 'saved_summary' ELSE 'truncated' END AS mode FROM {RES}")
def return_modes(s, d):
    return results(s, d).select("result_id", report.return_mode(F.col("markdown"), F.col("md_path").isNotNull(), F.col("result_id") % 10 == 0, 4096, 1).alias("mode"))


@query(f"SELECT batch_id, count(*) AS files, count(*) FILTER (WHERE ok) AS success, count(*) FILTER (WHERE NOT coalesce(ok, false)) AS failed, '处理完成：' || count(*) FILTER (WHERE ok) || '/' || count(*) || ' 个文件成功' AS summary FROM {RES} GROUP BY batch_id")
def batch_summary(s, d):
    x = results(s, d).withColumn("status", report.status(F.col("ok"), F.lit(None).cast("string"), F.lit(None).cast("string")))
    return report.batch_summary(x, "batch_id")


@query(f"SELECT result_id, CASE WHEN ok THEN 'success' ELSE 'failed' END AS status, CASE WHEN ok THEN '✅ ' || file_name ELSE '❌ ' || file_name || ' — ' || coalesce(error, '解析失败') END AS line FROM {RES}")
def file_status(s, d):
    st = report.status(F.col("ok"), F.lit("saved"), F.lit(None).cast("string"))
    return results(s, d).select("result_id", st.alias("status"), report.summary_line(F.col("file_name"), st, F.col("error")).alias("line"))


@query(f"""SELECT result_id, folder, array_to_string(list_filter(list_transform(list_filter(coalesce(media_paths, []), lambda p: trim(coalesce(p, ''), ' ') <> ''), lambda p: CASE WHEN starts_with(p, '/') THEN p ELSE folder || '/' || list_last(string_split(p, '/')) END), lambda p: p IS NOT NULL), '|') AS paths
  FROM (SELECT *, coalesce(nullif(trim(coalesce(media_dir, ''), ' '), ''), nullif(regexp_extract(list_filter(coalesce(media_paths, []), lambda p: starts_with(p, '/'))[1], '^(.*)/[^/]*$', 1), ''),
   CASE WHEN len(coalesce(media_paths, [])) > 0 THEN coalesce(regexp_extract(nullif(trim(coalesce(md_path, ''), ' '), ''), '^(.*)/[^/]*$', 1) || '/' || regexp_replace(regexp_replace(list_last(string_split(md_path, '/')), '\\.md$', ''), '(.)\\.[^.]*$', '\\1') || '_media', nullif(trim(coalesce(output_dir, ''), ' '), '') || '/' || regexp_replace(list_last(string_split(file_name, '/')), '(.)\\.[^.]*$', '\\1') || '_media') END) AS folder FROM {RES})""")
def media_locations(s, d):
    r = results(s, d).withColumn("folder", report.media_folder(F.col("media_dir"), F.col("media_paths"), F.col("md_path"), F.col("output_dir"), F.col("file_name")))
    return r.select("result_id", "folder", F.array_join(report.absolute_media(F.col("media_paths"), F.col("folder")), "|").alias("paths"))


@query(f"SELECT source_id, CASE WHEN size_bytes > 10 * 1048576 THEN 'too large' WHEN total_pages > 20 THEN 'too many pages' END AS refused, coalesce(CASE WHEN source_id % 4 = 0 THEN 'out/' || source_id END, CASE WHEN source_id % 3 = 0 THEN 'auto' END, CASE WHEN source_id % 5 = 0 THEN 'sum' END) AS folder FROM {SRC}")
def service_limits(s, d):
    i = F.col("source_id")
    return sources(s, d, "total_pages", "size_bytes").select("source_id", chain.within_limits(F.col("total_pages"), F.col("size_bytes"), F.lit(False)).alias("refused"), report.output_folder(F.when(i % 4 == 0, F.concat(F.lit("out/"), i)).otherwise(" "), i % 3 == 0, F.lit("auto"), i % 5 == 0, F.lit("sum")).alias("folder"))


@query("SELECT service, count(*) AS total, count(*) FILTER (WHERE st = 'valid') AS valid, count(*) FILTER (WHERE st <> 'valid') AS invalid FROM (SELECT service, CASE WHEN service = 'mineru' THEN CASE WHEN code = 'A0211' THEN 'expired' WHEN code = 'A0202' OR status = 401 THEN 'invalid' WHEN status = 200 THEN 'valid' ELSE 'error' END ELSE CASE WHEN status IN (200, 400) THEN 'valid' WHEN status IN (401, 403) THEN 'invalid' ELSE 'error' END END AS st FROM (SELECT CASE WHEN c_custkey % 2 = 0 THEN 'mineru' ELSE 'paddle' END AS service, [200, 400, 401, 403, 500][c_custkey % 5 + 1] AS status, ['', 'A0211', 'A0202'][c_custkey % 3 + 1] AS code FROM customer)) GROUP BY service")
def token_validity(s, d):
    k = F.col("c_custkey")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), (k % n).cast("int"))
    x = read(s, d, "customer").select(F.when(k % 2 == 0, "mineru").otherwise("paddle").alias("service"), pick((200, 400, 401, 403, 500), 5).alias("status"), pick(("", "A0211", "A0202"), 3).alias("code"))
    x = x.withColumn("st", chain.token_status(F.col("service"), F.col("status"), F.col("code")))
    return x.groupBy("service").agg(F.count("*").alias("total"), F.count(F.when(F.col("st") == "valid", 1)).alias("valid"), F.count(F.when(F.col("st") != "valid", 1)).alias("invalid"))


@query("""SELECT doc_id, string_agg(l, chr(10) ORDER BY k) AS deduplicated FROM (SELECT doc_id, l, min(k) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL) GROUP BY doc_id, l) GROUP BY doc_id""")
def paragraph_dedup(s, d):
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", rows.distinct_paragraphs(F.col("text")).alias("deduplicated"))


@query(f"""SELECT result_id, '---' || chr(10) || 'title: ' || CASE WHEN regexp_matches(file_name, '[:#{{}}\\[\\],&*?|<>=!%@`-]') THEN '"' || file_name || '"' ELSE file_name END || chr(10) || 'type: ' || coalesce(file_type, 'none') || chr(10) || '---' || chr(10) || chr(10) AS front FROM {RES}""")
def frontmatter(s, d):
    m = F.create_map(F.lit("title"), F.col("file_name"), F.lit("type"), F.coalesce("file_type", F.lit("none")))
    return results(s, d).select("result_id", T.frontmatter(m).alias("front"))


@query(f"""SELECT r.batch_id, array_to_string(list_sort(list(DISTINCT backend) FILTER (WHERE backend IS NOT NULL)), ',') AS used_backends FROM {RES} r GROUP BY r.batch_id""")
def used_backends(s, d):
    return results(s, d).groupBy("batch_id").agg(F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("used_backends"))


@query("SELECT source_id, page, xref FROM (SELECT DISTINCT source_id, page, xref FROM page_images) i WHERE NOT EXISTS (SELECT 1 FROM (SELECT source_id, start_page FROM chunks) c WHERE c.source_id = i.source_id AND c.start_page <= i.page)")
def unchunked_images(s, d):
    """Anti join: pictures on pages before any chunk of their source."""
    first = read(s, d, "chunks").groupBy("source_id").agg(F.min("start_page").alias("from_page"))
    img = read(s, d, "page_images").select("source_id", "page", "xref").distinct()
    return img.join(first.where("from_page IS NOT NULL"), (img["source_id"] == first["source_id"]) & (first["from_page"] <= img["page"]), "left_anti")


WORDS = "list_filter(list_transform(string_split(regexp_replace(t, '[^A-Za-z ]', '', 'g'), ' '), lambda x: trim(x)), lambda x: x <> '')"


def word_lines(s, d, per: int = 12):
    """Each document's Latin words, per to a line."""
    w = F.filter(F.split(F.regexp_replace("text", "[^A-Za-z ]", ""), " "), lambda x: x != "")
    x = read(s, d, "documents").where("text IS NOT NULL").select("doc_id", w.alias("w"))
    return x.select("doc_id", F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size("w") / per).cast("int") - 1, F.lit(0))), lambda k: F.array_join(F.slice("w", k * per + 1, F.lit(per)), " ")).alias("lines"))


LINES = f"list_transform(generate_series(0, greatest(ceil(len(w) / 12.0)::INT - 1, 0)), lambda k: array_to_string(w[k * 12 + 1:k * 12 + 12], ' ')) AS lines FROM (SELECT doc_id, {WORDS} AS w FROM (SELECT doc_id, text AS t FROM documents WHERE text IS NOT NULL))"


@query(f"""SELECT doc_id, array_to_string(list_prepend('# ' || doc_id || '.docx', list_filter(list_transform(list_zip(lines, generate_series(1, len(lines))), lambda x: CASE WHEN list_position(lines, x[1]) = x[2] THEN x[1] ELSE '' END), lambda x: x <> '')), chr(10) || chr(10)) AS markdown FROM (SELECT doc_id, {LINES})""")
def docx_extract(s, d):
    from ..sources.files import documents
    from .fixtures import files

    out = documents(files(word_lines(s, d), "doc_id", "lines", "docx"))
    return out.select(F.regexp_extract("path", r"(\d+)\.", 1).cast("bigint").alias("doc_id"), "markdown")


@query(f"""SELECT doc_id, '# ' || doc_id || '.pptx' || chr(10) || chr(10) || array_to_string(list_transform(lines, lambda x, k: '## Slide ' || k || CASE WHEN x = '' THEN '' ELSE chr(10) || chr(10) || x END), chr(10) || chr(10)) AS markdown FROM (SELECT doc_id, {LINES})""")
def pptx_extract(s, d):
    from ..sources.files import documents
    from .fixtures import files

    out = documents(files(word_lines(s, d), "doc_id", "lines", "pptx"))
    return out.select(F.regexp_extract("path", r"(\d+)\.", 1).cast("bigint").alias("doc_id"), "markdown")


def text_lines(s, d):
    """Each document's whole text as its lines."""
    return read(s, d, "documents").where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("lines"))


# Lines without what XML cannot hold and without blanks around them.
TEXT_LINES = rf"(SELECT doc_id, k, regexp_replace(regexp_replace(l, '[\x00-\x08\x0b\x0c\x0e-\x1f\x{{fffe}}\x{{ffff}}]', '', 'g'), '^{WS}+|{WS}+$', '', 'g') AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text IS NOT NULL))"


@query(f"""SELECT doc_id, '# ' || doc_id || '.docx' || coalesce(string_agg(chr(10) || chr(10) || l, '' ORDER BY k) FILTER (WHERE l <> ''), '') AS markdown FROM (SELECT doc_id, l, min(k) AS k FROM {TEXT_LINES} GROUP BY doc_id, l) GROUP BY doc_id""")
def docx_extract_whole(s, d):
    """As docx_extract, of the whole texts; paragraphs that repeat come out once."""
    from ..sources.files import documents
    from .fixtures import files

    out = documents(files(text_lines(s, d), "doc_id", "lines", "docx"))
    return out.select(F.regexp_extract("path", r"(\d+)\.", 1).cast("bigint").alias("doc_id"), "markdown")


@query(f"""SELECT doc_id, '# ' || doc_id || '.pptx' || string_agg(chr(10) || chr(10) || '## Slide ' || k || CASE WHEN l = '' THEN '' ELSE chr(10) || chr(10) || l END, '' ORDER BY k) AS markdown FROM {TEXT_LINES} GROUP BY doc_id""")
def pptx_extract_whole(s, d):
    """As pptx_extract, of the whole texts, a slide for each line."""
    from ..sources.files import documents
    from .fixtures import files

    out = documents(files(text_lines(s, d), "doc_id", "lines", "pptx"))
    return out.select(F.regexp_extract("path", r"(\d+)\.", 1).cast("bigint").alias("doc_id"), "markdown")


@query()
def html_markdown(s, d):
    """Pages derived from all sources as Markdown; checked by tests, as the dialect is the converter's own."""
    from ..formats.html_markdown import convert

    @F.pandas_udf("string")
    def run(page: pd.Series) -> pd.Series:
        return page.map(convert)

    return derived_pages(s, d).select("source_id", run("html").alias("markdown"))


REWRITE = "concat('![c](imgs/', s.source_id, ' x.png \"t\") <img src=\"imgs/', s.source_id, ' x.png\"> ![d]( imgs/', s.source_id, ' x.png )')"


@query(f"""SELECT source_id, '![c](a%20b_media/image_' || source_id || '.png "t") <img src="a%20b_media/image_' || source_id || '.png"> ![d](a%20b_media/image_' || source_id || '.png)' AS rewritten FROM {SRC}""")
def media_rewrite(s, d):
    x = sources(s, d).alias("s")
    m = F.create_map(F.concat(F.lit("imgs/"), F.col("source_id"), F.lit(" x.png")), F.concat(F.lit("/out/image_"), F.col("source_id"), F.lit(".png")))
    return x.select("source_id", T.rewrite_media(F.expr(REWRITE), m, F.lit("a b")).alias("rewritten"))


@query("""WITH m AS (SELECT DISTINCT source_id, xref FROM page_images), r AS (SELECT source_id, xref, min(page) AS p FROM page_images WHERE page % 2 = 0 GROUP BY 1, 2) SELECT source_id, xref, row_number() OVER (PARTITION BY source_id ORDER BY p NULLS LAST, xref)::INT AS place FROM m LEFT JOIN r USING (source_id, xref)""")
def media_by_reference(s, d):
    x = read(s, d, "page_images")
    return media.by_reference(x.select("source_id", "xref").distinct(), x.where("page % 2 = 0").select("source_id", "xref", "page"), ["source_id", "xref"], "page", "xref").select("source_id", "xref", "place")


@query(ORACLE["media_by_reference"].replace(" WHERE page % 2 = 0", ""))
def media_by_reference_whole(s, d):
    """As media_by_reference, with every reference."""
    x = read(s, d, "page_images")
    return media.by_reference(x.select("source_id", "xref").distinct(), x.select("source_id", "xref", "page"), ["source_id", "xref"], "page", "xref").select("source_id", "xref", "place")


@query("SELECT source_id, source_path, size_bytes FROM (SELECT DISTINCT source_id, source_path, size_bytes FROM sources) WHERE NOT coalesce(" + SUFFIX.format("source_path") + " IN ('pdf', 'html') AND size_bytes < 200000, false)")
def small_previews(s, d):
    """Leaves out small files of two types, as previews of formulas are left out."""
    x = read(s, d, "sources").select("source_id", "source_path", "size_bytes").distinct()
    x = x.withColumn("ext", F.when(M.suffix(F.col("source_path")).isin("pdf", "html"), ".WMF").otherwise("png"))
    return media.without_previews(x, "ext", "size_bytes", 200000).drop("ext")


@query("""SELECT o.o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 AND c.c_custkey IS NOT NULL THEN '$x_{' || c.c_nationkey || '}$' WHEN o_orderkey % 5 = 0 THEN '![formula](p' || o_orderkey || '.png)' ELSE '' END AS text FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_orderkey""")
def formula_or_preview(s, d):
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    f = read(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("id"), F.concat(F.lit("x_{"), F.col("c_nationkey"), F.lit("}")).alias("latex"))
    p = o.where("id % 5 = 0").select("id", F.concat(F.lit("p"), F.col("id"), F.lit(".png")).alias("preview"))
    return media.formula_or_preview(o, f, p, ["id"]).select("id", "text")


@query("""SELECT o.o_orderkey AS id, CASE WHEN c.c_custkey IS NOT NULL THEN '$x_{' || c.c_nationkey || '}$' WHEN p.p_partkey IS NOT NULL THEN '![formula](p' || p.p_partkey || '.png)' ELSE '' END AS text FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = o.o_orderkey""")
def formula_or_preview_whole(s, d):
    """As formula_or_preview, with all customers as formulas and all parts as previews."""
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("id"))
    f = read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("x_{"), F.col("c_nationkey"), F.lit("}")).alias("latex"))
    p = read(s, d, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("p"), F.col("p_partkey"), F.lit(".png")).alias("preview"))
    return media.formula_or_preview(o, f, p, ["id"]).select("id", "text")


@query(f"""SELECT result_id, coalesce(file_type, 'x') || CASE WHEN len(coalesce(media_paths, [])) > 0 THEN chr(10) || '媒体路径: ' || array_to_string(media_paths, ', ') ELSE '' END || CASE WHEN len(coalesce(warnings, [])) > 0 THEN chr(10) || chr(10) || '⚠️ 警告:' || chr(10) || array_to_string(list_transform(warnings, lambda w: '- ' || w), chr(10)) ELSE '' END AS payload FROM {RES}""")
def agent_payload(s, d):
    none = F.array().cast("array<string>")
    return results(s, d).select("result_id", report.agent_text(F.coalesce("file_type", F.lit("x")), F.lit(""), F.coalesce("media_paths", none), F.coalesce("warnings", none)).alias("payload"))


@query(ORACLE["agent_payload"].replace("coalesce(file_type, 'x')", "coalesce(markdown, '') || coalesce(guide, '')").replace(RES, f"{RES} LEFT JOIN ({ORACLE['media_guide']}) USING (result_id)"))
def agent_payload_whole(s, d):
    """As agent_payload, of each result's Markdown and the guide to its media."""
    none = F.array().cast("array<string>")
    r = results(s, d)
    return r.select("result_id", report.agent_text(F.col("markdown"), guide_of(r), F.coalesce("media_paths", none), F.coalesce("warnings", none)).alias("payload"))


@query(f"""SELECT result_id, json_extract_string(j, '$.content') AS content, json_extract_string(j, '$.metadata.format') AS format, json_extract_string(j, '$.metadata.mediaPaths[0]') AS first_path FROM (SELECT result_id, json_object('content', file_name, 'metadata', json_object('format', file_type, 'mediaPaths', list_transform(coalesce(media_paths, []), lambda p: 'doc_media/' || list_last(string_split(p, '/'))))) AS j FROM {RES})""")
def saved_json(s, d):
    j = report.saved_json(F.col("file_name"), {"format": F.col("file_type")}, F.lit("doc"), F.col("media_paths"))
    x = results(s, d).select("result_id", j.alias("j"))
    return x.select("result_id", F.get_json_object("j", "$.content").alias("content"), F.get_json_object("j", "$.metadata.format").alias("format"), F.get_json_object("j", "$.metadata.mediaPaths[0]").alias("first_path"))


@query(ORACLE["saved_json"].replace("'content', file_name", "'content', markdown"))
def saved_json_whole(s, d):
    """As saved_json, with each result's Markdown as content."""
    j = report.saved_json(F.col("markdown"), {"format": F.col("file_type")}, F.lit("doc"), F.col("media_paths"))
    x = results(s, d).select("result_id", j.alias("j"))
    return x.select("result_id", F.get_json_object("j", "$.content").alias("content"), F.get_json_object("j", "$.metadata.format").alias("format"), F.get_json_object("j", "$.metadata.mediaPaths[0]").alias("first_path"))


@query(f"""SELECT source_id, CASE WHEN count(*) = 1 THEN max(coalesce(markdown, '')) ELSE string_agg('## ' || file_name || chr(10) || chr(10) || coalesce(markdown, ''), chr(10) || chr(10) ORDER BY result_id) END AS text FROM {RES} GROUP BY source_id""")
def readable_text(s, d):
    return report.readable(results(s, d), "source_id", "result_id", "file_name", "markdown")


@query(f"""SELECT result_id, len(list_filter(coalesce(media_paths, []), lambda p: trim(coalesce(p, ''), ' ') <> '')) - len(list_filter(coalesce(media_paths, []), lambda p: trim(coalesce(p, ''), ' ') <> '' AND (starts_with(p, '/') OR media_dir IS NOT NULL))) AS unresolved, json_extract_string(json_object('name', file_name, 'status', CASE WHEN ok THEN 'success' ELSE 'failed' END, 'error', error, 'mdPath', md_path), '$.mdPath') AS md FROM {RES}""")
def path_blocks(s, d):
    found = report.absolute_media(F.col("media_paths"), F.col("media_dir"))
    b = report.path_block(F.col("file_name"), report.status(F.col("ok"), F.lit(None).cast("string"), F.lit(None).cast("string")), F.col("error"), {"mdPath": F.col("md_path")})
    return results(s, d).select("result_id", report.unresolved(F.col("media_paths"), found).alias("unresolved"), F.get_json_object(b, "$.mdPath").alias("md"))


@query("SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'office' WHEN 1 THEN 'libreoffice' ELSE CASE WHEN c_custkey % 3 = 0 THEN 'office' WHEN c_custkey % 5 = 0 THEN 'libreoffice' END END AS provider FROM customer")
def legacy_providers(s, d):
    k = F.col("c_custkey")
    wanted = F.when(k % 4 == 0, "Office-COM").when(k % 4 == 1, " soffice ").when(k % 4 == 2, "auto")
    return read(s, d, "customer").select(k.alias("id"), chain.legacy_provider(wanted, k % 3 == 0, F.when(k % 5 == 0, "/opt/soffice")).alias("provider"))


@query("SELECT source_id, path FROM (SELECT DISTINCT source_id, 'p' || page || '/' || xref AS path FROM page_images) m WHERE NOT EXISTS (SELECT 1 FROM page_images a WHERE a.source_id = m.source_id AND 'p' || a.page || '/' || a.xref = m.path AND a.y0 IS NOT NULL)")
def unanchored_media(s, d):
    x = read(s, d, "page_images").withColumn("path", F.concat(F.lit("p"), "page", F.lit("/"), "xref")).withColumn("doc", F.col("source_id"))
    return sheets.unanchored(x.select("doc", "path").distinct(), x.where("y0 IS NOT NULL")).select(F.col("doc").alias("source_id"), "path")


@query("SELECT date_trunc('hour', arrived_at) AS start, backend, count(*) AS n FROM attempts WHERE arrived_at IS NOT NULL GROUP BY 1, 2")
def arrivals(s, d):
    """The streaming aggregation over the table as a whole; as a stream it drops what comes after the watermark."""
    from ..streaming.inbox import arrivals as windows

    return windows(read(s, d, "attempts").where("arrived_at IS NOT NULL"), "arrived_at", "backend")


@query("SELECT c_custkey AS id, '\\frac{' || c_nationkey || '}{\\alpha' || c_custkey || '}' AS latex, 'x' || c_custkey || '^{' || c_nationkey || '}' AS power FROM customer")
def formulas(s, d):
    """Office math and MathType records made of the rows, as LaTeX."""
    from xml.etree import ElementTree as ET

    from ..formats.mtef import to_latex
    from ..formats.omml import latex
    from . import fixtures

    @F.pandas_udf("string")
    def office(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([latex(ET.fromstring(fixtures.fraction(str(x), f"α{y}"))) for x, y in zip(a, b)])

    @F.pandas_udf("string")
    def mathtype(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([to_latex(fixtures.equation(f"x{x}", str(y))) for x, y in zip(a, b)])

    return read(s, d, "customer").select(F.col("c_custkey").alias("id"), office("c_nationkey", "c_custkey").alias("latex"), mathtype("c_custkey", "c_nationkey").alias("power"))


@query(f"""SELECT source_id, array_to_string(list_filter(list_transform(list_sort(list(struct_pack(k := chunk_index, t := chunk_name))), lambda x: x.t), lambda t: trim(coalesce(t, ''), ' ') <> ''), chr(10) || chr(10)) AS markdown FROM {CHUNKS} GROUP BY source_id""")
def ocr_results(s, d):
    """JSON lines of an OCR service made of chunks, with a broken line among them."""
    from ..sources.files import ocr_lines

    c = read(s, d, "chunks").distinct().where("data IS NOT NULL").select("source_id", "chunk_index", "chunk_name")
    j = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.col("chunk_name").alias("text"), F.create_map(F.lit("imgs/a.png"), F.lit("u")).alias("images")).alias("markdown"))).alias("layoutParsingResults")).alias("result")))
    lines = c.select("source_id", "chunk_index", F.explode(F.array(j, F.lit("{broken"))).alias("line"))
    return ocr_lines(lines, "source_id", "chunk_index", "line").select("source_id", "markdown")


@query(f"""SELECT source_id, coalesce(string_agg(body, chr(10) || chr(10) ORDER BY chunk_index, body) FILTER (WHERE trim(body, ' ') <> ''), '') AS markdown FROM (SELECT DISTINCT chunk_id, source_id, chunk_index, start_page, end_page, chunk_name, decode(data) AS body FROM chunks) GROUP BY source_id""")
def ocr_results_whole(s, d):
    """As ocr_results, of the chunks' whole texts, null ones too."""
    from ..sources.files import ocr_lines

    c = read(s, d, "chunks").distinct().select("source_id", "chunk_index", F.decode("data", "UTF-8").alias("text"))
    j = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(F.col("text"), F.create_map(F.lit("imgs/a.png"), F.lit("u")).alias("images")).alias("markdown"))).alias("layoutParsingResults")).alias("result")))
    lines = c.select("source_id", "chunk_index", F.explode(F.array(j, F.lit("{broken"))).alias("line"))
    return ocr_lines(lines, "source_id", "chunk_index", "line").select("source_id", "markdown")


@query("""SELECT doc_id, 0 AS pos, 'image' AS kind, 'image_001.png' AS name, strlen(text)::INT AS size FROM documents WHERE length(text) > 0 UNION ALL SELECT doc_id, 1, 'audio', 'audio_001.mp3', strlen(text)::INT FROM documents WHERE length(text) > 0""")
def embedded_media(s, d):
    from ..functions.remote import embedded

    b = F.base64(F.encode("text", "UTF-8"))
    b = F.regexp_replace(b, r"\s", "")
    x = read(s, d, "documents").where("length(text) > 0").select("doc_id", F.concat(F.lit("![a](data:image/png;base64,"), b, F.lit(") and ![b](data:audio/mpeg;base64,"), b, F.lit(")")).alias("md"))
    return embedded(x, "doc_id", "md").select("doc_id", "pos", "kind", "name", F.octet_length("data").alias("size"))


@query(f"SELECT source_id, regexp_matches(source_path, '^https?://') AS web, false AS inside FROM {SRC}")
def public_addresses(s, d):
    from ..functions.remote import public_host

    judge = public_host(lambda host: ["8.8.8.8"])  # every name resolves to a public address here
    return sources(s, d).select("source_id", judge("source_path").alias("web"), judge(F.concat(F.lit("http://10.0."), F.col("source_id") % 250, F.lit(".1/x"))).alias("inside"))


@query(f"""SELECT source_id, '<img src="image_' || source_id || '.png"> [v](clip.mp4)' AS markdown FROM {SRC}""")
def source_substitution(s, d):
    m = F.create_map(F.concat(F.lit("https://h/"), F.col("source_id"), F.lit("?x=1")), F.concat(F.lit("/o/m/image_"), F.col("source_id"), F.lit(".png")), F.lit("https://h/v"), F.lit("clip.mp4"))
    text = F.concat(F.lit('<img src="https://h/'), F.col("source_id"), F.lit('?x=1"> [v](https://h/v)'))
    return sources(s, d).select("source_id", html.substitute_sources(text, m).alias("markdown"))
