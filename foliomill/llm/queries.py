"""Queries of the training-data operators, over whole tables with the limits of the table settings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read
from . import abuse, boilerplate, lookalikes, mojibake, near_duplicates, packing, scans, splitting, tokenizing


def setting(spark: SparkSession, d: str, name: str) -> int:
    return read(spark, d, "settings").where(F.col("setting") == name).head()["amount"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.pairs(read(spark, d, "results"), percent=setting(spark, d, "similaritypercent"))


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.groups(read(spark, d, "results"), percent=setting(spark, d, "similaritypercent"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.pairs(read(spark, d, "results"))


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.canonical(read(spark, d, "results")).select("result_id", "canonical").dropDuplicates(["result_id"])


def pieces(spark: SparkSession, d: str) -> DataFrame:
    limits = (setting(spark, d, x) for x in ("splitchunkbytes", "splitchunkpages", "splitoverlapbytes"))
    return splitting.split(read(spark, d, "chunks"), *limits)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pieces(spark, d).where("n_pieces > 1").select("chunk_id").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return pieces(spark, d).drop("over").dropDuplicates(["chunk_id", "piece"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.affected(read(spark, d, "results"))


def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.restored(read(spark, d, "results"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.noisy(scans.repaired(read(spark, d, "results"))).select("result_id")


def p5_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired(read(spark, d, "results"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pages = boilerplate.web_pages(read(spark, d, "results"), read(spark, d, "sources"))
    return boilerplate.main_content(pages).select("result_id", F.explode("dropped").alias("line_no")).select("result_id", F.col("line_no").cast("long")).distinct()


def p6_main(spark: SparkSession, d: str) -> DataFrame:
    pages = boilerplate.web_pages(read(spark, d, "results"), read(spark, d, "sources"))
    return boilerplate.main_content(pages).select("result_id", "main").dropDuplicates(["result_id"])


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizing.token_ids(read(spark, d, "documents"))


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    from ..session import staged

    sizes = tokenizing.token_ids(read(spark, d, "documents"), out="size", count_only=True)
    sizes = staged(sizes.groupBy("doc_id").agg(F.max("size").alias("size")), "sizes")
    return packing.pack(sizes, "doc_id", "size", setting(spark, d, "containertokens"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_scores(spark, d).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scored(read(spark, d, "documents"), read(spark, d, "abuse_examples"))


def p9_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.rates(read(spark, d, "documents"), p9_scores(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_canonical, p3_found, p3_pieces, p4_found, p4_restored, p5_found, p5_repaired, p6_found, p6_main, p7_ids, p8_containers, p9_found, p9_scores, p9_rates)}
# Brute force where SQL can express the definition; the others are tested in tests/llm.
ORACLE: dict[str, str] = {
    "p1_found": """WITH t AS (SELECT result_id, replace(replace(replace(replace(lower(any_value(markdown)), ' ', ''), chr(9), ''), chr(10), ''), chr(13), '') AS s FROM results WHERE markdown IS NOT NULL GROUP BY result_id),
 g AS (SELECT DISTINCT result_id, substr(s, i, 5) AS piece FROM t, unnest(generate_series(1, length(s) - 4)) u(i) WHERE length(s) >= 200),
 n AS (SELECT result_id, count(*) AS n FROM g GROUP BY 1),
 o AS (SELECT a.result_id AS x, b.result_id AS y, count(*) AS c FROM g a JOIN g b ON a.piece = b.piece AND a.result_id < b.result_id GROUP BY 1, 2)
 SELECT x AS result_id_a, y AS result_id_b FROM o JOIN n p ON p.result_id = x JOIN n q ON q.result_id = y WHERE c * 100 >= 70 * (p.n + q.n - c)""",
    "p3_found": """SELECT DISTINCT chunk_id FROM chunks WHERE coalesce(octet_length(data), 0) > 8192
 OR CASE WHEN start_page IS NULL OR end_page IS NULL THEN length(coalesce(decode(data), '')) - length(replace(coalesce(decode(data), ''), chr(12), '')) + 1 ELSE abs(end_page - start_page) + 1 END > 20""",
}
