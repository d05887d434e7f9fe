"""The engine's functions for SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..formats.html_markdown import convert
from .budget import blocks

# name(parameters) -> SQL over Spark's own functions, so that queries stay within one plan.
SQL = {
    "mask_key(k STRING)": "CASE WHEN coalesce(length(k), 0) < 8 THEN '***' ELSE concat(left(k, 4), '...', right(k, 4)) END",
    "media_ext(p STRING)": r"lower(regexp_extract(element_at(split(p, '/'), -1), '^.+\\.([^.]*)$', 1))",
    "encode_media_path(p STRING)": "replace(p, ' ', '%20')",
    "language_code(l STRING)": "CASE WHEN lower(l) IN ('zh', 'zh-cn', 'zh-hans', 'chinese') THEN 'ch' ELSE l END",
    "auth_error(m STRING)": "lower(coalesce(m, '')) RLIKE 'auth|token|401|403|quota|limit'",
    "column_number(ref STRING)": "aggregate(filter(split(regexp_extract(ref, '^([A-Z]+)', 1), ''), c -> c <> ''), 0, (a, c) -> a * 26 + ascii(c) - 64)",
}


def register(spark: SparkSession) -> None:
    """Create the functions as temporary SQL functions, and Python ones for texts that need a loop."""
    kinds = {"column_number(ref STRING)": "INT", "auth_error(m STRING)": "BOOLEAN"}
    for head, body in SQL.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kinds.get(head, 'STRING')} RETURN {body}")
    spark.udf.register("inline_blocks", blocks())

    @F.pandas_udf("string")
    def html_to_markdown(html: pd.Series) -> pd.Series:
        return html.map(lambda t: None if t is None else convert(t))

    spark.udf.register("html_to_markdown", html_to_markdown)
