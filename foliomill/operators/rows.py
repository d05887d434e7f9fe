"""Rows that were delivered several times, first occurrences and ordered choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, key: str, order: str = "arrived_at") -> DataFrame:
    """One row per key: the one delivered last; of equals any, as redelivered rows carry the same content. Spark limits the
    groups before the shuffle too, and columns that nobody asks for later are not read."""
    last = Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last())
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def first_of(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order; nulls count as equal."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def distinct_paragraphs(text: Column, by: str = "\n") -> Column:
    """Lines of a text, each different one once, at its first place."""
    return F.array_join(F.array_distinct(F.split(text, by)), "\n")
