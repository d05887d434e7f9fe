"""Pairs within groups, spread over tasks however large a group is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 512


def pairs_within(df: DataFrame, group: str, item: str, other: str | None = None, tile: int = TILE) -> DataFrame:
    """(p, q), p < q: the different items of each group; with other, only those that differ in that column.

    A group is cut into tiles of about tile rows by a hash of the item, and each two tiles meet under a key of their own, so
    that a group with a third of all rows is worked on by many tasks. Rows of df must be distinct.
    """
    size = df.groupBy(group).agg(F.count("*").alias("_c")).where("_c > 1")
    x = df.join(size, group).withColumn("_t", F.expr(f"cast(ceil(_c / {tile}D) as int)"))
    x = x.withColumn("_m", F.expr(f"pmod(xxhash64({item}), _t)").cast("int")).withColumn("_o", F.explode(F.expr("sequence(0, _t - 1)")))
    x = x.select(F.col(group).alias("g"), F.least("_m", "_o").alias("i"), F.greatest("_m", "_o").alias("j"), F.col("_m").alias("m"), F.col(item).alias("k"), (F.col(other) if other else F.lit(0)).alias("s"))
    met = "x.g = y.g AND x.i = y.i AND x.j = y.j AND x.k < y.k AND (x.i = x.j OR x.m <> y.m)" + (" AND x.s <> y.s" if other else "")
    return x.alias("x").join(x.alias("y"), F.expr(met)).select(F.col("x.k").alias("p"), F.col("y.k").alias("q"))
