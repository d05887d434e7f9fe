"""Filling containers of fixed capacity with texts, measured in tokens (problem 8).

Method: minimum bin slack. For the next container a bitset subset-sum dynamic programme over the lengths still available
finds the fullest combination that fits; it is taken out, and so on until nothing is left.

The programme needs only how many items there are of each length, at most ``capacity`` numbers whatever the input's size.
A combination found is used as often as the numbers allow, which uses up at least one length, so the number of distinct
combinations is bounded by the lengths too, and the driver's work does not grow with the data. Items are then matched with
places by their rank within their length: salted counts, a running sum over salts and a rank within each salt, so that no
task holds all the items of one length.
"""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SALTS = 256


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The largest length available plus the combination of others that fills its container best: {length: times}.

    Sums reachable are bits of an integer. A length available c times enters as bundles of 1, 2, 4 ... of itself, which
    cover every number up to c in about log c shifts. Longer lengths come first, so that ties prefer few long items.
    """
    first = max(counts)
    room = capacity - first
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        bundle = 1
        while left > 0:
            take = min(bundle, left)
            now = (reach | reach << (take * length)) & mask
            if now != reach:
                steps.append((length, take, reach))
                reach = now
            left -= take
            bundle *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    use = {first: 1}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            use[length] = use.get(length, 0) + take
            at -= take * length
    return use


def fill(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(combination, number of containers filled so) in the order found; histogram: items by length, each 1..capacity."""
    counts, out = {k: v for k, v in histogram.items() if v > 0}, []
    while counts:
        use = fullest(counts, capacity)
        times = min(counts[k] // n for k, n in use.items())
        for k, n in use.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((use, times))
    return out


def places(filled: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int]]:
    """(length, first rank, items per container, first container) of each run of places, ranks counted from 0."""
    rank: dict[int, int] = {}
    out, container = [], 0
    for use, times in filled:
        for k, n in use.items():
            out.append((k, rank.get(k, 0), n, container))
            rank[k] = rank.get(k, 0) + n * times
        container += times
    return out


def pack(df: DataFrame, key: str, size: str, capacity: int, salts: int = SALTS) -> DataFrame:
    """(key, piece INT, start INT, n_tokens INT, container BIGINT): the container of each item, or of each of its pieces.

    df has one row per item. An item longer than capacity is cut into full pieces and a rest; other items stay whole.
    Null and negative sizes count as 0. An item of size 0 takes no room and lies in container 0, with piece 0.
    Rows that repeat are items of their own. An empty df gives no rows. capacity must be positive.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    item = df.select(F.col(key).alias("k"), F.greatest(F.coalesce(F.col(size).cast("int"), F.lit(0)), F.lit(0)).alias("size"))
    cut = F.expr(f"explode(sequence(0, greatest(cast(ceil(size / {capacity}.0D) as int) - 1, 0)))")
    piece = item.select("k", "size", cut.alias("piece")).selectExpr("k", "piece", f"piece * {capacity} AS start", f"least(size - piece * {capacity}, {capacity}) AS n", f"pmod(xxhash64(k, piece), {salts}) AS salt")
    # Items by length and salt: at most capacity * salts rows; the driver gets capacity of them.
    by_salt = piece.where("n > 0").groupBy("n", "salt").agg(F.count("*").alias("c"))
    offsets = by_salt.withColumn("before", F.coalesce(F.sum("c").over(Window.partitionBy("n").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    histogram = {r["n"]: r["c"] for r in by_salt.groupBy("n").agg(F.sum("c").alias("c")).collect()}
    table: dict[int, list[list[int]]] = {}
    for length, rank, per, container in places(fill(histogram, capacity)):
        runs = table.setdefault(length, [[], [], []])
        for column, x in zip(runs, (rank, per, container)):
            column.append(x)
    spread = df.sparkSession.sparkContext.broadcast(table)

    def place(batches):
        runs = spread.value
        for b in batches:
            out = []
            for n, rank in zip(b.column("n").to_pylist(), b.column("rank").to_pylist()):
                if not n:
                    out.append(0)
                    continue
                ranks, per, first = runs[n]
                i = bisect_right(ranks, rank) - 1
                out.append(first[i] + (rank - ranks[i]) // per[i])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("k", "piece", "start", "n")), pa.array(out, pa.int64())], names=["k", "piece", "start", "n", "container"])

    ranked = piece.withColumn("rank", F.row_number().over(Window.partitionBy("n", "salt").orderBy("k", "piece")) - 1).join(offsets.select("n", "salt", "before"), ["n", "salt"], "left")
    ranked = ranked.select("k", "piece", "start", "n", (F.col("rank") + F.coalesce(F.col("before"), F.lit(0))).cast("long").alias("rank"))
    kind = df.schema[key].dataType.simpleString()
    return ranked.mapInArrow(place, f"k {kind}, piece int, start int, n int, container bigint").select(F.col("k").alias(key), "piece", "start", F.col("n").alias("n_tokens"), "container")
