"""Groups and pairs of texts that share most of their content (problem 1).

Method: size-banded tiles with hashed bitmap signatures. Texts become sets of 5-character pieces. Sets meet in tiles of sizes
that may be alike enough; the bits that one bitmap has and the other lacks bound the overlap from above, and only pairs that
the bound lets through are intersected exactly, as sorted arrays.

Size bands alone leave all pairs of neighbouring bands to be compared, and an exact prefix filter is no way out either: where
texts share a language the rarest 30 % of a text's pieces are as common as the corpus is large. So sets meet only within buckets of
min-wise signatures, ``BANDS`` keys of ``ROWS`` minima each, and the bands and tiles divide a bucket. A pair with likeness t meets in fewer than
``MEET`` buckets with a probability of 2e-5 at t = 0.7, where 13 are expected, and 2e-8 at 0.75; unlike texts rarely meet
twice.

A bucket of more than ``TILE`` sets is cut into tiles of about that many by size band, then by hash, and two tiles meet only
if their bands are the same or neighbours; so a hot bucket is spread over tasks. Sets that occur several times are compared
once. For the exact step pairs are gathered in blocks, each of which gets a text once, however many partners it has there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import released, spread, staged
from .within import pairs_within

ROWS, BANDS, MEET, HASHES, BITS, TILE, WIDTH = 6, 108, 2, 9, 2048, 256, 5
BLOCK = 4_000_000  # pieces of all texts of a part of a block; 32 MB of sorted arrays
BINS = ROWS * BANDS // HASHES
M = np.uint64(0x9E3779B97F4A7C15)
MINIMA = np.array([0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1, 0x9E3779B1, 0xB5297A4D, 0x68E31DA5, 0x1B56C4E9, 0x7FEB352D], np.uint32)
HASH_NO = np.arange(HASHES, dtype=np.uint64) << np.uint64(32)
EDGES = np.arange(HASHES * BINS + 1, dtype=np.uint64) * np.uint64(2**32) // np.uint64(BINS)
EMPTY = np.uint64(0xFFFFFFFF)
# Blanks that likeness ignores; fixed by the problem's statement.
DROPPED = " \t\n\r"


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted 64-bit hashes of the different pieces of width characters."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(a) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = a[:n].astype(np.uint64)
    for k in range(1, width):
        h *= M
        h ^= h >> np.uint64(29)
        h += a[k : n + k]
    h *= M
    h ^= h >> np.uint64(32)
    h.sort()
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def bitmap(s: np.ndarray) -> bytes:
    bits = np.zeros(BITS, np.uint8)
    bits[(s & np.uint64(BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def band_keys(s: np.ndarray) -> np.ndarray:
    """BANDS 32-bit keys of ROWS minima each: of every hash function one minimum in each of BINS ranges of its values. An
    empty range counts as a value; two sets agree in a range with a probability of at least their likeness."""
    v = (s >> np.uint64(16)).astype(np.uint32)[None, :] * MINIMA[:, None]
    v ^= v >> np.uint32(15)
    v *= np.uint32(0x2C1B3C6D)
    v.sort(axis=1)
    flat = (v + HASH_NO[:, None]).ravel()  # ascending, as the hash function's number stands in the upper half
    at = np.searchsorted(flat, EDGES[:-1])
    mins = np.append(flat, EDGES[-1])[at]
    mins = np.where(mins < EDGES[1:], mins, EMPTY).astype(np.uint32)
    rows = mins.reshape(ROWS, BANDS).astype(np.uint64)  # a band takes its minima from different hash functions
    h = rows[0].copy()
    for k in range(1, ROWS):
        h *= M
        h ^= h >> np.uint64(31)
        h += rows[k]
    h *= M
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def plain(text: str) -> str:
    text = text.lower()
    for c in DROPPED:
        text = text.replace(c, "")
    return text


def signed(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    """(k, x, h, n, bits, bands) of each row whose text has at least least characters once blanks are dropped; h stands for the
    set, which equal texts share, x for the text as stored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for b in batches:
            rows = []
            for k, x, t in zip(b["k"], b["x"], b["t"]):
                t = plain(t) if t else ""
                if len(t) >= max(least, WIDTH):
                    s = shingles(t)
                    rows.append((k, x, np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64), len(s), bitmap(s), band_keys(s)))
            yield pd.DataFrame(rows, columns=["k", "x", "h", "n", "bits", "bands"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key).alias("k"), F.xxhash64(text).alias("x"), F.col(text).alias("t")).where("k IS NOT NULL AND length(t) >= 5")).mapInPandas(run, f"k {kind}, x bigint, h bigint, n int, bits binary, bands array<int>")


def tile_pairs(percent: int):
    """Pairs (a, b) of a tile's sets with compatible sizes, and in how many of the tiles at hand they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def pairs(g: pd.DataFrame) -> pd.DataFrame:
            cuts = np.flatnonzero(np.concatenate(([True], np.any([g[c].to_numpy()[1:] != g[c].to_numpy()[:-1] for c in ("key", "i", "j")], axis=0), [True])))
            h, n, mine, i, j = (g[c].to_numpy() for c in ("h", "n", "tile", "i", "j"))
            out = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b - a < 2:
                    continue
                hh, nn = h[a:b], n[a:b]
                near = np.minimum(nn[:, None], nn[None, :]) * 100 >= percent * np.maximum(nn[:, None], nn[None, :])
                near &= hh[:, None] < hh[None, :]
                if i[a] != j[a]:
                    near &= mine[a:b][:, None] != mine[a:b][None, :]
                x, y = np.nonzero(near)
                out.append(np.stack((hh[x], hh[y]), axis=1))
            every = pd.DataFrame(np.concatenate(out) if out else np.empty((0, 2), np.int64), columns=["a", "b"])
            return every.groupby(["a", "b"], sort=False).size().reset_index(name="c")

        for b in batches:
            g = b if rest is None else pd.concat((rest, b), ignore_index=True)
            last = g.iloc[-1]
            tail = (g["key"] == last["key"]) & (g["i"] == last["i"]) & (g["j"] == last["j"])
            rest = g[tail]
            yield pairs(g[~tail])
        if rest is not None:
            yield pairs(rest)

    return run


def tiles(rows: DataFrame, percent: int) -> DataFrame:
    """(key, i, j, tile, h, n): each set of a bucket under every pair of tiles (i, j) that it is compared in. rows (h, n, key)
    are distinct.

    A bucket of at most TILE sets is one tile. Larger ones are cut by size band, of which compatible sizes are at most one
    apart, and each band by hash into parts of about TILE sets; the number of a band's parts comes from its own count.
    """
    step = f"(ln(100 / {percent}D) + 1e-6)"
    buckets = rows.groupBy("key").agg(F.count("*").alias("c")).where("c > 1")
    met = staged(rows.join(buckets.hint("merge"), "key"), "met")  # read three times below
    small = met.where(f"c <= {TILE}").select("key", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("tile"), "h", "n")
    large = met.where(f"c > {TILE}").withColumn("z", F.expr(f"cast(floor(ln(n) / {step}) as int)"))
    parts = large.groupBy("key", "z").agg(F.expr(f"cast(ceil(count(*) / {TILE}D) as int)").alias("t"))
    parts = parts.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("z", "t"))).alias("parts"))  # as many entries as bands
    large = large.join(parts.hint("merge"), "key").withColumn("tile", F.expr("shiftleft(cast(z as bigint), 32) | pmod(xxhash64(h), parts[z])"))
    others = [f"coalesce(transform(sequence(0, parts[z {d}] - 1), o -> shiftleft(cast(z {d} as bigint), 32) | o), array())" for d in ("- 1", "+ 0", "+ 1")]
    large = large.withColumn("o", F.explode(F.expr(f"concat({', '.join(others)})")))
    return small.unionByName(large.select("key", F.least("tile", "o").alias("i"), F.greatest("tile", "o").alias("j"), "tile", "h", "n"))


def bounded(percent: int):
    """Keep the pairs whose overlap can be large enough by their bitmaps."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            x, y = (np.frombuffer(b"".join(b[c]), np.uint64).reshape(len(b), -1) for c in ("bits_a", "bits_b"))
            na, nb = b["na"].to_numpy(np.int64), b["nb"].to_numpy(np.int64)
            over = np.minimum(na - np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64), nb - np.bitwise_count(y & ~x).sum(axis=1, dtype=np.int64))
            keep = over * 100 >= percent * (na + nb - over)
            yield b.loc[keep, ["a", "b"]]

    return run


def blocks(near: DataFrame, sizes: DataFrame) -> DataFrame:
    """(block, i, j, a, b): pairs gathered so that those of one family of copies mostly fall into one block, under the smallest
    set that either side is paired with. A block is cut into parts of about BLOCK pieces, and two parts meet under a key of
    their own, so no task holds more than two parts' texts. sizes: (h, n)."""
    both = near.select("a", "b").union(near.select("b", "a")).toDF("h", "o")
    label = both.groupBy("h").agg(F.least(F.min("h"), F.min("o")).alias("l"))
    side = lambda c: label.select(F.col("h").alias(c), F.col("l").alias(f"l_{c}")).hint("merge")
    x = near.join(side("a"), "a").join(side("b"), "b").select(F.least("l_a", "l_b").alias("block"), "a", "b")
    ends = x.select("block", F.explode(F.array("a", "b")).alias("h")).distinct().join(sizes.hint("merge"), "h")
    parts = ends.groupBy("block").agg(F.expr(f"cast(ceil(sum(n) / {BLOCK}D) as int)").alias("t"))
    x = x.join(parts.hint("merge"), "block").withColumn("p", F.expr("pmod(xxhash64(a), t)")).withColumn("q", F.expr("pmod(xxhash64(b), t)"))
    return x.select("block", F.least("p", "q").cast("int").alias("i"), F.greatest("p", "q").cast("int").alias("j"), "a", "b")


def verified(percent: int):
    """Exact intersection of sorted arrays. Rows come sorted by block and part, its texts (h, t) before its pairs (a, b)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, sets = None, {}
        for r in batches:
            out = []
            for block, i, j, h, t, a, b in zip(r["block"], r["i"], r["j"], r["h"], r["t"], r["a"], r["b"]):
                if (block, i, j) != at:
                    at, sets = (block, i, j), {}
                if t is not None:
                    sets[h] = shingles(plain(t))
                    continue
                x, y = sets[a], sets[b]
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                o = int((both[1:] == both[:-1]).sum())
                if o * 100 >= percent * (len(x) + len(y) - o):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def links(df: DataFrame, key: str = "result_id", text: str = "markdown", percent: int = 70, least: int = 200) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (k, h) names the set of each row with enough text, links (a, b), a < b, the pairs of
    different sets with likeness of at least percent. Rows with null keys, null texts or texts under least characters are
    in neither. Rows equal in key and text count once. An empty df gives two empty tables."""
    sets = staged(signed(df, key, text, least), "sets")
    members = sets.select("k", "h").distinct()
    nodes = sets.groupBy("h").agg(F.min(F.struct("k", "x")).alias("one"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("bands").alias("bands"))
    rows = nodes.select("h", "n", F.posexplode("bands").alias("band", "v")).select("h", "n", F.expr("shiftleft(cast(band as bigint), 32) | (v & 4294967295)").alias("key"))
    near = tiles(rows, percent).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(tile_pairs(percent), "a bigint, b bigint, c bigint")
    near = near.groupBy("a", "b").agg(F.sum("c").alias("c")).where(f"c >= {MEET}").select("a", "b")
    side = nodes.select("h", "n", "bits")
    near = near.join(side.select(F.col("h").alias("a"), F.col("n").alias("na"), F.col("bits").alias("bits_a")).hint("merge"), "a")
    near = near.join(side.select(F.col("h").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bits_b")).hint("merge"), "b")
    near = staged(near.mapInPandas(bounded(percent), "a bigint, b bigint"), "near")
    own = sets.groupBy("h").agg(F.min(F.struct("k", "x")).alias("one"), F.first("n").alias("n"))
    pairs_ = blocks(near, own.select("h", "n"))
    held = pairs_.select("block", "i", "j", F.explode(F.array("a", "b")).alias("h")).distinct().join(own.hint("merge"), "h").select("block", "i", "j", "h", "one.k", "one.x")
    texts = df.select(F.col(key).alias("k"), F.xxhash64(text).alias("x"), F.col(text).alias("t")).groupBy("k", "x").agg(F.first("t").alias("t"))
    held = texts.join(held.hint("merge"), ["k", "x"])
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    both = held.select("block", "i", "j", "h", "t", zero.alias("a"), zero.alias("b"), F.lit(0).alias("kind"))
    both = both.unionByName(pairs_.select("block", "i", "j", zero.alias("h"), none.alias("t"), "a", "b", F.lit(1).alias("kind")))
    return members, both.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "kind").drop("kind").mapInPandas(verified(percent), "a bigint, b bigint")


def pairs(df: DataFrame, key: str = "result_id", text: str = "markdown", percent: int = 70, least: int = 200) -> DataFrame:
    """(key_a, key_b), key_a < key_b: every two rows of different keys at least percent alike, equal texts included."""
    members, found = links(df, key, text, percent, least)
    members = staged(members, "members")
    same = pairs_within(members, "h", "k")
    unlike = found.join(members.select(F.col("h").alias("a"), F.col("k").alias("p")), "a").join(members.select(F.col("h").alias("b"), F.col("k").alias("q")), "b").select("p", "q")
    return same.union(unlike).where("p <> q").select(F.least("p", "q").alias(f"{key}_a"), F.greatest("p", "q").alias(f"{key}_b")).distinct()


def groups(df: DataFrame, key: str = "result_id", text: str = "markdown", percent: int = 70, least: int = 200, rounds: int = 60) -> DataFrame:
    """(key, group, n_links): the connected group of each row by links, named by its smallest key, and its number of links to
    different texts. Rows without enough text are groups of their own. Smallest labels spread along links and are
    followed to their own labels in each round, so that the number of rounds grows as the logarithm of a chain's length."""
    members, found = links(df, key, text, percent, least)
    members, found = staged(members, "members"), staged(found, "links")
    label = members.groupBy("h").agg(F.min("k").alias("g"))
    both = found.union(found.select("b", "a")).toDF("h", "o")
    label = before = staged(label, "label")
    for _ in range(rounds):
        low = both.join(label.select(F.col("h").alias("o"), "g").hint("merge"), "o").groupBy("h").agg(F.min("g").alias("low"))
        stepped = label.join(low, "h", "left").select("h", "g", F.least("g", F.coalesce("low", "g")).alias("s"))
        first = members.groupBy("k").agg(F.min("h").alias("fh"))  # a label is a key; follow it to the label of its own set
        hop = stepped.groupBy("s").agg(F.count("*").alias("_")).join(first.select(F.col("k").alias("s"), "fh"), "s").join(label.select(F.col("h").alias("fh"), F.col("g").alias("t")), "fh").select("s", "t")
        fresh = staged(stepped.join(hop, "s", "left").select("h", F.least("s", F.coalesce("t", "s")).alias("g"), F.col("g").alias("was")), "label")
        released(before)
        before, label = fresh, fresh.select("h", "g")
        if fresh.where("g <> was").isEmpty():
            break
    else:
        raise RuntimeError("groups have not settled")
    degree = both.groupBy("h").agg(F.count("*").alias("n_links"))
    own = members.join(label, "h").join(degree, "h", "left").groupBy("k").agg(F.min("g").alias("g"), F.max("n_links").alias("n_links"))
    rows = df.select(F.col(key).alias("k")).distinct()
    return rows.join(own, "k", "left").select(F.col("k").alias(key), F.coalesce("g", "k").alias("group"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
