"""Cutting items larger than the limits at natural boundaries, with an overlap between pieces (problem 3).

Method: agglomerative merging. An item starts as atomic segments, cut at every possible boundary (page, paragraph, sentence,
word, and, within words of more than GRAIN bytes, characters). Adjacent pairs wait in a heap by the strength of the boundary between
them; the weakest are merged first, as long as the merged segment, with the overlap in front, fits both limits.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

# Boundaries by strength. A match ends where a piece may end; bytes, so that sizes are those of the limits.
PAGE = re.compile(rb"\x0c")
PARAGRAPH = re.compile(rb"(?:\r\n|\r|\n|\xe2\x80\xa9|\xe2\x80\xa8|\xc2\x85)+")
SENTENCE = re.compile(rb"(?:[.!?]+[\"')\]]*(?:\xe2\x80[\x99\x9d])*[ \t]+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xef\xbd\xa1)(?:\xe3\x80\x8d|\xe2\x80[\x99\x9d])*)")
WORD = re.compile(rb"(?:[ \t]+|\xe3\x80\x80|\xc2\xa0|\xef\xbc\x8c|\xef\xbc\x9b|\xe3\x80\x81)+")
LEVELS = ((4, PAGE), (3, PARAGRAPH), (2, SENTENCE), (1, WORD))
GRAIN = 64  # bytes of an atomic segment within a word that is longer


def char_start(data: bytes, at: int) -> int:
    """The start of the character that holds the byte at at; bytes that are no UTF-8 count one by one after three."""
    low = max(0, at - 3)
    k = at
    while k > low and k < len(data) and data[k] & 0xC0 == 0x80:
        k -= 1
    return at if k < len(data) and data[k] & 0xC0 == 0x80 else k


def atoms(data: bytes, most: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments and the strength of the boundary at each; none is longer than most bytes."""
    strength: dict[int, int] = {len(data): 5}
    for level, pattern in reversed(LEVELS):
        for m in pattern.finditer(data):
            if 0 < m.end() < len(data):
                strength[m.end()] = level
    ends, out = sorted(strength), []
    start = 0
    for e in ends:
        while e - start > most:
            cut = char_start(data, start + most)
            cut = cut if cut > start else start + most
            out.append((cut, 0))
            start = cut
        out.append((e, strength[e]))
        start = e
    return [e for e, _ in out], [s for _, s in out]


def front(data: bytes, start: int, overlap: int) -> int:
    """Where the overlap before start begins: at most overlap bytes back, moved forward to the next boundary if one is near,
    at least to a character's start."""
    if not start:
        return 0
    low = max(0, start - overlap)
    at = low
    while at < start and data[at] & 0xC0 == 0x80 and at - low < 4:
        at += 1
    if low and at < start and not (data[at - 1 : at].isspace()):
        m = WORD.search(data, at, min(start, at + overlap // 4))
        if m and m.end() < start:
            return m.end()
    return at


class Pages:
    """0-based page of a byte. Pages change at form feeds. If an item is said to have more pages than its form feeds show, they
    count as spread evenly over the bytes; if fewer, what follows the last page counts as that page."""

    def __init__(self, data: bytes, pages: int):
        self.feeds = [m.start() for m in PAGE.finditer(data)]
        self.data, self.n, self.pages = data, len(data), max(pages, 1)

    def last(self, end: int) -> int:
        """Page of the last character before end."""
        return self(char_start(self.data, end - 1))

    def __call__(self, at: int) -> int:
        seen = bisect_left(self.feeds, at)
        if len(self.feeds) + 1 >= self.pages:
            return min(seen, self.pages - 1)
        return min(self.pages - 1, max(seen, at * self.pages // max(self.n, 1)))


def pieces(data: bytes | None, start_page: int | None, end_page: int | None, limit: int, page_limit: int, overlap: int) -> tuple[int, bool, list[tuple[int, int, int, int]]]:
    """(pages, over the limits, pieces (start page, end page, begin, end) with begin .. end the bytes, overlap included)."""
    feeds = (data or b"").count(b"\x0c")
    known = start_page is not None and end_page is not None
    low = min(start_page, end_page) if known else start_page if start_page is not None else max(1, end_page - feeds) if end_page is not None else 1
    pages = abs(end_page - start_page) + 1 if known else feeds + 1
    over = len(data or b"") > limit or pages > page_limit
    if not data:
        # Nothing to cut but the pages themselves.
        return pages, over, [(low + k, low + min(k + page_limit, pages) - 1, 0, 0) for k in range(0, pages, page_limit)]
    if not over:
        return pages, False, [(low, low + pages - 1, 0, len(data))]
    page = Pages(data, pages)
    if 2 * overlap > limit:
        raise ValueError("overlap must be at most half of limit")
    out = []
    for a, b in merged(data, page, limit, overlap, page_limit):
        begin = front(data, a, overlap)
        while begin < a and page.last(b) - page(begin) >= page_limit:
            begin = min((f + 1 for f in page.feeds if f >= begin), default=a) if any(begin <= f < a for f in page.feeds) else a
        out.append([low + page(begin), low + max(page(begin), page.last(b)), begin, b])
    out[0][0] = min(out[0][0], low)
    out[-1][1] = max(out[-1][1], min(low + pages - 1, out[-1][0] + page_limit - 1))
    while out[-1][1] < low + pages - 1:  # pages that have no bytes
        out.append([out[-1][1] + 1, min(out[-1][1] + page_limit, low + pages - 1), len(data), len(data)])
    return pages, True, [tuple(x) for x in out]


def merged(data: bytes, page: Pages, limit: int, overlap: int, page_limit: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of data, without their overlaps. Every piece fits in limit bytes together with up to
    overlap bytes in front, and touches at most page_limit pages; the pages of the overlap count unless page_limit is 1."""
    room = max(1, limit - overlap)
    # An atom may not lie on more pages than a piece, either.
    ends, edge = atoms(data, max(1, min(GRAIN, room, len(data) * page_limit // page.pages)))
    n = len(ends)
    start, end = [0, *ends[:-1]], list(ends)
    first = [page(max(0, x - overlap) if page_limit > 1 else x) for x in start]
    last = [page.last(x) for x in ends]  # of a segment's end, which is that of its last atom
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    # A pair waits under the boundary between its two segments, then its size; one that has changed meanwhile is passed over.
    heap = [(edge[i], end[i + 1] - start[i], i, end[i], end[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    push, pop = heapq.heappush, heapq.heappop
    while heap:
        _, size, i, ei, ej = pop(heap)
        j = right[i]
        if not alive[i] or j >= n or end[i] != ei or end[j] != ej:
            continue
        if size > (room if start[i] else limit) or last[j] - first[i] >= page_limit:
            continue
        k = right[j]
        end[i], edge[i], last[i], alive[j], right[i] = ej, edge[j], last[j], False, k
        if k < n:
            left[k] = i
            if (size := end[k] - start[i]) <= limit:
                push(heap, (edge[i], size, i, ej, end[k]))
        h = left[i]
        if h >= 0 and (size := ej - start[h]) <= limit:
            push(heap, (edge[h], size, h, end[h], ej))
    return [(start[i], end[i]) for i in range(n) if alive[i]]


def split(df: DataFrame, limit: int, page_limit: int, overlap: int, key: str = "chunk_id", start: str = "start_page", end: str = "end_page", data: str = "data") -> DataFrame:
    """(key, piece INT, n_pieces INT, over BOOLEAN, start_page INT, end_page INT, data BINARY): the pieces of every row.

    An overlap starts at a boundary where one is near, so it may be shorter than overlap by a quarter, and it is cut short
    where it would lie on one page more than page_limit allows (with a page_limit of 1: at every page). overlap must be at most half
    of limit. A row within both limits comes out whole, as one piece. Null or empty data gives pieces without data, one for each
    page_limit pages. Pages run from start to end in either order; where one is null, form feeds plus one count. Without
    overlaps the pieces of a row, put together, are its data. Equal rows come out equally. Other columns are not read.
    """
    if limit < 8 or page_limit < 1 or not 0 <= 2 * overlap <= limit:
        raise ValueError("limit must be at least 8, page_limit at least 1, overlap between 0 and half of limit")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, s, e, d in zip(*(b.column(i).to_pylist() for i in range(4))):
                pages, over, parts = pieces(d, s, e, limit, page_limit, overlap)
                rows += [(k, i, len(parts), over, a, z, None if d is None else d[x:y]) for i, (a, z, x, y) in enumerate(parts)]
            columns = list(zip(*rows)) or [()] * 7
            kinds = (b.schema.field(0).type, pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["k", "piece", "n_pieces", "over", "start_page", "end_page", "data"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(start).cast("int").alias("s"), F.col(end).cast("int").alias("e"), F.col(data).cast("binary").alias("d"))
    done = spread(rows).mapInArrow(run, f"k {kind}, piece int, n_pieces int, over boolean, start_page int, end_page int, data binary")
    return done.withColumnRenamed("k", key)
