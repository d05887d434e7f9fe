"""Byte budgets for returned text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

KIB = 1024
# Sizes and numbers of blocks.
BLOCK_BYTES = (4 * KIB, 28 * KIB, 30 * KIB)  # least, default, most
BLOCK_COUNT = (1, 4, 8)
MARKER = "\n\n[中间内容已省略]\n\n"


def clamp(value: Column, bounds: tuple[int, int, int]) -> Column:
    """A setting within bounds; null, NaN and infinities are the default."""
    least, default, most = bounds
    x = value.cast("double")
    ok = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.least(F.lit(most), F.greatest(F.lit(least), F.when(ok, F.floor(x)).otherwise(F.lit(default)))).cast("int")


def cut_blocks(text: str, most: int, count: int) -> tuple[list[str], bool]:
    """Blocks of at most most bytes, ending at line ends where there is one, never inside a character; and whether count blocks
    held everything."""
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= most:
        return [text], True
    blocks, at = [], 0
    while at < len(raw) and len(blocks) < count:
        end = min(at + most, len(raw))
        if end < len(raw):
            line = raw.rfind(b"\n", at, end)
            end = line + 1 if line >= at else end
            while end > at and raw[end] & 0xC0 == 0x80:
                end -= 1
            end = end if end > at else at + 1
        blocks.append(raw[at:end].decode("utf-8", "replace"))
        at = end
    return blocks, at >= len(raw)


def head(text: str, most: int) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= most:
        return text
    end = max(0, most)
    while end and raw[end] & 0xC0 == 0x80:
        end -= 1
    return raw[:end].decode("utf-8", "replace")


def head_tail(text: str, most: int) -> str:
    """Two fifths from the start and the rest from the end around a marker, in at most most bytes."""
    raw = text.encode("utf-8", "surrogatepass")
    mark = len(MARKER.encode())
    if len(raw) <= most:
        return text
    if most <= mark:
        return head(text, most)
    front = -(-(most - mark) * 2 // 5)
    start = len(raw) - (most - mark - front)
    while start < len(raw) and raw[start] & 0xC0 == 0x80:
        start += 1
    return head(text, front) + MARKER + raw[start:].decode("utf-8", "replace")


def fit(text: str, most: int, count: int, notice: str = "") -> str:
    """The longest head_tail that, with the notice, fits in the blocks."""
    low, high, best = 0, max(0, most * count - len(notice.encode())), notice
    while low <= high:
        mid = (low + high) // 2
        candidate = head_tail(text, mid) + notice
        if cut_blocks(candidate, most, count)[1]:
            best, low = candidate, mid + 1
        else:
            high = mid - 1
    return best


def blocks():
    """(text, most, count) -> STRUCT<blocks, complete> as a column function."""

    @F.pandas_udf("struct<blocks: array<string>, complete: boolean>")
    def run(text: pd.Series, most: pd.Series, count: pd.Series) -> pd.DataFrame:
        done = [cut_blocks(t or "", int(m), int(c)) for t, m, c in zip(text, most, count)]
        return pd.DataFrame({"blocks": [b for b, _ in done], "complete": [c for _, c in done]})

    return run


def fitted(most: int, count: int, notice: str = ""):
    """text -> the longest head and tail that fit in the blocks with the notice, as a column function."""

    @F.pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return text.map(lambda t: fit(t or "", most, count, notice))

    return run


def head_tail_column(text: Column, most: int) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else head_tail(t, most))

    return run(text)
