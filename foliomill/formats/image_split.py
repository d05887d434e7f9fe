"""Cutting long pictures at blank rows."""

from __future__ import annotations


import numpy as np


def blank_rows(pixels: np.ndarray, tolerance: float = 15.0, share: float = 0.98) -> np.ndarray:
    """Of each row of an RGB picture (height, width, 3) whether at least share of its pixels are near the pixel of median
    brightness."""
    p = pixels.astype(np.float64)
    order = np.argsort(p.sum(axis=2) / 3, axis=1, kind="stable")
    middle = np.take_along_axis(order, np.full((p.shape[0], 1), p.shape[1] // 2), axis=1)
    median = p[np.arange(p.shape[0]), middle[:, 0]]
    near = np.sqrt(((p - median[:, None, :]) ** 2).sum(axis=2)) < tolerance
    return near.mean(axis=1) >= share


def first_gap(blank: np.ndarray, start: int, end: int, least: int = 5) -> int | None:
    """The middle of the first run of least blank rows within start .. end."""
    run = 0
    for y in range(start, min(end, len(blank))):
        run = run + 1 if blank[y] else 0
        if run == least:
            return y - least + 1 + least // 2
    return None


def pieces(blank: np.ndarray, width: int, threshold: float = 2.0, start: float = 1.2, end: float = 1.5, overlap: float = 0.1) -> list[tuple[int, int]]:
    """(top, bottom) of the pieces of a picture whose height exceeds threshold widths. A cut is made at a gap between start and end
    widths below the top; without one at end, and the next piece then begins overlap widths earlier. A rest of less than
    half a width joins the piece above."""
    height = len(blank)
    if height <= width * threshold:
        return [(0, height)]
    out, top = [], 0
    while top < height:
        gap = first_gap(blank, top + int(width * start), top + int(width * end))
        cut = min(gap if gap is not None else top + int(width * end), height)
        cut = height if height - cut < width * 0.5 else cut
        out.append((top, cut))
        top = cut if cut == height or gap is not None else max(top + 1, cut - int(width * overlap))
    return out


def from_spark_image(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """RGB pixels of a row of Spark's image source, which holds rows of blue, green, red."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(a, 3, axis=2) if channels == 1 else a[:, :, 2::-1]


__all__ = ["blank_rows", "first_gap", "from_spark_image", "pieces"]
