"""Compound files: a FAT-like file system within a file. Layout as in the published specification."""

from __future__ import annotations

import struct

MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
END, FREE = 0xFFFFFFFE, 0xFFFFFFFF


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC or len(data) < 512:
            raise ValueError("not a compound file")
        shift, mini_shift = struct.unpack_from("<HH", data, 30)
        self.data, self.size, self.mini_size = data, 1 << shift, 1 << mini_shift
        n_fat, start_dir, _, self.cutoff, start_mini, n_mini, start_difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)
        difat = list(struct.unpack_from("<109I", data, 76))
        sector, seen = start_difat, set()
        while sector < END and n_difat and sector not in seen:
            seen.add(sector)
            part = struct.unpack(f"<{self.size // 4}I", self.sector(sector))
            difat += part[:-1]
            sector = part[-1]
        per = self.size // 4
        self.fat = [x for s in difat[:n_fat] if s < END for x in struct.unpack(f"<{per}I", self.sector(s))]
        raw = self.chain(start_mini, self.fat, self.sector) if n_mini else b""
        self.mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]))
        entries = self.chain(start_dir, self.fat, self.sector)
        self.entries = {}
        self.root = b""
        for k in range(0, len(entries) - 127, 128):
            e = entries[k : k + 128]
            n, kind = struct.unpack_from("<H", e, 64)[0], e[66]
            start, size = struct.unpack_from("<I", e, 116)[0], struct.unpack_from("<I", e, 120)[0]
            label = e[: max(n - 2, 0)].decode("utf-16-le", "replace")
            if kind == 5:
                self.root = self.chain(start, self.fat, self.sector)[:size]
            elif kind == 2:
                self.entries[label] = (start, size)

    def sector(self, k: int) -> bytes:
        part = self.data[(k + 1) * self.size : (k + 2) * self.size]
        return part.ljust(self.size, b"\0")

    def mini_sector(self, k: int) -> bytes:
        return self.root[k * self.mini_size : (k + 1) * self.mini_size]

    @staticmethod
    def chain(start: int, table: list[int], sector) -> bytes:
        out, k, left = [], start, len(table)
        while k < END and k < len(table) and left >= 0:
            out.append(sector(k))
            k, left = table[k], left - 1
        return b"".join(out)

    def stream(self, label: str) -> bytes:
        start, size = self.entries[label]
        if size < self.cutoff:
            return self.chain(start, self.mini_fat, self.mini_sector)[:size]
        return self.chain(start, self.fat, self.sector)[:size]


def equation(data: bytes) -> bytes | None:
    """The equation's records in an embedded object, or None. The stream begins with its header's length, and the length of
    what follows at byte 8; if that is too large, all that is there counts."""
    try:
        c = Compound(data)
    except (ValueError, struct.error):
        return None
    label = next((x for x in c.entries if "Equation" in x), None)
    if label is None:
        return None
    raw = c.stream(label)
    if len(raw) < 28:
        return None
    head, size = struct.unpack_from("<H", raw)[0], struct.unpack_from("<I", raw, 8)[0]
    return raw[head:] if head + size > len(raw) else raw[head : head + size]
