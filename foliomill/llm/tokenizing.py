"""Token ids of whole texts by a public byte-level BPE tokenizer (problem 7).

Method: BPE as DuckDB recursive queries, one DuckDB in each Python worker. A text is cut into words by the tokenizer's
pattern; a word's bytes become token-position rows that join the merge table; in each round of the recursion every word
contracts its leftmost pair of minimum rank, until no pair of any word can be merged; an ordered aggregation gives the ids.

What makes this affordable on a whole corpus:

* A word is cut further where two neighbouring bytes occur side by side in no token of the vocabulary. No merge can ever
  cross such a place, so the ids are the same. A run of Chinese characters falls into pieces of one or two characters.
* The recursion runs over the distinct pieces that a worker has not met yet, a few thousand rows, not over the corpus.
* A piece of more than ``WINDOW`` bytes is encoded in windows, which are then joined two by two: the tokens around a seam are
  encoded together, and if the outermost of them come out as they were, the rest stands; else the tokens after the seam are encoded again until they do. (Tokens are a text's encoding exactly if each
  two neighbours are the encoding of their own bytes: the first contraction across a boundary between two tokens would be made in
  their own encoding, too.) So a word of a megabyte costs as much as a
  megabyte of short words, where one recursion over it would need rows in the square of its length.

The recursion keeps the rows of all its rounds, so pieces go in by the sum of their squared lengths, ``ROWS`` at a time. The words
known to a worker are forgotten once there are more than ``memo`` of them, and long ones at once, so memory stays bounded.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

TOKENIZERS = "/opt/tokenizers"
MEMO = 400_000
BATCH = 5_000  # texts encoded together, or fewer if they have more than BATCH_BYTES
BATCH_BYTES = 16_000_000
WINDOW = 32  # bytes
SEAM = 12  # bytes on each side of a seam
LONG = 2_048  # bytes of a piece that the recursion takes on, and of a word that is remembered
ROWS = 4_000_000

# The recursion, over piece_bytes(piece, pos, id) and merges(a, b, rank, id). Positions keep their gaps after a contraction,
# which does no harm: neighbours are found by order. A piece's rows of its last round n are its tokens.
BPE_SQL = """
WITH RECURSIVE state(piece, pos, id, n) AS (
  SELECT piece, pos, id, 0 FROM piece_bytes
  UNION ALL
  (WITH cur AS (SELECT piece, pos, id, n, lead(id) OVER w AS nxt, lead(pos) OVER w AS nxt_pos
                FROM state WINDOW w AS (PARTITION BY piece ORDER BY pos)),
        can AS (SELECT c.piece, c.pos, c.nxt_pos, m.rank, m.id FROM cur c JOIN merges m ON m.a = c.id AND m.b = c.nxt),
        best AS (SELECT piece, arg_min(struct_pack(pos := pos, nxt_pos := nxt_pos, id := id), (rank, pos)) AS s FROM can GROUP BY piece)
   SELECT c.piece, c.pos, CASE WHEN c.pos = b.s.pos THEN b.s.id ELSE c.id END, c.n + 1
   FROM cur c JOIN best b USING (piece) WHERE c.pos <> b.s.nxt_pos)
)
SELECT s.piece, list(s.id ORDER BY s.pos) AS ids
FROM state s JOIN (SELECT piece, max(n) AS n FROM state GROUP BY piece) l USING (piece, n)
GROUP BY s.piece
"""

# One round of the same over a table of one piece, (pos, id), for pieces whose recursion would have too many rows.
ROUND_SQL = """
WITH cur AS (SELECT pos, id, lead(id) OVER w AS nxt, lead(pos) OVER w AS nxt_pos FROM state WINDOW w AS (ORDER BY pos)),
     best AS (SELECT c.pos, c.nxt_pos, m.id FROM cur c JOIN merges m ON m.a = c.id AND m.b = c.nxt ORDER BY m.rank, c.pos LIMIT 1)
SELECT c.pos, CASE WHEN c.pos = b.pos THEN b.id ELSE c.id END AS id FROM cur c, best b WHERE c.pos <> b.nxt_pos
"""


def vocabulary(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 of the token's bytes, a blank, its rank, which is also its id."""
    with open(path, "rb") as f:
        return ranks_in(f.read())


def ranks_in(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Bpe:
    """Encoder of one worker. pattern: cuts a text into words; the words together are the whole text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, memo: int = MEMO):
        import duckdb
        import regex

        self.ranks, self.memo = ranks, memo
        self.token = {r: t for t, r in ranks.items()}
        self.words = regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.pieces: dict[bytes, tuple[int, ...]] = {}
        self.byte_id = [ranks[bytes([b])] for b in range(256)]
        self.joins = np.zeros(65536, bool)  # true where two bytes stand side by side in some token
        for token in ranks:
            for x, y in zip(token, token[1:]):
                self.joins[x << 8 | y] = True
        rows = [(ranks[t[:k]], ranks[t[k:]], r, r) for t, r in ranks.items() if len(t) > 1 for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.db = duckdb.connect(config={"threads": 1})
        merges = pa.table(dict(zip(("a", "b", "rank", "id"), (pa.array(c, pa.int32()) for c in zip(*rows)))))
        self.db.register("m_", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM m_")
        self.db.unregister("m_")

    def cut(self, words: list[bytes]) -> list[list[bytes]]:
        """Pieces of each word's bytes between which nothing can merge."""
        blob = b"".join(words)
        at = np.frombuffer(blob, np.uint8).astype(np.int32)
        ends = np.cumsum([len(w) for w in words])
        cuts = ~self.joins[at[:-1] << 8 | at[1:]]
        cuts[ends[:-1] - 1] = True
        marks = np.concatenate(([0], np.flatnonzero(cuts) + 1, [len(blob)]))
        pieces = [blob[a:b] for a, b in zip(marks[:-1].tolist(), marks[1:].tolist())]
        where = np.searchsorted(marks, ends).tolist()
        return [pieces[a:b] for a, b in zip([0, *where], where)]

    def contract(self, pieces: list[bytes]) -> None:
        """Keep the ids of pieces not known yet."""
        self.pieces.update((p, (self.ranks[p],)) for p in pieces if len(p) == 1)
        self.recursion([p for p in pieces if 1 < len(p) <= WINDOW])
        self.joined([p for p in pieces if len(p) > WINDOW])

    def recursion(self, todo: list[bytes]) -> None:
        """Run the recursive query over pieces, so many at a time that its rows stay below ROWS."""
        sums = np.cumsum([len(p) ** 2 // 2 for p in todo])
        start = 0
        while start < len(todo):
            end = max(start + 1, int(np.searchsorted(sums, (sums[start - 1] if start else 0) + ROWS)))
            part = todo[start:end]
            start = end
            if len(part[0]) > LONG:
                self.pieces[part[0]] = self.one(part[0])
                continue
            flat = b"".join(part)
            no = [i for i, p in enumerate(part) for _ in p]
            pos = [j for p in part for j in range(len(p))]
            table = pa.table({"piece": pa.array(no, pa.int32()), "pos": pa.array(pos, pa.int32()), "id": pa.array([self.byte_id[b] for b in flat], pa.int32())})
            self.db.register("piece_bytes", table)
            for i, ids in self.db.execute(BPE_SQL).fetchall():
                self.pieces[part[i]] = tuple(ids)
            self.db.unregister("piece_bytes")

    def one(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a piece by rounds that each replace the state."""
        state = pa.table({"pos": pa.array(range(len(piece)), pa.int32()), "id": pa.array([self.byte_id[b] for b in piece], pa.int32())})
        while True:
            self.db.register("state", state)
            after = self.db.execute(ROUND_SQL).to_arrow_table()
            self.db.unregister("state")
            if not after.num_rows:
                return tuple(state.sort_by("pos").column("id").to_pylist())
            state = after

    def encoded(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of short pieces, remembered or not."""
        fresh = list(dict.fromkeys(p for p in pieces if p not in self.pieces))
        self.pieces.update((p, (self.ranks[p],)) for p in fresh if len(p) == 1)
        self.recursion([p for p in fresh if len(p) > 1])
        return [self.pieces[p] for p in pieces]

    def joined(self, pieces: list[bytes]) -> None:
        """Encode long pieces in windows and join these two by two."""
        parts = [self.encoded([p[k : k + WINDOW] for k in range(0, len(p), WINDOW)]) for p in pieces]
        while any(len(p) > 1 for p in parts):
            ends = [(x[k], x[k + 1]) for x in parts for k in range(0, len(x) - 1, 2)]
            cuts = [(len(a) - self.some(reversed(a)), self.some(b)) for a, b in ends]
            seams = self.encoded([self.bytes_of(a[i:] + b[:j]) for (a, b), (i, j) in zip(ends, cuts)])
            made = iter([a[:i] + r + b[j:] if (not i or r[0] == a[i]) and (j == len(b) or r[-1] == b[j - 1]) else self.shifted(a, b) for (a, b), (i, j), r in zip(ends, cuts, seams)])
            parts = [[next(made) if k + 1 < len(x) else x[k] for k in range(0, len(x), 2)] for x in parts]
        self.pieces.update((p, x[0]) for p, x in zip(pieces, parts))

    def bytes_of(self, ids: tuple[int, ...]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))

    def some(self, ids) -> int:
        """How many of the first ids to take for a seam: two at least, of SEAM bytes or more."""
        size = n = 0
        for n, i in enumerate(ids, 1):
            size += len(self.token[i])
            if n > 1 and size >= SEAM:
                break
        return n

    def shifted(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """a and b joined where tokens of b move, as in a run of equal signs whose tokens' lengths do not divide a's: b is
        encoded again from its start until its tokens are as before. Such runs repeat, so most steps are remembered ones."""
        out, at = list(a), 0
        while at < len(b):
            part = b[at : at + self.some(b[at : at + WINDOW])]
            k = self.some(reversed(out))
            while True:
                r = self.encoded([self.bytes_of((*out[-k:], *part))])[0]
                if len(out) <= k or r[0] == out[-k]:
                    break
                k *= 2
            out[-k:] = r
            at += len(part)
            if r[-1] == part[-1]:
                break
        return (*out, *b[at:])

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; [] for an empty text and for null. A lone surrogate is read as U+FFFD."""
        known = self.known
        if len(known) > self.memo or len(self.pieces) > self.memo:
            known.clear()
            self.pieces.clear()
        split = [self.words.findall(t) if t else [] for t in texts]
        fresh = set().union(*split).difference(known) if split else set()
        if fresh:
            cuts = dict(zip(fresh, self.cut([w.encode("utf-8", "replace") for w in fresh])))
            self.contract(sorted({p for c in cuts.values() for p in c}.difference(self.pieces)))
            pieces = self.pieces
            for w, c in cuts.items():
                known[w] = pieces[c[0]] if len(c) == 1 else tuple(i for p in c for i in pieces[p])
        ids = [list(chain.from_iterable(map(known.__getitem__, ws))) for ws in split]
        for w in fresh:
            if len(w) > LONG:
                del known[w]
        for p in [p for p in self.pieces if len(p) > LONG] if fresh else ():
            del self.pieces[p]
        return ids


_ENCODERS: dict[tuple, Bpe] = {}


def encoder(data: bytes, pattern: str, memo: int = MEMO) -> Bpe:
    """The worker's encoder for a vocabulary file's content."""
    at = (hash(data), len(data), pattern, memo)
    if at not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[at] = Bpe(ranks_in(data), pattern, memo)
    return _ENCODERS[at]


def portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """(start, end) of the texts that are encoded together."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= BATCH_BYTES or k - start + 1 >= BATCH:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def paths(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[str, str]:
    """File and word pattern of a public byte-level tokenizer in folder (see its README)."""
    import importlib.util
    import os

    spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return os.path.join(folder, f"{name}.tiktoken"), module.PATTERN


def token_ids(df: DataFrame, key: str = "doc_id", text: str = "text", out: str = "ids", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, count_only: bool = False) -> DataFrame:
    """(key, ids ARRAY<INT>) for every row of df, or (key, ids INT) with their number if count_only.

    Null and empty texts get [] (0). Special tokens' strings are ordinary text. Rows equal in key stay apart. No shuffle
    but of an input with fewer partitions than cores: one pass over two columns of df. Other columns of df, whatever their names, are not read.
    """
    file, pattern = paths(tokenizer, folder)
    with open(file, "rb") as f:  # a few MB at most, whatever the corpus's size
        sent = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(sent.value, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for start, end in portions(texts):
                ids = bpe.encode_batch(texts[start:end])
                if count_only:
                    values = pa.array([len(x) for x in ids], pa.int32())
                else:
                    ends = np.zeros(len(ids) + 1, np.int32)
                    np.cumsum([len(x) for x in ids], out=ends[1:])
                    flat = np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))
                    values = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, end - start), values], names=["k", "v"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).mapInArrow(run, f"k {kind}, v {'int' if count_only else 'array<int>'}").select(F.col("k").alias(key), F.col("v").alias(out))
