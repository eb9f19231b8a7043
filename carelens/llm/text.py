"""Vectorised tokenising and hashing of Arrow text columns inside tasks.

Words are the runs ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes. All helpers work
on slices of an Arrow batch that hold a bounded number of text bytes, so a task
never needs more than a few such slices of memory; a single text longer than
that forms a slice of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
MASK = (1 << 64) - 1
LONG_WORD = 64

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FOLD = _LOWER.copy()
_FOLD[[b for b in range(128) if not chr(b).isalnum()]] = 0x20


def _table(seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**64, 256, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (a fixed bijection with good avalanche)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES):
    """Cut a batch into row ranges of about ``limit`` text bytes each."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    block = np.cumsum(size.astype(np.int64)) // limit
    cut = np.flatnonzero(np.diff(block)) + 1
    edges = [0, *cut.tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]], off - off[0]


class Words:
    """Words of a slice of texts: byte positions, owning row and 64-bit hashes.

    ``n``      words per row, ``first`` index of a row's first word,
    ``row``    row of each word, ``pos`` index of the word inside its row,
    ``start``/``end`` byte positions in ``raw``."""

    def __init__(self, col: pa.Array, lower: bool = False, fold: bool = False):
        raw, off = text_bytes(col)
        if lower:
            raw = _LOWER[raw]
        if fold:  # lower case, ASCII punctuation counts as blank
            raw = _FOLD[raw]
        self.raw, self.off = raw, off
        word = ~_SPACE[raw]
        size = len(raw)
        before, after = np.zeros(size, bool), np.zeros(size, bool)
        if size:
            before[1:], after[:-1] = word[:-1], word[1:]
            inner = off[(off > 0) & (off < size)]
            before[inner], after[inner - 1] = False, False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.start, off[:-1], side="left")
        self.n = np.diff(np.append(self.first, len(self.start)))
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        self.pos = np.arange(len(self.start)) - self.first[self.row]

    def hashes(self, seed: int = 1) -> np.ndarray:
        return span_hashes(self.raw, self.start, self.end, seed)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hash of each byte span (a polynomial over a random byte table)."""
    table, base = _table(seed), np.uint64(_table(seed + 1000)[0] | np.uint64(1))
    length = end - start
    h = np.zeros(len(start), np.uint64)
    order = np.argsort(-np.minimum(length, LONG_WORD + 1), kind="stable")
    s, left = start[order], np.minimum(length[order], LONG_WORD + 1)
    acc = np.zeros(len(start), np.uint64)
    count = np.searchsorted(-left, -np.arange(1, LONG_WORD + 1), side="right")
    for j in range(LONG_WORD):
        c = count[j]
        if c == 0:
            break
        acc[:c] = acc[:c] * base + table[raw[s[:c] + j]]
    h[order] = acc
    for i in np.flatnonzero(length > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(raw[start[i]:end[i]].tobytes(), seed)
    return mix(h)


def rolling(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hash of every k consecutive entries of ``h`` (length len(h) - k + 1, at least 0)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = int(_table(seed + 2000)[0]) | 1
    out, done, power, width = None, 0, h, 1
    while True:
        if k & width:
            if out is None:
                out, done = power, width
            else:
                m = len(h) - done - width + 1
                out = out[:m] * np.uint64(pow(base, width, 1 << 64)) + power[done:done + m]
                done += width
        if done == k:
            return mix(out[:n])
        m = len(power) - width
        power = power[:m] * np.uint64(pow(base, width, 1 << 64)) + power[width:width + m]
        width *= 2


def crc_mod(ids, m: int) -> np.ndarray:
    """crc32 of the decimal id modulo m; a null id counts as the empty string."""
    from zlib import crc32
    return np.array([crc32(b"" if i is None else str(i).encode()) % m for i in ids], np.int64)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def base_columns(docs, *names: str):
    """The named columns of ``docs``, cast only where a type differs (an alias
    on top of a column would keep Spark from reusing an exchange)."""
    from pyspark.sql import functions as F
    want = {"doc_id": "bigint"}
    have = dict(docs.dtypes)
    return docs.select(*[F.col(n) if have[n] == want.get(n, "string")
                         else F.col(n).cast(want.get(n, "string")).alias(n) for n in names])
