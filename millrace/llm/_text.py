"""Vectorised tokenising of whole texts held in Arrow buffers.

Texts are worked on as UTF-8 bytes, some megabytes at a time. Every separator used here is
ASCII, so a byte table does what a character class would do and keeps all byte positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
SPACE = 0x20


def _byte_table(separators: set[int]) -> bytes:
    lower = {b: b + 32 for b in range(ord("A"), ord("Z") + 1)}
    return bytes(SPACE if lower.get(b, b) in separators else lower.get(b, b) for b in range(256))


#: A-Z lower-cased; words are [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = _byte_table({*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})
#: A-Z lower-cased; words are [^\x20\x09-\x0D]+
BLANK = _byte_table({0x20, *range(0x09, 0x0E)})

_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One large_string array without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(first row, end row, the rows' bytes, offsets into them) with about `limit` bytes; a longer text comes alone."""
    arr = strings(column)
    if not len(arr):
        return
    offs = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = memoryview(arr.buffers()[2]) if arr.buffers()[2] is not None else memoryview(b"")
    i = 0
    while i < len(arr):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, len(arr))
        yield i, j, bytes(data[offs[i] : offs[j]]), offs[i : j + 1] - offs[i]
        i = j


class Words:
    """Words of a chunk: byte starts and ends, and for each row the first word's number."""

    def __init__(self, raw: bytes, offs: np.ndarray, table: bytes):
        self.raw, self.offs = raw, offs
        self.low = raw.translate(table)
        self.buf = buf = np.frombuffer(self.low, np.uint8)
        n = len(buf)
        if not n:
            self.starts = self.ends = np.zeros(0, np.int64)
            self.ptr = np.zeros(len(offs), np.int64)
            return
        word = buf != SPACE
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        rows = offs[:-1][offs[:-1] < offs[1:]]
        first[rows] = word[rows]
        rows = offs[1:][offs[:-1] < offs[1:]] - 1
        last[rows] = word[rows]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.starts, offs)

    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        starts = self.starts
        if not len(starts):
            return np.zeros(0, np.uint64)
        longest = int((self.ends - starts).max())
        powers = np.full(longest + 1, _BASE)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        s0, n = int(starts[0]), len(self.buf)
        rel = np.arange(s0, n, dtype=np.int64)
        rel -= np.repeat(starts, np.diff(np.append(starts, n)))
        np.minimum(rel, longest, out=rel)
        h = np.add.reduceat(_BYTE[self.buf[s0:]] * powers[rel], starts - s0)
        return mix(h + (self.ends - starts).astype(np.uint64))

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, one space between them."""
        return b" ".join(self.low[s:e] for s, e in zip(self.starts[i:j].tolist(), self.ends[i:j].tolist()))


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; the caller leaves out those that cross rows."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    odd = mix(np.arange(1, k + 1, dtype=np.uint64) * _BASE) | np.uint64(1)
    acc = h[:n] * odd[0]
    for j in range(1, k):
        acc += h[j : j + n] * odd[j]
    return mix(acc + np.uint64(k))


def inside(ptr: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n windows of k words lie within one row."""
    ok = np.ones(max(n, 0), bool)
    for back in range(1, k):  # a window may not start in the k - 1 words before a row's end
        at = ptr[1:] - back
        at = at[(at >= 0) & (at < len(ok))]
        ok[at] = False
    return ok


def code_points(low: bytes, offs: np.ndarray) -> np.ndarray:
    """Code points of each row."""
    lead = (np.frombuffer(low, np.uint8) & 0xC0) != 0x80
    c = np.concatenate([[0], np.cumsum(lead)])
    return c[offs[1:]] - c[offs[:-1]]
