"""Vectorised words and rolling hashes over Arrow text batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which is what
``[^\\x20\\x09-\\x0D]+`` finds in UTF-8.  Everything works on whole batches of
documents at once; a batch is cut into pieces of about ``PIECE`` bytes first, so
that memory does not follow the size of an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
U = np.uint64
_BASE = (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1)
_rng = np.random.Generator(np.random.PCG64(20240229))
#: 64 random bits for each byte value; the second table folds A-Z onto a-z.
_BITS = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_BITS_LOWER = _BITS[_FOLD]
_WORD = np.ones(256, bool)
_WORD[[32, 9, 10, 11, 12, 13]] = False
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(lane: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n.  Tables for up to two pieces are kept; those of longer texts go with them."""
    have = _powers.get(lane)
    if have is None or len(have[0]) <= n:
        out = []
        for b in (_BASE[lane], pow(_BASE[lane], -1, 1 << 64)):
            a = np.full(max(n, PIECE) + 1, b, U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        have = (out[0], out[1])
        if n <= 2 * PIECE:
            _powers[lane] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; one document at least."""
    i = batch.schema.get_field_index(text)
    lengths = np.diff(offsets(batch.column(i))[1])
    at, total = 0, 0
    for k, n in enumerate(lengths):
        if total and total + n > limit:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


def offsets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts; nulls are empty."""
    if arr.null_count:
        arr = arr.fill_null("" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    buffers = arr.buffers()
    if not len(arr) or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    o = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[o[0] : o[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, o - o[0]


class Words:
    """The words of a piece, runs of bytes of ``table``: ``first[d]:first[d+1]`` are those of document d."""

    def __init__(self, column: pa.Array, lower: bool = False, table: np.ndarray = _WORD):
        self.data, self.offs = data, offs = offsets(column)
        w = table[data]
        n = len(data)
        if n:
            prev = np.empty(n, bool)
            prev[0] = False
            prev[1:] = w[:-1]
            prev[offs[:-1][offs[:-1] < n]] = False
            nxt = np.empty(n, bool)
            nxt[-1] = False
            nxt[:-1] = w[1:]
            nxt[offs[1:][offs[1:] > 0] - 1] = False
            self.start = np.flatnonzero(w & ~prev)
            self.end = np.flatnonzero(w & ~nxt) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offs)
        self.lower = lower

    def hashes(self) -> np.ndarray:
        """64 bits for each word, the same for equal words."""
        n = len(self.data)
        up, down = powers(0, n)
        h = np.zeros(n + 1, U)
        np.cumsum((_BITS_LOWER if self.lower else _BITS)[self.data] * up[:n], out=h[1:])
        return mix((h[self.end] - h[self.start]) * down[self.start] + (self.end - self.start).astype(U))


class Ranges:
    """Hashes of ranges of a sequence in constant time each."""

    def __init__(self, h: np.ndarray, lane: int = 0):
        n = len(h)
        up, self.down = powers(lane, n)
        self.sum = np.zeros(n + 1, U)
        np.cumsum((h if lane == 0 else mix(h + U(0x632BE59BD9B4E019))) * up[:n], out=self.sum[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sum[end] - self.sum[start]) * self.down[start] + (end - start).astype(U))


def starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, start) of all windows of k words inside one document."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    doc = np.repeat(np.arange(len(n)), n)
    return doc, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] of them), start[1], ..."""
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
