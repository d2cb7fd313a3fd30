"""Vectorised kernels over the flat buffers of Arrow string columns: words, hashes, minimizers."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Bytes of the words [^\x20\x09-\x0D]+.
SPACE_WORD = np.ones(256, dtype=bool)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
ALNUM_WORD = np.zeros(256, dtype=bool)
ALNUM_WORD[0x30:0x3A] = ALNUM_WORD[0x61:0x7B] = ALNUM_WORD[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` pseudorandom words that depend on ``seed`` only."""
    return mix((np.arange(n, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + U(seed * 0xD1342543DE82EF95 & (2**64 - 1)))


BYTE_VALUE = constants(256, 11)


def give_back() -> None:
    """Returns freed memory to the system, which Arrow's pool and the C library would hold on to in a reused worker."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def parts(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows."""
    for batch in batches:
        for i in range(0, len(batch), rows):
            yield batch.slice(i, rows)


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offsets, data = col.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offs[0] : offs[-1]], offs - offs[0]


def slices(offs: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Runs of rows with about ``limit`` bytes; a longer row is a run of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def words(data: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the number of words before it. Rows break words."""
    inside = np.empty(len(data) + 1, dtype=bool)
    np.take(table, data, out=inside[:-1])
    inside[-1] = False
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[0] = False
    before[offs] = False
    starts = np.flatnonzero(inside & ~before)
    # a word ends where the next byte is no word byte or begins a row
    after = inside[1:].copy()
    cut = offs[1:-1]
    after[cut[cut > 0] - 1] = False
    ends = np.flatnonzero(inside[:-1] & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs).astype(np.int64)


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every range, one after another."""
    total = int(lens.sum())
    if not total:
        return np.zeros(0, np.int64)
    ahead = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - ahead, lens)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: a sum of bytes times a pseudorandom word of their place, spread."""
    if not len(starts):
        return np.zeros(0, U)
    lens = ends - starts
    at = ragged(starts, lens)
    place = at - np.repeat(starts, lens)
    values = (data[at].astype(U) + U(1)) * constants(int(lens.max()), 3)[place]
    return mix(np.add.reduceat(values, np.cumsum(lens) - lens) + lens.astype(U))


_R = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(which)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for r in (_R[which], pow(_R[which], -1, 2**64)):
            p = np.full(size, r, dtype=U)
            p[0] = 1
            both.append(np.cumprod(p))
        if size <= 1 << 22:
            _POWERS[which] = (both[0], both[1])
        have = (both[0], both[1])
    return have


class Rolling:
    """Hashes of any span of symbols in constant time, from a running polynomial sum modulo 2**64."""

    def __init__(self, x: np.ndarray, which: int):
        up, self.down = _powers(which, len(x) + 1)
        self.total = np.zeros(len(x) + 1, dtype=U)
        np.cumsum(x * up[: len(x)], out=self.total[1:])

    def every(self, k: int) -> np.ndarray:
        n = len(self.total) - k
        return mix((self.total[k:] - self.total[:-k]) * self.down[:n])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def sliding_min(x: np.ndarray, m: int) -> np.ndarray:
    """Minimum of every ``m`` neighbours, by doubling."""
    n, s = len(x), 1
    while 2 * s <= m:
        x = np.minimum(x[:-s], x[s:])
        s *= 2
    return np.minimum(x[: n - m + 1], x[m - s : n - s + 1]) if s < m else x


def sliding_argmin(x: np.ndarray, m: int) -> np.ndarray:
    """Place of the minimum of every ``m`` neighbours, the leftmost of equals, by doubling; whole values are compared."""
    at, s = np.arange(len(x), dtype=np.int32 if len(x) < 1 << 31 else np.int64), 1
    n = len(x)

    def less(a, i, b, j):
        right = b < a
        return np.where(right, b, a), np.where(right, j, i)

    while 2 * s <= m:
        x, at = less(x[:-s], at[:-s], x[s:], at[s:])
        s *= 2
    if s < m:
        _, at = less(x[: n - m + 1], at[: n - m + 1], x[m - s : n - s + 1], at[m - s : n - s + 1])
    return at


def blocks(x: np.ndarray, offs: np.ndarray, window: int, k: int):
    """Groups every row's windows of ``window`` symbols by the k-gram of least hash in them (the leftmost of equals).

    Returns, for each group: hash of the k-gram, hash of all symbols of its windows, row, first window's
    start in the row, number of windows. Groups partition the windows; equal windows have equal k-grams.
    """
    per_row = np.maximum(np.diff(offs) - window + 1, 0)
    if not per_row.any():
        e = np.zeros(0, np.int64)
        return e.astype(U), e.astype(U), e, e, e
    first, second = Rolling(x, 0), Rolling(x, 1)
    grams = first.every(k)
    least = sliding_argmin(grams, window - k + 1)
    at = ragged(offs[:-1], per_row)
    least = least[at]
    cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    a, n, p = at[cut], np.diff(np.append(cut, len(at))), least[cut]
    row = np.searchsorted(offs, a, side="right") - 1
    content = mix(second.span(a, a + n + window - 1) + n.astype(U) * U(0x9FB21C651E98DF25) + (p - a).astype(U))
    return grams[p], content, row, a - offs[row], n
