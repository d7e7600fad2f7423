"""Whole Arrow string batches as flat byte buffers: words, lines and hashes in numpy.

A column of texts is one UTF-8 buffer plus offsets, so words, word hashes and
n-gram hashes of thousands of documents come from a few vector operations with
no Python object per word.  Buffers are cut at document boundaries into pieces
of about ``PIECE`` bytes, which bounds the memory of a task by the longest
single text, not by the Arrow batch.

Hashes are polynomials modulo 2**64 over a random value per byte, finished with
a mixing step.  Equal words always have equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa

PIECE = 1 << 18

_ALL = np.arange(256)
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after A-Z is lower-cased: digits, ASCII letters, all non-ASCII.
ALNUM = ((_ALL >= 0x30) & (_ALL <= 0x39)) | ((_ALL >= 0x41) & (_ALL <= 0x5A)) | ((_ALL >= 0x61) & (_ALL <= 0x7A)) | (_ALL >= 0x80)
#: Word bytes of ``[^\x20\x09-\x0D]``.
INKED = ~((_ALL == 0x20) | ((_ALL >= 0x09) & (_ALL <= 0x0D)))
#: Bytes that begin a code point.
LEAD = (_ALL & 0xC0) != 0x80
LOWER = np.where((_ALL >= 0x41) & (_ALL <= 0x5A), _ALL + 32, _ALL).astype(np.uint8)

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_BYTE_LOWER = _BYTE[LOWER]
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 2**64)
_M1 = np.uint64(0xFF51AFD7ED558CCD)
_M2 = np.uint64(0xC4CEB9FE1A85EC53)
_Q = np.uint64(0xD6E8FEB86659FD93)
_S = np.uint64(32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW: dict[int, np.ndarray] = {}


def _pow(base: int, n: int) -> np.ndarray:
    have = _POW.get(base)
    if have is None or len(have) < n:
        have = _powers(base, max(n, 2 * PIECE))
        if n <= 4 * PIECE:  # tables for one huge text are not kept
            _POW[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective finishing step on 64-bit values."""
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


def pieces(column: pa.Array | pa.ChunkedArray, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``limit`` bytes; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        kind = np.int32
    else:
        kind = np.int64
    if len(column) == 0:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(column))
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


@dataclass
class Page:
    """Texts of one piece: their bytes and where each begins."""

    data: np.ndarray
    offs: np.ndarray
    table: np.ndarray
    lower: bool = False

    @property
    def n(self) -> int:
        return len(self.offs) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte flag in each text."""
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return c[self.offs[1:]] - c[self.offs[:-1]]

    @cached_property
    def inside(self) -> np.ndarray:
        return self.table[self.data]

    @cached_property
    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte start and end of every word; a word never crosses a text boundary."""
        m = self.inside
        if not len(m):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, stop = m.copy(), m.copy()
        start[1:] &= ~m[:-1]
        stop[:-1] &= ~m[1:]
        cut = self.offs[(self.offs > 0) & (self.offs < len(m))]
        start[cut] = m[cut]
        stop[cut - 1] = m[cut - 1]
        return np.flatnonzero(start), np.flatnonzero(stop) + 1

    @cached_property
    def first(self) -> np.ndarray:
        """Index of the first word of each text, and the number of words at the end."""
        return np.searchsorted(self.spans[0], self.offs)

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def doc(self) -> np.ndarray:
        """Text of every word."""
        return np.repeat(np.arange(self.n), self.counts)

    @cached_property
    def sums(self) -> np.ndarray:
        """Prefix sums of the byte polynomial."""
        out = np.empty(len(self.data) + 1, np.uint64)
        out[0] = 0
        np.cumsum((_BYTE_LOWER if self.lower else _BYTE)[self.data] * _pow(_P, len(self.data)), out=out[1:])
        return out

    def hash_spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of each byte span."""
        if not len(start):
            return np.zeros(0, np.uint64)
        h = (self.sums[end] - self.sums[start]) * _pow(_P_INV, len(self.data) + 1)[start]
        return mix(h + (end - start).astype(np.uint64) * _Q)

    @cached_property
    def words(self) -> np.ndarray:
        """Hash of every word."""
        return self.hash_spans(*self.spans)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, first word index) of every run of ``k`` words inside one text."""
        return grams(self.words, self.first, k)


def grams(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position) of each run of ``k`` words that stays between two consecutive entries of ``first``."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = words[:n].copy()
    for j in range(1, k):
        h *= _M1
        h += words[j : j + n]
    ok = np.zeros(len(words) + 1, bool)
    last = first[1:] - k + 1
    ahead = np.bincount(first[:-1][last > first[:-1]], minlength=len(words) + 2)
    behind = np.bincount(last[last > first[:-1]], minlength=len(words) + 2)
    ok = np.cumsum(ahead - behind)[:n] > 0
    at = np.flatnonzero(ok)
    return mix(h[at] + np.uint64(k)), at


def salted(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Keys that are equal only for equal hashes of the same owner."""
    return mix(hashes + owner.astype(np.uint64) * _Q)


def open_page(data: np.ndarray, offs: np.ndarray, table: np.ndarray, lower: bool = False) -> Page:
    return Page(data, offs, table, lower)
