"""Vectorised words and hashes over the UTF-8 bytes of Arrow string columns.

All separators used by the operators are ASCII, so cutting at byte level never splits a character.
Texts are handled in pieces of about a megabyte, which bounds the temporary arrays; a longer single
text is one piece of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE_BYTES = 1 << 20

#: The byte classes of the word patterns.
WHITE = np.zeros(256, dtype=bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything below 0x80 but digits and lower-case letters.
NOT_ALNUM = np.zeros(256, dtype=bool)
NOT_ALNUM[:0x80] = True
NOT_ALNUM[0x30:0x3A] = False
NOT_ALNUM[0x61:0x7B] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_U = np.uint64
_BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD93
WORD_BASE_2 = 0xC2B2AE3D27D4EB4F
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser (the public 64-bit murmur3 one)."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, PIECE_BYTES + 2)
        ways = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, dtype=np.uint64)
            a[0] = 1
            ways.append(np.cumprod(a, dtype=np.uint64))
        have = (ways[0], ways[1])
        if size <= 2 * PIECE_BYTES:
            _powers[base] = have
    return have


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hash of each ``values[start:end]`` from one running sum, independent of its position."""
    power, inverse = _powers_of(base, len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * power[: len(values)], out=total[1:])
    return mix64((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    whole = np.frombuffer(data, dtype=np.uint8)[first[0] : first[-1]]
    return whole, first - first[0]


def pieces(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


class Words:
    """Words of consecutive texts: byte spans, the first word of each text, and word hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, separator: np.ndarray, lower: bool) -> None:
        self.offsets = offsets - offsets[0] if len(offsets) else offsets
        self.data = LOWER[data] if lower else data
        self._separator = separator
        inside = ~separator[self.data]
        edge = np.zeros(len(inside) + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.zeros(len(inside) + 1, dtype=bool)
        before[1:] = inside
        after = np.zeros(len(inside) + 1, dtype=bool)
        after[:-1] = inside
        self.start = np.flatnonzero(after[:-1] & (~before[:-1] | edge[:-1]))
        self.end = np.flatnonzero(before[1:] & (~after[1:] | edge[1:])) + 1
        #: Word i of text t is number first[t] + i.
        self.first = np.searchsorted(self.start, self.offsets)

    @property
    def texts(self) -> int:
        return len(self.offsets) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(self.texts), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hash(_BYTE_VALUE[self.data], self.start, self.end, _BYTE_BASE)

    def starts_with_room(self, length: int) -> np.ndarray:
        """Numbers of the words at which ``length`` words of one text begin."""
        n = self.counts
        room = np.maximum(n - length + 1, 0)
        total = int(room.sum())
        within = np.arange(total) - np.repeat(np.cumsum(room) - room, room)
        return np.repeat(self.first[:-1], room) + within


def batches_of_words(column: pa.Array, separator: np.ndarray, lower: bool) -> Iterator[tuple[int, int, Words]]:
    data, offsets = text_buffers(column)
    for lo, hi in pieces(offsets):
        yield lo, hi, Words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1], separator, lower)


def int64(values: np.ndarray) -> pa.Array:
    """Unsigned hashes as Spark's signed longs, bit by bit."""
    return pa.array(np.ascontiguousarray(values).view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64))
