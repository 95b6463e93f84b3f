"""Words of Arrow text columns as numpy arrays.

Word borders, word hashes and hashes of word windows of a whole batch come from a few array passes
over the column's bytes; there is no Python loop over words.  A hash is a polynomial over the bytes
modulo 2**64, taken from prefix sums, shifted to the span's start by inverse powers and mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_WINDOW_BASE = 0xC2B2AE3D27D4EB4F
_INVERSE, _WINDOW_INVERSE = pow(_BASE, -1, 1 << 64), pow(_WINDOW_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: Bytes that separate words: space and the controls from tab to carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes outside letters, digits and non-ASCII characters, for texts in lower case.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def powers(base: int, n: int) -> np.ndarray:
    """``base ** i`` modulo 2**64 for ``i`` up to ``n`` at least; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        have = np.cumprod(factors, dtype=np.uint64)
        if size <= 2 * SLICE_BYTES:  # longer ones serve a single giant text
            _powers[base] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each; a longer row stands alone."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1)
        yield row, end
        row = end
    give_back()


def give_back() -> None:
    """Return Arrow's freed memory to the system after a batch: a reused worker would otherwise keep its peak."""
    pa.default_memory_pool().release_unused()


class Words:
    """Word borders of the rows ``[row, end)`` of a batch.

    ``starts`` and ``ends`` are byte positions in ``data``; row ``r`` has the words
    ``first[r] .. first[r + 1]``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = BLANKS, lower: bool = True):
        self.raw, self.offsets = data, offsets
        self.data = LOWER[data] if lower else data
        inside = ~breaks[self.data]
        n = len(data)
        begins, stops = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        stops[:-1] &= ~inside[1:]
        borders = offsets[1:-1]
        borders = borders[(borders > 0) & (borders < n)]
        begins[borders] = inside[borders]
        stops[borders - 1] = inside[borders - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.starts, self.ends)

    def text(self, word: int) -> bytes:
        return self.data[self.starts[word] : self.ends[word]].tobytes()

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Start word and hash of each window of ``width`` words that lies inside one row."""
        total = len(hashes)
        if total < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        last = np.repeat(self.first[1:], self.counts)
        at = np.flatnonzero(np.arange(total) + width <= last)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(_WINDOW_BASE, total)[:total], dtype=np.uint64)])
        return at, mix((sums[at + width] - sums[at]) * powers(_WINDOW_INVERSE, total)[at] + np.uint64(width))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``[starts, ends)``."""
    n = len(data)
    p = powers(_BASE, n)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(_INVERSE, n)[starts] + (ends - starts).astype(np.uint64))


def per_row(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the ranges that ``first`` bounds (empty ranges give 0)."""
    sums = np.concatenate([np.zeros(1, np.result_type(values, np.int64) if values.dtype.kind in "biu" else np.float64), np.cumsum(values)])
    return sums[first[1:]] - sums[first[:-1]]


def joined_bytes(words: Words, chosen: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The chosen words (a mark per word) with one space behind each, and where each row begins."""
    picked = np.flatnonzero(chosen)
    begins, sizes = words.starts[picked], words.ends[picked] - words.starts[picked] + 1
    places = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    source = np.repeat(begins - places[:-1], sizes) + np.arange(places[-1])
    out = words.data[np.minimum(source, max(len(words.data) - 1, 0))] if len(source) else np.zeros(0, np.uint8)
    out[places[1:] - 1] = 0x20
    return out.tobytes(), places[np.searchsorted(picked, words.first)]


def joined(words: Words, chosen: np.ndarray) -> list[str]:
    """Each row's chosen words, joined by one space."""
    raw, bounds = joined_bytes(words, chosen)
    return [raw[a : max(a, b - 1)].decode("utf-8", "replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
