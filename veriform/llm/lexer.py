"""Words of whole Arrow text columns, as numpy arrays.

All texts of a batch are one run of UTF-8 bytes; words are found and hashed in a few passes over it, without a
Python object per word. Memory is bounded by the slice of rows given in, whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are worked on at once; a longer single text is worked on alone.
SLICE_BYTES = 3 << 20
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo : hi + 1] = True
    return table


def white_space() -> np.ndarray:
    """Bytes that separate words: blank and U+0009 to U+000D."""
    return byte_set((0x20, 0x20), (0x09, 0x0D))


def ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with at most ``limit`` bytes of text, one row at least."""
    _, offsets = buffers(batch.column(column))
    at, n = 0, batch.num_rows
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offset of each row, nulls as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values evenly."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """Words of a text column: row, first byte and end of each, all in reading order."""

    def __init__(self, column: pa.Array, separators: np.ndarray | None = None, fold: np.ndarray | None = None):
        self.data, self.offsets = buffers(column)
        self.rows = len(self.offsets) - 1
        if fold is not None:
            self.data = fold[self.data]
        word = ~(white_space() if separators is None else separators)[self.data]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        edges = self.offsets[1:-1]
        edges = edges[edges < len(word)]
        begin[edges] = word[edges]
        last = word.copy()
        last[:-1] &= ~word[1:] | begin[1:]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(last) + 1
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        self.is_word = word

    def counts(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def firsts(self) -> np.ndarray:
        """Index of each row's first word, with the number of words at the end."""
        return np.concatenate(([0], np.cumsum(self.counts())))

    def hashes(self, upto: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word, or of its first ``upto`` bytes."""
        start, end = self.start, self.end if upto is None else np.minimum(self.end, self.start + upto)
        out = np.empty(len(start), np.uint64)
        inverse = np.uint64(pow(_BASE, -1, 1 << 64))
        powers = inverses = np.ones(1, np.uint64)
        i = 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(start, start[i] + _BLOCK)))
            lo, hi = int(start[i]), int(max(end[i:j].max(), start[i] + 1))
            if len(powers) < hi - lo:
                size = max(_BLOCK + 1024, hi - lo)
                powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, _BASE, np.uint64))))
                inverses = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size, inverse, np.uint64))))
            part = (self.data[lo:hi].astype(np.uint64) + np.uint64(1)) * powers[: hi - lo]
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(part)))
            out[i:j] = (total[end[i:j] - lo] - total[start[i:j] - lo]) * inverses[start[i:j] - lo]
            i = j
        return mix(out)


def runs(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words (by its first word), and which of them stay inside one row."""
    m = max(0, len(hashes) - n + 1)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out = out * np.uint64(0x2127599BF4325C37 | 1) + hashes[i : i + m]
    return mix(out), row[:m] == row[n - 1 : n - 1 + m]
