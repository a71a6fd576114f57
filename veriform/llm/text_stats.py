"""Counts over whole texts, many texts at once, that quality rules and classifiers share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .lexer import Words, byte_set, mix, runs, white_space


def symbol_bytes() -> np.ndarray:
    """# * $ % & | < >"""
    table = np.zeros(256, bool)
    table[[ord(c) for c in "#*$%&|<>"]] = True
    return table


class TextStats:
    """Per row of a text column: words, characters, symbols and repeats. Nulls count as empty."""

    def __init__(self, column: pa.Array):
        self.words = w = Words(column, white_space())
        self.rows = w.rows
        self.n_words = w.counts()
        self.hashes = w.hashes()
        data, offsets = w.data, w.offsets
        self._at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # characters before each byte
        word_chars = self._at[w.end] - self._at[w.start]
        self.word_chars = np.bincount(w.row, word_chars, self.rows).astype(np.int64)
        self.word_chars2 = np.bincount(w.row, word_chars.astype(float) ** 2, self.rows)
        self.n_chars = np.diff(self._at[offsets])
        self.n_bytes = np.diff(offsets)

    def bytes_in(self, table: np.ndarray) -> np.ndarray:
        """Bytes of each text that are in a set."""
        total = np.concatenate(([0], np.cumsum(table[self.words.data])))
        return np.diff(total[self.words.offsets])

    def words_with(self, table: np.ndarray, last: bool = True) -> np.ndarray:
        """Words of each text that end (or start) with a byte of a set."""
        w = self.words
        return np.bincount(w.row, table[w.data[(w.end - 1) if last else w.start]], self.rows)

    def repeated(self, size: int = 3) -> np.ndarray:
        """Words of each text inside a run of ``size`` words that occurs twice or more in it, the first time included."""
        w = self.words
        h, ok = runs(self.hashes, w.row, size)
        places = np.flatnonzero(ok)
        if not len(places):
            return np.zeros(self.rows, np.int64)
        key = mix(h[places] + w.row[places].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = np.zeros(len(self.hashes), bool)
        start = places[order[twice]]
        for i in range(size):
            hit[start + i] = True
        return np.bincount(w.row[hit], minlength=self.rows)

    def distinct_words(self) -> np.ndarray:
        w = self.words
        key = np.sort(mix(self.hashes + w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        row_of = mix(self.hashes + w.row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(row_of, kind="stable")
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        return np.bincount(w.row[order[first]], minlength=self.rows)


def features(column: pa.Array) -> np.ndarray:
    """Statistics of each text that tell prose from junk, one row per text, all finite."""
    s = TextStats(column)
    n = np.maximum(s.n_words, 1).astype(float)
    chars = np.maximum(s.n_chars, 1).astype(float)
    upper, lower = s.bytes_in(byte_set((65, 90))), s.bytes_in(byte_set((97, 122), (128, 255)))
    letters = np.maximum(upper + lower, 1)
    mean = s.word_chars / n
    lines = s.bytes_in(byte_set((10, 10))) + 1
    mark = lambda chars_: s.bytes_in(byte_set(*((ord(c), ord(c)) for c in chars_)))
    ends = s.words_with(byte_set(*((ord(c), ord(c)) for c in ".?!:;,")))
    stops = s.words_with(byte_set(*((ord(c), ord(c)) for c in ".?")))
    return np.stack([
        np.log1p(s.n_words), mean, np.sqrt(np.maximum(s.word_chars2 / n - mean**2, 0)), s.bytes_in(symbol_bytes()) / n, upper / letters,
        mark("0123456789") / chars, mark("!") / n, mark("|") / n, ends / n, stops / n, lines / n, s.repeated(3) / n, s.distinct_words() / n,
        mark("()[]{}") / n, mark("\"'") / n, s.bytes_in(byte_set((128, 255))) / np.maximum(s.n_bytes, 1), mark("/\\@_=~^") / n,
        s.words_with(byte_set((65, 90)), last=False) / n,
    ], axis=1)
