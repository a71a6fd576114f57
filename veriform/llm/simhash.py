"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into three segments. Each segment is decoded to a codeword of the binary Golay code
(23, 12); words that differ in one bit have the nearest codeword of one among the codewords nearest to the other or
to its one-bit neighbours. Three differing bits leave two segments of which one is equal and the other differs in
one bit at most, or else each segment differs in one bit. So keys made of two codeword indices find every pair: one
side is indexed under its own codewords, the other asks for those of its neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from .graph import connected_components
from .lexer import Words, ascii_lower, slices, white_space

SHINGLE = 3
MAX_BITS = 3
# Segment widths of a fingerprint, each padded with zeros to the 23 bits of the code.
SEGMENTS = (22, 21, 21)
# Generator polynomial of the binary Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GENERATOR = 0b101011100011


def shingle_hashes(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of each run of ``size`` words, lower-cased and joined by a blank, and its row.

    A text of fewer words has one run, all its words; a text without words has none.
    """
    from xxhash import xxh64_intdigest

    w = Words(column, white_space(), ascii_lower())
    if not len(w.start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    after = np.zeros(len(w.data), bool)
    after[1:] = w.is_word[:-1]
    kept = w.is_word | after
    place = np.concatenate(([0], np.cumsum(kept)))
    text = np.where(w.is_word, w.data, 32).astype(np.uint8)[kept].tobytes()
    firsts, counts = w.firsts(), w.counts()
    lasts = firsts[w.row] + counts[w.row] - 1
    i = np.arange(len(w.start))
    head = (i + size - 1 <= lasts) | (i == firsts[w.row])
    i = i[head]
    to = np.minimum(i + size - 1, lasts[head])
    hashed = [xxh64_intdigest(text[a:b], 42) for a, b in zip(place[w.start[i]].tolist(), place[w.end[to]].tolist(), strict=True)]
    return np.array(hashed, np.uint64), w.row[i]


def fingerprints_of(column: pa.Array, block: int = 1 << 17) -> np.ndarray:
    """Fingerprint of each text: a bit is set if it is set in over half of the hashes.

    The bits of a byte are spread to the bytes of one 64-bit word, so that up to 255 hashes are counted by one sum.
    """
    hashes, row = shingle_hashes(column)
    spread = np.zeros(256, np.uint64)
    for bit in range(8):
        spread |= (np.arange(256, dtype=np.uint64) >> np.uint64(bit) & np.uint64(1)) << np.uint64(8 * bit)
    ones = np.zeros((len(column), 64), np.int64)
    for at in range(0, len(hashes), block):
        h, r = hashes[at : at + block], row[at : at + block]
        cut = np.unique(np.concatenate((np.flatnonzero(np.diff(r)) + 1, np.arange(0, len(h), 255))))
        sums = np.add.reduceat(spread[h.astype("<u8").view(np.uint8).reshape(-1, 8)], cut, axis=0)
        np.add.at(ones, r[cut], sums.astype("<u8").view(np.uint8).reshape(-1, 64))
    total = np.bincount(row, minlength=len(column))[:, None]
    packed = np.packbits((2 * ones > total).astype(np.uint8), axis=1, bitorder="little")
    return packed.view("<u8").reshape(-1).astype(np.uint64)


def with_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``h`` (hash of the text), ``fp`` (64 bits as a long) of every row; null and empty texts have 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                fp = fingerprints_of(part.column("text")).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("h"), pa.array(fp)], names=["id", "h", "fp"])

    kind = dict(docs.dtypes)[id_col]
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, f"id {kind}, h long, fp long")


class Golay:
    """Nearest codewords of 23-bit words, by a table of the code's 2048 syndromes."""

    def __init__(self):
        def remainder(v: int) -> int:
            for bit in range(22, 10, -1):
                if v >> bit & 1:
                    v ^= GENERATOR << (bit - 11)
            return v

        unit = [remainder(1 << i) for i in range(23)]
        self.syndrome = np.zeros((3, 256), np.int64)
        for part in range(3):
            for value in range(256):
                for i in range(8):
                    if value >> i & 1 and part * 8 + i < 23:
                        self.syndrome[part, value] ^= unit[part * 8 + i]
        self.leader = np.zeros(2048, np.int64)
        for errors in range(1, 4):
            for places in combinations(range(23), errors):
                s = e = 0
                for i in places:
                    s, e = s ^ unit[i], e | 1 << i
                self.leader[s] = e

    def index(self, v: np.ndarray) -> np.ndarray:
        """12-bit index of the codeword nearest to each word."""
        s = self.syndrome[0, v & 255] ^ self.syndrome[1, v >> 8 & 255] ^ self.syndrome[2, v >> 16 & 255]
        return (v ^ self.leader[s]) >> 11

    def near(self, v: np.ndarray, width: int) -> np.ndarray:
        """Indices nearest to each word or a word one bit away, one row per word; -1 where repeated."""
        around = np.stack([self.index(v)] + [self.index(v ^ (1 << i)) for i in range(width)], axis=1)
        rest = np.sort(around[:, 1:], axis=1)
        repeated = np.zeros(rest.shape, bool)
        repeated[:, 1:] = rest[:, 1:] == rest[:, :-1]
        rest = np.where(repeated | (rest == around[:, :1]), -1, rest)
        return np.concatenate((around[:, :1], -np.sort(-rest, axis=1)[:, :6]), axis=1)


def keys_of(fp: np.ndarray, golay: Golay) -> tuple[list[np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Keys a fingerprint is indexed under, and (row, key) of those that it asks for."""
    at, own, near = 0, [], []
    for width in SEGMENTS:
        v = (fp >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
        own.append(golay.index(v))
        near.append(golay.near(v, width))
        at += width
    index, ask_row, ask_key = [], [], []
    for p, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        index.append(p << 24 | own[a] << 12 | own[b])
        x, y = near[a][:, :, None], near[b][:, None, :]
        fits = (x >= 0) & (y >= 0)
        if p:  # only the first pair is asked for a bit in each segment: (1, 1, 1) is found there
            fits[:, 1:, 1:] = False
        key = np.where(fits, p << 24 | x << 12 | y, -1).reshape(len(fp), -1)
        r, c = np.nonzero(key >= 0)
        ask_row.append(r)
        ask_key.append(key[r, c])
    return index, (np.concatenate(ask_row), np.concatenate(ask_key))


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp`` (distinct) -> ``a``, ``b``: every pair of at most ``max_bits`` (up to 3) differing bits, once or more."""
    if not 0 <= max_bits <= 3:
        raise ValueError("three segments find up to 3 differing bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            whole = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for at in range(0, len(whole), 8192):
                fp = whole[at : at + 8192]
                index, (row, key) = keys_of(fp.view(np.uint64), golay)
                fp_all = np.concatenate([fp] * len(index) + [fp[row]])
                asks = np.concatenate((np.zeros(len(index) * len(fp), bool), np.ones(len(row), bool)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([*index, key]).astype(np.int32)), pa.array(fp_all), pa.array(asks)], names=["key", "fp", "asks"])

    rows = fps.select("fp").mapInArrow(run, "key int, fp long, asks boolean")
    index = rows.where(~F.col("asks")).select("key", F.col("fp").alias("a"))
    asked = rows.where("asks").select("key", F.col("fp").alias("b"))
    return index.join(asked, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)).select("a", "b")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``id``, ``h`` (hash of the text), ``fp``, ``component`` of every row: the least id that its fingerprint reaches over links,
    and ``root``: the fingerprint that stands for the component.

    Copies and texts with the same fingerprint are one node, so no group is expanded into pairs; only the different
    fingerprints are keyed, joined and verified. Rows that repeat are returned as often as they come; a null id
    has its component and is never one unless the component has no other id. Components whose rows have no id, or that
    share their least id, have the same ``component``; only ``root`` tells them apart.
    """
    marked = materialise(with_fingerprints(docs, id_col, text_col))
    nodes = materialise(marked.groupBy("fp").agg(F.min("id").alias("least")))
    roots = connected_components(fingerprint_links(nodes, max_bits))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component"))
    named = rooted.join(heads, "root").select("fp", "component", "root")
    return marked.join(named, "fp").select("id", "h", "fp", "component", "root")


def one_per_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of near-duplicates.

    The row with the least id stays, null ids last; of several rows with that id, the one with the least hash of its
    text; of equal rows, one.
    """
    comp = simhash_components(docs, id_col, text_col, max_bits).groupBy("root", "id", "h").agg(F.count(F.lit(1)).alias("n"))
    kept = materialise(comp.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h", "n")).alias("k")).select("k.*"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col(f"row.`{id_col}`").alias("id_"), F.xxhash64(F.col(f"row.`{text_col}`").cast("string")).alias("h_"))
    same = (F.col("h_") == F.col("h")) & F.col("id_").eqNullSafe(F.col("id"))
    alone = rows.join(kept.where("n = 1").select("id", "h"), same, "left_semi").select("row.*")
    # Rows repeated in full are rare, and only they are numbered.
    repeated = rows.join(kept.where("n > 1").select("id", "h"), same, "left_semi")
    first = repeated.withColumn("nth", F.row_number().over(Window.partitionBy("id_", "h_").orderBy("h_"))).where("nth = 1").select("row.*")
    return alone.unionByName(first)
