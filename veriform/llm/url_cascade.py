"""URL verdicts by host and path rules, and else by a cascade of Bloom filters over the hosts of the corpus.

The first filter holds the listed hosts, the second the other hosts that pass the first, the third the listed ones
that pass the second, and so on until nothing passes wrongly. For any host of the corpus the first filter that it
does not pass tells whether it is listed, exactly, and pages are judged without a join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bits per key and hash functions of the first filter and of the later ones.
FIRST, LATER = (10, 5), (4, 2)
# Listed keys whose filters are sent to the tasks at once (about 2 MB for each million); more are judged in turns.
KEYS_AT_ONCE = 20_000_000


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits a host, its subdomains, and urls whose path starts with the rule's."""

    pattern: str
    verdict: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> Column:
    """Place in ``rules`` of the longest rule that fits; null if none."""
    out = None
    for i in sorted(range(len(rules)), key=lambda i: (-len(rules[i].pattern), rules[i].pattern)):
        r = rules[i]
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, i) if out is None else out.when(fits, i)
    return F.lit(None).cast("int") if out is None else out


def _places(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    salt = np.uint64((2 * level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    a, b = h1.view(np.uint64) ^ salt, (h2.view(np.uint64) * salt) | np.uint64(1)
    b ^= b >> np.uint64(29)
    return np.stack([((a + np.uint64(i) * b) >> np.uint64(11)) % np.uint64(bits) for i in range(hashes)], axis=1).astype(np.int64)


def passes(filters: list[tuple[int, int, np.ndarray]], level: int, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    bits, hashes, words = filters[level]
    at = _places(h1, h2, level, bits, hashes)
    return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool).all(axis=1)


def listed(filters: list[tuple[int, int, np.ndarray]], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Whether keys of the universe are listed: the first filter that a key does not pass decides."""
    out = np.zeros(len(h1), bool)
    left = np.arange(len(h1))
    for level in range(len(filters)):
        ok = passes(filters, level, h1[left], h2[left])
        out[left[~ok]] = level % 2 == 1
        left = left[ok]
    out[left] = len(filters) % 2 == 1
    return out


def _bloom(keys: DataFrame, level: int, bits: int, hashes: int) -> np.ndarray:
    """The filter's bits, set in the tasks and joined by words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(_places(*(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2")), level, bits, hashes))
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    got = keys.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((bits + 63) // 64, np.uint64)
    words[got.column("word").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return words


def build_cascade(universe: DataFrame) -> list[tuple[int, int, np.ndarray]]:
    """``h1``, ``h2`` (two hashes of a key), ``listed``, each key once -> the filters."""
    inside, outside = universe.where("listed").select("h1", "h2"), universe.where("not listed").select("h1", "h2")
    filters: list[tuple[int, int, np.ndarray]] = []
    here, there = inside, outside
    n = here.count()
    while n:
        per, hashes = FIRST if not filters else LATER
        bits = max(64, n * per)
        level = len(filters)
        filters.append((bits, hashes, _bloom(here, level, bits, hashes)))
        wrong = there.mapInArrow(_passing(filters, level), "h1 long, h2 long")
        here, there = materialise(wrong), here
        n = here.count()
    return filters


def _passing(filters: list, level: int):
    held = filters[: level + 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = passes(held, level, *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2")))
            yield batch.filter(pa.array(ok))

    return run


def judge_urls(pages: DataFrame, rules: list[Rule], on_list, id_col: str = "page_id", url_col: str = "url", keys_at_once: int = KEYS_AT_ONCE) -> DataFrame:
    """Per row: ``id``, ``url``, ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``: the rule's, else ``block`` for
    listed hosts and ``allow`` for others.

    ``on_list`` says of a host column whether it is listed, or is a table with a ``host`` column of listed hosts, whose
    subdomains are listed too. All hosts of ``pages``, the empty one included, are the key universe. An empty list, or
    one with no host of the corpus, lists nothing.
    """
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), host.alias("host"), path.alias("path"))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    if isinstance(on_list, DataFrame):
        parts = F.split("host", r"\.")
        ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
        known = hosts.select("host", F.explode(ends).alias("end")).join(on_list.select(F.col("host").alias("end")).distinct(), "end", "left_semi").select("host").distinct()
        hosts = hosts.join(known.withColumn("listed", F.lit(True)), "host", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    else:
        hosts = hosts.withColumn("listed", F.coalesce(on_list(F.col("host")), F.lit(False)))
    h1, h2 = F.xxhash64("host"), F.xxhash64(F.lit(1), "host")
    universe = materialise(hosts.select(h1.alias("h1"), h2.alias("h2"), "listed"))
    turns = universe.where("listed").count() // keys_at_once + 1
    at = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("id", "url", "host", "path", at.alias("at"), h1.alias("h1"), h2.alias("h2"))
    out = None
    for turn in range(turns):
        mine = F.pmod(F.col("h1"), F.lit(turns)) == turn
        filters = build_cascade(universe.where(mine) if turns > 1 else universe)

        def run(batches: Iterator[pa.RecordBatch], filters=filters) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yes = listed(filters, *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("h1", "h2")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "url", "host", "path", "at")), pa.array(yes)], names=["id", "url", "host", "path", "at", "listed"])

        some = rows.where(mine) if turns > 1 else rows
        kinds = dict(rows.dtypes)
        judged = some.mapInArrow(run, f"id {kinds['id']}, url {kinds['url']}, host string, path string, at int, listed boolean")
        out = judged if out is None else out.unionByName(judged)
    if not rules:
        name = verdict = F.lit(None).cast("string")
    else:
        name = F.get(F.array(*[F.lit(r.pattern) for r in rules]), F.col("at"))
        verdict = F.get(F.array(*[F.lit(r.verdict) for r in rules]), F.col("at"))
    return out.select("id", "url", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
