"""Phrases whose words belong together, counted by an index of word ids per shard.

A shard is a few million words with their own ids and a break after each piece of text. Its bidirectional index holds
the Burrows-Wheeler transforms of the shard and of its reverse, sorted as deep as phrases of a round are long. An interval of rows
stands for a phrase; extending it to the right or left by each word that follows or precedes gives the intervals, and the counts, of longer ones.

Counts are summed across shards round by round: a shard deals its phrases into buckets by a hash, each bucket a compressed
block, and a task adds up the blocks that all shards have for a bucket. After a round each shard hears which of its own phrases are frequent
everywhere, and keeps no words but those of overlapping frequent phrases; so the next round only lists phrases both of whose shorter parts
are frequent, and no list of phrases goes to all tasks.
"""

from __future__ import annotations

import os
from collections import defaultdict
from collections.abc import Iterator, Sequence
from functools import cached_property
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ..session import scratch
from .lexer import mix

# Words of a shard; the piece that crosses the mark is the last one in it.
SHARD = 1 << 20
# Words of all shards for each bucket; a phrase has one entry of a bucket in each shard that holds it.
BUCKET = 1 << 19
_BREAKS = bytes(b"\n"[0] if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))

# A shard: its words and their languages by id less one, ids of its text, 0 for a break, and how many words that are.
STATE = "shard long, words array<binary>, langs array<string>, lang_of binary, seq binary, tokens long"
# Phrases of a shard that fall into a bucket.
FOUND = "bucket int, shard long, block binary"
# Frequent phrases, and for each shard the places of its own ones among all its phrases of as many words.
KEPT = "lang string, phrase binary, f long, shard long, slots binary"


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of each piece of a text that has any."""
    for piece in text.lower().translate(_BREAKS).split(b"\n"):
        if words := piece.split():
            yield words


def _pack(a: np.ndarray) -> bytes:
    return len(a).to_bytes(8, "little") + pa.compress(a.astype(np.int32).tobytes(), "zstd", asbytes=True)


def _unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    return np.frombuffer(pa.decompress(b[8:], 4 * n, "zstd", asbytes=True), np.int32) if n else np.zeros(0, np.int32)


def cut_shards(rows: DataFrame, size: int = SHARD) -> DataFrame:
    """``lang``, ``text`` (binary) -> shards of about ``size`` words, made where the texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 24
        ids, seq = defaultdict(dict), []

        def fresh() -> None:
            nonlocal ids, seq
            number = count(1)
            ids, seq = defaultdict(lambda: defaultdict(number.__next__)), []

        def flush() -> pa.RecordBatch:
            langs = sorted(ids)
            known = sorted((i, w, k) for k, lang in enumerate(langs) for w, i in ids[lang].items())
            numbers = np.array(seq, np.int32)
            cols = [[at], [[w for _, w, _ in known]], [langs], [_pack(np.array([k for *_, k in known], np.int32))], [_pack(numbers)], [int((numbers > 0).sum())]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _STATE, strict=True)], schema=_STATE)

        fresh()
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                own = ids[lang]
                for words in pieces(text.as_py() or b""):
                    seq.extend(map(own.__getitem__, words))
                    seq.append(0)
                    if len(seq) >= size:
                        yield flush()
                        fresh()
                        own, at = ids[lang], at + 1
        if seq:
            yield flush()

    return rows.select("lang", "text").mapInArrow(run, STATE)


def suffix_order(seq: np.ndarray, depth: int) -> np.ndarray:
    """Places of a text sorted by at least ``depth`` symbols from there on; what follows the end sorts first."""
    rank, known, order = seq.astype(np.int64), 1, None
    while known < depth:
        behind = np.zeros(len(rank), np.int64)
        behind[: len(rank) - known] = rank[known:] + 1
        key = rank * (int(rank.max()) + 2) + behind
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(key), np.int64)
        rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
        known *= 2
    return np.argsort(rank, kind="stable") if order is None else order


class Transform:
    """Burrows-Wheeler transform of a text, and the row to which each row leads when its symbol is put in front."""

    def __init__(self, seq: np.ndarray, depth: int):
        self.bwt = np.roll(seq, 1)[suffix_order(seq, depth)]
        by = np.argsort(self.bwt, kind="stable")
        self.front = np.empty(len(seq), np.int64)
        self.front[by] = np.arange(len(seq))


class Phrases:
    """Phrases of as many words each: rows in the forward and the reverse transform where each begins, rows, and words."""

    def __init__(self, at: np.ndarray, back: np.ndarray, size: np.ndarray, words: list[np.ndarray]):
        self.at, self.back, self.size, self.words = at, back, size, words

    def __len__(self) -> int:
        return len(self.size)


class Index:
    """Both transforms of a shard, whose text ends with a break. Phrases of up to ``depth`` words can be extended to either side.

    An interval is known in both transforms at once; to the right it is extended by the reverse one, to the left by the
    forward one. Each is made when it is first asked for.
    """

    def __init__(self, seq: np.ndarray, depth: int):
        self.seq, self.depth = seq, depth
        self.whole = Phrases(np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(seq)]), [])

    @cached_property
    def forward(self) -> Transform:
        return Transform(self.seq, self.depth)

    @cached_property
    def reverse(self) -> Transform:
        return Transform(self.seq[::-1], self.depth)

    @staticmethod
    def _extend(t: Transform, at: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each interval of a transform and each symbol in it: interval, symbol, row in front, row of the other transform, rows."""
        start = np.cumsum(size) - size
        owner = np.repeat(np.arange(len(size)), size)
        rows = np.arange(len(owner)) - np.repeat(start - at, size)
        symbol = t.bwt[rows].astype(np.int64)
        key = owner * (int(t.bwt.max(initial=0)) + 1) + symbol
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.diff(key[order], prepend=-1))
        sizes = np.diff(first, append=len(order))
        head = order[first]
        # Symbols before this one fill the first rows of the interval in the other transform.
        across = other[owner[head]] + first - start[owner[head]]
        some = symbol[head] > 0
        return tuple(x[some] for x in (owner[head], symbol[head], t.front[rows[head]], across, sizes))

    def right(self, p: Phrases) -> Phrases:
        owner, symbol, back, at, size = self._extend(self.reverse, p.back, p.at, p.size)
        return Phrases(at, back, size, [*(w[owner] for w in p.words), symbol])

    def left(self, p: Phrases) -> Phrases:
        owner, symbol, at, back, size = self._extend(self.forward, p.at, p.back, p.size)
        return Phrases(at, back, size, [symbol, *(w[owner] for w in p.words)])

    def phrases(self, words: int) -> Phrases:
        """All phrases of so many words, in the order of their words."""
        p = self.whole
        for _ in range(words):
            p = self.right(p)
        return p


def slots_of(seq: np.ndarray, words: int) -> np.ndarray:
    """For each place the number of the phrase that begins there among all different ones, as :meth:`Index.phrases` orders them; -1: none."""
    out = np.full(len(seq), -1, np.int64)
    n = len(seq) - words + 1
    if n <= 0:
        return out
    whole = np.ones(n, bool)
    rank = np.zeros(n, np.int64)
    for i in range(words):
        part = seq[i : i + n].astype(np.int64)
        whole &= part > 0
        rank = np.unique(rank * (int(seq.max()) + 1) + part, return_inverse=True)[1]
    out[:n][whole] = np.unique(rank[whole], return_inverse=True)[1]
    return out


def keep_runs(seq: np.ndarray, kept: np.ndarray, words: int) -> np.ndarray:
    """The words of each run of two or more kept phrases that begin next to each other, with a break after each run.

    ``kept`` tells for each place whether the phrase of so many words that begins there is kept.
    """
    edges = np.diff(np.concatenate(([0], kept.astype(np.int8), [0])))
    begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long_ = end - begin > 1
    begin, size = begin[long_], (end - begin)[long_] + words - 1
    start = np.cumsum(size + 1) - size - 1
    out = np.zeros(int((size + 1).sum()), np.int32)
    to = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    out[to] = seq[to - np.repeat(start - begin, size)]
    return out


def _spans(x: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    edges = [0, *(np.flatnonzero(np.diff(x)) + 1).tolist(), len(x)]
    return list(zip(edges[:-1], edges[1:], strict=True)) if len(x) else []


class Shard:
    """A row of :data:`STATE` in use."""

    def __init__(self, row: dict):
        self.number, self.seq = row["shard"], _unpack(row["seq"])
        self.words, self.langs = pa.array(row["words"], pa.binary()), pa.array(row["langs"], pa.string())
        self.lang_of = _unpack(row["lang_of"])
        langs = [x.encode() + b"\0" for x in row["langs"]]
        self.hashes = np.array([xxh3_64_intdigest(langs[k] + w) for k, w in zip(self.lang_of.tolist(), row["words"], strict=True)], np.uint64)

    def entries(self, p: Phrases, numbered: bool) -> tuple[pa.Table, np.ndarray]:
        """Phrases with their slot and count, and a hash of each that is the same in all shards."""
        words = [self.words.take(pa.array(w - 1)) for w in p.words]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", pa.binary())) if len(words) > 1 else words[0]
        h = np.zeros(len(p), np.uint64)
        for w in p.words:
            h = mix(h + self.hashes[w - 1])
        slot = np.arange(len(p)) if numbered else np.full(len(p), -1)
        return self.table(self.langs.take(pa.array(self.lang_of[p.words[0] - 1])), phrase, slot, p.size), h

    def totals(self) -> tuple[pa.Table, np.ndarray]:
        """All words of each language, as the phrase of none."""
        n = np.bincount(self.lang_of[self.seq[self.seq > 0] - 1], minlength=len(self.langs))
        h = np.array([xxh3_64_intdigest(x) for x in self.langs.to_pylist()], np.uint64)
        return self.table(self.langs, pa.array([b""] * len(n), pa.binary()), np.full(len(n), -1), n), h

    @staticmethod
    def table(lang: pa.Array, phrase: pa.Array, slot: np.ndarray, n: np.ndarray) -> pa.Table:
        return pa.table([lang, phrase, pa.array(slot.astype(np.int32)), pa.array(n.astype(np.int32))], schema=_ENTRY)

    def blocks(self, parts: Sequence[tuple[pa.Table, np.ndarray]], buckets: int) -> Iterator[tuple[int, int, bytes]]:
        """Entries of each bucket that has any, as one compressed block."""
        bucket = (np.concatenate([h for _, h in parts]) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        dealt = pa.concat_tables([t for t, _ in parts]).combine_chunks().take(pa.array(order))
        for a, b in _spans(bucket[order]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _ENTRY, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(dealt.slice(a, b - a).combine_chunks())
            yield int(bucket[order[a]]), self.number, sink.getvalue().to_pybytes()


def _buckets(shards: DataFrame) -> int:
    return max(8, (shards.agg(F.sum("tokens").alias("n")).first()["n"] or 0) // BUCKET)


def first_round(shards: DataFrame) -> DataFrame:
    """All words, single words and pairs of each shard."""
    buckets = _buckets(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                shard = Shard(batch.slice(i, 1).to_pylist()[0])
                index = Index(shard.seq, 2)
                single = index.right(index.whole)
                rows = list(shard.blocks([shard.totals(), shard.entries(single, False), shard.entries(index.right(single), True)], buckets))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_FOUND)], schema=_FOUND)

    return shards.mapInArrow(run, FOUND)


def next_round(shards: DataFrame, kept: DataFrame, words: int) -> DataFrame:
    """Phrases of ``words`` words of each shard, and the shard as it is left, given the shorter ones that are frequent."""
    buckets = _buckets(shards)

    def run(states: pa.Table, slots: pa.Table) -> pa.Table:
        rows, left = [], []
        for row in states.to_pylist():
            shard = Shard(row)
            here = slots_of(shard.seq, words - 1)
            wanted = np.zeros(int(here.max(initial=-1)) + 2, bool)
            for some in slots.column("slots").to_pylist():
                wanted[_unpack(some)] = True
            shard.seq = keep_runs(shard.seq, wanted[here], words - 1)
            if len(shard.seq):
                rows += shard.blocks([shard.entries(Index(shard.seq, words).phrases(words), True)], buckets)
                left.append(row | {"seq": _pack(shard.seq), "tokens": int((shard.seq > 0).sum())})
        found = pa.table([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_FOUND)], schema=_FOUND)
        both = pa.schema([*_FOUND, *list(_STATE)[1:]])
        for f in list(both)[len(_FOUND) :]:
            found = found.append_column(f, pa.nulls(len(rows), f.type))
        return pa.concat_tables([found.cast(both), pa.Table.from_pylist(left, both)])

    return shards.groupBy("shard").cogroup(kept.where("slots is not null").select("shard", "slots").groupBy("shard")).applyInArrow(run, f"{FOUND}, {STATE.partition(', ')[2]}")


_STATE = pa.schema([("shard", pa.int64()), ("words", pa.list_(pa.binary())), ("langs", pa.list_(pa.string())), ("lang_of", pa.binary()), ("seq", pa.binary()), ("tokens", pa.int64())])
_FOUND = pa.schema([("bucket", pa.int32()), ("shard", pa.int64()), ("block", pa.binary())])
_KEPT = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("f", pa.int64()), ("shard", pa.int64()), ("slots", pa.binary())])
_ENTRY = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("slot", pa.int32()), ("n", pa.int32())])


def frequent(found: DataFrame, least: int, tasks: int) -> DataFrame:
    """The phrases whose counts over all shards reach ``least``: a row for each with its count ``f``, and rows with the slots of each shard.

    The empty phrase stands for all words of a language and stays whatever its count.
    """

    def run(group: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(block).read_all() for block in group.column("block").to_pylist()]
        shard = np.repeat(group.column("shard").to_numpy(), [len(p) for p in parts])
        entries = pa.concat_tables(parts).combine_chunks()
        lang, phrase, slot = (entries.column(c) for c in ("lang", "phrase", "slot"))
        key = pc.binary_join_element_wise(lang.cast(pa.binary()), phrase, pa.scalar(b"\t", pa.binary())).combine_chunks().dictionary_encode()
        at = key.indices.to_numpy()
        # Sums of whole numbers are exact as floats as long as they are below 2 ** 53.
        f = np.bincount(at, entries.column("n").to_numpy(), len(key.dictionary)).astype(np.int64)
        first = np.zeros(len(f), np.int64)
        first[at[::-1]] = np.arange(len(at))[::-1]
        empty = pc.equal(phrase, b"").combine_chunks().to_numpy(zero_copy_only=False)
        stays = (f >= least) | empty[first]
        some = pa.array(first[stays])
        out = [pa.table([lang.take(some).combine_chunks(), phrase.take(some).combine_chunks(), pa.array(f[stays]), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.binary())], schema=_KEPT)]
        slots = slot.to_numpy()
        held = stays[at] & (slots >= 0)
        shard, slots = shard[held], slots[held]
        order = np.argsort(shard, kind="stable")
        lists = [(int(shard[order[a]]), _pack(slots[order[a:b]])) for a, b in _spans(shard[order])]
        n = len(lists)
        out.append(pa.table([pa.nulls(n, pa.string()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.array([x for x, _ in lists], pa.int64()), pa.array([x for _, x in lists], pa.binary())], schema=_KEPT))
        return pa.concat_tables(out)

    return found.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(run, KEPT)


def _stored(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cuts(words: int) -> Column:
    """The cut of a phrase with the lowest score: ``score``, ``cut`` (words before it), ``l``, ``r``."""
    def one(k: int) -> Column:
        l, r = F.get("heads", F.lit(k - 1)), F.get("tails", F.lit(words - k - 1))
        big = "decimal(38,0)"
        score = F.call_function("div", F.lit(1000).cast(big) * F.col("a").cast(big) * F.col("n").cast(big), l.cast(big) * r.cast(big)).cast("long")
        return F.struct(score.alias("score"), F.lit(k).alias("cut"), l.alias("l"), r.alias("r"))

    return F.array_min(F.array(*[one(k) for k in range(1, words)]))


def scored_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, longest: int = 5, size: int = SHARD) -> DataFrame:
    """``lang``, ``phrase``, ``words``, ``a``, ``cut``, ``l``, ``r``, ``n``, ``score`` of each phrase that is not always part of a longer frequent one.

    A phrase is frequent if it occurs ``least`` times; a language that is null is ``und``, a null text is empty. Rows
    that repeat count as often as they come. An empty table has no phrases.
    """
    if longest < 2:
        raise ValueError("a phrase has two words or more")
    spark, root = docs.sparkSession, scratch(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    state = _stored(cut_shards(rows, size), os.path.join(root, "shards"))
    # Blocks are small and adding them up is work, so tasks are counted, not measured in bytes.
    tasks = min(4096, _buckets(state))
    kept = _stored(frequent(first_round(state), least, tasks), os.path.join(root, "kept-2"))
    total = kept.where("phrase = X''").select("lang", F.col("f").alias("n"))
    phrases = kept.where("phrase <> X''").select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("f").alias("a"))
    single = phrases.where(~F.contains("phrase", F.lit(" ")))
    level = single.select("lang", "phrase", "a", F.array("a").alias("heads"), F.array("a").alias("tails"))
    found, levels = phrases.where(F.contains("phrase", F.lit(" "))), []
    for words in range(2, longest + 1):
        level = _stored(_with_parts(found, level, words), os.path.join(root, f"level-{words}"))
        levels.append(level)
        if words < longest:
            left = _stored(next_round(state, kept, words + 1), os.path.join(root, f"round-{words + 1}"))
            state = left.where("seq is not null").select("shard", "words", "langs", "lang_of", "seq", "tokens")
            kept = _stored(frequent(left.where("block is not null").select("bucket", "shard", "block"), least, tasks), os.path.join(root, f"kept-{words + 1}"))
            found = kept.where("phrase is not null").select("lang", F.col("phrase").cast("string").alias("phrase"), F.col("f").alias("a"))
    out = None
    for words, level in enumerate(levels, start=2):
        if words < longest:
            longer = levels[words - 1]
            sides = [longer.select("lang", F.substring_index("phrase", " ", d * words).alias("phrase"), F.col("a").alias("more")) for d in (1, -1)]
            inside = sides[0].unionByName(sides[1]).groupBy("lang", "phrase").agg(F.max("more").alias("more"))
            # A longer one never counts more, so it counts the same or it does not matter.
            level = level.join(inside.withColumnRenamed("more", "a"), ["lang", "phrase", "a"], "left_anti")
        best = level.join(total, "lang").withColumn("best", cuts(words))
        part = best.select("lang", "phrase", F.lit(words).alias("words"), "a", "best.cut", "best.l", "best.r", "n", "best.score")
        out = part if out is None else out.unionByName(part)
    return out


def _with_parts(phrases: DataFrame, shorter: DataFrame, words: int) -> DataFrame:
    """Adds counts of the first 1, 2 ... words (``heads``) and of the last ones (``tails``), which those of the two shorter phrases give."""
    p = phrases.select("*", F.substring_index("phrase", " ", words - 1).alias("head"), F.substring_index("phrase", " ", 1 - words).alias("tail"))
    first = shorter.select("lang", F.col("phrase").alias("head"), "heads")
    last = shorter.select("lang", F.col("phrase").alias("tail"), "tails")
    return p.join(first, ["lang", "head"]).join(last, ["lang", "tail"]).select(
        "lang", "phrase", "a", F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"))


def top_phrases(scored: DataFrame, most: int, parts: int = 256) -> DataFrame:
    """The first ``most`` rows of each language by score, count and phrase, with ``rank`` from 1.

    Each language is first cut down in ``parts`` parts, so that no task orders all of its phrases.
    """
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(parts))
    few = scored.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= most)
    return few.drop("part", "rank").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= most)


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 100, longest: int = 5, most: int = 2000, size: int = SHARD) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``words``, ``a``, ``cut``, ``l``, ``r``, ``n``, ``score``: the phrases of each language that stick together best."""
    return top_phrases(scored_phrases(docs, lang_col, text_col, least, longest, size), most)
