"""Language-model scores by subword lattices: every way to cut a word into pieces of a given vocabulary counts.

The pieces are those of an existing vocabulary, which is not trained; its order of pieces is the first guess of their
probabilities. Each different word of the corpus is one lattice. A forward recursion in log space adds all of its
segmentations; forward and backward together give the expected uses of each piece in the learned words, which are the
probabilities of the next turn.

Pieces alone are a model of new words. A text is a lattice of words, of one end, and of three ways to each word: by all its
segmentations, as a word that was learned (absolute discounting leaves the mass for the first way), and as a word that
stood in the text before. These ways are added too. What stood before is drawn as from an urn, whose product over a
text does not depend on the order of its words, so a text is scored from the counts of its different words.

Words are counted in tasks and met once in a shuffle; words that may be frequent enough to make a hot key are few, and
go to all tasks; all others are joined.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch

MARK = "▁"
# The end of a text as a word, and its place among the symbols; words hold no blank.
END = b" "
# Words that make up at least one part in this many of all words go to every task: at most so many can.
FREQUENT = 400_000
# Bytes of a word above which a digest is its key.
LONG = 64
# Different words after which a task hands on what it has counted.
KEEP = 300_000
# Bytes of a text that are split at once.
SLICE = 1 << 22
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def key_of(word: bytes) -> bytes:
    return word if len(word) <= LONG else END + hashlib.sha256(word).digest()


def word_lists(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, lower-cased in ASCII, some at a time."""
    at = 0
    while at < len(text):
        cut = len(text)
        if cut - at > SLICE and (blank := _BLANK.search(text, at + SLICE)):
            cut = blank.end()
        yield text[at:cut].lower().split()
        at = cut


class Vocabulary:
    """Pieces with their place, whether they are prefixes of others, and the first guess of their probabilities.

    Symbols are the pieces, then 256 bytes, then the end.
    """

    def __init__(self, scores: Mapping[str, float]):
        pieces = [p for p in sorted(scores, key=lambda p: (-scores[p], p)) if not re.search(f".{MARK}|[A-Z]", p)]
        self.place = {p: i for i, p in enumerate(pieces)}
        self.bytes_at = len(pieces)
        self.size = len(pieces) + 257
        # Numbers, not their logarithms: scores of such vocabularies are ranks.
        weights = np.append(1 / (np.arange(len(pieces)) + 10.0), np.full(257, 0.1 / (len(pieces) + 10.0)))
        self.guess = weights / weights.sum()

    def arcs(self, p: np.ndarray) -> dict[str, float | None]:
        """Log probability of each piece; None for strings that only start one."""
        log = np.log(p).tolist()
        out: dict[str, float | None] = {x[:i]: None for x in self.place for i in range(1, len(x))}
        out.update((x, log[i]) for x, i in self.place.items())
        return out


class Lattice:
    """Words as lattices under given probabilities of the symbols."""

    def __init__(self, vocabulary: Vocabulary, p: np.ndarray):
        self.vocabulary, self.table = vocabulary, vocabulary.arcs(p)
        self.bytes_log = np.log(p[vocabulary.bytes_at : vocabulary.bytes_at + 256]).tolist()

    def forward(self, word: bytes) -> tuple[list[float], list[tuple[int, int, str, float]]]:
        """Log probability of each prefix over all of its segmentations, and all arcs by their start."""
        text, table = MARK + word.decode("utf-8", "surrogateescape"), self.table
        n, missing = len(text), self
        into: list[list[float]] = [[] for _ in range(n + 1)]
        into[0].append(0.0)
        alpha, arcs = [], []
        for s in range(n):
            a = _log_sum(into[s])
            alpha.append(a)
            e = s + 1
            if table.get(text[s:e]) is None:  # no piece of its own: its bytes are
                lp = sum(self.bytes_log[b] for b in text[s].encode("utf-8", "surrogateescape"))
                into[e].append(a + lp)
                arcs.append((s, e, "", lp))
            while e <= n:
                lp = table.get(text[s:e], missing)
                if lp is missing:
                    break
                if lp is not None:
                    into[e].append(a + lp)
                    arcs.append((s, e, text[s:e], lp))
                e += 1
        alpha.append(_log_sum(into[n]))
        return alpha, arcs

    def log_probability(self, word: bytes) -> float:
        return self.forward(word)[0][-1]

    def expect(self, word: bytes, times: float, into: np.ndarray) -> None:
        """Adds the expected uses of each symbol in ``times`` occurrences of a word."""
        alpha, arcs = self.forward(word)
        text = MARK + word.decode("utf-8", "surrogateescape")
        all_, place, at = alpha[-1], self.vocabulary.place, self.vocabulary.bytes_at
        back: list[list[float]] = [[] for _ in alpha]
        back[-1].append(0.0)
        beta = [0.0] * len(alpha)
        done, exp = len(alpha) - 1, math.exp
        for s, e, piece, lp in reversed(arcs):
            while done > s:  # every arc that leaves a later place has been seen
                beta[done] = _log_sum(back[done])
                done -= 1
            onward = lp + beta[e]
            back[s].append(onward)
            uses = times * exp(alpha[s] + onward - all_)
            if piece:
                into[place[piece]] += uses
            else:
                for b in text[s].encode("utf-8", "surrogateescape"):
                    into[at + b] += uses


class Lattices:
    """Many words as lattices at once: words of one length are the columns of arrays, and each step is taken for all of them.

    The pieces are a trie, walked from every place of every word at the same time. Longer words than ``longest`` go one by one.
    """

    longest = 64
    # Words of one length that are worked on together.
    together = 8192

    def __init__(self, vocabulary: Vocabulary, p: np.ndarray):
        self.vocabulary, self.p = vocabulary, p
        self.one: Lattice | None = None
        nodes, edges = {"": 0}, []
        inner = {c: i for i, c in enumerate(sorted({c for x in vocabulary.place for c in x[1:]}), start=1)}
        for piece in vocabulary.place:
            for i in range(1, len(piece) + 1):
                if piece[:i] not in nodes:
                    nodes[piece[:i]] = len(nodes)
                    if i > 1:
                        edges.append((nodes[piece[: i - 1]], inner[piece[i - 1]], nodes[piece[:i]]))
        # Node 0 is no place in the trie, and no character leads on from it.
        self.next = np.zeros((len(nodes), len(inner) + 1), np.int32)
        for node, code, to in edges:
            self.next[node, code] = to
        self.first, self.inner = np.zeros(0x110000, np.int32), np.zeros(0x110000, np.int16)
        self.place = np.full(len(nodes), -1)
        for text, node in nodes.items():
            if len(text) == 1:
                self.first[ord(text)] = node
            self.place[node] = vocabulary.place.get(text, -1)
        for c, code in inner.items():
            self.inner[ord(c)] = code
        self.log = np.where(self.place >= 0, np.log(p[self.place]), -np.inf)
        self.bytes_log = np.log(p[vocabulary.bytes_at : vocabulary.bytes_at + 256])

    def groups(self, words: Sequence[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words of one length, and their characters, one column for each word."""
        texts = [MARK + w.decode("utf-8", "surrogateescape") for w in words]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        for size in np.unique(sizes[sizes <= self.longest]).tolist():
            every = np.flatnonzero(sizes == size)
            for i in range(0, len(every), self.together):
                some = every[i : i + self.together]
                joined = "".join([texts[j] for j in some.tolist()]).encode("utf-32-le", "surrogatepass")
                yield some, np.ascontiguousarray(np.frombuffer(joined, np.uint32).reshape(-1, size).T)

    def long(self, words: Sequence[bytes]) -> Iterator[int]:
        for i, w in enumerate(words):
            if len(w) >= self.longest and len(w.decode("utf-8", "surrogateescape")) >= self.longest:
                self.one = self.one or Lattice(self.vocabulary, self.p)
                yield i

    def arcs(self, chars: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """For pieces of 1, 2 ... characters, their node and log probability from each place; and which characters are bytes."""
        node = self.first[chars]
        nodes, logs = [node], [self.log[node]]
        unknown = np.isneginf(logs[0])
        if unknown.any():
            each, at = np.unique(chars[unknown], return_inverse=True)
            logs[0][unknown] = np.array([self.bytes_log[list(self.bytes_of(c))].sum() for c in each.tolist()])[at]
        codes = self.inner[chars]
        for k in range(2, len(chars) + 1):
            node = self.next[node[:-1], codes[k - 1 :]]
            if not node.any():
                break
            nodes.append(node)
            logs.append(self.log[node])
        return nodes, logs, unknown

    @staticmethod
    def bytes_of(char: int) -> bytes:
        return chr(char).encode("utf-8", "surrogateescape")

    @staticmethod
    def _add(ways: list[np.ndarray]) -> np.ndarray:
        x = np.stack(ways)
        top = x.max(0)
        return top + np.log(np.exp(x - top).sum(0))

    def forward(self, logs: list[np.ndarray], size: int) -> list[np.ndarray]:
        """Log probability of the first 0, 1 ... characters of each word over all segmentations."""
        alpha = [np.zeros(logs[0].shape[1])]
        for end in range(1, size + 1):
            alpha.append(self._add([alpha[end - k] + logs[k - 1][end - k] for k in range(1, min(len(logs), end) + 1)]))
        return alpha

    def log_probabilities(self, words: Sequence[bytes]) -> np.ndarray:
        out = np.zeros(len(words))
        for some, chars in self.groups(words):
            out[some] = self.forward(self.arcs(chars)[1], len(chars))[-1]
        for i in self.long(words):
            out[i] = self.one.log_probability(words[i])
        return out

    def expect(self, words: Sequence[bytes], into: np.ndarray) -> None:
        """Adds the expected uses of each symbol in one occurrence of each word."""
        at = self.vocabulary.bytes_at
        for _, chars in self.groups(words):
            size = len(chars)
            nodes, logs, unknown = self.arcs(chars)
            alpha = self.forward(logs, size)
            beta = [np.zeros(chars.shape[1])]  # from the end on, last character first
            for start in range(size - 1, -1, -1):
                beta.append(self._add([beta[size - start - k] + logs[k - 1][start] for k in range(1, min(len(logs), size - start) + 1)]))
            for k, (node, log) in enumerate(zip(nodes, logs, strict=True), start=1):
                uses = np.exp(np.stack([alpha[s] + log[s] + beta[size - s - k] for s in range(size - k + 1)]) - alpha[-1])
                if k == 1 and unknown.any():
                    each, which = np.unique(chars[unknown], return_inverse=True)
                    for c, n in zip(each.tolist(), np.bincount(which, uses[unknown]).tolist(), strict=True):
                        for b in self.bytes_of(c):
                            into[at + b] += n
                    uses = np.where(unknown, 0.0, uses)
                found = np.bincount(node.ravel(), uses.ravel(), len(self.place))
                real = (self.place >= 0) & (found > 0)
                into[self.place[real]] += found[real]
        for i in self.long(words):
            self.one.expect(words[i], 1.0, into)


def _log_sum(x: list[float]) -> float:
    if len(x) == 1:
        return x[0]
    top = max(x)
    return top + math.log(sum([math.exp(v - top) for v in x]))


def count_words(rows: DataFrame) -> DataFrame:
    """``text`` (binary), ``held`` -> ``key``, ``word`` (long words only), ``learned``, ``seen``: counts of each different word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())  # learned from, held out
        for batch in batches:
            for text, held in zip(batch.column("text"), batch.column("held").to_pylist(), strict=True):
                c = counts[held]
                for words in word_lists(text.as_py() or b""):
                    c.update(words)
                c[END] += 1
            if len(counts[0]) + len(counts[1]) > KEEP:
                yield flush(*counts)
        yield flush(*counts)

    def flush(learned: Counter, held: Counter) -> pa.RecordBatch:
        words = list(learned.keys() | held.keys())
        n = [learned[w] for w in words]
        cols = [pa.array([key_of(w) for w in words], pa.binary()), pa.array([w if len(w) > LONG else None for w in words], pa.binary()),
                pa.array(n, pa.int64()), pa.array([a + held[w] for a, w in zip(n, words, strict=True)], pa.int64())]
        learned.clear()
        held.clear()
        return pa.RecordBatch.from_arrays(cols, names=["key", "word", "learned", "seen"])

    return rows.select("text", "held").mapInArrow(run, "key binary, word binary, learned long, seen long")


def _many(parts: Iterator, rows: int = 1 << 16) -> Iterator:
    """Arrays or batches put together to so many rows, so that words of one length come in numbers."""
    held, n = [], 0
    join = lambda: pa.concat_arrays(held) if isinstance(held[0], pa.Array) else pa.concat_batches(held)
    for part in parts:
        held.append(part)
        n += len(part)
        if n >= rows:
            yield join()
            held, n = [], 0
    if n:
        yield join()


def expected_uses(words: DataFrame, vocabulary: Vocabulary, p: np.ndarray) -> np.ndarray:
    """Expected uses of each symbol over all different learned words; one number for each symbol reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices, uses = Lattices(vocabulary, p), np.zeros(vocabulary.size)
        for words in _many(batch.column("word") for batch in batches):
            lattices.expect(words.to_pylist(), uses)
        some = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(uses[some])], names=["symbol", "uses"])

    found = words.where((F.col("learned") > 0) & (F.col("key") != END)).select("word").mapInArrow(run, "symbol int, uses double")
    out = np.zeros(vocabulary.size)
    for r in found.groupBy("symbol").agg(F.sum("uses").alias("uses")).collect():
        out[r["symbol"]] = r["uses"]
    return out


def train(words: DataFrame, vocabulary: Vocabulary, turns: int, prior: float) -> np.ndarray:
    """Probabilities of the symbols after some turns; ``prior`` uses are dealt out by the first guess."""
    p = vocabulary.guess
    for _ in range(turns):
        uses = expected_uses(words, vocabulary, p) + prior * vocabulary.guess
        p = uses / uses.sum()
    return p


@dataclass(frozen=True)
class Words:
    """What is known of learned words: their number, how many are different, the discount, and the weight of an urn's start."""

    learned: int
    different: int
    discount: float
    start: float

    def log_probability(self, count: np.ndarray, by_pieces: np.ndarray) -> np.ndarray:
        """Of words with so many learned occurrences, as a learned word or by pieces."""
        if not self.learned:
            return by_pieces
        with np.errstate(divide="ignore"):
            learned = np.log(np.maximum(count - self.discount, 0.0) / self.learned)
        return np.logaddexp(learned, math.log(self.discount * self.different / self.learned) + by_pieces)

    def drawn(self, log_p: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Log of the product over so many draws of a word from the urn, without what the text's length divides it by."""
        a = self.start * np.exp(log_p)
        out = math.log(self.start) + log_p
        for k in range(1, 8):
            out = out + np.where(times > k, np.log(k + a), 0.0)
        many = times > 8
        return out + np.where(many, _log_gamma(a + np.maximum(times, 8)) - _log_gamma(a + 8), 0.0)

    def length(self, tokens: int) -> float:
        return math.lgamma(tokens + self.start) - math.lgamma(self.start)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series, for 8 and more."""
    i = 1 / x
    i2 = i * i
    return (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + i * (1 / 12 - i2 * (1 / 360 - i2 * (1 / 1260 - i2 * (1 / 1680 - i2 / 1188))))


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        return -1


SCORED = "key binary, seen long, known boolean, base double, log_p double, pieces double"
SUMS = ("tokens long", "known long", "base double", "score double", "pieces double")


def _sums(words: Words, times: np.ndarray, known: np.ndarray, base: np.ndarray, log_p: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, ...]:
    """What each word adds to each sum of its text."""
    return times, times * known, times * base, words.drawn(log_p, times) / math.log(10), times * pieces


def lattice_scores(docs: DataFrame, scores: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2,
                   turns: int = 2, prior: float = 1000.0, start: float = 3000.0, frequent: int = FREQUENT) -> DataFrame:
    """``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``pieces_score``: one row for each row of ``docs``.

    Learned from rows whose crc32 of the id as text does not leave ``held_fold``; rows without an id are held out. A null
    text is an empty one, which has an end and nothing else. With nothing to learn from, the pieces alone score.
    Rows that repeat are learned and returned as often as they come. All scores are log10 probabilities, above
    negative infinity for every text: characters that no piece knows are bytes. ``pieces_score`` is that of the pieces
    alone, words told apart by their mark. ``start`` is how many words of a text weigh as much as all that was learned.
    """
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    root, vocabulary = scratch(spark, "lattice"), Vocabulary(scores)
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").cast("binary")
    held = F.coalesce(F.crc32(id_.cast("string").cast("binary")) % folds == held_fold, F.lit(True))
    rows = docs.select(id_.alias("id"), text.alias("text"), held.alias("held"))

    # Lattices are work for many tasks, though their words are few bytes: about as many as read the texts.
    tasks = max(16, min(4096, 2 * rows.rdd.getNumPartitions()))
    counted = count_words(rows).repartition(tasks, "key").groupBy("key").agg(
        F.coalesce(F.max("word"), F.col("key")).alias("word"), F.sum("learned").alias("learned"), F.sum("seen").alias("seen"))
    counted.write.parquet(os.path.join(root, "words"))
    found = spark.read.parquet(os.path.join(root, "words"))
    total = found.agg(F.sum("learned").alias("n"), F.sum("seen").alias("seen"), *[F.count(F.when(c, 1)).alias(a) for a, c in (
        ("v", F.col("learned") > 0), ("once", F.col("learned") == 1), ("twice", F.col("learned") == 2))]).first()
    n, v, seen = total["n"] or 0, total["v"], total["seen"] or 0
    words = Words(n, v, min(0.9, max(0.1, total["once"] / max(1, total["once"] + 2 * total["twice"]))), start)
    spread = found.repartition(tasks, "key")
    p = train(spread, vocabulary, turns if n else 0, prior)
    end_log, size = math.log(p[-1]), n + v + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = Lattices(vocabulary, p)
        for batch in _many(batches):
            every = batch.column("word").to_pylist()
            pieces = np.where([w == END for w in every], end_log, lattices.log_probabilities(every))
            learned = batch.column("learned").to_numpy()
            cols = [pa.array(learned > 0), pa.array(np.log10((learned + 1.0) / size)), pa.array(words.log_probability(learned, pieces)), pa.array(pieces / math.log(10))]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("seen"), *cols], names=["key", "seen", "known", "base", "log_p", "pieces"])

    spread.mapInArrow(score, SCORED).write.parquet(os.path.join(root, "scored"))
    scored = spark.read.parquet(os.path.join(root, "scored"))
    often = (F.col("seen") * frequent >= seen) | (F.col("key") == END)
    few = scored.where(often).collect()
    table = [np.array([r[c] for r in few], float) for c in ("known", "base", "log_p", "pieces")]
    shared = spark.sparkContext.broadcast((_Places((bytes(r["key"]), i) for i, r in enumerate(few)), table))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, values = shared.value
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            whole, rare = [], []
            for text in batch.column("text"):
                counts: Counter = Counter((END,))
                for part in word_lists(text.as_py() or b""):
                    counts.update(part)
                each = list(counts)
                times = np.fromiter(counts.values(), np.int64, len(each))
                at = np.fromiter(map(places.__getitem__, each), np.int64, len(each))
                for i in np.flatnonzero(at < 0).tolist():
                    key = key_of(each[i])
                    at[i] = places[key]
                    if at[i] < 0:
                        rare.append((uid, key, int(times[i])))
                here = at >= 0
                sums = [x.sum() for x in _sums(words, times[here], *(x[at[here]] for x in values))]
                whole.append((uid, int(times.sum()), int(sums[1]), sums[2], sums[3] - words.length(int(times.sum())) / math.log(10), sums[4]))
                uid += 1
            nothing = pa.nulls(len(rare), batch.column("id").type), pa.nulls(len(rare), pa.bool_())
            for part, id_held in ((whole, (batch.column("id"), batch.column("held"))), (rare, nothing)):
                k = len(part)
                cols = [pa.array([r[0] for r in part], pa.int64()), *id_held]
                if part is whole:
                    cols += [pa.array([r[1 + i] for r in part], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()))] + [pa.nulls(k, pa.binary())]
                else:
                    cols += [pa.array([r[2] for r in part], pa.int64()), pa.nulls(k, pa.int64()), *[pa.nulls(k, pa.float64())] * 3, pa.array([r[1] for r in part], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["uid", "id", "held", "tokens", "known", "base", "score", "pieces", "key"])

    path = os.path.join(root, "texts")
    rows.mapInArrow(look_up, f"uid long, id {kind}, held boolean, {', '.join(SUMS)}, key binary").write.parquet(path)
    texts = spark.read.parquet(path)
    whole = texts.where("key is null").drop("key")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("tokens", "known", "base", "log_p", "pieces")]
            sums = _sums(words, *columns)
            yield pa.RecordBatch.from_arrays([batch.column("uid"), *[pa.array(x) for x in sums[1:]]], names=["uid", "known", "base", "score", "pieces"])

    more = texts.where("key is not null").select("uid", "key", "tokens").join(scored.where(~often).select("key", "known", "base", "log_p", "pieces"), "key")
    more = more.select("uid", "tokens", "known", "base", "log_p", "pieces").mapInArrow(add, f"uid long, {', '.join(SUMS[1:])}")
    more = more.groupBy("uid").agg(*[F.sum(c).alias(f"more_{c}") for c in ("known", "base", "score", "pieces")])

    def both(a: str) -> Column:
        return F.col(a) + F.coalesce(F.col(f"more_{a}"), F.lit(0))

    return whole.join(more, "uid", "left").select(
        "id", F.col("held").alias("held_out"), F.col("tokens").alias("n_tokens"), both("known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        both("base").alias("base_score"), both("score").alias("score"), both("pieces").alias("pieces_score"))
