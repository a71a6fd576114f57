"""Token counts by a deterministic transducer compiled from a byte-pair vocabulary.

The state after some characters is the places at which a piece that goes on may have begun, with the last token of the
encoding of the text up to each of them. One more character has exactly one piece that ends with it and agrees
with the token before, so transitions are deterministic; each is annotated with the tokens it emits, which is below
one where pieces grow together. States and transitions are compiled as texts need them and kept.

No piece holds a word mark behind another character, so a word mark after another character resets the state. A
chunk of text is thus a map: the count between its first and last reset, and the open ends on both sides, on which
the entry state acts. Maps of neighbouring chunks compose associatively; long texts are cut into chunks, spread over
tasks, and their maps composed by a tree.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from functools import reduce
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
# Characters of a chunk; longer texts are cut.
CHUNK = 1 << 16
# Entries after which a task drops what it has compiled or counted; it is then made again as needed.
KEEP = 400_000


def load_pieces(path: str) -> dict[str, float]:
    """Normal pieces of a sentencepiece BPE model and their scores."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kinds = (m.is_control, m.is_unknown, m.is_byte, m.is_unused)
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not any(k(i) for k in kinds)}


def merged(text: str, scores: Mapping[str, float]) -> tuple[list[str], int]:
    """Encoding of a short text by merging the best pair again and again, the first one of equals; and where the last merge joined two parts."""
    parts, joint = list(text), 0
    while len(parts) > 1:
        best = max(range(len(parts) - 1), key=lambda i: (scores.get(parts[i] + parts[i + 1], float("-inf")), -i))
        if parts[best] + parts[best + 1] not in scores:
            break
        joint = len(parts[best])
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return parts, joint


def joints(scores: Mapping[str, float]) -> dict[str, int]:
    """For each piece that is its own encoding, the place where its last merge joined it; 0 for single characters.

    Raises if a part is merged later than the whole, as no vocabulary learned by merging has it.
    """
    out = {}
    for piece in scores:
        parts, joint = merged(piece, scores)
        if parts == [piece]:
            out[piece] = joint
            if any(len(x) > 1 and scores[x] < scores[piece] for x in (piece[:joint], piece[joint:])):
                raise ValueError(f"{piece!r} is merged before its parts")
    return out


def unit_pattern(scores: Iterable[str]) -> re.Pattern[str]:
    """Cuts a text where no piece can reach across: before word marks, and between characters that no piece has side by side.

    Characters that stand side by side in some piece are of one kind, also by way of others. A unit is word marks and a run of one kind.
    """
    kind: dict[str, str] = {}

    def of(char: str) -> str:
        while kind.setdefault(char, char) != char:
            kind[char] = char = kind[kind[char]]
        return char

    for piece in scores:
        bare = piece.lstrip(MARK)
        for a, b in pairwise(bare):
            kind[of(a)] = of(b)
    runs: dict[str, list[str]] = {}
    for char in kind:
        runs.setdefault(of(char), []).append(char)
    kinds = sorted((r for r in runs.values()), key=len, reverse=True)
    either = "".join(f"[{''.join(map(re.escape, sorted(r)))}]+|" for r in kinds)
    return re.compile(f"{MARK}*(?:{either}[^{MARK}])|{MARK}+")


class State(dict):
    """Next states by character, compiled when first asked for.

    ``emitted``: tokens that the transition to this state emits. ``open``: places at which a piece may begin that does not end yet, the first one first. Each has the text since, the
    token that ends there (None: a reset), and the tokens up to it less those up to the end.
    """

    __slots__ = ("emitted", "machine", "open")

    def __init__(self, machine: Transducer, open_: tuple, emitted: int):
        self.machine, self.open, self.emitted = machine, open_, emitted

    def __missing__(self, char: str) -> State:
        to = self[char] = self.machine.compile(self.open, char)
        return to


class Transducer:
    """Counts the tokens of pieces of text that start and end at a reset."""

    def __init__(self, scores: Mapping[str, float], joined: Mapping[str, int] | None = None):
        self.scores = scores
        self.joined = joints(scores) if joined is None else joined
        self.starts = {p[:i] for p in scores for i in range(1, len(p) + 1)}
        self.cut = unit_pattern(scores).findall
        self.fits: dict[tuple[str, str], bool] = {}
        self.edges: tuple[dict[str, list], dict[str, list]] = ({}, {})
        self.units = Units(self)
        self.forget()

    def forget(self) -> None:
        self.compiled = 0
        self.states: dict[tuple, State] = {}
        self.reset = self.state((("", None, 0),), 0)

    def state(self, open_: tuple, emitted: int) -> State:
        known = self.states.get((open_, emitted))
        if known is None:
            known = self.states[open_, emitted] = State(self, open_, emitted)
        return known

    def edge(self, piece: str, last: int) -> list[tuple[str, float]]:
        """Parts that hold the last (1) or first (0) character while a piece is merged, and the score at which each is used up."""
        kept = self.edges[last]
        if piece not in kept:
            out, part, until = [], piece, float("-inf")
            while True:
                out.append((part, until))
                if len(part) == 1:
                    break
                until, at = self.scores[part], self.joined[part]
                part = part[at:] if last else part[:at]
            kept[piece] = out[::-1]
        return kept[piece]

    def agree(self, before: str | None, piece: str) -> bool:
        """Whether a piece can follow a token in an encoding: no part of one is merged with a part of the other in between."""
        if piece not in self.joined:
            return False
        if before is None:
            return True
        key = (before, piece)
        if key not in self.fits:
            if len(self.fits) > KEEP:
                self.fits.clear()
            self.fits[key] = self._apart(self.edge(before, 1), self.edge(piece, 0))
        return self.fits[key]

    def _apart(self, left: list[tuple[str, float]], right: list[tuple[str, float]]) -> bool:
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = left[i], right[j]
            score = self.scores.get(a + b)
            if score is not None and score > a_until and score >= b_until:  # of equals the first pair is merged
                return False
            if i + 1 == len(left) and j + 1 == len(right):
                return True
            if a_until >= b_until:
                i += 1
            else:
                j += 1

    def ending(self, open_: tuple, char: str) -> tuple[str, int]:
        """The piece that ends with a character after a state, and the tokens emitted."""
        joined, fits = self.joined, self.fits
        for since, token, had in open_:
            piece = since + char
            if piece in joined:
                fit = token is None or fits.get((token, piece))
                if fit or (fit is None and self.agree(token, piece)):
                    return piece, had + 1
        return "", len(char.encode("utf-8", "surrogatepass"))  # no piece: its bytes are tokens, and nothing joins them

    def compile(self, open_: tuple, char: str) -> State:
        """The state after a state and a character."""
        self.compiled += 1
        last, emitted = self.ending(open_, char)
        if not last:
            return self.state(self.reset.open, emitted)
        starts = self.starts
        return self.state((*[(p, t, c - emitted) for s, t, c in open_ if (p := s + char) in starts], ("", last, 0)), emitted)

    def run(self, text: str) -> int:
        """Tokens of a unit. No state is made behind its last character, as most ends are new where units are."""
        state, total = self.reset, 0
        for char in text[:-1]:
            state = state[char]
            total += state.emitted
        for char in text[-1:]:
            total += state[char].emitted if char in state else self.ending(state.open, char)[1]
        return total

    def count(self, text: str) -> int:
        """Tokens of a text that begins and ends at resets; blanks are word marks already.

        Each different unit is run once and then looked up, so a text costs a look-up for each of its units.
        """
        if len(self.units) > KEEP:
            self.units.clear()
        if self.compiled > 2 * KEEP:
            self.forget()
        return sum(map(self.units.__getitem__, self.cut(text)))


class Units(dict):
    """Tokens of units, counted when first asked for; very long units are not kept."""

    def __init__(self, machine: Transducer):
        self.machine = machine

    def __missing__(self, unit: str) -> int:
        n = self.machine.run(unit)
        if len(unit) < 64:
            self[unit] = n
        return n


_RESET = re.compile(f"(?<=[^{MARK}]){MARK}")


def chunk_map(chunk: str, machine: Transducer) -> tuple[str, int, str | None]:
    """Open start, tokens from the first reset to the last, open end; the end is None if there is no reset."""
    first = _RESET.search(chunk)
    if not first:
        return chunk, 0, None
    a = first.start()
    last = max(i for i in (chunk.rfind(MARK),) if i >= a)
    while last > a and chunk[last - 1] == MARK:
        last -= 1
    return chunk[:a], machine.count(chunk[a:last]), chunk[last:]


def compose(x: tuple[str, int, str | None], y: tuple[str, int, str | None], machine: Transducer) -> tuple[str, int, str | None]:
    if x[2] is None and y[2] is None:
        return chunk_map(x[0] + y[0], machine)
    if x[2] is None:
        a, n, b = chunk_map(x[0] + y[0], machine)
        return (a, y[1], y[2]) if b is None else (a, n + machine.count(b) + y[1], y[2])
    if y[2] is None:
        a, n, b = chunk_map(x[2] + y[0], machine)
        return (x[0], x[1], a) if b is None else (x[0], x[1] + machine.count(a) + n, b)
    return x[0], x[1] + machine.count(x[2] + y[0]) + y[1], y[2]


def close(m: tuple[str, int, str | None], machine: Transducer) -> int:
    return machine.count(m[0]) + m[1] + machine.count(m[2] or "")


def token_counts(docs: DataFrame, scores: Mapping[str, float], id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Per row: ``id``, ``n_bytes`` (UTF-8), ``n_tokens``, as sentencepiece encodes the text with a model that keeps texts as they
    are, marks a word's start before the text, and falls back to bytes.

    Null counts as empty, which has no tokens. Texts of more than ``chunk`` characters are spread over tasks; rows
    that repeat in full are counted once and returned as often as they come.
    """
    kind, joined = dict(docs.dtypes)[id_col], joints(scores)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(scores, joined)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [machine.count(MARK + t.replace(" ", MARK)) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    short = rows.where(F.length("text") <= chunk).select("id", "text", F.octet_length("text").cast("long").alias("n_bytes"))
    short = short.mapInArrow(whole, f"id {kind}, n_bytes long, n_tokens long")

    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(scores, joined)
        for batch in batches:
            got = [chunk_map((MARK if p == 0 else "") + t.replace(" ", MARK), machine) for p, t in zip(batch.column("pos").to_pylist(), batch.column("part").to_pylist(), strict=True)]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "uid", "n_bytes", "pos")), *cols], names=["id", "uid", "n_bytes", "pos", "head", "n", "tail"])

    cut = rows.where(F.length("text") > chunk).select(
        "id", F.xxhash64("id", "text").alias("uid"), F.octet_length("text").cast("long").alias("n_bytes"),
        F.posexplode(F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % chunk), F.lit(0))).alias("pos", "part"))
    cut = cut.repartition("uid", "pos").mapInArrow(maps, f"id {kind}, uid long, n_bytes long, pos int, head string, n long, tail string")
    once = cut.groupBy("uid", "pos").agg(F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.first(F.struct("head", "n", "tail")).alias("map"), F.count(F.lit(1)).alias("times"))
    long_ = once.groupBy("uid").agg(F.first("id").alias("id"), F.max("n_bytes").alias("n_bytes"), F.max("times").alias("times"),
                                    F.transform(F.array_sort(F.collect_list(F.struct("pos", "map"))), lambda x: x["map"]).alias("maps"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Transducer(scores, joined)
        for batch in batches:
            n = [_tree([(m["head"], m["n"], m["tail"]) for m in ms], machine) for ms in batch.column("maps").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), batch.column("times"), pa.array(n, pa.int64())], names=["id", "n_bytes", "times", "n_tokens"])

    folded = long_.mapInArrow(fold, f"id {kind}, n_bytes long, times long, n_tokens long")
    folded = folded.select("id", "n_bytes", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")
    return short.unionByName(folded)


def _tree(maps: list[tuple[str, int, str | None]], machine: Transducer) -> int:
    while len(maps) > 1:
        maps = [reduce(lambda a, b: compose(a, b, machine), maps[i : i + 2]) for i in range(0, len(maps), 2)]
    return close(maps[0], machine) if maps else 0
