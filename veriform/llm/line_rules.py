"""Line-first cleaning: rules judge each line, failing lines go, and texts that lose too much go as a whole."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lexer import slices
from .text_stats import TextStats, symbol_bytes

WHITE = " \t\n\x0b\x0c\r"
# Wording of menus, notices and licences that is not part of a text. Fixed values.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "back to top", "click here", "cookie policy", "enable javascript", "forgot your password", "licensed under",
    "log in", "lorem ipsum", "no part of this", "privacy policy", "read more", "share on facebook", "share this", "sign in", "sign up", "skip to content",
    "subscribe to our", "terms and conditions", "terms of service", "terms of use", "uses cookies", "without warranties", "you may obtain a copy",
)


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; shares are of a line's words unless they say otherwise."""

    separators: int = 2  # marks that part the entries of a menu
    entry_words: float = 2.5  # words between them, at most
    symbols: float = 0.3
    shouts: float = 0.5  # words that end in two or more ! or ?
    upper: float = 0.7  # of the line's letters, in lines of five words or more
    one_word: float = 0.5  # the most frequent word, in lines of ten words or more
    bare_words: int = 3  # fewer words than these need a stop, question or exclamation mark at the end
    boilerplate_words: int = 60  # lines with a phrase of BOILERPLATE and at most so many words
    lost: float = 0.3  # of a text's words, more than which may not go


_PHRASE = re.compile(rf"\b(?:{'|'.join(map(re.escape, BOILERPLATE))})\b", re.I)
_SEPARATOR = re.compile(r"(?<!\S)[|»›•·>](?!\S)|\|")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_SHOUT = re.compile(r"[!?]{2,}(?!\S)")
_END = re.compile(r"[.!?:;…。！？\"'”»)]$")


def line_fault(line: str, rules: Rules) -> str | None:
    """The rule that a line fails: navigation, punctuation, repetition or boilerplate."""
    words = line.split()
    n = len(words)
    if not n:
        return None
    parts = len(_SEPARATOR.findall(line))
    if parts >= rules.separators and (n - parts) <= rules.entry_words * (parts + 1):
        return "navigation"
    if len(_SYMBOL.findall(line)) > rules.symbols * n or len(_SHOUT.findall(line)) > rules.shouts * n:
        return "punctuation"
    if n >= 5 and not line.islower():
        upper, lower = sum(map(str.isupper, line)), sum(map(str.islower, line))
        if upper > rules.upper * (upper + lower):
            return "punctuation"
    if n < rules.bare_words and not _END.search(line.rstrip(WHITE)):
        return "punctuation"
    if n >= 10 and max(map(words.count, set(words)) if n < 40 else np.unique(words, return_counts=True)[1].tolist()) > rules.one_word * n:
        return "repetition"
    if n <= rules.boilerplate_words and _PHRASE.search(line):
        return "boilerplate"
    return None


def clean_text(text: str, rules: Rules) -> tuple[str, int, int, int]:
    """The text without failing lines; words lost with them, lines lost, and lines equal to an earlier one."""
    seen: set[str] = set()
    kept, lost, lines, repeats = [], 0, 0, 0
    for line in text.split("\n"):
        if not line.strip(WHITE):
            kept.append(line)
            continue
        again = line in seen
        seen.add(line)
        repeats += again
        # a line met before is boilerplate too if it is short
        if line_fault(line, rules) or again:
            lost += len(line.split())
            lines += 1
        else:
            kept.append(line)
    return "\n".join(kept), lost, lines, repeats


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules(), with_text: bool = True) -> DataFrame:  # noqa: B008
    """Per row: ``id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``words_lost``, ``lines_lost``,
    ``passes`` (enough of the text stays) and, if asked for, ``clean_text``.

    Words are parted by ASCII white space. Whole texts are read, whatever their length; a null text counts as empty,
    and an empty text, having nothing to lose, passes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbols = symbol_bytes()
        for batch in batches:
            for part in slices(batch):
                column = part.column("text")
                s = TextStats(column)
                cleaned = [clean_text(t or "", rules) for t in column.to_pylist()]
                lost = np.array([c[1] for c in cleaned])
                cols = [part.column("id"), s.n_words, s.word_chars, s.bytes_in(symbols), [c[3] for c in cleaned], s.repeated(3), lost, [c[2] for c in cleaned]]
                cols = [cols[0], *(pa.array(c, pa.int64()) for c in cols[1:]), pa.array(lost <= rules.lost * s.n_words)]
                if with_text:
                    cols.append(pa.array([c[0] for c in cleaned], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "words_lost", "lines_lost", "passes"] + ["clean_text"] * with_text
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:8]) + ", passes boolean" + ", clean_text string" * with_text
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, schema)
