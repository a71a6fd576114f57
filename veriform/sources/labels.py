"""Values beside their labels, whatever elements hold them.

A small automaton reads the tags of a page and gives each piece of visible text its element path. The value of a
label is the later text nearest to it by path: the fewest steps up from the label, then the fewest siblings between, then the
column most like the label's own, then the order of the page. So a cell beside a heading cell, the cell below a column's heading, the
description of a term, and spans nested to any depth are found alike.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriform.operators.mapping import named

# Fixed values of the markup language: elements without content, elements whose content is not text, elements inside a line
# of text, and elements that a new one of the same kind ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title noscript".split())
INLINE = frozenset("a abbr b big cite code em font i mark q s small strong sub sup tt u".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "option": {"option"}}
# Elements that hold other ones of the kinds above, so that none outside is ended.
HOLDS = frozenset("table ul ol dl div section article body".split())
# Elements that name things and hold no values.
NAMING = frozenset(("th", "dt", "label", "caption", "legend"))

_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_BLANKS = re.compile(r"\s+")

Path = tuple[tuple[str, int], ...]


def texts(page: str) -> Iterator[tuple[Path, str]]:
    """Path and text of each run of visible text, in order; a path is (element, place among its siblings) from the outside in.

    Elements inside a line are no step of a path, so ``<b>Price</b>: 3`` is one run. Each character is looked at once.
    """
    path: list[tuple[str, int]] = []
    counts = [0]  # children seen, for the page and each open element
    held: list[str] = []
    at, low = 0, None

    def flush() -> Iterator[tuple[Path, str]]:
        text = _BLANKS.sub(" ", html.unescape("".join(held))).strip()
        held.clear()
        if text:
            yield tuple(path), text

    while at < len(page):
        tag = page.find("<", at)
        if tag < 0:
            held.append(page[at:])
            break
        held.append(page[at:tag])
        if page.startswith("<!--", tag):
            end = page.find("-->", tag + 4)
            at = len(page) if end < 0 else end + 3
            continue
        end = page.find(">", tag)
        name = _NAME.match(page, tag + 1)
        if end < 0 or not (name or page[tag + 1 : tag + 2] in ("!", "?")):
            held.append("<")
            at = tag + 1
            if end < 0:  # no tag ends any more
                held.append(page[at:])
                break
            continue
        at = end + 1
        if not name:
            continue
        element, closing = name[1].lower(), page[tag + 1] == "/"
        if element in INLINE or element == "wbr":
            continue
        yield from flush()
        if closing:
            depth = next((i for i in range(len(path) - 1, -1, -1) if path[i][0] == element), None)
            if depth is not None:
                del path[depth:], counts[depth + 1 :]
            continue
        if element in RAW:
            low = page.lower() if low is None else low
            stop = low.find(f"</{element}", at)
            at = len(page) if stop < 0 else stop
            counts[-1] += 1
            continue
        for i in range(len(path) - 1, -1, -1):
            if path[i][0] in ENDS.get(element, ()):
                # Only the innermost of cells and rows is ended, with all in it.
                del path[i:], counts[i + 1 :]
                if element != "tr" or not any(p[0] == "tr" for p in path):
                    break
            elif path[i][0] in HOLDS:
                break
        counts[-1] += 1
        if element not in VOID and not page.startswith("/", end - 1):
            path.append((element, counts[-1]))
            counts.append(0)
    yield from flush()


def _cell(path: Path) -> int | None:
    return next((place for name, place in reversed(path) if name in ("td", "th")), None)


def distance(label: Path, other: Path) -> tuple[int, int, int]:
    """Steps up from a label until a later text is below, siblings between the two there, and how far apart their columns are."""
    same = 0
    while same < min(len(label), len(other)) and label[same] == other[same]:
        same += 1
    up = len(label) - same
    gap = other[same][1] - label[same][1] if up and same < len(other) else 0
    a, b = _cell(label), _cell(other)
    return up, gap, abs(a - b) if a is not None and b is not None else 0


def _is_naming(path: Path) -> bool:
    return any(name in NAMING for name, _ in path[-2:])


def _word(text: str) -> str:
    return text.rstrip(" :").casefold()


def values_of(page: str, labels: Sequence[str]) -> list[str | None]:
    """The value of each label, null where there is none.

    A run that begins with the label and a colon holds its value, else the nearest later run does that names nothing and
    is no label itself; a run before a label never is its value.
    """
    runs = list(texts(page))
    words = [_word(text) for _, text in runs]
    asked = {_word(x) for x in labels}
    out = []
    for label in labels:
        word, value = _word(label), None
        for i, (path, text) in enumerate(runs):
            if words[i].startswith(word) and text[len(label) :].lstrip().startswith(":") and text[: len(label)].casefold() == word:
                value = text[len(label) :].lstrip()[1:].strip() or None
                if value:
                    break
            if words[i] == word:
                best = None
                for j in range(i + 1, len(runs)):
                    other = runs[j][0]
                    if words[j] in asked or _is_naming(other) or words[j] == "":
                        continue
                    far = (*distance(path, other), j)
                    if best is None or far < best:
                        best = far
                if best:
                    value = runs[best[-1]][1].lstrip(": ")
                    break
        out.append(value)
    return out


def labelled_values(df: DataFrame, page: str, labels: Mapping[str, str], keep: Sequence[str] = ()) -> DataFrame:
    """``(keep..., fields...)``: for each name in ``labels`` the value beside its label, as text; null pages have none."""
    kept = df.select(*[named(c).alias(f"c{i}") for i, c in enumerate(keep)], named(page).alias("page"))
    asked = list(labels.values())
    schema = T.StructType([*kept.schema.fields[:-1], T.StructField("found", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if p is None else values_of(p, asked) for p in batch.column("page").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(keep))], pa.array(found, pa.list_(pa.string()))], names=schema.names)

    read = kept.mapInArrow(run, schema)
    return read.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], *[F.get("found", F.lit(i)).alias(name) for i, name in enumerate(labels)])
