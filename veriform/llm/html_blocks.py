"""Main text of web pages by two passes of block rules.

The first pass judges each block by the elements around it, its length, and the share of links and of stop words in
it. Short or middling blocks stay undecided; in the second pass they take the label of the nearest decided blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements whose content is never shown as text.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas audio video select datalist".split())
# Elements that hold no part of the article.
ASIDE = frozenset("nav header footer aside form dialog menu button fieldset".split())
ARTICLE = frozenset(("article", "main"))
# Words of class, id and role that mark elements outside the article. Fixed values.
HINTS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs byline comment comments complementary consent contentinfo cookie cookies copyright disqus "
    "footer form header login masthead menu menubar modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted recommended "
    "related respond search share sharing sidebar signup skip social sponsor sponsored subscribe toc toolbar topbar widget widgets".split())
# Parts of names that tell how an element is laid out, not what it holds: with-sidebar, share-enabled. Fixed values.
STATES = frozenset("with without has have no not is are show hide shown enabled disabled enable disable on off open opened closed active inactive visible above below before after".split())
# These stay outside however much of the page they hold.
REMARKS = frozenset("comment comments disqus respond".split())
# Elements inside a line of text; all others part blocks.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that open and close in pairs and are followed by their end; others may be left open.
PAIRED = frozenset("div section article main nav header footer aside form ul ol dl table tbody thead tr td th body html figure figcaption blockquote dialog menu button fieldset details".split())
# Frequent function words of English, French, German and Spanish. Fixed values.
STOP_WORDS = frozenset(
    "a about all an and are as at be been but by can for from had has have he her his i if in into is it its more my no not of on one or our out she so some than that the "
    "their them then there these they this to up was we were what when which who will with would you your "
    "au aux avec ce ces cette d dans de des du elle en est et il ils je l la le les leur mais ne nous on ou par pas plus pour qu que qui sa se ses son sont sur un une vous y "
    "aber als am auch auf aus bei bin bis das dass dem den der die durch ein eine einem einen einer es für hat ich ihr im ist mit nach nicht noch nur oder sein sich sie sind so "
    "über um und uns von vor war wenn werden wie wir wird zu zum zur "
    "al como con cuando del el ella ellos era es esta este está fue ha hay lo los las más me mi muy nos o para pero por porque quien sin sobre son su sus también te tiene todo una uno y ya".split())
SHORT, LONG = 70, 200
LINKS, STOPS_LOW, STOPS_HIGH = 0.3, 0.2, 0.3

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_WORD = re.compile(r"[^\W\d_]+")


def _hint(name: str) -> str | None:
    """The word of HINTS that a class, id or role is, begins or ends with."""
    parts = [p for p in re.split(r"[^a-z0-9]+", name) if p]
    if not parts or not STATES.isdisjoint(parts):
        return None
    return next((p for p in (parts[-1], parts[0]) if p in HINTS), None)


def _mark(attributes: str) -> str | None:
    """``hidden``, ``remark`` or ``named`` after something beside the article."""
    found = None
    for a in _ATTRIBUTE.finditer(attributes):
        name, value = a[1].lower(), next((v for v in a.groups()[1:] if v is not None), "").lower()
        if (name == "hidden" and value != "false") or (name == "aria-hidden" and value.strip() == "true") or (name == "style" and _HIDING.search(value)):
            return "hidden"
        if name in ("class", "id", "role"):
            hints = {h for h in map(_hint, value.split()) if h}
            if hints:
                found = "remark" if found == "remark" or not REMARKS.isdisjoint(hints) else "named"
    return found


class Block:
    __slots__ = ("text", "linked", "inside", "outside", "heading", "marks")

    def __init__(self, text: str, linked: int, inside: bool, outside: bool, heading: bool, marks: tuple[int, ...] = ()):
        self.text, self.linked, self.inside, self.outside, self.heading, self.marks = text, linked, inside, outside, heading, marks


def blocks(page: str) -> list[Block]:
    """Runs of text between elements that part blocks, in page order.

    An element that is only named after something beside the article and holds most of the page's unlinked text is
    a wrapper of the article, and its name does not count.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # element; before it: inside the article, outside of it, named elements around
    marks: tuple[int, ...] = ()
    named = 0
    words: list[str] = []
    linked = anchors = 0
    heading = False
    inside = outside = False
    at, n = 0, len(page)

    def end() -> None:
        nonlocal words, linked
        text = " ".join("".join(words).split())
        if text:
            out.append(Block(text, min(linked, len(text)), inside, outside, heading, marks))
        words, linked = [], 0

    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m[2]
        if name is None:
            token = m[0]
            if token.startswith("<![CDATA["):
                token = token[9:].removesuffix("]]>")
            elif token.startswith("<") and len(token) > 1:
                continue
            text = html.unescape(token)
            words.append(text)
            if anchors:
                linked += len(" ".join(text.split()))
            continue
        name = name.lower()
        closing, attributes = bool(m[1]), m[3] or ""
        if name == "a":
            anchors = max(0, anchors - 1) if closing else 1
        if name in INLINE:
            if name in ("img", "wbr"):
                continue
            continue
        if name == "br":
            words.append(" ")
            continue
        end()
        if name[0] == "h" and name[1:] in "123456" and len(name) == 2:
            heading = not closing
        if name in ("head",):
            continue
        if name in RAW:
            if not closing and not attributes.rstrip().endswith("/"):
                stop = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = stop.end() if stop else n
            continue
        if name in VOID or name not in PAIRED:
            continue
        anchors = 0
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    _, inside, outside, marks = stack[i]
                    del stack[i:]
                    break
        else:
            stack.append((name, inside, outside, marks))
            mark = _mark(attributes) if attributes and name not in ("html", "body") and name not in ARTICLE else None
            if name in ASIDE or mark in ("hidden", "remark"):
                outside = True
            elif mark:
                named += 1
                marks += (named,)
            # A wrapper may be named after something beside the article that it holds.
            if name in ARTICLE and not any(s[0] in ASIDE for s in stack) and not (inside and (outside or marks)):
                inside, outside, marks = True, False, ()
    end()
    held: dict[int, int] = {}
    free = [0 if b.outside else len(b.text) - b.linked for b in out]
    for b, n in zip(out, free, strict=True):
        for m in b.marks:
            held[m] = held.get(m, 0) + n
    most = max(LONG, sum(free) / 2)
    for b in out:
        b.outside = b.outside or any(held[m] <= most for m in b.marks)
    return out


def stop_share(text: str) -> float:
    """Share of stop words in the words of a text."""
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / max(1, len(words))


def first_pass(b: Block, has_article: bool, known: bool = True) -> bool | None:
    """True: main text, False: not, None: undecided. ``known``: the page is in a language whose stop words are listed;
    if not, a long block without links is main text."""
    if b.outside:
        return False
    n = len(b.text)
    links = b.linked / n
    if has_article:
        return b.inside and not (links > 0.9 and n < SHORT)
    if links > LINKS:
        return False
    if b.heading:
        return None
    if n < SHORT:
        return None if not links else False
    stops = stop_share(b.text)
    if stops >= STOPS_HIGH:
        return True if n > LONG or stops >= STOPS_HIGH else None
    if stops >= STOPS_LOW:
        return True if n > LONG else None
    if n <= LONG:
        return None
    return False if known else None if b.linked else True


def main_text(page: str) -> str:
    """The page's main text, its blocks joined by a blank."""
    found = blocks(page)
    has_article = any(b.inside and not b.outside for b in found)
    known = has_article or any(not b.outside and len(b.text) >= SHORT and stop_share(b.text) >= STOPS_LOW for b in found)
    labels = [first_pass(b, has_article, known) for b in found]
    before: list[bool | None] = []
    last: bool | None = None
    for label in labels:
        before.append(last)
        last = label if label is not None else last
    after: list[bool | None] = [None] * len(labels)
    last = None
    for i in range(len(labels) - 1, -1, -1):
        after[i] = last
        last = labels[i] if labels[i] is not None else last
    kept = []
    for b, label, prev, next_ in zip(found, labels, before, after, strict=True):
        if label is None:
            # A heading belongs to what follows it; other blocks need good neighbours on each side that has any.
            sides = [next_] if b.heading and next_ is not None else [x for x in (prev, next_) if x is not None]
            label = all(sides) if sides else len(b.text) >= SHORT
        if label:
            kept.append(b.text)
    return " ".join(kept)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: ``id``, ``url``, ``text``. Null pages count as empty; a page without main text has the empty text."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p.as_py() or "") for p in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    return rows.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string")
