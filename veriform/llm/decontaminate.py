"""Passages of a benchmark in training texts, by a positional inverted index. DataFrame operations only.

The corpus is read twice. The first pass counts how often each benchmark word occurs in it. Each window of an item is
then looked up under its rarest word: the second pass stores the postings of these words alone (text, position and
the words around it). Posting lists are intersected at the offsets that the words have in a window, and what is left
is compared word for word. Words too common to be the rarest of any window have no postings, and no text is shuffled.

Benchmarks are read in blocks of bounded size; the words of a block are broadcast, each block costs two passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# All of ASCII that is neither letter nor digit stands between words; every character beyond it is part of one.
BETWEEN = "".join(c for c in map(chr, range(128)) if not c.isalnum())
WINDOW = 10
# Bytes of benchmark text whose words are broadcast at once.
BLOCK_BYTES = 8 << 20


def _words(text: Column) -> Column:
    """Words of a text with A-Z in lower case, other letters as they are; none for null.

    Characters are mapped and split at blanks, which takes a tenth of the time of extracting words by a pattern.
    """
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " "), "")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """``window``, ``item``, ``words``: the different runs of ``size`` words of each item, the whole of a shorter one."""
    b = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"),
                         _words(F.col(f"`{text_col}`").cast("string")).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    w = b.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words")).distinct()
    return w.withColumn("window", F.xxhash64("item", "words"))


def postings(rows: DataFrame, terms: DataFrame, around: int) -> DataFrame:
    """``uid``, ``text`` -> ``uid``, ``pos``, ``term``, ``before`` (how many of the words stand before it), ``near``."""
    split = rows.select("uid", _words(F.col("text")).alias("w"))
    # The outer form, or else texts are split once more to look for empty ones.
    each = split.select("uid", "w", F.posexplode_outer("w").alias("pos", "term"))
    before = F.least(F.col("pos"), F.lit(around))
    near = F.slice("w", F.col("pos") - before + 1, before + around + 1)
    return each.join(F.broadcast(terms), "term").select("uid", "pos", "term", before.alias("before"), near.alias("near"))


def _block_matches(rows: DataFrame, windows: DataFrame, size: int, slop: int) -> DataFrame:
    windows = materialise(windows)
    terms = windows.select("window", F.posexplode("words").alias("off", "term"))
    each = rows.select(F.explode_outer(_words(F.col("text"))).alias("term"))
    df = materialise(each.join(F.broadcast(terms.select("term").distinct()), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    ranked = terms.join(df, "term", "left").groupBy("window").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term", "off")).alias("rarest"))
    ranked = ranked.where("rarest.df > 0")  # a word that no text has: the window occurs nowhere
    probes = materialise(ranked.select("window", F.col("rarest.term").alias("term"), F.col("rarest.off").alias("off")))
    anchors = probes.select("term").distinct()
    index = materialise(postings(rows, anchors, size - 1 + slop))
    # Every word of a window that is listed, at its offset; the rarest one brings the words around it.
    listed = terms.join(probes.select("window"), "window").join(anchors, "term")
    lists = listed.groupBy("window").agg(F.count(F.lit(1)).alias("lists"))
    rare = probes.join(lists, "window").join(windows, "window")
    lead = index.join(rare, "term").select("uid", "window", "item", "words", "lists", (F.col("pos") - F.col("off")).alias("start"), "pos", "off", "before", "near")
    at = F.col("before") - F.col("off")
    exact = (at >= 0) & (F.slice("near", F.greatest(at, F.lit(0)) + 1, F.size("words")) == F.col("words"))
    # One bit per offset, 63 to a column: rows that repeat in full share their uid and bring each posting as often as they come.
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("off") % 63)
    masks = {f"m{k}": F.bit_or(F.when(F.floor(F.col("off") / 63) == k, bit).otherwise(F.lit(0).cast("long"))) for k in range((size - 1) // 63 + 1)}
    met = (
        index.join(listed, "term").select("uid", "window", "off", (F.col("pos") - F.col("off")).alias("start"))
        .groupBy("uid", "window", "start").agg(*(m.alias(n) for n, m in masks.items()))
        .join(lists, "window").where(sum(F.bit_count(n) for n in masks) == F.col("lists")).select("uid", "window", "start")
    )
    phrases = lead.where("start >= 0").join(met, ["uid", "window", "start"], "left_semi").where(exact)
    out = phrases.select("uid", "item", F.lit("phrase").alias("kind"), "start", F.size("words").alias("n"))
    if slop:
        span = F.size("words") + slop
        first = F.greatest(F.col("before") - span + 1, F.lit(0))
        inside = F.exists(F.sequence(first, F.col("before")), lambda s: F.size(F.array_except("words", F.slice("near", s + 1, span))) == 0)
        near = lead.where(inside & ~exact).select("uid", "item", F.lit("near").alias("kind"), (F.col("pos") - F.col("before") + first).cast("int").alias("start"), span.alias("n"))
        out = out.unionByName(near)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
            item_text_col: str = "text", size: int = WINDOW, slop: int = 0) -> DataFrame:
    """Where windows of benchmark items occur: ``uid`` (hash of a document's id and text), ``item``, ``kind``,
    ``start`` (word of the document, from 0) and ``n`` words.

    ``phrase``: all words of the window in their order. With ``slop``, ``near``: all different words of the window
    within ``slop`` words more than it has, in any order, around its rarest word; ``start`` and ``n`` then bound the
    place where they are searched. Null texts have no words; a null item id counts as the empty text.
    """
    rows = docs.select(F.xxhash64(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("uid"),
                       F.col(f"`{text_col}`").cast("string").alias("text"))
    windows = materialise(benchmark_windows(benchmark, item_col, item_text_col, size))
    weight = windows.agg(F.sum(F.length(F.array_join("words", " ")))).first()[0] or 0
    blocks = int(weight // (BLOCK_BYTES * size)) + 1
    out = None
    for block in range(blocks):
        some = windows if blocks == 1 else windows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        found = _block_matches(rows, some, size, slop)
        out = found if out is None else out.unionByName(found)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", size: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per row of ``docs``: ``id``, ``uid``, ``n_words``, ``n_hit`` (words inside a match), ``items`` (ids of the items, sorted as texts).

    Rows that repeat in full have the same result each. Empty tables on either side give no matches.
    """
    found = matches(docs, benchmark, id_col, text_col, item_col, item_text_col, size, slop)
    per = found.groupBy("uid").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end")))).alias("spans"),
                                   F.array_sort(F.collect_set("item")).alias("items"))
    none = F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).alias("to"))
    total = F.aggregate("spans", none, lambda a, s: F.struct((a["hit"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("hit"),
                                                            F.greatest(a["to"], s["end"]).alias("to")))
    per = per.select("uid", total["hit"].alias("n_hit"), "items")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("uid"), F.size(_words(text)).cast("long").alias("n_words"))
    return rows.join(per, "uid", "left").select("id", "uid", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                                               F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that hold a window of a benchmark item; all columns, no text is changed."""
    hit = materialise(matches(docs, benchmark, id_col, text_col, **how).select("uid").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.withColumn("uid", F.xxhash64(F.col(f"row.`{id_col}`"), F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))))
    return rows.join(hit, "uid", "left_anti").select("row.*")
