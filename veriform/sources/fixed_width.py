"""Where the fields of fixed-width lines begin and end, found from the lines.

Every line is a few strings of bits, one bit for each column: is it filled, does a word begin there, does one end, what kind
of character is it. They are cut into numbers and combined by bitwise aggregates in the tasks and then over all lines,
so what reaches the driver is a few numbers for every sixty columns, however many lines there are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriform.operators.mapping import named

CHUNK = 60
# Kinds of characters that tell neighbouring fields apart.
KINDS = {"digit": "[0-9]", "letter": r"\p{L}", "other": r"[^0-9\p{L} ]"}


def _bits(line: Column) -> dict[str, Column]:
    """Strings of 0 and 1, as long as the line."""
    filled = F.regexp_replace(F.regexp_replace(line, "[^ ]", "1"), " ", "0")
    begins = F.translate(F.replace(F.concat(F.lit("0"), filled), F.lit("01"), F.lit("0S")), "1S", "01")
    ends = F.translate(F.replace(F.concat(filled, F.lit("0")), F.lit("10"), F.lit("E0")), "1E", "01")
    out = {"filled": filled, "begins": F.substring(begins, F.lit(2), F.length(line)), "ends": F.substring(ends, F.lit(1), F.length(line))}
    for kind, pattern in KINDS.items():
        mark = F.regexp_replace(line, pattern, "\u0001")
        out[kind] = F.regexp_replace(F.translate(F.regexp_replace(mark, "[^\u0001]", "0"), "\u0001", "1"), "[^01]", "0")
    return out


def column_facts(df: DataFrame, line: str) -> dict[str, str]:
    """Strings of 0 and 1 over all columns: ``ever`` and ``always`` filled, a word ``begins`` or ``ends`` there in some line, ``digit``, ``letter``, ``other``.

    Empty and null lines say nothing; blanks at the end of a line may be missing.
    """
    text = df.select(F.rtrim(named(line)).alias("line")).where("line <> ''")
    sizes = F.floor((F.length("line") + (CHUNK - 1)) / CHUNK)
    rows = text.select(*[c.alias(k) for k, c in _bits(F.col("line")).items()], F.explode(F.sequence(F.lit(0), (sizes - 1).cast("int"))).alias("chunk"))

    def number(c: str) -> Column:
        part = F.substring(F.col(c), F.col("chunk") * CHUNK + 1, F.lit(CHUNK))
        return F.conv(F.rpad(part, CHUNK, "0"), 2, 10).cast("long")

    kinds = ["begins", "ends", *KINDS]
    found = rows.select("chunk", number("filled").alias("filled"), *[number(k).alias(k) for k in kinds]).groupBy("chunk").agg(
        F.count(F.lit(1)).alias("n"), F.bit_or("filled").alias("ever"), F.bit_and("filled").alias("always"), *[F.bit_or(k).alias(k) for k in kinds])
    chunks = {r["chunk"]: r for r in found.collect()}
    lines = max((r["n"] for r in chunks.values()), default=0)
    out = {k: "" for k in ("ever", "always", *kinds)}
    for i in range(len(chunks)):
        for k in out:
            # A chunk that some lines do not reach is blank there.
            value = 0 if k == "always" and chunks[i]["n"] < lines else chunks[i][k]
            out[k] += format(value, f"0{CHUNK}b")
    width = len(out["ever"].rstrip("0"))
    return {k: v[:width] for k, v in out.items()}


def _parts(facts: dict[str, str], a: int, b: int) -> list[tuple[int, int]]:
    """A run of filled columns, parted where fields touch.

    They touch behind a number that is set to the right (words begin at several columns, digits end in one that is always
    filled, and no digit follows), and before a column that is always filled where words begin behind ends that vary.
    """
    def kinds(p: int) -> set[str]:
        return {k for k in KINDS if facts[k][p] == "1"}

    out, start = [], a
    for p in range(a, b - 1):
        here = facts["begins"][start : p + 1].count("1")
        solid = facts["always"][p] == "1" and facts["always"][p + 1] == "1"
        number = solid and here > 1 and all(kinds(q) <= {"digit", "other"} for q in range(start, p + 1)) and kinds(p) == {"digit"} and "digit" not in kinds(p + 1)
        text = facts["always"][p] == "0" and facts["always"][p + 1] == "1" and facts["begins"][p + 1] == "1" and facts["begins"][start] == "1" and here == 1 and "1" in facts["ends"][start:p]
        if number or text:
            out.append((start, p + 1))
            start = p + 1
    return [*out, (start, b)]


def infer_fields(df: DataFrame, line: str, names: Sequence[str] | None = None, kind: str = "string") -> list[tuple[str, int, int, str]]:
    """``(name, start, length, type)`` of each field, as :func:`veriform.sources.records.read_fixed_width` takes them.

    Columns that are blank in all lines part fields, and go to the field behind them where its words begin at several
    columns and end at one, as numbers set to the right do, else to the field before them. Names are ``c1``, ``c2`` ... unless given.
    """
    facts = column_facts(df, line)
    width, runs, p = len(facts["ever"]), [], 0
    while p < width:
        if facts["ever"][p] == "0":
            p += 1
            continue
        end = facts["ever"].find("0", p)
        end = width if end < 0 else end
        runs += _parts(facts, p, end)
        p = end
    fields: list[list[int]] = []
    for a, b in runs:
        right = facts["begins"][a:b].count("1") > 1 and facts["ends"][a:b].count("1") <= 1
        before = fields[-1][1] if fields else 0
        if fields and not right:
            fields[-1][1] = a
            before = a
        fields.append([before, b])
    if names is not None and len(names) != len(fields):
        raise ValueError(f"{len(fields)} fields, {len(names)} names")
    return [(names[i] if names else f"c{i + 1}", a + 1, b - a, kind) for i, (a, b) in enumerate(fields)]
