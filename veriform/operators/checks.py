"""Checks of inputs and outputs. Each is a struct column ``(ok, reason)``; reason is null when ok."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriform.functions.text import is_json, strip
from veriform.operators.mapping import missing_targets, named
from veriform.operators.profile import long_form

# Patterns of hostile content by family; negative numbers are not formulas.
INJECTION_PATTERNS = {
    "sql": r"(?i)\bunion\s+(all\s+)?select\b|;\s*(drop|delete|truncate|alter)\s+(table|from|database)\b|'\s*or\s+'?1'?\s*=\s*'?1",
    "script": r"(?i)<script\b|\bjavascript:|<[^>]*\son(error|load|click)\s*=",
    "formula": r"""(?md)(?:@(?<=(?:^|[,;|\t])["']?@)[A-Za-z]|[=+-](?<=(?:^|[,;|\t])["']?[=+-])[A-Za-z(])""",
    "prompt": r"(?i)\b(ignore|disregard|forget)\s+(all\s+|the\s+|any\s+)?(previous|prior|above)\s+(instructions|rules|prompts)\b",
}

# A family's pattern can match only where all words of one of these groups occur.
INJECTION_WORDS = {
    "sql": (("union", "select"), (";", "drop"), (";", "delete"), (";", "truncate"), (";", "alter"), ("'", "=", "or")),
    "script": (("<script",), ("javascript:",), ("<", "onerror"), ("<", "onload"), ("<", "onclick")),
    "formula": (("=",), ("@",), ("+",), ("-",)),
    "prompt": (("instructions",), ("rules",), ("prompts",)),
}

CONTROL_CHARACTERS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFD}]"


def check(ok: Column, reason: Column | str) -> Column:
    text = F.lit(reason) if isinstance(reason, str) else reason
    fine = F.coalesce(ok, F.lit(False))
    return F.struct(fine.alias("ok"), F.when(~fine, text).alias("reason"))


def required_all(matches: Column, required: Sequence[str]) -> Column:
    missing = missing_targets(matches, required)
    return check(F.size(missing) == 0, F.concat(F.lit("Missing fields: "), F.array_join(missing, ", ")))


def required_most(matches: Column, required: Sequence[str]) -> Column:
    """More than half of the fields are there."""
    found = len(required) - F.size(missing_targets(matches, required))
    return check(
        found * 2 > len(required), F.concat(F.lit("Only "), found.cast("string"), F.lit(f" of {len(required)} fields present"))
    )


def mandatory(fields: Mapping[str, Column]) -> Column:
    """Every field has a value."""
    absent = F.array_compact(F.array(*[F.when(c.isNull() | (strip(c) == ""), F.lit(n)) for n, c in fields.items()]))
    return check(F.size(absent) == 0, F.concat(F.lit("Missing: "), F.array_join(absent, ", ")))


def any_of(fields: Mapping[str, Column]) -> Column:
    """At least one field has a value (some contact, some image)."""
    found = F.lit(False)
    for c in fields.values():
        found = found | F.coalesce(strip(c) != "", F.lit(False))
    return check(found, "None present: " + ", ".join(fields))


def json_parses(c: Column) -> Column:
    return check(is_json(c), "Not valid JSON")


def xml_parses(c: Column) -> Column:
    options = {"columnNameOfCorruptRecord": "bad", "mode": "PERMISSIVE"}
    return check(F.from_xml(c, "any string, bad string", options)["bad"].isNull(), "Not well-formed XML")


# Elements without an end tag, and those whose end tag may be left out.
VOID_TAGS = "area|base|br|col|embed|hr|img|input|link|meta|param|source|track|wbr"
OPEN_TAGS = "li|dt|dd|p|rt|rp|optgroup|option|colgroup|caption|thead|tbody|tfoot|tr|td|th"


def tags_balance(c: Column) -> Column:
    """Every element is closed, after it was opened and before what surrounds it.

    Comments, scripts and styles are not looked into. Elements without an end tag, those that may leave it out, and
    those closed in themselves do not count.
    """
    bare = F.regexp_replace(c, r"(?is)<!--.*?-->|(?<=<script)\b[^>]*>.*?(?=</script)|(?<=<style)\b[^>]*>.*?(?=</style)", ">")
    skipped = rf"(?i)(?:{VOID_TAGS}|{OPEN_TAGS})\b"
    tags = F.regexp_extract_all(bare, F.lit(rf"(?is)<(/?(?!{skipped})[a-z][a-z0-9:-]*)(?:\s[^<>]*)?(?<!/)>"), 1)
    # A text of the elements that are open, the innermost last; once wrong, it stays so.
    step = lambda open_, tag: (
        F.when(open_ == "!", open_).when(~tag.startswith("/"), F.concat(open_, F.lit("<"), tag))
        .when(open_.endswith(F.concat(F.lit("<"), F.substring(tag, F.lit(2), F.length(tag)))), F.substring(open_, F.lit(1), F.length(open_) - F.length(tag)))
        .otherwise(F.lit("!"))
    )
    return check(F.aggregate(F.transform(tags, F.lower), F.lit(""), step) == "", "Unbalanced tags")


def lines_align(c: Column, sep: str) -> Column:
    """At least a header and a row, all with the same number of fields (quoted separators aside)."""
    bare = F.regexp_replace(strip(c), '"[^"]*"', "")
    counts = F.transform(F.split(bare, "\n", -1), lambda x: F.length(x) - F.length(F.replace(x, F.lit(sep), F.lit(""))))
    return check((F.size(counts) >= 2) & (F.array_min(counts) >= 1) & (F.array_min(counts) == F.array_max(counts)), "Rows do not line up")


def not_empty(c: Column) -> Column:
    return check(strip(c) != "", "Empty data")


def injection_families(c: Column) -> Column:
    """Array of the families of hostile patterns found.

    Whole texts are tested, but a pattern runs only where its words occur: a search for a fixed word
    is many times faster than a pattern.
    """
    lower = F.lower(c)

    def found(family: str) -> Column:
        near = F.lit(False)
        for words in INJECTION_WORDS[family]:
            every = F.lit(True)
            for word in words:
                every = every & F.contains(lower, F.lit(word))
            near = near | every
        return near & c.rlike(INJECTION_PATTERNS[family])

    return F.array_compact(F.array(*[F.when(found(f), F.lit(f)) for f in INJECTION_PATTERNS]))


def no_injection(c: Column) -> Column:
    found = injection_families(c)
    return check(F.size(found) == 0, F.concat(F.lit("Suspicious content: "), F.array_join(found, ", ")))


def no_corruption(c: Column) -> Column:
    return check(F.is_valid_utf8(c) & ~c.rlike(CONTROL_CHARACTERS), "Invalid or control characters")


def identifiers_valid(headers: Column) -> Column:
    bad = F.filter(headers, lambda h: ~h.rlike(r"^[A-Za-z_]\w*$"))
    return check(F.size(bad) == 0, F.concat(F.lit("Invalid names: "), F.array_join(bad, ", ")))


def fits(text: Column, kind: str) -> Column:
    """True when a stripped text can be cast to the type.

    A failing cast costs an exception, so texts that cannot be a number or a moment by their first
    character are told apart before.
    """
    cast = text.try_cast(kind).isNotNull()
    if kind.startswith(("int", "bigint", "smallint", "tinyint", "decimal", "date", "timestamp")):
        return text.rlike(r"^[+\-.\d]") & cast
    if kind in ("double", "float"):
        return text.rlike(r"(?i)^([+\-.\d]|nan|inf)") & cast
    return cast


def type_fit(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Share of present values of each text column that fit its target type: ``(name, target, present, fitting, ok)``; one scan."""
    aggs, records = [], []
    for i, (c, kind) in enumerate(targets.items()):
        text = strip(named(c))
        present = text != ""
        aggs += [F.count_if(present).alias(f"p{i}"), F.count_if(present & fits(text, kind)).alias(f"f{i}")]
        records.append([
            ("name", F.lit(c)), ("target", F.lit(kind)), ("present", F.col(f"p{i}")), ("fitting", F.col(f"f{i}")),
            ("ok", F.col(f"p{i}") == F.col(f"f{i}")),
        ])
    return long_form(df.agg(*aggs), records)
