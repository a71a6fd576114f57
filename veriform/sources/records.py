"""Files and text columns of records: delimited, JSON, XML, fixed width."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriform.sources.quoted import read_quoted


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | T.StructType | None = None,
                   *, multi_line: bool | None = None) -> DataFrame:
    """Quoted text with doubled quotes. Columns are strings unless a schema is given.

    Large files are split, and records with line breaks inside quotes are put together (:mod:`veriform.sources.quoted`). Where
    it is known whether records have line breaks, say so: without them the quotes need not be counted first, and with
    ``multi_line`` each file is read by one task, which also reads stray quotes inside bare fields.
    """
    if multi_line is None:
        return read_quoted(spark, path, sep, header, schema)
    reader = spark.read.option("sep", sep).option("header", str(header).lower()).option("escape", '"')
    reader = reader.option("multiLine", str(multi_line).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.csv(path)


def read_json(spark: SparkSession, path: str, schema: str | T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    reader = spark.read.option("multiLine", str(multi_line).lower())
    if schema is not None:
        reader = reader.schema(schema)
    return reader.json(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType | None = None) -> DataFrame:
    """Repeating elements as rows; attributes get ``_`` in front, mixed text is ``_VALUE``."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path)


def from_delimited(c: Column, schema: str, sep: str = ",") -> Column:
    """One delimited record in a column as a struct."""
    return F.from_csv(c, schema, {"sep": sep, "escape": '"', "mode": "PERMISSIVE"})


def from_xml_record(c: Column, schema: str) -> Column:
    return F.from_xml(c, schema, {"mode": "PERMISSIVE"})


def read_fixed_width(df: DataFrame, line: str, spec: Sequence[tuple[str, int, int, str]]) -> DataFrame:
    """Fields cut by ``(name, start, length, type)``, start counted from 1; trimmed, null where the type does not fit."""
    return df.select(*[F.trim(F.substring(F.col(line), start, length)).try_cast(kind).alias(name) for name, start, length, kind in spec])


NUMBERED = r"(?i)&#(?:x[0-9a-f]{1,6}|[0-9]{1,7});"
NAMED = r"&[A-Za-z][A-Za-z0-9]*;"
# Names and what they stand for, as one text that Spark makes a map of once.
_NAMES = "\x02".join(f"&{name}\x01{text}" for name, text in sorted(html5.items()) if name.endswith(";") and name != "amp;")


def unescape(c: Column) -> Column:
    """Character references as characters: numbered ones, and all names of the markup language that end with a semicolon."""
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"{NUMBERED}|{NAMED}"), F.lit(0)))
    names = F.str_to_map(F.lit(_NAMES), F.lit("\x02"), F.lit("\x01"))

    def char(ref: Column) -> Column:
        code = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(F.substring(ref, F.lit(4), F.length(ref) - 4), 16, 10)).otherwise(F.substring(ref, F.lit(3), F.length(ref) - 3))
        number = code.try_cast("int")
        valid = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
        # UTF-32 knows every code point; a number that is none stays as it is. An ampersand waits for the others.
        four = F.unhex(F.lpad(F.hex(number), 8, "0"))
        return F.when(number == 38, F.lit("&amp;")).when(valid, F.decode(four, "UTF-32")).otherwise(ref)

    def text(ref: Column) -> Column:
        return F.when(ref.startswith("&#"), char(ref)).otherwise(F.coalesce(F.try_element_at(names, ref), ref))

    out = F.aggregate(found, c, lambda done, ref: F.replace(done, ref, text(ref)))
    return F.when(F.contains(c, F.lit("&")), F.replace(out, F.lit("&amp;"), F.lit("&"))).otherwise(c)


def visible(c: Column) -> Column:
    """Markup without scripts, styles and comments."""
    for pattern in (r"(?is)<script\b.*?</script>", r"(?is)<style\b.*?</style>", r"(?s)<!--.*?-->"):
        c = F.regexp_replace(c, pattern, "")
    return c


def inner_text(c: Column) -> Column:
    """Markup as text: tags out, entities resolved, whitespace runs to one blank."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(c, r"<[^>]*>", "")), r"\s+", " "))


def _nullable(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _with_class(css_class: str | None) -> str:
    """Attributes of an element, with a class among them if one is asked for; quoted either way, or bare."""
    if not css_class:
        return r"(?:\s[^>]*)?"
    word = rf"(?<![\w-]){re.escape(css_class)}(?![\w-])"
    return rf"""\s[^>]*?\bclass\s*=\s*(?:"[^"]*?{word}[^"]*"|'[^']*?{word}[^']*'|{word})[^>]*"""


def _value(name: str) -> str:
    return rf"""\b{re.escape(name)}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _bare(found: Column) -> Column:
    quoted = found.startswith('"') | found.startswith("'")
    return F.when(quoted, F.substring(found, F.lit(2), F.length(found) - 2)).otherwise(found)


def tag_text(tag: str, css_class: str | None = None):
    """Text of the first element of a tag, or of a tag with a class."""
    pattern = rf"(?is)<{re.escape(tag)}{_with_class(css_class)}>(.*?)</{re.escape(tag)}>"
    return lambda page: _nullable(inner_text(F.regexp_extract(page, pattern, 1)))


def tag_list(tag: str, css_class: str | None = None):
    """Texts of all elements of a tag, or of a tag with a class."""
    pattern = rf"(?is)<{re.escape(tag)}{_with_class(css_class)}>(.*?)</{re.escape(tag)}>"
    return lambda page: F.transform(F.regexp_extract_all(page, F.lit(pattern), 1), inner_text)


def attribute(tag: str, name: str):
    """Attribute of the first element of a tag that has it; the value may be quoted either way, or bare."""
    return lambda page: _nullable(unescape(_bare(F.regexp_extract(page, rf"(?is)<{re.escape(tag)}\b[^>]*?\s{_value(name)}", 1))))


def attribute_list(tag: str, name: str):
    return lambda page: F.transform(F.regexp_extract_all(page, F.lit(rf"(?is)<{re.escape(tag)}\b[^>]*?\s{_value(name)}"), 1), lambda v: unescape(_bare(v)))


def labelled(label: str):
    """Text right after ``label`` and a colon, or in the cell after a heading cell, up to the next end tag."""
    pattern = rf"(?is)>\s*{re.escape(label)}\s*:?\s*(?:</[^>]+>\s*(?:<[^>/]+>\s*)?)?([^<>]+)<"
    return lambda page: _nullable(inner_text(F.regexp_extract(page, pattern, 1)))


def section_list(heading: str, item: str = "li"):
    """Items of the first list after a heading."""
    def items(page: Column) -> Column:
        block = F.regexp_extract(page, rf"(?is)<h\d[^>]*>\s*{re.escape(heading)}\s*</h\d>\s*<[uo]l[^>]*>(.*?)</[uo]l>", 1)
        return tag_list(item)(block)
    return items


def extract_html(df: DataFrame, page: str, fields: Mapping[str, object], keep: Sequence[str] = ()) -> DataFrame:
    """Fields of HTML pages; ``fields`` maps a name to one of the extractors above."""
    cleaned = df.withColumn("_page", visible(F.col(page)))
    return cleaned.select(*keep, *[take(F.col("_page")).alias(name) for name, take in fields.items()])
