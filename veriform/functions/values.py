"""Value functions: markers, dates, numbers, booleans, phones, escaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriform.functions.text import strip

# Texts that stand for a missing value.
NULL_MARKERS = ("", "NULL", "N/A")

# Accepted date layouts, the shape of each, and where year, month and day start in it.
DATE_LAYOUTS = (
    ("YYYY-MM-DD", r"^\d{4}-\d{2}-\d{2}$", (1, 6, 9)),
    ("YYYY-MM-DD HH:MM:SS", r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}$", (1, 6, 9)),
    ("MM/DD/YYYY", r"^\d{2}/\d{2}/\d{4}$", (7, 1, 4)),
    ("YYYY/MM/DD", r"^\d{4}/\d{2}/\d{2}$", (1, 6, 9)),
    ("DD.MM.YYYY", r"^\d{2}\.\d{2}\.\d{4}$", (7, 4, 1)),
    ("YYYYMMDD", r"^\d{8}$", (1, 5, 7)),
    ("Month D, YYYY", r"^[A-Z][a-z]+ \d{1,2}, \d{4}$", None),
)

TRUE_WORDS = ("yes", "true", "1")
FALSE_WORDS = ("no", "false", "0")


def trim_text_fields(df: DataFrame) -> DataFrame:
    """Strip every string column; all other columns stay as they are."""
    return df.select(
        *[strip(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`")
          for f in df.schema.fields]
    )


def upper_case(c: Column) -> Column:
    return F.upper(c)


def split_full_name(c: Column) -> tuple[Column, Column]:
    """First word, and the rest (null for a single word)."""
    text = strip(c)
    first = F.substring_index(text, " ", 1)
    rest = strip(F.substring(text, F.length(first) + 1, F.length(text)))
    return first, F.nullif(rest, F.lit(""))


def is_marker(c: Column, markers: Sequence[str] = NULL_MARKERS) -> Column:
    """True when the text is one of the markers for a missing value."""
    short = strip(c)
    return (F.length(short) <= max(len(m) for m in markers)) & F.upper(short).isin([m.upper() for m in markers])


def null_if_marker(c: Column, markers: Sequence[str] = NULL_MARKERS) -> Column:
    return F.when(~is_marker(c, markers), c)


def date_layout(c: Column) -> Column:
    """Name of the layout a date text has, or null."""
    out = F.lit(None).cast("string")
    for name, shape, _ in reversed(DATE_LAYOUTS):
        out = F.when(c.rlike(shape), F.lit(name)).otherwise(out)
    return out


def to_date(c: Column) -> Column:
    """Date of a text in any known layout; null for days that do not exist.

    The shape picks the layout, its digits are put in order, and one cast parses them all; only
    month names need a formatter.
    """
    text = strip(c)
    ordered = F.lit(None).cast("string")
    spelled = F.lit(None).cast("date")
    for _, shape, places in reversed(DATE_LAYOUTS):
        if places is None:
            spelled = F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit("MMMM d, yyyy")).cast("date"))
            continue
        year, month, day = places
        digits = F.concat_ws("-", F.substring(text, year, 4), F.substring(text, month, 2), F.substring(text, day, 2))
        ordered = F.when(text.rlike(shape), digits).otherwise(ordered)
    return F.coalesce(ordered.try_cast("date"), spelled)


def iso_date(c: Column) -> Column:
    return F.date_format(to_date(c), "yyyy-MM-dd")


def us_date(c: Column) -> Column:
    return F.date_format(c, "MM/dd/yyyy")


def json_timestamp(c: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SSZ``; the session zone must be UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def two_decimals(c: Column) -> Column:
    """Text with exactly two decimals, rounded half up; null where the value is no number, which a check can see."""
    return c.try_cast(T.DecimalType(38, 2)).cast("string")


def clean_number(c: Column, kind: T.DataType | str = "decimal(18,2)") -> Column:
    """First number in the text without currency sign or thousands separators; null if none.

    It is below zero if a minus touches its first digit or the currency sign or code before it, if the text ends with a
    minus after it, or if round brackets hold the whole text.
    """
    number = r"\d[\d,]*(?:\.\d+)?"
    currency = r"(?:\p{Sc}|\b[A-Z]{3}\b)"
    digits = F.replace(F.regexp_substr(c, F.lit(number)), F.lit(","), F.lit(""))
    minus = rf"^\D*[-\u2212](?:{currency}\s*)?{number}|^[^\d-]*{number}\s*{currency}?-\s*$|^\s*\([^\d()]*{number}[^\d()]*\)\s*$"
    return F.when(c.rlike(minus), F.concat(F.lit("-"), digits)).otherwise(digits).try_cast(kind)


def trailing_unit(c: Column) -> Column:
    """What follows the number: ``$750/month`` gives ``month``, ``1.8 acres`` gives ``acres``."""
    rest = F.regexp_extract(c, r"\d[\d,]*(?:\.\d+)?\s*/?\s*([A-Za-z][A-Za-z ]*)", 1)
    return F.nullif(strip(rest), F.lit(""))


def to_boolean(c: Column) -> Column:
    """yes/no, true/false and 1/0 in any case; anything else is null."""
    word = F.lower(strip(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def bool_text(c: Column) -> Column:
    """Lower-case true/false."""
    return F.when(c, F.lit("true")).when(~c, F.lit("false"))


def phone(c: Column) -> Column:
    """``(###) ###-####`` for ten digits; other texts stay unchanged."""
    digits = F.regexp_replace(c, r"\D", "")
    shaped = F.concat(
        F.lit("("), F.substring(digits, 1, 3), F.lit(") "), F.substring(digits, 4, 3), F.lit("-"), F.substring(digits, 7, 4)
    )
    return F.when(F.length(digits) == 10, shaped).otherwise(c)


def csv_field(c: Column, sep: str = ",") -> Column:
    """Quote a field that holds a separator, quote or line break; double the quotes inside."""
    special = F.contains(c, F.lit(sep)) | F.contains(c, F.lit('"')) | F.contains(c, F.lit("\n")) | F.contains(c, F.lit("\r"))
    return F.when(special, F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def escapes(sep: str) -> tuple[tuple[str, str], ...]:
    """What is escaped in a field, in order, and how."""
    # \x01 is escaped too, because split_escaped uses it as a stand-in.
    return ("\\", "\\\\"), (sep, "\\" + sep), ("\n", "\\n"), ("\r", "\\r"), ("\x01", "\\1")


def escape_field(c: Column, sep: str = "|") -> Column:
    """Backslash-escape separators, backslashes and line breaks, so that a record stays one line."""
    for plain, escaped in escapes(sep):
        c = F.replace(c, F.lit(plain), F.lit(escaped))
    return c


def split_escaped(line: Column, sep: str = "|") -> Column:
    """Fields of a line written with ``escape_field``, values restored."""
    parked = F.replace(line, F.lit("\\\\"), F.lit("\x01"))
    fields = F.split(parked, rf"(?<!\\)\Q{sep}\E", -1)

    def restore(field: Column) -> Column:
        for plain, escaped in ((sep, "\\" + sep), ("\n", "\\n"), ("\r", "\\r")):
            field = F.replace(field, F.lit(escaped), F.lit(plain))
        pieces = F.transform(F.split(field, "\x01", -1), lambda p: F.replace(p, F.lit("\\1"), F.lit("\x01")))
        return F.array_join(pieces, "\\")

    # Most lines hold no escape at all; they are split and nothing else.
    return F.when(F.contains(line, F.lit("\\")), F.transform(fields, restore)).otherwise(F.split(line, rf"\Q{sep}\E", -1))


def field_count(line: Column, sep: str = "|") -> Column:
    """Number of fields of a line, escaped separators not counted."""
    parked = F.replace(F.replace(line, F.lit("\\\\"), F.lit("")), F.lit("\\" + sep), F.lit(""))
    return F.length(parked) - F.length(F.replace(parked, F.lit(sep), F.lit(""))) + 1


def json_string(c: Column) -> Column:
    """The text as a quoted JSON string."""
    boxed = F.to_json(F.array(c))
    return F.substring(boxed, F.lit(2), F.length(boxed) - 2)


def sql_literal(c: Column) -> Column:
    """The text as a quoted SQL literal."""
    return F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))


def join_list(c: Column, sep: str = ";") -> Column:
    return F.array_join(c, sep)


def mask(c: Column) -> Column:
    """First and last four characters of a longer text, else ``***``."""
    return F.when(F.length(c) > 8, F.concat(F.left(c, F.lit(4)), F.lit("..."), F.right(c, F.lit(4)))).otherwise(F.lit("***"))


def base_name(c: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(c, "/", -1)


def line_count(c: Column) -> Column:
    """Lines of the stripped text."""
    text = strip(c)
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def byte_size(c: Column) -> Column:
    return F.octet_length(c).cast("bigint")


# Words that put a format into a category, tested in this order.
FORMAT_CATEGORIES = (
    ("delimited", ("pipe", "delimited", "csv", "tsv")),
    ("json", ("json",)),
    ("xml", ("xml",)),
    ("fixed_width", ("fixed",)),
    ("text", ("text", "article", "document", "narrative", "unstructured")),
)


def format_category(c: Column) -> Column:
    text = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit("other")
    for category, words in reversed(FORMAT_CATEGORIES):
        found = F.lit(False)
        for word in words:
            found = found | F.contains(text, F.lit(word))
        out = F.when(found, F.lit(category)).otherwise(out)
    return out
