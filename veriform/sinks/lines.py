"""Delimited text: records as lines, with header, quoting or escaping, and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriform.functions.text import strip
from veriform.functions.values import csv_field, escape_field, escapes
from veriform.operators.mapping import named


# How the formats write true and false.
CAPITALISED = ("True", "False")
LOWER_CASE = ("true", "false")


def field_text(c: Column, kind: T.DataType, trim: bool = True, words: tuple[str, str] = CAPITALISED) -> Column:
    """A typed value as text, losing nothing: no thousands separator, ISO dates, the given words for booleans.

    Floating-point numbers have the shortest digits that give the same number back, without an exponent from 1e-20 up
    to 1e22. Timestamps have the fraction of a second that they need, and no time at midnight.
    """
    if isinstance(kind, T.StringType):
        return strip(c) if trim else c
    if isinstance(kind, T.DoubleType | T.FloatType):
        text = c.cast("string")
        size = F.abs(c.cast("double"))
        spelled = F.when(size.between(1e-20, 1), text.try_cast(T.DecimalType(38, 37)).cast("string")).when(
            size.between(1, 1e22), text.try_cast(T.DecimalType(38, 15)).cast("string"))
        plain = F.when(F.contains(text, F.lit("E")), F.coalesce(spelled, text)).otherwise(text)
        return F.regexp_replace(plain, r"(\.\d*?[1-9])0+$|\.0+$", "$1")
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        midnight = F.date_trunc("day", c) == c
        moment = F.regexp_replace(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.?0+$", "")
        whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        return F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.when(F.date_trunc("second", c) == c, whole).otherwise(moment))
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit(words[0])).when(~c, F.lit(words[1]))
    if isinstance(kind, T.ArrayType | T.MapType | T.StructType):
        return F.to_json(c)
    return c.cast("string")


def texts(df: DataFrame, cols: Sequence[str], trim: bool = True, words: tuple[str, str] = CAPITALISED) -> list[Column]:
    return [F.coalesce(field_text(named(c), df.schema[c].dataType, trim, words), F.lit("")) for c in cols]


def delimited_line(df: DataFrame, cols: Sequence[str], sep: str = "|") -> Column:
    """One record as a line; strings are trimmed, separators, backslashes and line breaks in them escaped."""
    return F.concat_ws(sep, *[escape_field(t, sep) for t in texts(df, cols)])


def csv_line(df: DataFrame, cols: Sequence[str], sep: str = ",") -> Column:
    """One record after RFC 4180; strings keep their blanks."""
    return F.concat_ws(sep, *[csv_field(t, sep) for t in texts(df, cols, trim=False, words=LOWER_CASE)])


def header_frame(df: DataFrame, header: str) -> DataFrame:
    return df.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("line"))


def _quoted_header(cols: Sequence[str], sep: str) -> str:
    return sep.join('"' + c.replace('"', '""') + '"' if any(x in c for x in (sep, '"', "\n", "\r")) else c for c in cols)


def _escaped_header(cols: Sequence[str], sep: str) -> str:
    """Names as :func:`veriform.functions.values.escape_field` writes values."""
    out = []
    for name in cols:
        for plain, escaped in escapes(sep):
            name = name.replace(plain, escaped)
        out.append(name)
    return sep.join(out)


def to_delimited_lines(df: DataFrame, cols: Sequence[str] | None = None, sep: str = "|") -> DataFrame:
    """Header line and one line per row; an empty input gives the header alone."""
    cols = list(cols or df.columns)
    return header_frame(df, _escaped_header(cols, sep)).unionByName(df.select(delimited_line(df, cols, sep).alias("line")))


def to_pipe_lines(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return to_delimited_lines(df, cols, "|")


def to_csv_lines(df: DataFrame, cols: Sequence[str] | None = None, sep: str = ",") -> DataFrame:
    cols = list(cols or df.columns)
    return header_frame(df, _quoted_header(cols, sep)).unionByName(df.select(csv_line(df, cols, sep).alias("line")))


def _write(df: DataFrame, header: str, line: Column, path: str, line_sep: str, mode: str) -> None:
    # Every part file opens with the header, as readers expect of a folder of delimited files. The
    # first row of a partition is told by the low bits of its position; no shuffle, no extra pass.
    place = F.monotonically_increasing_id()
    first = place.bitwiseAND(F.lit((1 << 33) - 1)) == 0
    body = df.select(line.alias("value")).select(
        F.when(first, F.concat(F.lit(header + line_sep), F.col("value"))).otherwise(F.col("value")).alias("value")
    )
    alone = df.sparkSession.range(0, 1, 1, 1).select(F.lit(header).alias("value"))
    # One file per task, whatever the session says: a second file of a task would have no header.
    alone.unionByName(body).write.mode(mode).option("lineSep", line_sep).option("maxRecordsPerFile", 0).text(path)


def write_delimited(df: DataFrame, path: str, cols: Sequence[str] | None = None, sep: str = "|", mode: str = "errorifexists") -> None:
    """Part files that each start with the header; one of them holds the header alone."""
    cols = list(cols or df.columns)
    _write(df, _escaped_header(cols, sep), delimited_line(df, cols, sep), path, "\n", mode)


def write_csv(df: DataFrame, path: str, cols: Sequence[str] | None = None, sep: str = ",", mode: str = "errorifexists") -> None:
    """RFC 4180 part files with CRLF line ends; line breaks inside values stay as they are."""
    cols = list(cols or df.columns)
    _write(df, _quoted_header(cols, sep), csv_line(df, cols, sep), path, "\r\n", mode)
