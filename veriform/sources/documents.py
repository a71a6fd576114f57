"""Whole files as documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriform.functions.values import base_name, byte_size, line_count
from veriform.sources.folder import UNREADABLE, read_files

REPLACEMENT = chr(0xFFFD)
# A code point that no text may use; holds the place of real replacement characters while decoding.
HELD = chr(0x10FFFE)


def decode_dropping(content: Column) -> Column:
    """UTF-8 text with undecodable bytes left out."""
    raw = content.cast("string")
    held = F.replace(raw, F.lit(REPLACEMENT), F.lit(HELD))
    cleaned = F.replace(F.replace(F.make_valid_utf8(held), F.lit(REPLACEMENT), F.lit("")), F.lit(HELD), F.lit(REPLACEMENT))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(cleaned)


def decode_text(content: Column) -> Column:
    """UTF-8 where it is valid, else Latin-1."""
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "ISO-8859-1"))


def detect_encoding(content: Column) -> Column:
    """ASCII, UTF-8 or ISO-8859-1."""
    raw = content.cast("string")
    return (
        F.when(~F.is_valid_utf8(raw), F.lit("ISO-8859-1"))
        .when(F.octet_length(raw) == F.length(raw), F.lit("ASCII"))
        .otherwise(F.lit("UTF-8"))
    )


def read_folder(spark: SparkSession, folder: str, pattern: str = "*", asked: Sequence[str] = ()) -> DataFrame:
    """Files of one folder that match a pattern: ``(file_path, file_size, content, error)``, one row per file.

    Not recursive. Files are listed without being opened and read in groups; one that cannot be read does not stop the
    others: it has no content, and an error. One that is gone before it is listed counts as never there, but names
    in ``asked`` have a row in any case.
    """
    return read_files(spark, folder, pattern, asked)


def read_documents(spark: SparkSession, folder: str, pattern: str = "*", asked: Sequence[str] = ()) -> DataFrame:
    """``(file_path, value, error)``, one row per file; the value of an unreadable file is null."""
    return read_folder(spark, folder, pattern, asked).select("file_path", decode_dropping(F.col("content")).alias("value"), "error")


def with_missing(requested: DataFrame, loaded: DataFrame) -> DataFrame:
    """Every requested ``file_path``; value is null and ``error`` set where nothing was loaded."""
    joined = requested.select("file_path").join(loaded.drop("error"), "file_path", "left")
    return joined.withColumn("error", F.when(F.col("value").isNull(), F.lit(UNREADABLE)))


def with_provenance(df: DataFrame, path: str = "file_path", value: str = "value") -> DataFrame:
    """Base name, size in bytes and line count of each document."""
    return df.withColumns(
        {"file_name": base_name(F.col(path)), "byte_size": byte_size(F.col(value)), "line_count": line_count(F.col(value))}
    )


def sample_lines(c: Column, n: int = 100) -> Column:
    """The first ``n`` lines of a text."""
    return F.substring_index(c, "\n", n)
