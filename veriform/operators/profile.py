"""Profiling of tables and of document texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriform.functions.text import is_json, strip
from veriform.functions.values import DATE_LAYOUTS, NULL_MARKERS, byte_size, date_layout, format_category, is_marker, line_count, to_date
from veriform.operators.mapping import match_frame, named

# Kinds of a single value, one bit each; a column's kinds are the bitwise or of its values' kinds.
KINDS = ("boolean", "integer", "float", "date", "datetime", "string")
BIT = {kind: 1 << i for i, kind in enumerate(KINDS)}


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, as a delimited file would hold it."""
    return df.select(*[named(c).cast("string").alias(c) for c in df.columns])


def value_kind(v: Column) -> Column:
    """Bit of the narrowest kind of a stripped text; null for missing values.

    The first character decides which tests a value needs, so most values meet one test or two.
    """
    first = F.ascii(v)
    numeric = first.between(48, 57) | first.isin(43, 45, 46)
    capital = first.between(65, 90)
    return (
        F.when(is_marker(v), F.lit(None).cast("int"))
        # A cast that fails costs an exception, so shapes decide first and casts only confirm.
        .when(numeric & v.rlike(r"^[+-]?\d+$") & ((F.length(v) <= 18) | v.try_cast("bigint").isNotNull()), F.lit(BIT["integer"]))
        .when(numeric & v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), F.lit(BIT["float"]))
        .when(numeric & v.rlike(r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}") & v.try_cast("timestamp").isNotNull(), F.lit(BIT["datetime"]))
        .when(F.length(v).between(4, 5) & F.lower(v).isin("true", "false"), F.lit(BIT["boolean"]))
        .when((numeric | (capital & v.rlike(r" \d+, \d{4}$"))) & to_date(v).isNotNull(), F.lit(BIT["date"]))
        .when(v.isNotNull(), F.lit(BIT["string"]))
    )


def kind_name(mask: Column) -> Column:
    """Kind that holds all values: one kind only, or float for integers and floats, or datetime for dates with times."""
    out = F.lit("string")
    for kind in ("boolean", "integer", "float", "date", "datetime"):
        out = F.when(mask == BIT[kind], F.lit(kind)).otherwise(out)
    out = F.when(mask == (BIT["integer"] | BIT["float"]), F.lit("float")).otherwise(out)
    return F.when(mask == (BIT["date"] | BIT["datetime"]), F.lit("datetime")).otherwise(out)


def long_form(one_row: DataFrame, records: Sequence[Sequence[tuple[str, Column]]]) -> DataFrame:
    """One row per record from a single row of aggregates."""
    structs = [F.struct(*[c.alias(name) for name, c in record]) for record in records]
    return one_row.select(F.inline(F.array(*structs)))


def typed_kind(kind: T.DataType) -> str:
    """Kind of all values of a column that is no text."""
    if isinstance(kind, T.IntegralType) or (isinstance(kind, T.DecimalType) and kind.scale == 0):
        return "integer"
    if isinstance(kind, T.NumericType):
        return "float"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.DateType):
        return "date"
    return "datetime" if isinstance(kind, T.TimestampType | T.TimestampNTZType) else "string"


def profile_columns(df: DataFrame, samples: bool = False) -> DataFrame:
    """``(name, position, data_type, nullable, row_count[, samples])``, one row per column.

    Text columns are judged by their values, as a delimited file would be read. They are turned to rows of (column number,
    value) and aggregated per column: the test of a value is compiled once, however many columns
    there are, and each task sends one row per column. Other columns have their kind already; only their nulls are
    counted. A column without values is ``string``.
    """
    text = [i for i, f in enumerate(df.schema.fields) if isinstance(f.dataType, T.StringType)]
    typed = [i for i in range(len(df.columns)) if i not in text]
    names = F.array(*[F.lit(c) for c in df.columns])
    parts = []
    if typed:
        counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count(named(df.columns[i])).alias(f"n{i}") for i in typed])
        kinds = [F.when(F.col(f"n{i}") > 0, F.lit(typed_kind(df.schema.fields[i].dataType))).otherwise(F.lit("string")) for i in typed]
        parts.append(long_form(counts, [
            [("name", F.lit(df.columns[i])), ("position", F.lit(i)), ("data_type", k), ("nullable", F.col(f"n{i}") < F.col("rows")), ("row_count", F.col("rows"))] for i, k in zip(typed, kinds, strict=True)
        ]).where("row_count > 0"))
    if text:
        cells = F.inline(F.array(*[F.struct(F.lit(i).alias("position"), named(df.columns[i]).alias("value")) for i in text]))
        stripped = df.select(cells).select("position", strip(F.col("value")).alias("v"))
        kinds = stripped.select("position", value_kind(F.col("v")).alias("kind"))
        found = kinds.groupBy("position").agg(F.bit_or("kind").alias("mask"), F.count("kind").alias("present"), F.count(F.lit(1)).alias("row_count"))
        parts.append(found.select(
            F.get(names, F.col("position")).alias("name"), "position", kind_name(F.col("mask")).alias("data_type"),
            (F.col("present") < F.col("row_count")).alias("nullable"), "row_count",
        ))
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.join(sample_values(as_text(df)), "name", "left") if samples else out


MAX_DOUBLE = 1.7976931348623157e308


def _distinct(*values: Column) -> Column:
    return F.array_distinct(F.array_compact(F.array(*values)))


def infer_types(df: DataFrame) -> DataFrame:
    return profile_columns(df).select("name", "data_type")


def sample_values(df: DataFrame) -> DataFrame:
    """Two or three values per column: smallest, one drawn by hash, largest. One scan, nothing collected."""
    aggs, records = [], []
    for i, c in enumerate(df.columns):
        v = F.when(~is_marker(named(c)), named(c))
        aggs += [F.min(v).alias(f"lo{i}"), F.max(v).alias(f"hi{i}"), F.min_by(v, F.md5(v)).alias(f"any{i}")]
        records.append([("name", F.lit(c)), ("samples", _distinct(F.col(f"lo{i}"), F.col(f"any{i}"), F.col(f"hi{i}")))])
    return long_form(df.agg(*aggs), records)


def null_profile(df: DataFrame, markers: Sequence[str] = NULL_MARKERS) -> DataFrame:
    """Per column the rows, nulls and counts of each marker: ``(name, row_count, nulls, representation, n)``."""
    aggs, records = [F.count(F.lit(1)).alias("n")], []
    for i, c in enumerate(df.columns):
        text = F.upper(strip(named(c)))
        aggs.append(F.count_if(named(c).isNull()).alias(f"null{i}"))
        for j, marker in enumerate(markers):
            aggs.append(F.count_if(text == marker.upper()).alias(f"m{i}_{j}"))
            records.append([
                ("name", F.lit(c)), ("row_count", F.col("n")), ("nulls", F.col(f"null{i}")), ("representation", F.lit(marker)), ("found", F.col(f"m{i}_{j}")),
            ])
    return long_form(df.agg(*aggs), records)


def numeric_ranges(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Smallest, largest and mean value of numeric columns, and how many values are not finite: ``(name, low, high, mean, non_finite)``.

    Not-a-number and infinite values are counted and left out of the rest. The mean has ten significant digits, so that
    it does not depend on the order in which numbers are added.
    """
    cols = list(cols or [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)])
    aggs, records = [], []
    for i, c in enumerate(cols):
        value = named(c).cast("double")
        finite = F.abs(value) <= MAX_DOUBLE  # not a number is above every number
        held = F.when(finite, value)
        aggs += [F.min(held).alias(f"lo{i}"), F.max(held).alias(f"hi{i}"), F.avg(held).alias(f"m{i}"), F.count_if(~finite).alias(f"n{i}")]
        mean = F.format_string("%.9e", F.col(f"m{i}")).cast("double")
        records.append([("name", F.lit(c)), ("low", F.col(f"lo{i}")), ("high", F.col(f"hi{i}")), ("mean", F.when(F.col(f"m{i}").isNotNull(), mean)), ("non_finite", F.col(f"n{i}"))])
    return long_form(df.agg(*aggs), records)


def date_formats(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """How many values of each text column have each date layout: ``(name, layout, n)``, layouts that occur."""
    cols = list(cols or df.columns)
    layouts = [name for name, _, _ in DATE_LAYOUTS]
    shaped = df.select(*[date_layout(strip(named(c))).alias(f"l{i}") for i, c in enumerate(cols)])
    aggs, records = [], []
    for i, c in enumerate(cols):
        for j, layout in enumerate(layouts):
            aggs.append(F.count_if(F.col(f"l{i}") == layout).alias(f"n{i}_{j}"))
            records.append([("name", F.lit(c)), ("layout", F.lit(layout)), ("n", F.col(f"n{i}_{j}"))])
    return long_form(shaped.agg(*aggs), records).filter("n > 0")


# Layouts that only a whole column decides: name, shape of a value, and where year, month and day are in it (place, length).
COLUMN_LAYOUTS = (
    ("YYYY-MM-DD", r"^\d{4}-\d{2}-\d{2}$", ((1, 4), (6, 2), (9, 2))), ("YYYY-DD-MM", r"^\d{4}-\d{2}-\d{2}$", ((1, 4), (9, 2), (6, 2))),
    ("MM/DD/YYYY", r"^\d{2}/\d{2}/\d{4}$", ((7, 4), (1, 2), (4, 2))), ("DD/MM/YYYY", r"^\d{2}/\d{2}/\d{4}$", ((7, 4), (4, 2), (1, 2))),
    ("YYYY/MM/DD", r"^\d{4}/\d{2}/\d{2}$", ((1, 4), (6, 2), (9, 2))), ("DD.MM.YYYY", r"^\d{2}\.\d{2}\.\d{4}$", ((7, 4), (4, 2), (1, 2))),
    ("MM.DD.YYYY", r"^\d{2}\.\d{2}\.\d{4}$", ((7, 4), (1, 2), (4, 2))), ("YYYYMMDD", r"^\d{8}$", ((1, 4), (5, 2), (7, 2))),
    ("DDMMYYYY", r"^\d{8}$", ((5, 4), (3, 2), (1, 2))), ("MM/DD/YY", r"^\d{2}/\d{2}/\d{2}$", ((7, 2), (1, 2), (4, 2))), ("DD/MM/YY", r"^\d{2}/\d{2}/\d{2}$", ((7, 2), (4, 2), (1, 2))),
    ("YY/MM/DD", r"^\d{2}/\d{2}/\d{2}$", ((1, 2), (4, 2), (7, 2))),
)


def possible_layouts(v: Column) -> Column:
    """Set of the layouts under which a stripped text is a day that exists, one bit each; years of two digits are 2000 and later."""
    digits = F.ascii(v).between(48, 57) & F.length(v).between(8, 10)
    out = F.lit(0)
    for i, (_, shape, parts) in enumerate(COLUMN_LAYOUTS):
        year, month, day = (F.substring(v, at, n) for at, n in parts)
        whole = year if parts[0][1] == 4 else F.concat(F.lit("20"), year)
        # A cast that fails is dear, so months and days that never exist are told by their digits.
        fits = v.rlike(shape) & month.between("01", "12") & day.between("01", "31")
        fits = F.when(fits, F.concat_ws("-", whole, month, day).try_cast("date").isNotNull())
        out = out.bitwiseOR(F.when(fits, F.lit(1 << i)).otherwise(F.lit(0)))
    return F.when(digits, out).otherwise(F.lit(0))


def column_layouts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Date layouts that all values of a text column have: ``(name, layouts, n, undated)``.

    Each value allows a set of layouts, and the sets of a column are intersected, task by task and then over all: one
    day above twelve tells day and month apart for the whole column. ``layouts`` holds all that are left, more than one where the
    column does not decide, none where no layout fits all values; ``undated`` counts the values that are no date at all. Missing
    values say nothing; a column without values has no layouts.
    """
    cols = list(cols or df.columns)
    # Values become rows of (column number, value), so that the test of a value is compiled once.
    cells = F.inline(F.array(*[F.struct(F.lit(i).alias("position"), F.when(~is_marker(named(c)), named(c)).alias("value")) for i, c in enumerate(cols)]))
    masks = df.select(cells).select("position", F.when(F.col("value").isNotNull(), possible_layouts(strip(F.col("value")))).alias("mask"))
    found = masks.groupBy("position").agg(F.bit_and("mask").alias("all"), F.count("mask").alias("n"), F.count_if(F.col("mask") == 0).alias("undated"))
    left = F.array_compact(F.array(*[F.when(F.col("all").bitwiseAND(F.lit(1 << j)) != 0, F.lit(name)) for j, (name, _, _) in enumerate(COLUMN_LAYOUTS)]))
    return found.select(F.get(F.array(*[F.lit(c) for c in cols]), F.col("position")).alias("name"), left.alias("layouts"), "n", "undated")


# Separators a file may use, by format name, tested in this order.
SEPARATORS = (("pipe-delimited", "|"), ("tab-delimited", "\t"), ("csv", ","), ("semicolon-delimited", ";"))


def _same_count(lines: Column, sep: str) -> Column:
    counts = F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit(sep), F.lit(""))))
    return (F.array_min(counts) >= 1) & (F.array_min(counts) == F.array_max(counts))


def detect_format(df: DataFrame, text: str) -> DataFrame:
    """Adds ``format``, ``delimiter``, ``quote_char`` and ``has_header`` of a document text.

    Marked-up formats are told by their opening; a delimited file has the same number of separators
    on every line, at least two lines; a fixed-width file has lines of one length with runs of blanks.
    """
    t = strip(F.col(text))
    bare = F.when(F.contains(t, F.lit('"')), F.regexp_replace(t, '"[^"]*"', "")).otherwise(t)
    work = df.withColumns({"_t": t, "_bare": bare}).withColumns(
        {"_first": F.substring_index("_bare", "\n", 1), "_many": F.contains("_t", F.lit("\n"))}
    )
    lines = F.split("_bare", "\n", -1)
    lengths = F.transform(lines, F.length)
    coded = work.withColumn("_found", _first_match(lines, lengths))
    delimiter = F.lit(None).cast("string")
    for name, sep in SEPARATORS:
        delimiter = F.when(F.col("_found") == name, F.lit(sep)).otherwise(delimiter)
    out = coded.withColumn("delimiter", delimiter)
    heads = F.split(F.col("_first"), F.concat(F.lit("\\Q"), F.col("delimiter"), F.lit("\\E")))
    header = F.when(F.col("delimiter").isNotNull(), ~F.exists(heads, lambda h: h.rlike(r"^\s*([+-]?[\d.,]+|\d{4}-\d{2}-\d{2}.*)?\s*$")))
    quote = F.when(F.col("delimiter").isNotNull() & F.contains("_t", F.lit('"')), F.lit('"'))
    return out.select(*[named(c) for c in df.columns], F.col("_found").alias("format"), "delimiter", quote.alias("quote_char"), header.alias("has_header"))


# What an HTML page opens with, after any comments and declarations.
HTML_OPENING = r"(?is)^(?:<!--.*?-->|<[?].*?[?]>|\s)*<(?:!doctype\s+html|html)\b"


def _first_match(lines: Column, lengths: Column) -> Column:
    t, many = F.col("_t"), F.col("_many")
    tests: list[tuple[Column, str]] = [
        (t.rlike(HTML_OPENING), "html"),
        (t.startswith("<?xml") | t.rlike(r"(?s)^<[A-Za-z][^>]*>.*>$"), "xml"),
        (t.rlike(r"^[{\[]") & is_json(t), "json"),
    ]
    # Counting over all lines comes last in each test, so it runs only where the first line fits.
    tests += [(many & F.contains("_first", F.lit(sep)) & _same_count(lines, sep), name) for name, sep in SEPARATORS]
    tests.append((many & F.contains(t, F.lit("  ")) & (F.array_min(lengths) == F.array_max(lengths)), "fixed-width"))
    out = F.lit("text")
    for test, name in reversed(tests):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def text_structure(df: DataFrame, page: str, keep: Sequence[str]) -> DataFrame:
    """Title and counts of headings, sections and paragraphs of a page."""
    from veriform.sources.records import tag_text, visible

    work = df.withColumn("_page", visible(F.col(page)))
    c = F.col("_page")

    def count(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)).cast("bigint")

    return work.select(
        *keep, tag_text("title")(c).alias("title"), count(r"(?i)<h[1-6][\s>]").alias("headings"),
        count(r"(?i)<(section|article)[\s>]").alias("sections"), count(r"(?i)<p[\s>]").alias("paragraphs"), count(r"(?i)<li[\s>]").alias("list_items"),
    )


def profile_valid(profile: Column) -> Column:
    """Struct ``(ok, reason)``: format present, at least one column, each with name and type."""
    columns = profile["columns"]
    reason = (
        F.when(profile["format"].isNull(), F.lit("No format given"))
        .when(columns.isNull(), F.lit("No list of columns"))
        .when(F.size(columns) == 0, F.lit("The list of columns is empty"))
        .when(F.exists(columns, lambda x: x["name"].isNull()), F.lit("A column has no name"))
        .when(F.exists(columns, lambda x: x["data_type"].isNull()), F.lit("A column has no data_type"))
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def enrich_profile(df: DataFrame, text: str, fmt: str, columns: str) -> DataFrame:
    """Adds line count, byte size, column count and format category."""
    return df.withColumns({
        "sample_line_count": line_count(F.col(text)), "sample_byte_size": byte_size(F.col(text)),
        "column_count": F.coalesce(F.size(F.col(columns)), F.lit(0)).cast("bigint"), "format_category": format_category(F.col(fmt)),
    })


def nest_profile(columns: DataFrame, fmt: str = "csv", delimiter: str = ",") -> DataFrame:
    """The long profile as one nested record (one row; as many elements as the table has columns)."""
    item = F.struct("position", "name", "data_type", "nullable", *(["samples"] if "samples" in columns.columns else []))
    return columns.agg(F.array_sort(F.collect_list(item)).alias("columns"), F.max("row_count").alias("row_count_sample")).select(
        F.lit(fmt).alias("format"), F.lit(delimiter).alias("delimiter"), F.lit('"').alias("quote_char"), "columns", "row_count_sample"
    )


# How a target type is filled.
FORMAT_RULES = {"date": "YYYY-MM-DD", "datetime": "YYYY-MM-DDTHH:MM:SSZ", "float": "two decimals", "number": "two decimals", "boolean": "true/false"}


def spec_from_profile(profile: DataFrame, target: Sequence[str], synonyms: Mapping[str, str], rules: Mapping[str, str] | None = None) -> DataFrame:
    """Mapping table of a conversion: ``(target_position, target, source, data_type, nullable, rule)``.

    The profile has one row per column of the source, so this is small whatever the data; a target
    without a source keeps its row with nulls.
    """
    item = F.struct("position", "name", "data_type", "nullable")
    one = profile.agg(F.array_sort(F.collect_list(item)).alias("cols")).withColumn("headers", F.transform("cols", lambda x: x["name"]))
    matched = match_frame(one, "headers", target, synonyms)
    named_rules = {**FORMAT_RULES, **(rules or {})}
    rows = matched.select(
        "cols", "matches", F.inline(F.array(*[F.struct(F.lit(i).alias("target_position"), F.lit(t).alias("target")) for i, t in enumerate(target)]))
    )
    hit = F.get(F.filter("matches", lambda m: m["target"] == F.col("target")), 0)
    source = F.get(F.filter("cols", lambda x: x["position"] == F.col("hit")["position"]), 0)
    rule = F.lit("as is")
    for kind, text in named_rules.items():
        rule = F.when(F.col("source_col")["data_type"] == kind, F.lit(text)).otherwise(rule)
    return rows.withColumn("hit", hit).withColumn("source_col", source).select(
        "target_position", "target", F.col("source_col.name").alias("source"), F.col("source_col.data_type").alias("data_type"),
        F.col("source_col.nullable").alias("nullable"), F.when(F.col("source_col").isNotNull(), rule).otherwise(F.lit("leave empty")).alias("rule"),
    )
