"""Comparing an output with its input.

Both sides are stacked and counted per key with map-side combined aggregates instead of being
joined: copies of a key cannot multiply, a key with a third of all rows is combined before it is
sent, and a comparison costs one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriform.functions.values import field_count
from veriform.operators.checks import check
from veriform.operators.mapping import named


def _stack(source: DataFrame, output: DataFrame, cols: Sequence[str]) -> DataFrame:
    picked = [named(c) for c in cols]
    return source.select(*picked, F.lit(1).alias("_side")).unionByName(output.select(*picked, F.lit(-1).alias("_side")))


def missing_rows(source: DataFrame, output: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys whose number of rows differs: ``(keys..., n_source, n_output, kind)``, kind lost, added or copies."""
    counted = _stack(source, output, keys).groupBy(*[named(k) for k in keys]).agg(
        F.count_if(F.col("_side") > 0).alias("n_source"), F.count_if(F.col("_side") < 0).alias("n_output")
    )
    kind = F.when(F.col("n_output") == 0, "lost").when(F.col("n_source") == 0, "added").otherwise("copies")
    return counted.filter("n_source <> n_output").withColumn("kind", kind)


def differing_rows(source: DataFrame, output: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Whole rows that occur more often on one side: ``(cols..., surplus)``, positive for the source."""
    return (
        _stack(source, output, cols).groupBy(*[named(c) for c in cols]).agg(F.sum("_side").alias("surplus")).filter("surplus <> 0")
    )


def value_diff(source: DataFrame, output: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Every value that occurs more often on one side: ``(keys..., column, value, surplus)``, positive for the source.

    Equal rows cancel first, so only differing rows are spread into values. A changed value is two rows, one for each
    side; a key on one side only has all its values on that side. Nothing that differs is left out.
    """
    rows = differing_rows(source, output, [*keys, *cols])
    values = F.array(*[F.struct(F.lit(c).alias("column"), named(c).cast("string").alias("value")) for c in cols])
    spread = rows.select(*[named(k) for k in keys], "surplus", F.inline(values))
    return spread.groupBy(*[named(k) for k in keys], "column", "value").agg(F.sum("surplus").alias("surplus")).filter("surplus <> 0")


def layout_check(line: Column, target: Sequence[str], sep: str = "|", header: Column | None = None) -> Column:
    """Check of one line: it has as many fields as the target.

    ``header`` marks the line that must be the header, by its place in the file; that line is checked for the exact
    names, and no other line may repeat them. Without it, the line is a record.
    """
    expected = sep.join(target)
    fields = field_count(line, sep)
    row = check(fields == len(target), F.concat(F.lit(f"Expected {len(target)} fields, found "), fields.cast("string")))
    if header is None:
        return row
    return F.when(header, check(line == expected, "Header differs")).when(line == expected, check(F.lit(False), "Header repeated")).otherwise(row)


def layout_summary(lines: DataFrame, target: Sequence[str], place: str, file: Sequence[str] = (), sep: str = "|", line: str = "line") -> DataFrame:
    """One row per file: ``(file..., header_ok, repeats, records, bad, ok)``.

    ``place`` numbers the lines of a file from 0. ``header_ok``: line 0 is the exact header; ``repeats``: the same line
    elsewhere; ``bad``: other lines with a wrong number of fields.
    """
    expected = sep.join(target)
    first, same = named(place) == 0, named(line) == expected
    counted = lines.groupBy(*[named(f) for f in file]).agg(
        F.coalesce(F.bool_or(first & same), F.lit(False)).alias("header_ok"), F.count_if(~first & same).alias("repeats"),
        F.count_if(~first & ~same).alias("records"), F.count_if(~first & ~same & (field_count(named(line), sep) != len(target))).alias("bad"),
    )
    return counted.withColumn("ok", F.col("header_ok") & (F.col("repeats") == 0) & (F.col("bad") == 0))


def csv_layout_check(line: Column, width: int, sep: str = ",") -> Column:
    """Same number of fields, quoted separators aside, and quotes in pairs."""
    bare = F.regexp_replace(line, '"[^"]*"', "")
    fields = F.length(bare) - F.length(F.replace(bare, F.lit(sep), F.lit(""))) + 1
    return check((fields == width) & ~F.contains(bare, F.lit('"')), F.concat(F.lit(f"Expected {width} fields, found "), fields.cast("string")))


def iso_date_ok(c: Column) -> Column:
    return check(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(c, F.lit("yyyy-MM-dd")).isNotNull(), "Not YYYY-MM-DD")


def two_decimals_ok(c: Column) -> Column:
    return check(c.rlike(r"^-?\d+\.\d{2}$"), "Not two decimals")


def json_type_ok(c: Column, field: str, kind: str) -> Column:
    """The field of a JSON text has the native type (``STRING``, ``BIGINT``, ``DECIMAL``, ``BOOLEAN``)."""
    found = F.regexp_extract(F.schema_of_variant(F.try_variant_get(F.try_parse_json(c), f"$.{field}", "variant")), r"^\w+", 0)
    return check(found == kind, F.concat(F.lit(f"{field} is "), F.coalesce(F.nullif(found, F.lit("")), F.lit("absent"))))


def profile_check(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Mismatches of two column profiles: ``(name, problem)``. One row per column of a table on either side."""
    d = declared.select("name", F.col("position").alias("p1"), F.col("data_type").alias("t1"), F.col("nullable").alias("n1"))
    a = actual.select("name", F.col("position").alias("p2"), F.col("data_type").alias("t2"), F.col("nullable").alias("n2"))
    both = d.join(a, "name", "full")
    problems = F.array_compact(F.array(
        F.when(F.col("p1").isNull(), "not in profile").when(F.col("p2").isNull(), "not in data"),
        F.when(F.col("p1") != F.col("p2"), F.concat(F.lit("position "), F.col("p1").cast("string"), F.lit(" is "), F.col("p2").cast("string"))),
        F.when(F.col("t1") != F.col("t2"), F.concat(F.lit("type "), F.col("t1"), F.lit(" is "), F.col("t2"))),
        F.when(F.col("n1") != F.col("n2"), F.concat(F.lit("nullable "), F.col("n1").cast("string"), F.lit(" is "), F.col("n2").cast("string"))),
    ))
    return both.select("name", F.explode_outer(problems).alias("problem")).filter("problem is not null")


# The sections a conversion specification must have, none of them empty.
SPEC_SECTIONS = (
    "data_conversion_system_msg", "data_conversion_request_msg", "data_verification_system_msg",
    "data_verification_request_msg", "data_validation_system_msg", "data_validation_request_msg",
)


def missing_sections(sections: Column) -> Column:
    """Required sections that a map of section texts lacks or leaves blank."""
    return F.array_compact(F.array(*[
        F.when(F.coalesce(F.trim(F.try_element_at(sections, F.lit(s))), F.lit("")) == "", F.lit(s)) for s in SPEC_SECTIONS
    ]))


def spec_coverage(spec: DataFrame, profile: DataFrame, allowed: dict[str, Sequence[str]]) -> DataFrame:
    """Problems of a mapping table ``(target, source, kind)`` against a profile: unknown sources and unfitting types.

    ``allowed`` lists the inferred types each target kind takes.
    """
    joined = spec.join(profile.select("name", "data_type"), spec["source"] == profile["name"], "left")
    fits = F.lit(False)
    for kind, types in allowed.items():
        fits = fits | ((F.col("kind") == kind) & F.col("data_type").isin(*types))
    problem = (
        F.when(F.col("source").isNull(), F.lit("no source")).when(F.col("name").isNull(), F.lit("not in profile"))
        .when(~fits, F.concat(F.col("data_type"), F.lit(" does not fit "), F.col("kind")))
    )
    return joined.select("target", "source", problem.alias("problem")).filter("problem is not null")
