"""Typed views and their definition text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veriform.operators.mapping import named

# SQL type for each inferred type name.
SQL_TYPES = {
    "string": "VARCHAR", "text": "TEXT", "number": "DECIMAL(18,2)", "integer": "INTEGER", "float": "FLOAT",
    "date": "DATE", "datetime": "TIMESTAMP", "boolean": "BOOLEAN",
}


def create_view(df: DataFrame, name: str, casts: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Registers a view of ``(source, alias, Spark type)`` and returns it; values that do not fit are null."""
    view = df.select(*[named(source).try_cast(kind).alias(alias) for source, alias, kind in casts])
    view.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def identifier(c: Column) -> Column:
    """A valid SQL name: other characters become ``_`` and a leading digit gets one in front."""
    clean = F.regexp_replace(c, r"\W", "_")
    return F.when(clean.rlike(r"^\d"), F.concat(F.lit("_"), clean)).otherwise(clean)


def sql_type(c: Column) -> Column:
    out = F.lit("VARCHAR")
    for kind, sql in SQL_TYPES.items():
        out = F.when(c == kind, F.lit(sql)).otherwise(out)
    return out


def view_ddl(profile: DataFrame, view: str, source: str) -> DataFrame:
    """CREATE VIEW text from a column profile ``(position, name, data_type)``; one row per column in, one row out.

    Names that clean to one alias, whatever their case, are told apart by a number: the second is ``name_2``.
    """
    alike = Window.partitionBy(F.lower(identifier(F.col("name")))).orderBy("position")
    nth = F.row_number().over(alike)
    alias = F.when(nth > 1, F.concat(identifier(F.col("name")), F.lit("_"), nth.cast("string"))).otherwise(identifier(F.col("name")))
    profile = profile.select("position", "name", "data_type", alias.alias("alias"))
    item = F.struct(
        F.col("position"),
        F.concat(
            F.lit('  CAST("'), F.replace(F.col("name"), F.lit('"'), F.lit('""')), F.lit('" AS '), sql_type(F.col("data_type")),
            F.lit(") AS "), F.col("alias"),
        ).alias("text"),
    )
    parts = profile.agg(F.array_sort(F.collect_list(item)).alias("items"))
    body = F.array_join(F.transform("items", lambda x: x["text"]), ",\n")
    return parts.select(F.concat(F.lit(f"CREATE VIEW {view} AS\nSELECT\n"), body, F.lit(f"\nFROM {source}")).alias("ddl"))
