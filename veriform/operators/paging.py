"""Places of rows in the order of their group, and pages of a stated size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriform.operators.mapping import named
from veriform.session import materialise


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], place: str = "place") -> DataFrame:
    """Adds the place, from 0, of each row in its group of ``keys`` by ``order``.

    Rows are dealt out by ranges of keys and order, so a group of any size lies in as many ranges as it needs. Each
    range is numbered by itself, and what a group has in earlier ranges is added from one count per group and range.
    Equal rows are numbered one after the other.
    """
    sort = [named(c) for c in dict.fromkeys([*keys, *order])]
    ranged = materialise(df.repartitionByRange(*sort).withColumn("_range", F.spark_partition_id()))
    in_range = Window.partitionBy(*[named(k) for k in keys], "_range").orderBy(*[named(c) for c in order])
    counts = ranged.groupBy(*[named(k) for k in keys], "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*[named(k) for k in keys]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    before = before.select(*[named(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_range").alias("_r"), "_before")
    local = ranged.withColumn("_local", F.row_number().over(in_range) - 1)
    on = (F.col("_range") == F.col("_r"))
    for i, k in enumerate(keys):
        on = on & named(k).eqNullSafe(F.col(f"_k{i}"))
    return local.join(before, on).select(*[named(c) for c in df.columns], (F.col("_before") + F.col("_local")).cast("bigint").alias(place))


def with_pages(df: DataFrame, keys: Sequence[str], order: Sequence[str], page_rows: int | None, page: str = "page") -> DataFrame:
    """Adds the page, from 0, that a row is on when each page takes ``page_rows`` rows of its group in order.

    Without ``page_rows`` all rows are on page 0. Pages put one after the other give the ordered group.
    """
    if page_rows is None:
        return df.withColumn(page, F.lit(0).cast("bigint"))
    if page_rows < 1:
        raise ValueError("a page holds at least one row")
    placed = numbered(df, keys, order, "_place")
    return placed.withColumn(page, F.floor(F.col("_place") / page_rows)).drop("_place")
