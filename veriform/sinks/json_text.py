"""JSON text: records, arrays and nested documents."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriform.operators.mapping import named
from veriform.operators.paging import with_pages

MOMENT = "yyyy-MM-dd'T'HH:mm:ss'Z'"
KEEP_NULLS = {"ignoreNullFields": "false", "timestampFormat": MOMENT, "timestampNTZFormat": MOMENT}


# Records of one array, unless the caller says otherwise; None is for groups that are known to fit one value.
PAGE_ROWS = 100_000


def to_json_records(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One JSON object per row, native types, nulls kept."""
    cols = list(cols or df.columns)
    return df.select(F.to_json(F.struct(*[named(c) for c in cols]), KEEP_NULLS).alias("record"))


def to_json_array(df: DataFrame, by: Sequence[str], cols: Sequence[str], order: Sequence[str], page_rows: int | None = PAGE_ROWS) -> DataFrame:
    """JSON arrays ``(by..., page, n, records)``, records in order.

    Groups are cut into pages of ``page_rows`` records by their order: the arrays of pages 0, 1, ... put together are the
    array of the group. None puts each group into one array, whatever its size.
    """
    picked = df.select(*[named(c) for c in dict.fromkeys([*by, *order, *cols])])
    paged = with_pages(picked, by, list(dict.fromkeys([*order, *cols])), page_rows)
    item = F.struct(F.struct(*[named(c) for c in order]).alias("o"), F.struct(*[named(c) for c in cols]).alias("r"))
    grouped = paged.groupBy(*[named(c) for c in by], "page").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select(*[named(c) for c in by], "page", "n", F.to_json(F.transform("items", lambda x: x["r"]), KEEP_NULLS).alias("records"))


def to_nested_json(layout: Mapping[str, Column | Mapping]) -> Column:
    """JSON document of a layout of sections; a section is a column or a mapping of fields."""

    def build(section) -> Column:
        if isinstance(section, Mapping):
            return F.struct(*[build(v).alias(k) for k, v in section.items()])
        return section

    return F.to_json(build(layout), KEEP_NULLS)


def write_json_records(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line. Timestamps have whole seconds, as the target format states."""
    df.write.mode(mode).options(**KEEP_NULLS).json(path)


def collect_children(items: DataFrame, keys: Sequence[str], fields: Mapping[str, str], totals: Mapping[str, Column] | None = None,
                     page_rows: int | None = None) -> DataFrame:
    """Child rows as one array per key: ``(keys..., page, n, totals..., items)``, items in field order.

    ``n`` and the aggregates in ``totals`` cover all children of the key. Keys that may have too many children for one
    array are cut into pages of ``page_rows`` items by their order; totals stand on every page.
    """
    totals = totals or {}
    item = F.array_sort(F.collect_list(F.struct(*[named(source).alias(name) for name, source in fields.items()]))).alias("items")
    over_all = [F.count(F.lit(1)).alias("n"), *(c.alias(name) for name, c in totals.items())]
    by = [named(k) for k in keys]
    if page_rows is None:
        return items.groupBy(*by).agg(*over_all, item).select(*by, F.lit(0).cast("bigint").alias("page"), "n", *totals, "items")
    columns = list(dict.fromkeys([*keys, *fields.values()]))
    paged = with_pages(items.select(*[named(c) for c in columns]), keys, list(fields.values()), page_rows).groupBy(*by, "page").agg(item)
    whole = items.groupBy(*by).agg(*over_all).select(*[named(k).alias(f"_k{i}") for i, k in enumerate(keys)], "n", *totals)
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & named(k).eqNullSafe(F.col(f"_k{i}"))
    return paged.join(whole, on).select(*by, "page", "n", *totals, "items")
