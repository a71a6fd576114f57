"""Rows whose key changed: lost rows paired one to one with added rows that hold the same values.

Rows are met by blocks, not compared with each other: first by all of their fields, then by all but one. Within a
block, lost and added rows are paired by their place in order, so a block of many equal rows gives as many
pairs as it has rows on its smaller side, and never all of their combinations.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriform.operators.mapping import named
from veriform.operators.paging import numbered
from veriform.operators.reconcile import missing_rows
from veriform.session import materialise


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, [x.eqNullSafe(y) for x, y in zip(left, right, strict=True)], F.lit(True))


def one_sided_rows(source: DataFrame, output: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the source whose key the output does not have, and rows of the output whose key the source does not have; copies included."""
    lone = materialise(missing_rows(source, output, keys).where("kind <> 'copies'"))

    def rows(df: DataFrame, kind: str) -> DataFrame:
        wanted = lone.where(F.col("kind") == kind).select(*[named(k).alias(f"_w{i}") for i, k in enumerate(keys)])
        picked = df.select(*[named(c) for c in [*keys, *fields]])
        return picked.join(wanted, _same([named(k) for k in keys], [F.col(f"_w{i}") for i in range(len(keys))]), "left_semi")

    return rows(source, "lost"), rows(output, "added")


def paired_rows(source: DataFrame, output: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """``(lost_<key>..., added_<key>..., changed)``: each lost row with the added row that took its place.

    Pairs that agree in all fields come first and have no ``changed`` field; then, field by field in the order given, those
    that agree in all others. In a block, rows are taken in the order of key and fields. A row is in one pair at most; rows
    with no partner are in none. Fields that are null agree with null.
    """
    if not fields:
        raise ValueError("rows are paired by their fields")
    every = [*keys, *fields]
    sides = {}
    for side, rows in zip(("lost", "added"), one_sided_rows(source, output, keys, fields), strict=True):
        sides[side] = materialise(rows.toDF(*[f"{side}_{c}" for c in every]).withColumn(f"_{side}", F.monotonically_increasing_id()))
    shown = [f"{side}_{k}" for side in sides for k in keys]
    # With one field, rows that agree in no field are not a pair.
    rounds = [None, *(fields if len(fields) > 1 else ())]
    pairs = None
    for changed in rounds:
        block = [f for f in fields if f != changed]
        placed = []
        for side, rows in sides.items():
            left = rows if pairs is None else rows.join(pairs.select(f"_{side}"), f"_{side}", "left_anti")
            placed.append(numbered(left, [f"{side}_{f}" for f in block], [f"{side}_{c}" for c in every], f"_{side}_place"))
        lost, added = placed
        on = _same([named(f"lost_{f}") for f in block], [named(f"added_{f}") for f in block]) & (F.col("_lost_place") == F.col("_added_place"))
        found = lost.join(added, on).select(*[named(c) for c in shown], F.lit(changed).cast("string").alias("changed"), "_lost", "_added")
        pairs = materialise(found if pairs is None else pairs.unionByName(found))
    return pairs.drop("_lost", "_added")
