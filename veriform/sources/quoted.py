"""Delimited records with line breaks inside quotes, read by many tasks.

A line begins inside a quoted field if an odd number of quotes stands before it in its file. Each range of a file
counts its quotes; the prefix sums of these few counts tell which ranges begin inside quotes. Then every range puts its
lines together on its own, and only the record that crosses from one range into the next is put together from its parts.
"""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriform.session import scratch

# Ranges that begin inside quotes are sent to all tasks up to this number of them; beyond it, lines are joined to their range.
SENT = 100_000

# Parts of a record: the whole, its first lines, lines of its middle, its last lines.
WHOLE, OPEN, MIDDLE, CLOSE = range(4)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``start`` of the range, ``value``: lines in the order of the file within a range."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with ``inside`` (whether their range begins in quotes) -> parts of records, in order."""
    at, odd, role, leads = None, 0, OPEN, False
    held: list[str] = []  # lines of the record that is open

    def rows(values: pa.Array, parts: list[int], first: int) -> pa.RecordBatch:
        n = len(values)
        cols = [pa.array([at[0]] * n, pa.string()), pa.array([at[1]] * n, pa.int64()), pa.array(parts, pa.int8()), pa.array([i == first for i in range(n)], pa.bool_()), values]
        return pa.RecordBatch.from_arrays(cols, names=["file", "start", "part", "first", "value"])

    def left() -> Iterator[pa.RecordBatch]:
        if held:
            yield rows(pa.array(["\n".join(held)]), [role], 0 if leads else -1)

    for batch in batches:
        files, starts = batch.column("file"), batch.column("start").to_numpy()
        changes = np.diff(files.dictionary_encode().indices.to_numpy()) | np.diff(starts)
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), len(starts)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            here = (files[a].as_py(), int(starts[a]))
            if here != at:
                yield from left()
                at, held, odd = here, [], int(batch.column("inside")[a].as_py())
                role, leads = MIDDLE if odd else OPEN, here[1] == 0
            values = batch.column("value").slice(a, b - a)
            after = (odd + np.cumsum(pc.count_substring(values, '"').to_numpy(zero_copy_only=False))) & 1
            before = np.append(odd, after[:-1])
            odd = int(after[-1])
            alone = (before == 0) & (after == 0)
            blank = pc.equal(pc.utf8_trim_whitespace(values), "").to_numpy(zero_copy_only=False)
            texts, kinds, ends = [], [], []
            for i in np.flatnonzero(~alone).tolist():
                held.append(values[i].as_py())
                if not after[i]:
                    texts.append("\n".join(held))
                    kinds.append(CLOSE if role == MIDDLE else WHOLE)
                    ends.append(i)
                    held, role = [], OPEN
            single = np.flatnonzero(alone & ~blank)
            lead = leads and min([*single[:1].tolist(), *ends[:1]], default=-1)
            if len(single):
                yield rows(values.take(pa.array(single)), [WHOLE] * len(single), 0 if leads and lead == single[0] else -1)
            if texts:
                yield rows(pa.array(texts), kinds, 0 if leads and lead == ends[0] else -1)
            leads = leads and not len(single) and not texts
    yield from left()


def read_records(spark: SparkSession, path: str, max_sent: int = SENT) -> DataFrame:
    """``file``, ``first`` (the first record of its file), ``value``: records of delimited text, line breaks in quotes kept.

    Quotes stand around fields, and are doubled inside them. Files are read in ranges whose size is
    that of ``spark.sql.files.maxPartitionBytes``. A quote that is never closed makes the rest of its file one record.
    Blank lines between records are none. The carriage return of a line end is left out.
    """
    lines = _lines(spark, path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "start").agg(F.bit_xor(quotes.cast("long").bitwiseAND(F.lit(1))).alias("odd"))
    # One row for each range of a file, whatever its size.
    before = F.coalesce(F.sum("odd").over(Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    where = os.path.join(scratch(spark, "quotes"), "inside")
    ranges.withColumn("before", before % 2).where("before = 1").select("file", "start").write.parquet(where)
    inside = spark.read.schema("file string, start long").parquet(where).withColumn("inside", F.lit(1))
    if inside.count() <= max_sent:
        told = lines.join(F.broadcast(inside), ["file", "start"], "left")
    else:
        ordered = lines.withColumn("nth", F.monotonically_increasing_id())
        told = ordered.join(inside, ["file", "start"], "left").repartition("file", "start").sortWithinPartitions("file", "start", "nth")
    told = told.select("file", "start", "value", F.coalesce("inside", F.lit(0)).alias("inside"))
    parts = told.mapInArrow(_parts, "file string, start long, part byte, first boolean, value string")
    ending = F.regexp_replace("value", r"\r\z", "")
    whole = parts.where(F.col("part") == WHOLE).select("file", "first", ending.alias("value"))

    # Parts of records that cross ranges: at most two of each range. The number of openings so far tells the record.
    cut = parts.where(F.col("part") != WHOLE)
    openings = F.count(F.when(F.col("part") == OPEN, 1)).over(Window.partitionBy("file").orderBy("start", F.col("part") == OPEN))
    joined = cut.withColumn("record", openings).groupBy("file", "record").agg(
        F.array_sort(F.collect_list(F.struct("start", (F.col("part") == OPEN).alias("opens"), "value"))).alias("p"), F.bool_or("first").alias("first"))
    crossing = joined.select("file", "first", F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    crossing = crossing.select("file", "first", ending.alias("value"))
    return whole.unionByName(crossing)


def read_quoted(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: str | T.StructType | None = None) -> DataFrame:
    """Records as columns of the schema; without one, strings named by the header, which all files share, or ``_c0``, ``_c1`` ..."""
    records = read_records(spark, path)
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE"}
    if schema is None:
        one = (records.where("first") if header else records).select("value").first()
        fields = next(csv.reader(io.StringIO(one["value"], newline=""), delimiter=sep), []) if one else []
        schema = T.StructType([T.StructField(f if header else f"_c{i}", T.StringType()) for i, f in enumerate(fields)])
    ddl = schema if isinstance(schema, str) else schema.toDDL()
    if header:
        records = records.where(~F.col("first"))
    return records.select(F.from_csv("value", ddl, options).alias("r")).select("r.*")
