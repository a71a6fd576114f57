"""Answers that are asked for once: a store of files, keyed by what was asked.

A task writes answers as it gets them, a few per file, into a folder that stays. A later run, and a task that is run
again after a failure, asks only for what no file holds. Equal requests are one request. Failed calls are
not stored, so they are tried again by the next run.
"""

from __future__ import annotations

import io
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriform.session import scratch
from veriform.sources.folder import file_system

# Takes what was asked and returns (content, error, seconds, retries, failed); never raises.
Asker = Callable[[str], tuple]

STORED = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("content", T.StringType()), T.StructField("elapsed", T.DoubleType()), T.StructField("retries", T.IntegerType()),
])
ANSWERED = T.StructType([*STORED.fields, T.StructField("error", T.StringType()), T.StructField("failed", T.BooleanType())])
_FILE = pa.schema([("key", pa.string()), ("content", pa.string()), ("elapsed", pa.float64()), ("retries", pa.int32())])


# Bytes of requests that are taken out of a batch at once; a longer single one is taken alone.
PART_BYTES = 1 << 20


def parts(batch: pa.RecordBatch, column: str, limit: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with at most ``limit`` bytes in a text column, so that Python objects are made for few rows at once."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_string())), 0)
    ends, at = np.cumsum(sizes.to_numpy(zero_copy_only=False)), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, limit + (ends[at - 1] if at else 0), "right")))
        yield batch.slice(at, to - at)
        at = to


class Shelf:
    """The part of a store that one task of one run writes, whatever its attempt."""

    def __init__(self, folder: str):
        self.system, self.at = file_system(folder)

    def held(self) -> dict[str, tuple]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        out = {}
        for f in self.system.get_file_info(fs.FileSelector(self.at, allow_not_found=True)):
            if f.type == fs.FileType.File and not f.base_name.startswith("."):
                with self.system.open_input_file(f.path) as source:
                    t = pq.read_table(source).to_pydict()
                out.update(zip(t["key"], zip(t["content"], t["elapsed"], t["retries"], strict=True), strict=True))
        return out

    def put(self, rows: list[tuple]) -> None:
        import pyarrow.parquet as pq

        self.system.create_dir(self.at, recursive=True)
        name, data = f"{uuid.uuid4().hex}.parquet", io.BytesIO()
        pq.write_table(pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_FILE)], schema=_FILE), data)
        with self.system.open_output_stream(f"{self.at}/.{name}", compression=None) as out:
            out.write(data.getvalue())
        self.system.move(f"{self.at}/.{name}", f"{self.at}/{name}")


def stored(spark, store: str) -> DataFrame:
    """All answers of a store, each key once."""
    from pyarrow import fs

    system, at = file_system(store)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return spark.createDataFrame([], STORED)
    return spark.read.schema(STORED).option("recursiveFileLookup", "true").parquet(store).dropDuplicates(["key"])


def ask_once(df: DataFrame, asked: str, ask: Asker, store: str, tasks: int, save_every: int = 20) -> DataFrame:
    """``key``, ``content``, ``elapsed``, ``retries``, ``error``, ``failed``: the answer to each different text of a column.

    The key is the SHA-256 of the text; rows where it is null ask for nothing. Texts whose answers are stored
    are not sent to any task; the others are dealt to ``tasks`` tasks, which save every ``save_every`` answers.
    """
    spark = df.sparkSession
    system, at = file_system(store)
    system.create_dir(at, recursive=True)
    wanted = df.where(F.col(asked).isNotNull()).groupBy(F.sha2(asked, 256).alias("key")).agg(F.first(asked).alias("text"))
    # What is known is listed once, before this run adds to it.
    path = os.path.join(scratch(spark, "answers"), "known")
    stored(spark, store).join(wanted.select("key"), "key", "left_semi").write.parquet(path)
    known = spark.read.schema(STORED).parquet(path)
    run = f"{store.rstrip('/')}/{uuid.uuid4().hex}"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shelf = Shelf(f"{run}/{TaskContext.get().partitionId()}")
        held, fresh = shelf.held(), []
        try:
            for batch in (part for whole in batches for part in parts(whole, "text")):
                rows = []
                for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if key in held:
                        rows.append((key, *held[key], None, False))
                        continue
                    content, error, elapsed, retries, failed = ask(text)
                    rows.append((key, content, elapsed, retries, error, failed))
                    if not failed:
                        fresh.append((key, content, elapsed, retries))
                        if len(fresh) >= save_every:
                            shelf.put(fresh)
                            fresh = []
                kinds = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[f.name for f in ANSWERED])
        finally:
            if fresh:
                shelf.put(fresh)

    new = wanted.join(known, "key", "left_anti").repartition(tasks, "key").mapInArrow(work, ANSWERED)
    return known.select("*", F.lit(None).cast("string").alias("error"), F.lit(False).alias("failed")).unionByName(new)
