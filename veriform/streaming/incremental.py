"""Converting the files of a folder as they arrive, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriform.sources.documents import decode_dropping

BINARY_FILE = "path string, modificationTime timestamp, length bigint, content binary"
Convert = Callable[[DataFrame], DataFrame]


def convert_stream(
    spark: SparkSession, folder: str, pattern: str, convert: Convert, out: str, checkpoint: str, files_per_batch: int | None = None
):
    """Starts a query that converts all files not seen before and then stops.

    ``convert`` gets ``(file_path, value)`` and returns a table. A batch writes to a folder of its
    own number and replaces it when it is run again, so a failure between write and commit neither
    loses nor doubles a file. Run it again to pick up new files; the checkpoint holds what was done.
    """
    reader = spark.readStream.format("binaryFile").schema(BINARY_FILE).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    files = reader.load(folder).select(F.col("path").alias("file_path"), decode_dropping(F.col("content")).alias("value"))

    def write(batch: DataFrame, number: int) -> None:
        convert(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_converted(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.parquet(out)
