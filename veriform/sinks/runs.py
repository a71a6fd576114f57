"""Run logs and output names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriform.functions.values import base_name
from veriform.operators.mapping import named
from veriform.sinks.named_files import NamedFiles, committed
from veriform.sources.folder import register


def output_name(path: Column, timestamp: str, ext: str = "txt", distinct: Column | None = None) -> Column:
    """``{base name}-{YYYYmmdd-HHMMSS}.{ext}``.

    With ``distinct``, usually the full path, eight hash characters keep two inputs of the same
    name apart; without it they would overwrite each other.
    """
    base = base_name(path)
    stem = F.regexp_replace(base, r"^(.*[^.].*)\.[^.]*$", "$1")
    parts = [stem, F.lit("-" + timestamp)]
    if distinct is not None:
        parts += [F.lit("-"), F.substring(F.md5(distinct), 1, 8)]
    return F.concat(*parts, F.lit("." + ext))


def write_run_log(results: DataFrame, path: str, run_date: str, run_id: str) -> None:
    """Appends one JSON record per document under ``run_date=/run_id=``; running again replaces that run only."""
    stamped = results.withColumn("run_date", F.lit(run_date)).withColumn("run_id", F.lit(run_id))
    (
        stamped.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("ignoreNullFields", "false")
        .partitionBy("run_date", "run_id").json(path)
    )


def read_run_log(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_outputs(results: DataFrame, folder: str, name: str = "output_name", output: str = "output") -> DataFrame:
    """Writes each output as a file of its name in ``folder`` and adds ``output_path`` to the results.

    Only rows with status ``success`` are written; the path of others is null. A file that cannot be written, has no name, or whose
    name is taken by another content, is ``save_failed``; files of earlier runs stay as they are. Names must
    differ within a run; :func:`output_name` with ``distinct`` makes such names.
    """
    spark = results.sparkSession
    register(spark, NamedFiles)
    lists = f"{folder.rstrip('/')}/_lists/{uuid.uuid4().hex}"
    saved = results.where("status = 'success'").select(named(name).alias("output_name"), named(output).cast("binary").alias("content"))
    saved.write.format(NamedFiles.name()).option("lists", lists).mode("append").save(folder)
    done = committed(lists)["lists"]
    listed = spark.read.schema("output_name string, path string").json([f"{lists}/{one}" for one in done]) if done else spark.createDataFrame([], "output_name string, path string")
    # A name that is listed twice is there once if its contents were the same, and told of both otherwise.
    there = listed.groupBy(F.col("output_name").alias("_saved")).agg(F.when(F.count(F.lit(1)) == F.count("path"), F.first("path")).alias("_path"))
    joined = results.join(there, named(name) == F.col("_saved"), "left")
    path = F.when(F.col("status") == "success", F.coalesce("_path", F.lit("save_failed")))
    return joined.withColumn("output_path", path).drop("_saved", "_path")
