"""A corpus prepared for training: five stages, each written and read again before the next one.

``STAGES`` lists them; each takes (spark, docs, sf_dir) and returns the documents it keeps, in the columns of
``documents``. The last returns, besides, how often the mix takes each document. SQL cannot express the stages
(learned scores, fingerprints, min-hashes), so ``ORACLE_SQL`` is None; tests hold each stage against its operator and planted cases.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriform.llm import decontaminate, quality_model, simhash, source_mix, substring_dedup
from veriform.session import scratch

QUALITY = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_model.good_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.one_per_component(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that another document keeps are cut out; documents with nothing left go."""
    return substring_dedup.without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with ``copies``: how often."""
    return source_mix.mixed_rows(docs).where(F.col("copies") > 0)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("benchmark", benchmark), ("mixture", mixture)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder; what each returns is written as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = scratch(spark, "pipeline")
    for i, (name, stage) in enumerate(STAGES):
        path = os.path.join(root, f"{i}-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
