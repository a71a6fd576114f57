"""Session settings and the shared folders that jobs may write to."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "veriform", master: str | None = None, shuffle_partitions: int | None = None,
                  driver_memory: str | None = None) -> SparkSession:
    """A session with the settings the operators rely on.

    Shuffle width is left to AQE: it starts wide and coalesces to the advisory partition size, so
    the same job fits a laptop and a large cluster. Pass ``shuffle_partitions`` only for local runs.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if driver_memory:
        b = b.config("spark.driver.memory", driver_memory)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return (
        b.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Without call sites for every column expression, long rules are built in a fraction of the time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        configured = held.get() if held.isDefined() else None
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared root."""
    return os.path.join(shared_root(spark), f"{name}-{uuid.uuid4().hex[:12]}")


# Spark removes the shuffle files of an execution when it ends, not when the driver happens to collect its garbage.
_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, free: bool = False) -> DataFrame:
    """Compute once and cut the lineage with a reliable checkpoint (survives executor loss).

    With ``free``, the shuffle files that this took are removed at once.
    """
    spark = df.sparkSession
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        root = shared_root(spark)
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(root)
    if free:
        before = spark.conf.get(_FREE, None)
        spark.conf.set(_FREE, "true")
        try:
            df = df.select("*")  # a frame keeps the setting that it was made with
        finally:
            if before is None:
                spark.conf.unset(_FREE)
            else:
                spark.conf.set(_FREE, before)
    return df.checkpoint(eager=True)
