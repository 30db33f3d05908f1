"""Session helpers: a local session for tests, the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, app: str = "tellsift") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TELLSIFT_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: the one in ``spark.checkpoint.dir``.

    Where that setting is absent, a local session (tests) takes a temporary folder, and any other
    a folder beside the warehouse, which a cluster shares.
    """
    context = spark.sparkContext
    named = context.getCheckpointDir() or context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if context.master.startswith("local") and "cluster" not in context.master:
        return tempfile.mkdtemp(prefix="tellsift-ckpt-")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


#: Seconds between two sweeps, and when the last one was.
SWEEP_S = 10
_swept = 0.0


def _sweep(spark: SparkSession) -> None:
    """Let Spark delete shuffles and checkpoints that no plan needs any more.

    It does so only after the driver has collected its garbage, which it may not do before the disk is full. Called
    before a table is written, when what the tables before were made of isn't needed any more.
    """
    global _swept
    if time.monotonic() - _swept > SWEEP_S:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        _swept = time.monotonic()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(checkpoint_folder(df.sparkSession))
    _sweep(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """The same as ``cut_lineage`` by a Parquet table in that folder, which takes less room where values repeat."""
    path = f"{checkpoint_folder(df.sparkSession).rstrip('/')}/written-{uuid.uuid4().hex}"
    _sweep(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
