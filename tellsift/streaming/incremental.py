"""Score files as they arrive, each once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def score_new_files(
    spark: SparkSession,
    folder: str,
    schema: str,
    score: Callable[[DataFrame], DataFrame],
    out: str,
    checkpoint: str,
    fmt: str = "parquet",
    files_per_batch: int = 1000,
    mode: str = "append",
    **options,
) -> StreamingQuery:
    """Score all files of ``folder`` that no earlier run has finished, then stop.

    ``score`` is a batch plan on one micro-batch, so it may aggregate and join. A batch that was
    broken off is run again into the same folder ``batch=<n>``, which it overwrites, so every file
    counts once.
    """
    stream = (
        spark.readStream.format(fmt)
        .schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .options(**options)
        .load(folder)
    )

    def write(batch: DataFrame, number: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def pending(filings: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    """Batch form: rows of the files that are not in the list of finished ones."""
    return filings.join(done.select(F.col(key)).distinct(), key, "left_anti")
