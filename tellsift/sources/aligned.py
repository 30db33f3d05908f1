"""Rows put side by side by their place in the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def read_with_position(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet rows of a folder or file with ``position``, from 0: files by name, rows in the order of their file.

    A row's place in its file comes from the reader and a file's first place from the files' row counts, so a lost task
    that runs again gives the same positions. Only one number per file is ordered in one task.
    """
    df = spark.read.parquet(path)
    if "position" in df.columns:
        raise ValueError("the table has a column named position")
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    files = rows.groupBy("_file").agg((F.max("_row") + 1).alias("_rows"))
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    return rows.join(files, "_file").select(*df.columns, (F.col("_before") + F.col("_row")).alias("position"))


def side_by_side(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of equal ``position`` as one; where one table is longer, the other's columns are null."""
    shared = (set(left.columns) & set(right.columns)) - {"position"}
    if shared:
        raise ValueError(f"both tables have {sorted(shared)}")
    return left.join(right, "position", "full")
