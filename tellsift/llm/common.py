"""Inputs and small expressions shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tellsift.session import checkpoint_folder, cut_lineage

__all__ = ["SPACE", "cut_lineage", "hinted", "n_words", "read", "remainder", "whole_row", "words", "written"]

SPACE = r"\x20\x09-\x0D"
_TRIM = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf: str, table: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet").select(*columns)


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_TRIM))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"[{SPACE}]+"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key written as text, modulo ``divisor``: the split into training and held-out rows."""
    return F.crc32(key.cast("string").cast("binary")) % divisor


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as one struct, so that an operator's own columns clash with none."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it again.

    For loops: a checkpointed table keeps the constraints of the plan that made it, and these grow from
    round to round; a table that is read again has none.
    """
    path = f"{checkpoint_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hinted(small: DataFrame, limit: int = 100_000) -> DataFrame:
    """A written table with a broadcast hint if it has at most ``limit`` narrow rows; joins on it give
    the same rows either way."""
    return F.broadcast(small) if small.limit(limit + 1).count() <= limit else small
