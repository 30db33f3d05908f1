"""A user's own function over chunks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructField, StructType

from tellsift.session import cut_lineage

#: Bytes of the rows that a function is given at a time; a longer row comes alone.
CHUNK_BYTES = 2**24


def map_chunks(
    df: DataFrame,
    function: Callable[[pd.DataFrame], pd.DataFrame],
    schema: StructType | str,
    keys: tuple[str, ...] = ("idx",),
    chunk_bytes: int = CHUNK_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """``function`` over all rows: the table of results, and the table ``(keys, error)`` of rows on which it failed.

    ``function`` gets some rows at a time, with all columns, and returns as many rows, in the same order, with the columns of
    ``schema``; the keys are carried past it. Where it raises, returns another number of rows or values that ``schema`` can't
    hold, the chunk is halved until the failing rows stand alone, so all others keep their result. Running out of memory
    isn't a row's fault and fails the task. Results are written once, since both tables are read from them; an empty
    table gives two empty ones. Results of a row mustn't hang on the other rows of its chunk.
    """
    wanted = schema if isinstance(schema, StructType) else df.sparkSession.createDataFrame([], schema).schema
    clash = {"_error", *keys} & set(wanted.names)
    if clash:
        raise ValueError(f"the function's columns may not be named {sorted(clash)}")
    names = list(keys)
    result = to_arrow_schema(wanted)

    def run(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        try:
            out = function(rows.to_pandas())
            if len(out) != rows.num_rows:
                raise ValueError(f"{len(out)} rows for {rows.num_rows}")
            columns = pa.RecordBatch.from_pandas(out[result.names], result, preserve_index=False).columns
            errors = pa.nulls(rows.num_rows, "string")
        except MemoryError:
            raise
        except Exception as failure:  # noqa: BLE001 - whatever a user's function raises goes to the side table
            if rows.num_rows > 1:
                yield from _halves(rows, run)
                return
            columns = [pa.nulls(1, kind) for kind in result.types]
            errors = pa.array([f"{type(failure).__name__}: {failure}"], "string")
        held = [rows.column(rows.schema.get_field_index(k)) for k in names]
        yield pa.RecordBatch.from_arrays([*held, *columns, errors], [*names, *result.names, "_error"])

    def bounded(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if rows.num_rows > 1 and rows.nbytes > chunk_bytes:
            yield from _halves(rows, bounded)
        else:
            yield from run(rows)

    def of_task(batches):
        for batch in batches:
            if batch.num_rows:
                yield from bounded(batch)

    full = StructType([*df.select(*names).schema.fields, *(StructField(f.name, f.dataType) for f in wanted.fields)]).add("_error", "string")
    done = cut_lineage(df.mapInArrow(of_task, full))
    failed = F.col("_error").isNotNull()
    return done.where(~failed).drop("_error"), done.where(failed).select(*names, F.col("_error").alias("error"))


def _halves(rows: pa.RecordBatch, then) -> Iterator[pa.RecordBatch]:
    middle = rows.num_rows // 2
    yield from then(rows.slice(0, middle))
    yield from then(rows.slice(middle))
