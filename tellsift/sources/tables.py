"""Reading and writing filings, results and models."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

FILE_NAME = r"([^/]*?)_([0-9A-Za-z\-]+)_(\d{4})\.csv$"


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of the given files or folders that exist, on whatever file system they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    kept = []
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(conf).globStatus(where):
            kept.append(path)
    return kept


def _csv(spark, paths: list[str], encoding: str, schema, with_file: bool, options: dict) -> DataFrame:
    latin = encoding.lower() in ("cp1252", "windows-1252")
    reader = spark.read.options(
        header=True, multiLine=True, escape='"', encoding="ISO-8859-1" if latin else encoding, **options
    )
    df = (reader.schema(schema) if schema is not None else reader).csv(paths)
    if latin:
        df = df.select(*[_from_latin1(df, name, kind) for name, kind in df.dtypes], *([F.col("_metadata.file_name").alias("file")] if with_file else []))
        return df
    return df.withColumn("file", F.col("_metadata.file_name")) if with_file else df


def _from_latin1(df: DataFrame, name: str, kind: str) -> Column:
    """cp1252 text that was read as Latin-1: the 32 control codes there are signs here.

    Spark reads Latin-1 in every session, cp1252 only with a session-wide setting.
    """
    codes = [c for c in range(0x80, 0xA0) if bytes([c]).decode("cp1252", "ignore")]
    signs = bytes(codes).decode("cp1252")
    column = F.translate(F.col(f"`{name}`"), "".join(map(chr, codes)), signs) if kind == "string" else F.col(f"`{name}`")
    return column.alias(name)


def read_csv(
    spark: SparkSession,
    paths: str | list[str],
    schema: StructType | str | None = None,
    encoding: str | None = None,
    with_file: bool = False,
    **options,
) -> DataFrame | None:
    """CSV files with a header; fields may hold line ends and doubled quotes.

    Without ``encoding`` each file is read as UTF-8 where all its bytes are valid UTF-8, and as
    cp1252 otherwise; without ``schema`` files are read together where their first lines are equal, and the columns of
    different headers are matched by name. Either takes one more scan of the bytes, for all files at once. Only files that are not empty count;
    without any, the result is an empty table of ``schema``, or None when no schema is given.
    ``with_file`` adds the file name as ``file``.
    """
    paths = existing(spark, [paths] if isinstance(paths, str) else paths)
    groups: dict[tuple[str, str], list[str]] = {}
    if paths and encoding is not None and schema is not None:
        groups[encoding, ""] = paths
    elif paths:
        # One row per file comes to the driver, as its file listing does anyway.
        place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        checks = (
            spark.read.text(paths)
            .select(F.col("_metadata.file_path").alias("file"), "value", place.alias("place"))
            .groupBy("file")
            .agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.hex(F.min_by("value", "place")).alias("header"))
        )
        for row in checks.toLocalIterator():
            kind = encoding or ("UTF-8" if row.utf8 else "windows-1252")
            groups.setdefault((kind, row.header if schema is None else ""), []).append(row.file)
    frames = [_csv(spark, files, enc, schema, with_file, options) for (enc, _), files in sorted(groups.items())]
    if not frames:
        return None if schema is None else spark.createDataFrame([], schema)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_csv(
    spark: SparkSession, paths: list[str], out: str | None = None, schema=None, **options
) -> DataFrame:
    """Union by name of the listed files that exist, written to ``out`` when given; one scan per distinct header."""
    merged = read_csv(spark, paths, schema=schema, **options)
    if merged is None:
        raise ValueError("none of the files exists or has content; give a schema")
    if out:
        write_table(merged, out)
    return merged


def file_parts(df: DataFrame, path_col: str = "path") -> DataFrame:
    """Add ``tag``, ``form_type`` and ``year`` from names like ``{tag}_{form_type}_{year}.csv``."""

    def part(i: int):
        found = F.regexp_extract(F.col(path_col), FILE_NAME, i)
        return F.when(found != "", found)

    return df.select("*", part(1).alias("tag"), part(2).alias("form_type"), part(3).cast("int").alias("year"))


def find_forms(
    spark: SparkSession, folder: str, form_types: list[str], tag: str = "breach", year: int | str = "all"
) -> list[str]:
    """Globs of the input files of the form types, by name and optionally by year."""
    tail = "*" if year == "all" else f"_{year}"
    return existing(spark, [f"{folder}/{tag}_{form}{tail}.csv" for form in form_types])


def with_row_key(df: DataFrame, name: str = "idx") -> DataFrame:
    """Add a key of 60 bits, a hash of all columns in order of their names. It needs no shuffle."""
    values = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    return df.withColumn(name, F.conv(F.substring(F.md5(values), 1, 15), 16, 10).cast("long"))


def read_filings(
    spark: SparkSession,
    folder: str,
    form_types: list[str],
    tag: str = "breach",
    year: int | str = "all",
    schema: StructType | str | None = None,
) -> DataFrame | None:
    """All files of the form types in one table with ``file``, ``form_type``, ``year`` and the key ``idx``.

    Files without a column ``idx`` get one from the file's name and the row's values, the same in every
    run; equal rows of one file share it.
    """
    globs = find_forms(spark, folder, form_types, tag, year)
    df = read_csv(spark, globs, schema=schema, with_file=True) if globs else None
    if df is None:
        return None
    if "idx" not in df.columns:
        df = with_row_key(df)
    wanted = file_parts(df.drop("form_type", "year", "tag"), "file")
    return wanted.where(F.col("form_type").isin(form_types))


def write_table(
    df: DataFrame, path: str, fmt: str | None = None, mode: str = "overwrite", by: list[str] | None = None
) -> str:
    """Write CSV or Parquet (by the path's ending), partitioned by ``by``."""
    fmt = fmt or ("csv" if path.rstrip("/").endswith(".csv") else "parquet")
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(header=True, escape='"', encoding="UTF-8")
    if by:
        writer = writer.partitionBy(*by)
    writer.save(path)
    return path


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A Parquet table, or None when it has not been written yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
