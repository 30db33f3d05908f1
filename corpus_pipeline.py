"""The corpus pipeline: stages that each work on all that the one before kept.

A stage takes and returns the columns of ``documents``; other columns of its input are dropped. Each
stage's rows are written to the shared folder and read again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tellsift.llm import mixing, neardup, packing, quality_rules, resampling
from tellsift.llm.common import written
from tellsift.llm.queries import tokenizer_path
from tellsift.session import checkpoint_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Learned rules, drawn weights and tokens have no SQL; tests compare their operators with brute force.
ORACLE_SQL = None


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed limits and the learned rules."""
    judged = quality_rules.judge(docs.select(*COLUMNS), _labels(spark, sf_dir), with_rows=True)
    return judged.where("kept").select("row.*")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws. A document without an id is drawn or not like others."""
    drawn = resampling.resample(docs.select(*COLUMNS), _labels(spark, sf_dir), with_rows=True)
    return drawn.where("sampled").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest id.

    Rows are told apart by a number that is written first, so rows without an id and rows that share one are judged
    each for itself. Of a group an id goes before none, and of equal ids the first row stays. Texts without words are no copies.
    """
    docs = written(docs.select(*COLUMNS).withColumn("_number", F.monotonically_increasing_id()))
    found = neardup.near_duplicates(docs.select("_number", "text"), key="_number").select("_number", "component_id")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_number")).alias("_first")
    kept = docs.select("_number", "doc_id").join(found, "_number").groupBy("component_id").agg(first)
    return docs.join(kept.select("_first._number"), "_number", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of the sources takes it."""
    return mixing.repeat_rows(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places; a repeated document is packed as often."""
    return packing.pack_documents(docs.select("doc_id", "text"), tokenizer_path())


STAGES = [
    ("quality rules", rules), ("quality classifier", classifier), ("near duplicates", near_duplicates),
    ("mixing", mix), ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
