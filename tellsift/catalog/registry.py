"""Registry of queries and shared inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its equivalent SQL."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def load(spark: SparkSession, path: str) -> DataFrame:
    """A table for a registered query.

    The tables that come with the queries are files of a single row group, which one task reads; their rows
    are dealt to all cores once. The library's own readers never do this.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def r6(column, name: str):
    return F.round(column, 6).alias(name)


def filings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as filings: the source is the firm, the language stands for the form type."""
    return load(spark, f"{sf}/documents.parquet").select(
        F.col("doc_id").alias("idx"),
        F.col("source").alias("cik"),
        F.col("lang").alias("form_type"),
        F.col("text").alias("filtered_text"),
    )


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, f"{sf}/labels.parquet").select(
        F.col("doc_id").alias("idx"),
        F.col("quality").alias("Incident"),
        F.col("toxic").alias("Immaterial"),
    )


def notices(spark: SparkSession, sf: str) -> DataFrame:
    """One filing per order, worded from the order, its customer and nation.

    The documents hold no tickers, addresses, amounts or list items; these do.
    """
    orders = load(spark, f"{sf}/orders.parquet")
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")
    )
    # the rows are short and what is done with them is long, so they aren't left in the few tasks that their bytes make up
    joined = joined.repartition(4 * spark.sparkContext.defaultParallelism)
    segment = F.lower("c_mktsegment")
    text = F.concat(
        F.lit("On "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(", "), F.col("c_name"),
        F.lit(" (NYSE: "), F.substring("c_mktsegment", 1, 4), F.lit(") filed Form "),
        F.when(F.col("o_orderstatus") == "F", "8-K").otherwise("10-K"),
        F.lit(" with the Securities and Exchange Commission.\nThe company reported that hackers had accessed data worth $"),
        F.floor("o_totalprice").cast("bigint").cast("string"),
        F.lit(" million; (a) a "), F.lower("o_orderpriority"),
        F.lit(" notice was not sent; and (iv) about "), (F.col("o_custkey") % 90 + 1).cast("string"),
        F.lit("% of three customers' records in "), F.col("n_name"),
        F.lit(" were disclosed: see www."), segment, F.lit(".com or mail ir"),
        F.col("c_custkey").cast("string"), F.lit("@"), segment,
        F.lit(".com. It doesn't expect a very harmful breach, said the U.S. Department of Justice ("),
        F.col("n_name"), F.lit(" v. Acme Holdings, Inc.) and Data Agreement Corp. Stolen data may have been sold."),
    )
    return joined.select(
        F.col("o_orderkey").alias("idx"), F.col("c_name").alias("cik"), text.alias("filtered_text")
    )
