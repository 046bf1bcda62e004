"""Tables read as file trees and histories, so that every search runs on them too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.paths import is_binary


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(files: DataFrame) -> DataFrame:
    """Rows that a scan gives to fewer tasks than there are cores, for work that costs more than a shuffle of them, are dealt out
    first; larger scans are left as they are."""
    cores = files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(cores) if files.select(F.lit(1)).rdd.getNumPartitions() < cores else files


#: Rows of a partition at most, about, where each becomes a file.
ROWS = 10_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """Rows dealt out by a key, so many to each task: a compact table's scan gives all to a few tasks, whose memory would grow with it."""
    n = -(-rows.count() // ROWS)
    return rows.repartition(n, key) if n > 1 else rows


def as_files(df: DataFrame, path, content) -> DataFrame:
    return df.select(path.alias("path"), path.alias("rel_path"), content.alias("content"), is_binary(content.cast("binary")).alias("is_binary"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source/doc_N.lang; what is null in a name is left empty, null texts are empty files."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    path = F.concat(named("source"), F.lit("/doc_"), named("doc_id"), F.lit("."), named("lang"))
    return as_files(table(spark, sf_dir, "documents"), path, F.coalesce("text", F.lit("")))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "pages"), F.col("url"), F.col("html"))


def chat_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversation/turn.role"""
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("."), F.col("role"))
    return as_files(table(spark, sf_dir, "conversations"), path, F.col("text"))


def order_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits, customers as authors."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    joined = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return joined.select(
        F.lit("orders").alias("repo"),
        F.col("o_orderkey").cast("string").alias("hash"),
        F.col("c_name").alias("author_name"),
        F.concat(F.lower("c_mktsegment"), F.lit("@example.com")).alias("author_email"),
        F.col("o_orderdate").alias("author_when"),
        F.col("o_orderpriority").alias("message"),
        F.lit(None).cast("string").alias("first_parent"),
    )


def line_commit_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    return items.select(F.lit("orders").alias("repo"), F.col("l_orderkey").cast("string").alias("hash"), F.col("l_partkey").cast("string").alias("path"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_files(table(spark, sf_dir, "part"), F.col("p_partkey").cast("string"), F.col("p_name"))
