"""Searches over newly arriving files: the same operators on a stream, without state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from quarry.functions.patterns import Pattern
from quarry.operators.lines import find_matches


def stream_table(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Parquet files of a folder as they arrive, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_matches(files: DataFrame, pattern: Pattern, context: int = 0) -> DataFrame:
    return find_matches(files, pattern, context)


def deliver(matches: DataFrame, take: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Give each batch of matches to take(batch, number); what has been delivered is remembered in the checkpoint folder."""
    return matches.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_rate(events: DataFrame, literal: str, late: str = "10 minutes", span: str = "1 hour") -> DataFrame:
    """Matches of a literal in event properties for each window of event time, late rows allowed for."""
    hits = events.where(F.contains("props", F.lit(literal)) | F.contains("event_type", F.lit(literal)))
    return hits.withWatermark("ts", late).groupBy(F.window("ts", span)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")
