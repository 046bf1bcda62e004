"""Helpers shared by the corpus operators: shared-folder tables, word splitting, batched text mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.shared import new_folder

#: A word is a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Write df as a table in the shared folder and read it back: lineage ends there, and losing executors costs nothing."""
    path = new_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, path: str) -> None:
    """Remove a table that stored() made and nothing reads any more."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_of(column: Column, modulus: int) -> Column:
    """crc32 of the column as text, modulo: the train and held-out split; null for null."""
    return F.crc32(column.cast("string").cast("binary")) % modulus


def word_count(text: Column) -> Column:
    """Words in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def map_texts(df: DataFrame, text: str, schema: str, make: Callable[[], Callable[[list], list[pa.Array]]], step: int = 512) -> DataFrame:
    """Append columns computed from df[text], a batch at a time.

    make() runs once in each task and returns a function from a list of texts (None for null) to
    one Arrow array per new column; it gets step texts at a time. The other columns of df pass through unchanged.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    source = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                made = work(part.column(source).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *names])
            pa.default_memory_pool().release_unused()

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(run, f"{fields}, {schema}")
