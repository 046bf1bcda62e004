"""A corpus pipeline: language ID, near-duplicate removal, substring removal, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as a
table in the shared folder and gives it to the next. All stages but the last return the columns of
documents. Texts that a stage shortens get a new n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm import bpe, langid, mixing, simhash, substring
from quarry.llm.common import bucket_of, release, stored
from quarry.llm.queries import VOCABULARY


def unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores before it as no column of docs has."""
    while name in docs.columns:
        name = "_" + name
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; those without letters are rejected. Rows keep their lang, a
    null lang is filled with the prediction."""
    held_out = F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    found, score = unused(docs, "found"), unused(docs, "score")
    known = langid.identify(docs, model, lang=found, score=score).where(F.col(found) != langid.UNKNOWN)
    return known.select(*[F.coalesce("lang", found).alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id (one without only where
    no other has any), of several with that id and text the first in the order of all columns."""
    groups = simhash.near_duplicates(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "t1", "t2"))
    own = lambda column: F.coalesce(column, F.lit(substring.NO_ID))
    i, a, b, n = by = [unused(docs, name) for name in ("i", "a", "b", "n")]
    by = by[:3]
    kept = groups.groupBy("root").agg(least.alias("k")).select(own(F.col("k.doc_id")).alias(i), F.col("k.t1").alias(a), F.col("k.t2").alias(b))
    t1, t2 = simhash.text_marks(F.col("text"))
    met = docs.withColumn(i, own(F.col("doc_id"))).withColumn(a, t1).withColumn(b, t2).join(kept, by)
    one = Window.partitionBy(*by).orderBy(*docs.columns)
    return met.withColumn(n, F.row_number().over(one)).where(F.col(n) == 1).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words of repeated passages; those that nothing is left of go."""
    kept = substring.remove_repeats(docs, also=[c for c in docs.columns if c not in ("doc_id", "text")], as_is=True)
    kept = kept.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    new = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))}
    return kept.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of training positions."""
    return mixing.takes(docs, mixing.mix(docs))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids, and whether decoding these gives back the text."""
    path = public_tokenizers.path(VOCABULARY)
    plain = bpe.round_trip(docs, path, public_tokenizers.PATTERN, data=(held := unused(docs, "decoded")), spaced=True)
    exact = F.col(held) == F.coalesce("text", F.lit("")).cast("binary")
    return plain.select(*docs.columns, "ids", F.size("ids").cast("long").alias("n_tokens"), exact.alias("exact"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixing_sources),
    ("byte_bpe", byte_bpe),
]

#: SQL can't express the stages; tests/llm holds them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for _, stage in STAGES[:-1]:
        docs, at = stored(stage(spark, docs, sf_dir))
        if before:
            release(spark, before)
        before = at
    return STAGES[-1][1](spark, docs, sf_dir)
