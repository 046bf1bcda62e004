"""The registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, fim, langid, licenses, mixing, nearest, negatives, simhash, substring, toxicity, vector_dedup, wordpiece
from quarry.llm.common import bucket_of

#: The vocabulary's file name among the public tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; null texts count as empty."""
    path = public_tokenizers.path(VOCABULARY)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    plain = bpe.round_trip(docs, path, public_tokenizers.PATTERN, spaced=True)
    digits = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return plain.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens: greedy word-pieces of the vocabulary; 0 for null and empty texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wordpiece.count_tokens(docs, public_tokenizers.path(VOCABULARY), inner_start=True).select("doc_id", "n_tokens")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(False)))
    model = langid.fit(docs.where("not held_out"))
    return langid.identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")


def virtual_files(docs: DataFrame) -> DataFrame:
    """Documents as a file tree: source / language / a hundred neighbours / file; ids divisible by 97 are licence files."""
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"))
    name = F.when(F.col("doc_id") % 97 == 0, F.concat(F.lit("sub"), (F.col("doc_id") % 2).cast("string"), F.lit("/LICENSE"))).otherwise(F.concat(F.lit("sub"), (F.col("doc_id") % 2).cast("string"), F.lit("/doc_"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", F.concat(folder, F.lit("/"), name).alias("path"), "text")


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, license, score, origin, license_path of documents read as a file tree."""
    files = virtual_files(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text"))
    return licenses.scan_licences(files.select("path", "text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_position, last_position, range-sorted by position."""
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_position", "last_position").orderBy("first_position", "doc_id")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    kept = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", F.coalesce(bucket_of(F.col("doc_id"), 5) == 0, F.lit(False)))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(bucket_of(F.col("doc_id"), 5) != 0)
    scored = toxicity.score_documents(docs, toxicity.fit(docs.where("not held_out"), labels))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    return vector_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    made = fim.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    whole = fim.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(whole, 256).alias("restored_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op13_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(chat.ADDED, "conv_id long, turn long, role string, text string"))
    return chat.digests(chat.format_conversations(rows))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_byte_bpe": op1_byte_bpe,
        "op2_token_counts": op2_token_counts,
        "op3_language_id": op3_language_id,
        "op4_license_scans": op4_license_scans,
        "op5_mixing": op5_mixing,
        "op6_nearest_neighbours": op6_nearest_neighbours,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_toxicity": op8_toxicity,
        "op9_embedding_near_dedup": op9_embedding_near_dedup,
        "op10_simhash_near_dedup": op10_simhash_near_dedup,
        "op11_fill_in_middle": op11_fill_in_middle,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_chat_formatting": op13_chat_formatting,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.MIX_SQL, "op11_fill_in_middle": fim.FIM_SQL, "op12_hard_negatives": negatives.NEGATIVES_SQL, "op13_chat_formatting": chat.CHAT_SQL}
