"""Near duplicates by SimHash, found with deletion-variant signatures.

A text's fingerprint has a bit set where more than half of its shingles' 64-bit hashes have it set.
Fingerprints are linked at three differing bits or fewer. Cut into two halves, at least one half then
differs by one bit at most, so the pair shares one of that half's 32 variants in which one bit is left
out. Distinct fingerprints are indexed by all 64 variants and joined on equality; the whole
fingerprints are compared in the join, and each pair is accepted under just one variant.

Signatures shared by many fingerprints (groups of near copies) are not joined within: there, the
variants are extended by those of quarters of the other half, one of which again differs by one bit
at most, and only equal extended signatures are joined.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other; texts of one or
two words have one shingle; repeated rows share a fingerprint; whole texts count; null ids get the
component of their fingerprint; extra columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_texts, partitions, stored
from quarry.llm.components import components

#: Signatures with more fingerprints than this are extended; it bounds the pairs looked at, not the result.
CROWD = 64


def set_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set, in eight-bit lanes of 255 rows at a time."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 64):
        part = hashes[at : at + 255 * 64]
        lanes = np.unpackbits(part.view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        for k in range(0, len(lanes), 255):
            total += lanes[k : k + 255].sum(0, dtype=np.uint64).view(np.uint8).astype(np.int64)
    return total


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of the word shingles, ASCII letters in lower case."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    hashes = np.fromiter([digest(line[a:b], 42) for a, b in spans], np.uint64, n)
    bits = set_counts(hashes) * 2 > n
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """Append each whole text's fingerprint as a (signed) long."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64), pa.int64())]

    return map_texts(docs.drop(out), text, f"{out} long", make)


def without_bit(value: Column, bit: Column) -> Column:
    return value.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))))


def half(fp: Column, upper: Column) -> Column:
    return F.when(upper, F.shiftrightunsigned(fp, 32)).otherwise(fp.bitwiseAND(F.lit(0xFFFFFFFF)))


def one_bit_at(diff: Column, bit: Column) -> Column:
    """diff is that bit alone, or nothing and the bit is 0: one variant for each accepted pair."""
    alone = F.call_function("shiftleft", F.lit(1).cast("long"), bit.cast("int"))
    return (diff == alone) | ((diff == 0) & (bit == 0))


def similar_pairs(fps: DataFrame) -> DataFrame:
    """fps: distinct fp -> pairs (a, b), a < b, that differ in one to three bits; each pair once."""
    variants = F.explode(F.sequence(F.lit(0), F.lit(63)))
    dealt = fps.repartition(partitions(fps.sparkSession), F.xxhash64("fp"))  # each row becomes 64; by a key of its own, or the planner drops the step
    index = dealt.select("fp", variants.alias("v")).withColumn("bit", F.col("v") % 32).withColumn("upper", F.col("v") >= 32)
    index = index.select("fp", "v", without_bit(half(F.col("fp"), F.col("upper")), F.col("bit")).alias("key"))
    crowd = index.groupBy("v", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = index.join(crowd, ["v", "key"])

    def accepted(first: str, second: str, v: str) -> Column:
        diff = F.col(first).bitwiseXOR(F.col(second))
        upper, bit = F.col(v) >= 32, F.col(v) % 32
        here = half(diff, upper)
        # a pair that both halves could find is the upper half's
        return (F.col(first) < F.col(second)) & (F.bit_count(diff) <= 3) & one_bit_at(here, bit) & (upper | (F.bit_count(half(diff, F.lit(True))) > 1))

    few = shared.where(F.col("n") <= CROWD).select("v", "key", "fp")
    plain = few.alias("x").join(few.alias("y"), (F.col("x.v") == F.col("y.v")) & (F.col("x.key") == F.col("y.key")) & accepted("x.fp", "y.fp", "x.v"))
    # In crowds the other half is cut into two quarters of 16 bits with variants of their own.
    more = F.explode(F.sequence(F.lit(0), F.lit(31)))
    many = shared.where(F.col("n") > CROWD).select("fp", "v", "key", more.alias("w"))
    other = half(F.col("fp"), F.col("v") < 32)
    quarter = F.when(F.col("w") >= 16, F.shiftrightunsigned(other, 16)).otherwise(other.bitwiseAND(F.lit(0xFFFF)))
    many = many.select("fp", "v", "key", "w", without_bit(quarter, F.col("w") % 16).alias("more"))
    diff = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    rest = half(diff, F.col("x.v") < 32)
    high = F.shiftrightunsigned(rest, 16)
    low = rest.bitwiseAND(F.lit(0xFFFF))
    in_high = F.col("x.w") >= 16
    once = one_bit_at(F.when(in_high, high).otherwise(low), F.col("x.w") % 16) & (in_high | (F.bit_count(high) > 1))
    same = (F.col("x.v") == F.col("y.v")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.w") == F.col("y.w")) & (F.col("x.more") == F.col("y.more"))
    crowded = many.alias("x").join(many.alias("y"), same & accepted("x.fp", "y.fp", "x.v") & once)
    return plain.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).unionByName(crowded.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")))


def text_marks(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp, root (the component's smallest fingerprint), component_id (its smallest doc_id), and two hashes
    of the text (t1, t2), by which a row is found again."""
    named = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), *text_marks(F.col(text)))
    rows, _ = stored(fingerprints(named, shingle=shingle).select("doc_id", "fp", "t1", "t2"))
    fps = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = components(similar_pairs(fps.select("fp")))
    rooted = fps.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    known = rooted.select("fp", "root").join(least, "root").select("fp", "root", "component_id")
    return rows.join(known, "fp").select("doc_id", "fp", "root", "component_id", "t1", "t2")
