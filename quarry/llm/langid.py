"""Language identification with blended-spectrum string kernels.

Two texts are compared by the 1- to 3-grams of letters that both contain (presence, not counts),
divided by the root of the product of how many each contains. A bounded number of landmark texts
(Nyström) turns that kernel into a feature map, on which one-versus-rest kernel ridge regression is
fitted. Scoring is two matrix products for each batch: grams x landmarks, landmarks x languages.

Training reads the ids and languages of all training rows to choose a bounded, hash-ordered set
(per_class for each language), then copies the chosen rows to a small table and works on their whole texts on the
executors; the driver gets landmark grams and kernel rows only. Of rows that share id and language one
text is learned from, the smallest, so that the bound holds for rows too.

Edge cases: null, empty and letterless texts get `und` with score 0; with nothing to learn from (no
training row with a language, or none of those chosen with letters), every row gets `und`; whole texts count, of any length; equal texts get equal answers, ties between
languages go to the smaller name; extra columns pass through, output columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_texts, release, stored

#: Grams fall into 2**BITS cells by a fixed mixing of their code points.
BITS = 18
UNKNOWN = "und"


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each 16-bit code point its lower case if it is a letter, else a space."""
    table = np.full(1 << 16, 32, np.uint32)
    for point in range(1 << 16):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def grams(text: str | None) -> np.ndarray:
    """Cells of the 1-, 2- and 3-grams of a text, with repeats; empty if it has no letters."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if (points >> 16).any():
        wide = [ord(c.lower()[0]) if c.isalpha() else 32 for c in map(chr, points[points >> 16 > 0].tolist())]
        low = letters()[points & 0xFFFF]
        low[points >> 16 > 0] = wide
    else:
        low = letters()[points]
    if not (low != 32).any():
        return np.empty(0, np.int64)
    blank = low == 32
    low = low[~(blank & np.roll(blank, 1))] if len(low) > 1 else low  # runs of other characters count as one space
    padded = np.concatenate([[32], low, [32]]).astype(np.uint64)
    mixed = (padded + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    two = (mixed[:-1] ^ (mixed[1:] >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
    three = (two[:-1] ^ (mixed[2:] >> np.uint64(11))) * np.uint64(0x94D049BB133111EB)
    return (np.concatenate([mixed, two, three]) >> np.uint64(64 - BITS)).astype(np.int64)


@dataclass
class Classifier:
    """cells: those that any landmark has; present: landmarks x cells; weights: landmarks x languages."""

    names: list[str]
    cells: np.ndarray
    present: np.ndarray
    weights: np.ndarray

    def kernel(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Kernel values of texts against landmarks, and which texts have letters."""
        flags = np.zeros(1 << BITS, bool)
        rows, sizes = np.zeros((len(texts), len(self.cells)), np.float32), np.zeros(len(texts))
        for k, text in enumerate(texts):
            found = grams(text)
            if len(found):
                flags[found] = True
                rows[k] = flags[self.cells]
                sizes[k] = np.count_nonzero(flags)
                flags[found] = False
        scale = np.sqrt(np.outer(np.maximum(sizes, 1), self.present.sum(1)))
        return (rows @ self.present.T) / scale, sizes > 0

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        values, lettered = self.kernel(texts)
        scores = values @ self.weights
        best = scores.argmax(1)
        top = np.clip((scores[np.arange(len(texts)), best] + 1) / 2, 0, 1)
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], np.where(lettered, top, 0.0)


def bounded_ids(docs: DataFrame, label: str, key: str, per_class: int) -> list[tuple]:
    """Up to per_class (key, label) of each label, the first ones by hash. Reads two columns only.

    Counts set a hash threshold for each label, so little more than is needed reaches the driver.
    """
    rows = docs.select(key, label).where(F.col(label).isNotNull() & F.col(key).isNotNull())
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40))
    share = F.lit(0)
    for name, n in counts.items():
        share = F.when(F.col(label) == name, F.lit(int(min(1.0, 2 * per_class / n) * (1 << 40)))).otherwise(share)
    found = rows.withColumn("__draw", draw).where(F.col("__draw") < share).distinct().collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for row in sorted(found, key=lambda r: (r["__draw"], r[key])):
        if taken[row[label]] < per_class:
            taken[row[label]] += 1
            out.append((row[key], row[label]))
    return out


def fit(train: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", per_class: int = 600, landmarks_per_class: int = 24, ridge: float = 0.05) -> Classifier:
    """Learn from at most per_class rows of each language, of which landmarks_per_class become landmarks."""
    spark = train.sparkSession
    chosen = bounded_ids(train, label, key, per_class)
    names = sorted({name for _, name in chosen})
    if not names:
        return Classifier([], np.empty(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    ids = F.broadcast(spark.createDataFrame(chosen, f"{key} long, {label} string"))
    rows_of = train.select(key, label, text).join(ids, [key, label], "left_semi")
    sample, sample_at = stored(rows_of.groupBy(key, label).agg(F.min(text).alias(text)))

    marks: list[tuple] = []
    for name in names:
        marks += [(k, n) for k, n in chosen if n == name][:landmarks_per_class]
    marked = F.broadcast(spark.createDataFrame(marks, f"{key} long, {label} string"))
    nothing = Classifier([], np.empty(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(grams(t)).astype(np.int32) for t in texts], pa.list_(pa.int32()))], names=["cells"])

    found = [np.array(r["cells"], np.int64) for r in sample.join(marked, [key, label], "left_semi").select(text).mapInArrow(presence, "cells array<int>").collect() if r["cells"]]
    if not found:
        release(spark, sample_at)
        return nothing
    found.sort(key=lambda c: (len(c), c.tobytes()))
    cells = np.unique(np.concatenate(found))
    present = np.zeros((len(found), len(cells)), np.float32)
    for k, c in enumerate(found):
        present[k, np.searchsorted(cells, c)] = 1
    model = Classifier(names, cells, present, np.zeros((len(found), len(names)), np.float32))
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lettered = shared.value.kernel(batch.column(0).to_pylist())
            keep = pa.array(lettered)
            yield pa.RecordBatch.from_arrays([batch.column(1).filter(keep), pa.array(list(values[lettered].astype(np.float64)), pa.list_(pa.float64()))], names=["name", "k"])

    made = sample.select(text, label).mapInArrow(rows, "name string, k array<double>").collect()
    made.sort(key=lambda r: (r["name"], r["k"]))  # order of arrival must not matter
    release(spark, sample_at)
    names = model.names = sorted({r["name"] for r in made})
    values = np.array([r["k"] for r in made])
    wanted = np.where(np.array([[r["name"] == n for n in names] for r in made]), 1.0, -1.0)
    sizes = present.sum(1)
    among = (present @ present.T) / np.sqrt(np.outer(sizes, sizes))
    power, vectors = np.linalg.eigh(among)
    root = vectors / np.sqrt(np.maximum(power, 1e-6))
    features = values @ root
    balance = _balance([r["name"] for r in made])
    weighted = features * balance[:, None]
    solved = np.linalg.solve(weighted.T @ features + ridge * np.eye(features.shape[1]) * balance.mean(), weighted.T @ wanted)
    model.weights = (root @ solved).astype(np.float32)
    return model


def _balance(names: list[str]) -> np.ndarray:
    """Every language weighs the same in the fit."""
    counts: dict[str, int] = {}
    for n in names:
        counts[n] = counts.get(n, 0) + 1
    return np.array([1 / counts[n] for n in names])


def identify(docs: DataFrame, model: Classifier, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """Append the predicted language of each whole text and a score from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts: list) -> list[pa.Array]:
            names, scores = [], []
            for at in range(0, len(texts), 128):
                n, s = shared.value.predict(texts[at : at + 128])
                names += n
                scores.append(s)
            return [pa.array(names, pa.string()), pa.array(np.concatenate([np.empty(0), *scores]), pa.float64())]

        return work

    return map_texts(docs.drop(lang, score), text, f"{lang} string, {score} double", make)

