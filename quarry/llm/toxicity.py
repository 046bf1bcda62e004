"""Toxicity by non-negative positive-unlabelled learning.

The classifier is linear over the presence of hashed words and word parts, trained in numpy on confirmed toxic
texts and unlabelled texts. Unlabelled texts contain toxic ones too: the risk of calling them clean
is corrected by the class prior, and where the corrected part turns negative its gradient step is
reversed, so that the model can't profit from memorising positives.

The training rows are a bounded, hash-ordered choice (positives and unlabelled parameters); texts of
chosen rows are hashed whole on the executors, only cells reach the driver. Of rows that share an id one text
is learned from, the smallest, so that the bounds hold for rows too. The class prior is the share of toxic
rows among labelled ones, but at least 0.001 and at most 0.5.

How much evidence a cell must give to take part is chosen anew in each fit: every fourth chosen row is
kept for validation, and the least non-negative risk on these decides. Held-out rows have no say.

Edge cases: null and empty texts are scored by the bias alone; without positives every score is 0;
texts of any length count whole; equal texts get equal scores; extra columns pass through and output
columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import map_texts

BITS = 21
CACHE = 200_000
#: Evidence (twice the log of the likelihood ratio) that a cell may have to show for being more frequent among positives.
CLEAR = (6.0, 10.0, 16.0)
#: Stripped from both ends of a word.
EDGES = b".,;:!?\"'()[]{}*#$%&_-/"


class Cells(dict):
    """The cells of a lower-case word without punctuation at its ends: itself and its parts of four and
    five characters, its beginning marked, since insults are inflected. Fills itself.

    kept: of all cells, those that matter; others are left out.
    """

    def __init__(self, kept: bytes | None = None):
        super().__init__()
        self.kept = kept

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        plain = "^" + word.lower().strip(EDGES).decode("utf-8", "replace").lower()
        parts = {plain, *(plain[k : k + n] for n in (4, 5) for k in range(len(plain) - n + 1))}
        found = [xxhash.xxh3_64_intdigest(p) >> (64 - BITS) for p in parts]
        found = tuple(found if self.kept is None else [c for c in found if self.kept[c]])
        if len(word) <= 64:
            self[word] = found
        return found


def cells_of(text: str | None, cells: Cells) -> np.ndarray:
    """The distinct cells of a whole text."""
    return np.fromiter(set().union(*map(cells.__getitem__, set((text or "").encode().split()))), np.int32)


class SparseRows:
    """Rows of present cells, for products with a weight vector and back."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows])
        self.flat = np.concatenate([np.empty(0, np.int64), *rows]).astype(np.int64)
        self.row = np.repeat(np.arange(len(rows)), self.sizes)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.flat], len(self.sizes))

    def back(self, values: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.flat, values[self.row], width)


def evidence(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Twice the log likelihood ratio of two shares a/n and b/m being different to being one."""

    def log(k: np.ndarray, of: int) -> np.ndarray:
        share = np.clip(k / max(1, of), 1e-12, 1 - 1e-12)
        return k * np.log(share) + (of - k) * np.log1p(-share)

    share = np.clip((a + b) / (n + m), 1e-12, 1 - 1e-12)
    return 2 * (log(a, n) + log(b, m) - (a + b) * np.log(share) - (n + m - a - b) * np.log1p(-share))


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, clear: float, steps: int = 400, rate: float = 0.05, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Weights over all cells and a bias that minimise the non-negative PU risk with logistic loss (Adam)."""
    width = 1 << BITS
    # Only cells that positives have clearly more often than unlabelled texts take part.
    counts = [np.bincount(np.concatenate([np.empty(0, np.int64), *rows]), minlength=width) for rows in (positive, unlabelled)]
    rates = [c / max(1, len(rows)) for c, rows in zip(counts, (positive, unlabelled), strict=True)]
    held = (rates[0] > rates[1]) & (evidence(counts[0], len(positive), counts[1], len(unlabelled)) > clear)
    used, place = np.flatnonzero(held), np.cumsum(held) - 1
    inner = [SparseRows([place[r[held[r]]] for r in rows]) for rows in (positive, unlabelled)]
    n = len(used)
    scale = 1 / np.sqrt(1 + 100 * rates[1][used])  # common words start small
    w, b = np.zeros(n), float(np.log(prior / (1 - prior)))
    m = v = np.zeros(n + 1)
    for step in range(1, steps + 1):
        zp, zu = inner[0].dot(w * scale) + b, inner[1].dot(w * scale) + b
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        lost = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()  # corrected risk of calling texts clean
        gp, gu = -prior * (1 - sp) / len(sp), np.zeros_like(su)
        if lost >= 0:
            gp, gu = gp - prior * sp / len(sp), su / len(su)
        else:
            gp, gu = prior * sp / len(sp), -su / len(su)
        grad = np.append(scale * (inner[0].back(gp, n) + inner[1].back(gu, n)) + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:n], b - move[n]
    out = np.zeros(width, np.float32)
    out[used] = w * scale
    return out, float(b)


def risk(model: tuple[np.ndarray, float], positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> float:
    """The non-negative PU risk of rows that the model hasn't seen."""
    zp, zu = (SparseRows(rows).dot(model[0]) + model[1] for rows in (positive, unlabelled))
    return prior * np.logaddexp(0, -zp).mean() + max(0.0, np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean())


def chosen_clear(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> float:
    """The evidence that does best on every fourth row after learning from the others; the middle one for few rows."""
    if min(len(positive), len(unlabelled)) < 8:
        return CLEAR[len(CLEAR) // 2]
    learned, kept = ([[r for k, r in enumerate(rows) if (k % 4 == 0) == want] for rows in (positive, unlabelled)] for want in (False, True))
    return min(CLEAR, key=lambda clear: risk(fit_nnpu(*learned, prior, clear, steps=150), *kept, prior))


class Toxicity:
    def __init__(self, weights: np.ndarray | None, bias: float):
        self.used = np.flatnonzero(weights).astype(np.int32) if weights is not None else None
        self.values, self.bias = (weights[self.used] if weights is not None else None), bias
        self.full, self.cells = None, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"full": None, "cells": None}

    def open(self) -> Toxicity:
        """Ready for scoring, in a task."""
        if self.used is not None and self.full is None:
            self.full = np.zeros(1 << BITS, np.float32)
            self.full[self.used] = self.values
            self.cells = Cells((self.full != 0).tobytes())
        return self

    def score(self, texts: list) -> np.ndarray:
        if self.used is None:
            return np.zeros(len(texts))
        cells = self.cells
        total = [self.full[cells_of(t, cells)].sum() for t in texts]
        return 1 / (1 + np.exp(-np.clip(np.array(total) + self.bias, -60, 60)))


def chosen_cells(docs: DataFrame, ids: list[int], text: str, key: str) -> dict[int, np.ndarray]:
    """Cells of one whole text for each of these ids."""
    wanted = F.broadcast(docs.sparkSession.createDataFrame([(i,) for i in sorted(ids)], f"{key} long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = Cells()
        for batch in batches:
            made = [np.sort(cells_of(t, cells)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], names=["key", "cells"])

    one = docs.select(F.col(key).cast("long"), text).join(wanted, key, "left_semi").groupBy(key).agg(F.min(text).alias(text))
    return {row["key"]: np.array(row["cells"], np.int32) for row in one.mapInArrow(run, "key long, cells array<int>").toLocalIterator()}


def first_ids(rows: DataFrame, key: str, bound: int) -> tuple[list[int], int]:
    """The first ids by hash, at most bound, and the number of rows."""
    n = rows.count()
    draw = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 40))
    found = rows.select(key, draw.alias("d")).where(F.col("d") <= int(min(1.0, 2 * bound / max(n, 1)) * (1 << 40))).distinct().collect()
    return [r[key] for r in sorted(found, key=lambda r: (r["d"], r[key]))[:bound]], n


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", positives: int = 2000, unlabelled: int = 4000) -> Toxicity:
    """Learn from docs and the labels given; at most positives toxic rows and unlabelled others are read."""
    spread = labels.select(key, label).where(F.col(key).isNotNull() & F.col(label).isNotNull())
    toxic = spread.where(F.col(label) == 1).select(key).distinct()
    known = docs.select(key).where(F.col(key).isNotNull())
    some, n_toxic = first_ids(known.join(toxic, key, "left_semi"), key, positives)
    if not some:
        return Toxicity(None, 0.0)
    others, n_all = first_ids(known, key, unlabelled)
    n_labelled = spread.select(key).distinct().count()
    prior = min(0.5, max(1e-3, toxic.count() / max(1, n_labelled)))
    cells = chosen_cells(docs, [*{*some, *others}], text, key)
    parts = [[cells[i] for i in ids if i in cells] for ids in (some, others)]  # in the order of hashes
    weights, bias = fit_nnpu(*parts, prior, chosen_clear(*parts, prior))
    return Toxicity(weights, bias)


def score_documents(docs: DataFrame, model: Toxicity, text: str = "text", score: str = "score") -> DataFrame:
    """Append each whole text's toxicity score, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value.open()
        return lambda texts: [pa.array(model.score(texts), pa.float64())]

    return map_texts(docs.drop(score), text, f"{score} double", make)
