"""Hard negatives of anchors by slots of scores.

Every anchor has up to `positives` best rows of its own label. A positive of score p asks for the best rows
of other labels with low * p <= of * score <= high * p: as many overlapping windows as there are positives.
Their upper limits split the scores into disjoint slots. Each block of rows keeps, for an anchor, its best
k rows of every slot (what lies below all windows that reach into a slot isn't kept), which are merged the
same way; a window then is answered by the slots up to its own limit, merged downwards, without looking at
rows again.

Anchors are compared with all rows, block by block: rows and anchors are dealt out by hashes of their ids
into parts of about `block`, so that a label of any size is spread, and a task holds one part of each.
What leaves a block is at most `positives` rows an anchor, then k rows for each of its slots. Components become whole
numbers, so scores are exact: products run in double precision where no sum can pass 2 ** 53, else in
64-bit whole numbers.

Edge cases: rows with a null id or label, a null vector, or a null or non-finite component take no part;
components are held within 2 ** 26 either way after scaling; vectors of different lengths don't meet; of rows
that share an id the one with the smallest label, then vector, counts; a positive of negative score has no
window; anchors without positives and positives without negatives give no rows; an empty table gives an
empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import partitions

#: Bound of a component's size.
LARGEST = 1 << 26
#: Anchors that are compared at once, which bounds the table of products.
STEP = 128


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, in double precision."""
    held = lambda x: F.least(F.greatest(F.floor(F.lit(float(scale)) * x.cast("double")), F.lit(-LARGEST)), F.lit(LARGEST))
    return F.transform(vector, lambda x: held(x).cast("int"))


def usable(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def numbers(column: pa.ChunkedArray, places: np.ndarray, dims: int) -> np.ndarray:
    return column.take(pa.array(places)).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(places), dims)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def compared(rows: pa.Table, anchors: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of some rows and anchors of one length, and their scores (anchors x rows)."""
    sizes, asked = (np.array(t["q"].combine_chunks().value_lengths()) if len(t) else np.zeros(0, np.int64) for t in (rows, anchors))
    for dims in np.intersect1d(sizes, asked).tolist():
        at, mine = np.flatnonzero(sizes == dims), np.flatnonzero(asked == dims)
        x = numbers(rows["q"], at, dims)
        for first in range(0, len(mine), STEP):
            some = mine[first : first + STEP]
            yield at, some, products(numbers(anchors["q"], some, dims), x)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, largest first, equal ones by id."""
    near = np.arange(len(scores))
    if len(scores) > k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def dealt(rows: DataFrame, anchors: DataFrame, parts: int, chunks: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(rows, anchors) for each part of the rows with each chunk of the anchors."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    by = lambda name, n, salt: F.pmod(F.xxhash64(F.lit(salt), name), F.lit(n)).cast("int")
    left = rows.withColumn("part", by("id", parts, 1)).withColumn("chunk", every(chunks))
    right = anchors.withColumn("chunk", by("anchor_id", chunks, 2)).withColumn("part", every(parts))
    return left.groupBy("part", "chunk").cogroup(right.groupBy("part", "chunk")).applyInArrow(work, schema)


def first_of(df: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best rows of each group: larger score, then smaller id."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return df.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).drop("n")


def hard_negatives(
    vectors: DataFrame, anchors: Column, key: str = "vec_id", vector: str = "embedding", label: str | Column = "label", k: int = 10, positives: int = 5, low: int = 30, high: int = 90, of: int = 100, scale: int = 256, block: int = 16384
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score. anchors is a test of rows of vectors."""
    lab = F.col(label) if isinstance(label, str) else label
    vec = F.col(vector)
    fit = vectors.where(F.col(key).isNotNull() & lab.isNotNull() & vec.isNotNull() & usable(vec))
    some = fit.select(F.col(key).cast("long").alias("id"), F.struct(lab.cast("string").alias("label"), whole(vec, scale).alias("q"), F.coalesce(anchors, F.lit(False)).alias("asks")).alias("row"))
    rows = some.groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")
    n, asking = fit.select(F.count(F.lit(1)), F.count(F.when(anchors, 1))).first()
    parts, chunks = max(-(-n // block), min(partitions(vectors.sparkSession), -(-n // 512)), 1), max(-(-asking // block), 1)
    asked = rows.where("asks").select(*[F.col(c).alias(as_) for c, as_ in (("id", "anchor_id"), ("label", "label"), ("q", "q"))])
    rows = rows.select("id", "label", "q")

    def alike(a: pa.Table, b: pa.Table) -> pa.Table:
        """The best rows of an anchor's own label in this part."""
        ids, names = a["id"].to_numpy(), b["anchor_id"].to_numpy()
        out: list[tuple] = []
        codes = np.unique(np.array(a["label"].to_pylist() + b["label"].to_pylist(), object).astype(str), return_inverse=True)[1]
        own, theirs = codes[: len(a)], codes[len(a) :]
        for code in np.intersect1d(own, theirs):
            mine, asking = np.flatnonzero(own == code), np.flatnonzero(theirs == code)
            for at, some, scores in compared(a.take(pa.array(mine)), b.take(pa.array(asking))):
                at, some = mine[at], asking[some]
                for anchor, line in zip(some.tolist(), scores, strict=True):
                    others = np.flatnonzero(ids[at] != names[anchor])
                    top = others[best(line[others], ids[at[others]], positives)]
                    out += [(int(names[anchor]), int(ids[at[j]]), int(line[j])) for j in top.tolist()]
        return table(out, ["anchor_id", "id", "score"])

    met = dealt(rows, asked, parts, chunks, alike, "anchor_id long, id long, score long")
    found = first_of(met, ["anchor_id"], positives)
    lists = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("score", "id"))).alias("positives"))
    wanting = asked.join(lists, "anchor_id").select("anchor_id", "label", "q", F.filter(F.col("positives.score"), lambda s: s >= 0).alias("limits")).where(F.size("limits") > 0)

    def unlike(a: pa.Table, b: pa.Table) -> pa.Table:
        """The best rows of other labels in this part, for each slot of an anchor."""
        ids, names, limits = a["id"].to_numpy(), b["anchor_id"].to_numpy(), b["limits"].to_pylist()
        codes = np.unique(np.array(a["label"].to_pylist() + b["label"].to_pylist(), object).astype(str), return_inverse=True)[1]
        own, theirs = codes[: len(a)], codes[len(a) :]
        out: list[tuple] = []
        for at, some, scores in compared(a, b):
            for anchor, line in zip(some.tolist(), scores, strict=True):
                p = np.array(limits[anchor], np.int64)
                uppers, first = np.unique(p * high // of, return_index=True)
                lowers = -(-p * low // of)[first]  # the lowest window that ends with the slot
                inside = np.flatnonzero((line >= lowers[0]) & (line <= uppers[-1]) & (own[at] != theirs[anchor]))
                slot = np.searchsorted(uppers, line[inside])
                for j in range(len(uppers)):
                    held = inside[(slot == j) & (line[inside] >= lowers[j])]
                    top = held[best(line[held], ids[at[held]], k)]
                    out += [(int(names[anchor]), j, int(ids[at[i]]), int(line[i])) for i in top.tolist()]
        return table(out, ["anchor_id", "slot", "id", "score"])

    kept = first_of(dealt(rows, wanting, parts, chunks, unlike, "anchor_id long, slot long, id long, score long"), ["anchor_id", "slot"], k)
    merged = kept.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("down"), "id"))).alias("downwards")).join(lists, "anchor_id")
    asks = merged.select("anchor_id", "downwards", F.explode("positives").alias("p"))
    inside = F.filter("downwards", lambda x: (F.lit(low) * F.col("p.score") <= -x["down"] * of) & (-x["down"] * of <= F.lit(high) * F.col("p.score")))
    ranked = asks.select("anchor_id", "p", F.posexplode(F.slice(inside, 1, k)).alias("at", "x"))
    return ranked.select("anchor_id", F.col("p.id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("negative_id"), F.col("p.score").alias("positive_score"), (-F.col("x.down")).alias("negative_score"))


def table(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, columns, strict=True)})


#: The same for DuckDB, from all pairs.
NEGATIVES_SQL = """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY n.score DESC, n.id)::INT AS rank, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score QUALIFY rank <= 10"""
