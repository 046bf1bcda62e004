"""Approximate nearest neighbours with a hash-prefix forest.

In each tree a vector has a string of BITS random hyperplane bits. The tree is the sorted array of these strings,
cut into ranges that tasks hold; within a range, prefixes are lengthened until at most `leaf` vectors share one,
and such a prefix is a cell. A query descends in every tree along its own string, as far as there are cells: the
prefixes that it shares are found by joins with the counts of all prefixes of cells. Then all trees ascend together:
from the longest prefix on, a level is given up in all of them, until `reach` times N ** `growth` vectors (counted
in each tree that holds them) lie below. In the last level the trees go up one by one, first those where the
query is closest to the hyperplane of the bit given up, and stop once there are enough.
The cells below are compared exactly, by the products of a cell's vectors and the queries that came to it.

Vectors are taken by bands of like length, each with a forest of its own, and are given one more component
that makes the lengths of a band equal: the largest inner product then is the smallest angle.

Equal vectors (two 64-bit hashes agree) are searched as one: only the ids of as many of them as can be
returned are kept, which loses nothing, since ties go to smaller ids. Cells of more than `block` vectors
(which share the whole string) are cut by a hash, and so are the queries of a cell, so that a task holds one part of either.

Uniformly random vectors are the hardest case: there a prefix tells little, and the defaults, which keep
a recall of 0.9 for them, look at 60 % of 2,000 vectors and 45 % of 50,000. Vectors with clusters need a smaller
`reach` and `growth`. Each tree holds a copy of each vector while it is compared.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part, nor
do null ids; vectors of different lengths don't meet; fewer candidates than asked for are all returned as far as they are
reached; rows that repeat count once; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import release, stored
from quarry.llm.vectors import equal_keys, hyperplanes, matrix, smallest_ids, takes_part

#: Bits of a tree's strings.
BITS = 48
#: Rows of a range of sorted strings.
RANGE = 1 << 20
#: Vectors of a band differ in length by this factor at most.
BAND = 1.25

BANDED = ["dims", "band"]
NODE = [*BANDED, "tree", "level", "prefix"]
CELL = [*BANDED, "tree", "depth", "cell"]


def bands(lengths: np.ndarray) -> np.ndarray:
    """The power of BAND that a length is nearest to: unit vectors are in the middle of theirs."""
    return np.floor(np.log(lengths) / np.log(BAND) + 0.5).astype(np.int32)


def levelled(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors of a band with the component that makes them as long as its longest."""
    return np.column_stack([x, np.sqrt(np.maximum(longest**2 - (x**2).sum(1), 0))])


@lru_cache(maxsize=256)
def planes(seed: int, dims: int, tree: int) -> np.ndarray:
    """BITS directions, orthogonal as far as there are any, so that bits tell different things."""
    step = min(BITS, dims)
    return np.hstack([np.linalg.qr(hyperplanes(seed + 1000 * tree + 100_000 * k, dims, step))[0] for k in range(-(-BITS // step))])[:, :BITS]


def strings_of(margins: np.ndarray) -> np.ndarray:
    """The signs of margins as one number, the first bit highest."""
    return (margins > 0) @ (1 << np.arange(BITS, dtype=np.int64)[::-1])


def cut(strings: np.ndarray, leaf: int, least: int) -> np.ndarray:
    """For each of a range's sorted strings how many of its bits name its cell.

    Prefixes at the range's ends may go on in other ranges; they are cut as deep as `least` whatever their count."""
    depth = np.zeros(len(strings), np.int32)
    for level in range(BITS):
        node = strings >> (BITS - level)
        starts = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        many = np.diff(np.append(starts, len(node)))
        large = np.repeat(many > leaf, many)
        if level < least:
            large |= (node == node[0]) | (node == node[-1])
        if not large.any():
            break
        depth[large] = level + 1
    return depth


def best_of(vectors: np.ndarray, ids: pa.ListArray, queries: np.ndarray, names: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of each query's `most` best; equal scores go to smaller ids. Products choose, plain sums score."""
    offsets, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
    starts, sizes = offsets[:-1], np.diff(offsets)
    out: tuple[list, list, list] = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)])
    step = max(1, (1 << 21) // max(1, len(vectors)))
    for at in range(0, len(queries), step):
        part = queries[at : at + step]
        rough = part @ vectors.T
        fair = np.ones_like(rough, bool)
        if len(vectors) > most:
            place = len(vectors) - most
            fair = rough >= (np.partition(rough, place, axis=1)[:, place] - 1e-9 * np.abs(rough).max(1))[:, None]
        q, v = np.nonzero(fair)
        scores = np.einsum("ij,ij->i", vectors[v], part[q])
        many = sizes[v]
        within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        q, found, scores = np.repeat(q, many), flat[np.repeat(starts[v], many) + within], np.repeat(scores, many)
        order = np.lexsort((found, -scores, q))
        q, found, scores = q[order], found[order], scores[order]
        first = np.searchsorted(q, q)
        kept = np.arange(len(q)) - first < most
        for held, new in zip(out, (names[at + q[kept]], found[kept], scores[kept]), strict=True):
            held.append(new)
    return tuple(np.concatenate(o) for o in out)


def part_of(name: str, parts: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(salt), name), parts).cast("int")


@dataclass
class Forest:
    """The trees over classes of equal vectors: classes (name, vec, ids, dims, band), rows (a name's cell in each tree)
    and cells with n; by dims and band what a query is to reach and how long the longest prefix is."""

    classes: DataFrame
    rows: DataFrame
    cells: DataFrame
    least: dict[tuple[int, int], int]
    deepest: dict[tuple[int, int], int]
    trees: int
    seed: int

    def nodes(self) -> DataFrame:
        """Each cell below each of its prefixes."""
        spread = self.cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("depth"))))
        return spread.withColumn("prefix", F.expr("shiftright(cell, depth - level)"))


def grow(plain: DataFrame, trees: int, most: int, reach: float, growth: float, block: int, seed: int) -> Forest:
    """The forest of plain (vec, ids, name)."""
    spark, kind = plain.sparkSession, plain.schema["vec"].dataType.simpleString()

    def banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            for dims in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                length = np.linalg.norm(matrix(part.column(0)), axis=1)
                made = [pa.array(np.full(len(part), dims, np.int32)), pa.array(bands(length)), pa.array(length)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "dims", "band", "length"])

    classes, _ = stored(plain.mapInArrow(banded, f"vec {kind}, ids array<bigint>, name long, dims int, band int, length double"))
    about = {(r["dims"], r["band"]): r for r in classes.groupBy(*BANDED).agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()}
    longest = {b: r["longest"] for b, r in about.items()}
    least = {b: max(4 * most, int(reach * r["n"] ** growth)) for b, r in about.items()}
    leaf = {b: min(block, max(32, m // (2 * trees))) for b, m in least.items()}
    usual = {b: max(0, int(np.ceil(np.log2(r["n"] / leaf[b])))) for b, r in about.items()}

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, band, name = batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for d, b in {*zip(dims.tolist(), band.tolist(), strict=True)}:
                mine = np.flatnonzero((dims == d) & (band == b))
                x = levelled(matrix(batch.column(0).take(pa.array(mine))), longest[d, b])
                for t in range(trees):
                    fixed = [pa.array(np.full(len(mine), v, np.int32)) for v in (d, b, t)]
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(strings_of(x @ planes(seed, d + 1, t))), pa.array(name[mine])], names=[*BANDED, "tree", "string", "name"])

    by = [*BANDED, "tree", "string", "name"]
    arrays = classes.select("vec", *BANDED, "name").mapInArrow(grown, "dims int, band int, tree int, string long, name long")
    ranges = max(1, -(-trees * sum(r["n"] for r in about.values()) // RANGE))
    arrays = arrays.repartitionByRange(ranges, *by).sortWithinPartitions(*by)

    def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        range_ = pa.Table.from_batches(held).combine_chunks()
        dims, band, tree, strings = (range_[n].to_numpy() for n in by[:4])
        breaks = np.flatnonzero((np.diff(dims) != 0) | (np.diff(band) != 0) | (np.diff(tree) != 0)) + 1
        for start, end in zip([0, *breaks], [*breaks, len(strings)], strict=True):
            own = (int(dims[start]), int(band[start]))
            depth = cut(strings[start:end], leaf[own], usual[own])
            part = range_.slice(start, end - start)
            made = pa.table({**{n: part[n] for n in by[:3]}, "depth": depth, "cell": strings[start:end] >> (BITS - depth), "name": part["name"]})
            yield from made.to_batches(max_chunksize=65536)

    rows, _ = stored(arrays.mapInArrow(celled, "dims int, band int, tree int, depth int, cell long, name long"))
    cells, _ = stored(rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n")))
    deepest = {(r["dims"], r["band"]): r["depth"] for r in cells.groupBy(*BANDED).agg(F.max("depth").alias("depth")).collect()}
    return Forest(classes, rows, cells, least, deepest, trees, seed)


def climb(forest: Forest, wanted: DataFrame) -> DataFrame:
    """The cells (with n) that each query (name, vec) is compared with: descent in all trees, then synchronous ascent."""
    spark, deepest, trees, seed = wanted.sparkSession, forest.deepest, forest.trees, forest.seed

    def descended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names = np.diff(batch.column(1).offsets.to_numpy()), batch.column(0).to_numpy()
            for (dims, band), deep in deepest.items():
                mine = np.flatnonzero(sizes == dims)
                if not len(mine):
                    continue
                x = matrix(batch.column(1).take(pa.array(mine)))
                x = np.column_stack([x, np.zeros(len(x))])
                levels = np.arange(deep + 1)
                for t in range(trees):
                    margins = x @ planes(seed, dims + 1, t)
                    prefix = strings_of(margins)[:, None] >> (BITS - levels)
                    doubt = np.abs(np.column_stack([margins, np.zeros(len(x))]))[:, : deep + 1]
                    fixed = [pa.array(np.full(prefix.size, v, np.int32)) for v in (dims, band, t)]
                    made = [np.repeat(names[mine], deep + 1), *fixed, np.tile(levels.astype(np.int32), len(x)), prefix.ravel(), doubt.ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], names=["name", *NODE, "doubt"])

    paths = wanted.select("name", "vec").mapInArrow(descended, "name long, dims int, band int, tree int, level int, prefix long, doubt double")
    counts = forest.nodes().groupBy(*NODE).agg(F.sum("n").alias("n"))
    goals = spark.createDataFrame([(*b, m) for b, m in forest.least.items()], "dims int, band int, least long")
    met = paths.join(counts, NODE).join(F.broadcast(goals), BANDED)  # goals: a row for each length and band
    own = Window.partitionBy("name", *BANDED)
    met = met.withColumn("total", F.sum("n").over(Window.partitionBy("name", *BANDED, "level")))
    met = met.withColumn("at", F.coalesce(F.max(F.when(F.col("total") >= F.col("least"), F.col("level"))).over(own), F.lit(0)))
    upper, lower = F.col("level") == F.col("at"), F.col("level") == F.col("at") + 1
    pick = lambda when, what: F.max(F.when(when, F.col(what)))
    trees_of = met.where(upper | lower).groupBy("name", *BANDED, "tree").agg(
        F.max("at").alias("at"), F.max("least").alias("least"), pick(upper, "n").alias("n"), F.coalesce(pick(lower, "n"), F.lit(0)).alias("below"),
        pick(upper, "prefix").alias("up"), pick(lower, "prefix").alias("down"), pick(upper, "doubt").alias("doubt"),
    )
    earlier = own.orderBy("doubt", "tree").rowsBetween(Window.unboundedPreceding, -1)
    held = F.sum("below").over(own) + F.coalesce(F.sum(F.col("n") - F.col("below")).over(earlier), F.lit(0))
    chosen = trees_of.withColumn("goes_up", held < F.col("least"))
    level = F.when(F.col("goes_up"), F.col("at")).otherwise(F.col("at") + 1)
    ways = chosen.select("name", *BANDED, "tree", level.alias("level"), F.when(F.col("goes_up"), F.col("up")).otherwise(F.col("down")).alias("prefix"))
    return ways.where("prefix is not null").join(forest.nodes(), NODE).select("name", *CELL, "n")


def nearest(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, trees: int = 24, reach: float = 3.7, growth: float = 0.84, block: int = 16384, seed: int = 3
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of each query (rows of vectors), itself left out.

    Repeated rows, equal in id and vector, count once, as candidates and as queries."""
    spark = vectors.sparkSession

    def named(df: DataFrame, own: str) -> DataFrame:
        vec = F.col("vec")
        rows = df.select(F.col(key).cast("long").alias(own), F.col(vector).alias("vec"))
        return rows.where(takes_part(vec) & F.col(own).isNotNull()).select(own, "vec", *equal_keys(vec, F.lit(True)))

    by = ["k1", "k2"]
    rows, asked = named(vectors, "vec_id"), named(queries, "query_id")
    ids = smallest_ids(rows.select("vec_id", *by).distinct(), by, "vec_id", k + 1)
    firsts = rows.groupBy(*by).agg(F.first("vec").alias("vec"))
    plain, plain_at = stored(firsts.join(ids, by).select("vec", "ids", F.element_at("ids", 1).alias("name")))
    wanted, _ = stored(asked.groupBy(*by).agg(F.min("query_id").alias("name"), F.first("vec").alias("vec")))
    most = k + 1
    forest = grow(plain, trees, most, reach, growth, block, seed)
    release(spark, plain_at)
    ways, _ = stored(climb(forest, wanted))
    # Cells come in parts of vectors, their queries in chunks; every part meets every chunk.
    shape = ways.groupBy(*CELL).agg(F.ceil(F.max("n") / block).cast("int").alias("parts"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("chunks"))
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = forest.rows.join(shape, CELL).join(forest.classes.select("name", "vec", "ids"), "name")
    left = held.withColumn("part", part_of("name", F.col("parts"), 1)).withColumn("chunk", each(F.col("chunks")))
    come = ways.drop("n").join(shape, CELL).withColumn("chunk", part_of("name", F.col("chunks"), 2)).withColumn("part", each(F.col("parts")))
    right = come.join(wanted.select("name", "vec"), "name")

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        fields = {"name": pa.int64(), "vec_id": pa.int64(), "score": pa.float64()}
        if not (len(a) and len(b)):
            return pa.table({n: pa.array([], t) for n, t in fields.items()})
        best = best_of(matrix(a["vec"]), a["ids"].combine_chunks(), matrix(b["vec"]), b["name"].to_numpy(), most)
        return pa.table({n: pa.array(v, t) for (n, t), v in zip(fields.items(), best, strict=True)})

    keys = [*CELL, "part", "chunk"]
    met = left.select(*keys, "vec", "ids").groupBy(*keys).cogroup(right.select(*keys, "vec", "name").groupBy(*keys)).applyInArrow(search, "name long, vec_id long, score double")
    once = met.groupBy("name", "vec_id").agg(F.max("score").alias("score"))  # several trees may have found it
    order = Window.partitionBy("name").orderBy(F.desc("score"), "vec_id")
    top = once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    mine = asked.select("query_id", *by).distinct().join(wanted.select("name", *by), by).select("query_id", "name")
    others = mine.join(top, "name").where("vec_id <> query_id")
    ranked = others.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("r")).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
