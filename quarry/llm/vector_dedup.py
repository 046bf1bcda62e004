"""Near duplicates among vectors by sorted projection passes.

In each pass the vectors are sorted, within their label, by a string of random hash bits. What is sorted
are ids with that string and a sketch of 64 more bits; two ids at most `window` places apart whose
sketches differ in few bits are neighbours. Vectors are fetched for ids with neighbours only, neighbours
are verified in double precision, and the verified pairs of all passes are united to components. Windows
run on across the bounds of range partitions, so their number doesn't matter.

Then every component is completed: all its pairs are compared, block with block, so that links are
counted exactly in groups of any density, whatever the windows met of them. Links are counted where they
are found; only pairs that joined two parts of a window to one leave it.

Equal vectors of a label are one class throughout, however many there are: classes are compared, their
sizes are counted. Vectors are equal if two 64-bit hashes are.

A pair at cosine 0.98 agrees in each bit with probability 0.936; in a pass it meets if it agrees in about
as many bits as the label's vectors outnumber the window by, in powers of two. More passes cost in proportion.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, null labels and
null ids link with nothing; vectors of different lengths aren't compared; repeated rows are links of
each other; different vectors with one id count as one; an empty table gives an empty result; extra
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import partitions, release, stored
from quarry.llm.components import components
from quarry.llm.vectors import equal_keys, hyperplanes, matrix, takes_part

#: Sketches of neighbours differ in at most this many of 64 bits: at cosine 0.98, 4 do on average, and more than 16 once in a million.
NEAR = 16
#: Rows of the sorted order that are verified together, and rows of a block in which a component is completed.
STRETCH, BLOCK = 4096, 2048


def sorted_neighbours(classes: DataFrame, passes: int, window: int, bits: int, seed: int) -> DataFrame:
    """classes: label, vec, rep -> rows of the sorted order that have neighbours, or that end a partition:
    part and at (place), label, kind (length and pass), rep."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            for dims in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                x, n = matrix(part.column(1)), len(part)
                sketch = np.packbits(x @ hyperplanes(seed, int(dims), 64) > 0, axis=1).view(np.int64).ravel()
                for p in range(passes):
                    code = (x @ hyperplanes(seed + 1 + p, int(dims), bits) > 0) @ weights
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.full(n, dims * passes + p, np.int32)), pa.array(code), pa.array(sketch), part.column(2)], names=["label", "kind", "code", "sketch", "rep"])

    label = next(f.dataType.simpleString() for f in classes.schema.fields if f.name == "label")
    spread = classes.select("label", "vec", "rep").mapInArrow(hashed, f"label {label}, kind int, code long, sketch long, rep long")
    order = ["label", "kind", "code", "rep"]
    ranged = spread.repartitionByRange(partitions(classes.sparkSession), *order).sortWithinPartitions(*order)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0

        def given(rows: pa.Table, keep: np.ndarray) -> Iterator[pa.RecordBatch]:
            if keep.any():
                kept = rows.filter(pa.array(keep))
                yield from pa.table({"part": pa.array(np.full(len(kept), part, np.int32)), "at": kept["at"], "label": kept["label"], "kind": kept["kind"], "rep": kept["rep"]}).to_batches()

        held, met = None, np.zeros(0, bool)
        for batch in batches:
            if not len(batch):
                continue
            new = pa.table({"at": pa.array(np.arange(count, count + len(batch))), **{c: batch.column(c) for c in ("label", "kind", "sketch", "rep")}})
            rows = pa.concat_tables([held, new]).combine_chunks() if held is not None else new
            near = np.concatenate([met, np.zeros(len(batch), bool)])
            start, count = len(met), count + len(batch)
            kind, sketch = rows["kind"].to_numpy(), rows["sketch"].to_numpy()
            group = np.concatenate([[0], np.cumsum((kind[1:] != kind[:-1]) | ~pc.equal(rows["label"][1:], rows["label"][:-1]).to_numpy(zero_copy_only=False).astype(bool))])
            for d in range(1, min(window, len(rows) - 1) + 1):
                b = slice(max(start, d), len(rows))
                a = slice(b.start - d, len(rows) - d)
                hit = (group[a] == group[b]) & (np.bitwise_count(sketch[a] ^ sketch[b]) <= NEAR)
                near[a] |= hit
                near[b] |= hit
            done = max(0, len(rows) - window)
            at = rows["at"].to_numpy()
            yield from given(rows[:done], near[:done] | (at[:done] < window))
            held, met = rows[done:], near[done:]
        if held is not None:
            yield from given(held, np.ones(len(met), bool))

    return ranged.mapInArrow(scan, f"part int, at long, label {label}, kind int, rep long")


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def merged(lab: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels of parts after the parts of i[k] and j[k] have become one."""
    while True:
        low, high = np.minimum(lab[i], lab[j]), np.maximum(lab[i], lab[j])
        if (low == high).all():
            return lab
        to = np.arange(len(lab))
        np.minimum.at(to, high, low)
        lab = to[lab]


def verified_links(near: DataFrame, classes: DataFrame, threshold: float, window: int) -> DataFrame:
    """Pairs (a, b) at the threshold, at most window places apart: enough of them to connect all that are."""
    ends = sorted((r["part"], r["n"]) for r in near.groupBy("part").agg((F.max("at") + 1).alias("n")).collect())  # one row for each partition
    start = dict(zip([p for p, _ in ends], np.cumsum([0, *[n for _, n in ends]]).tolist(), strict=False))
    starts = F.array(*[F.lit(start.get(k, 0)).cast("long") for k in range(max(start, default=0) + 1)])
    placed = near.withColumn("at", F.col("at") + F.element_at(starts, F.col("part") + 1)).drop("part")
    block = F.floor(F.col("at") / STRETCH)
    late = F.col("at") % STRETCH >= STRETCH - window  # met again by the first rows of the next stretch
    dealt = placed.withColumn("block", F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))))
    dealt = dealt.join(classes.select("label", "rep", "vec"), ["label", "rep"])

    def compared(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at").combine_chunks()
        at, kind = rows["at"].to_numpy(), rows["kind"].to_numpy()
        own = at // STRETCH == rows["block"].to_numpy()
        _, label = np.unique(np.array([str(v) for v in rows["label"].to_pylist()]), return_inverse=True)
        sizes = np.diff(rows["vec"].chunk(0).offsets.to_numpy()) if len(rows) else np.zeros(0)
        rep, found_a, found_b = rows["rep"].to_numpy(), [], []
        for dims in np.unique(sizes):
            mine = np.flatnonzero(sizes == dims)
            x = unit(matrix(rows["vec"].take(pa.array(mine))))
            lab, place = np.arange(len(mine)), at[mine]
            for d in range(1, min(window, len(mine) - 1) + 1):
                b = np.arange(d, len(mine))
                a = b - d
                fits = own[mine[b]] & (place[b] - place[a] <= window) & (kind[mine[a]] == kind[mine[b]]) & (label[mine[a]] == label[mine[b]]) & (lab[a] != lab[b])
                a, b = a[fits], b[fits]
                if len(a):
                    good = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
                    a, b = a[good], b[good]
                    found_a.append(rep[mine[a]])
                    found_b.append(rep[mine[b]])
                    lab = merged(lab, a, b)
        return pa.table({n: pa.array(np.concatenate([np.empty(0, np.int64), *f])) for n, f in (("a", found_a), ("b", found_b))})

    return dealt.groupBy("block").applyInArrow(compared, "a long, b long")


def linked_in(x: np.ndarray, y: np.ndarray, weight: np.ndarray, threshold: float) -> np.ndarray:
    """For each row of x the weight of the rows of y at the threshold. Products near it are looked at again, in one fixed order of addition."""
    out = np.zeros(len(x), np.int64)
    for at in range(0, len(x), 512):
        part = x[at : at + 512]
        close = part @ y.T
        hit = close >= threshold
        i, j = np.nonzero(np.abs(close - threshold) < 1e-9)
        hit[i, j] = np.einsum("ij,ij->i", part[i], y[j]) >= threshold
        out[at : at + 512] = hit.astype(np.float64) @ weight  # sums of sizes, exact as doubles
    return out


def completed(members: DataFrame, threshold: float) -> DataFrame:
    """members: root, rep, size, vec -> rep, others (sizes of the other classes linked), over all pairs of a component.

    Small components share a task by the hash of their root; large ones are cut into blocks, and each pair of blocks is a task."""
    counts, at = stored(members.groupBy("root").agg(F.count(F.lit(1)).alias("n")))
    small = counts.where(F.col("n") <= BLOCK).agg(F.sum("n")).first()[0] or 0
    packs = max(1, -(-small // BLOCK))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    met = members.join(counts, "root").withColumn("own", F.when(F.col("n") <= BLOCK, F.lit(-1)).otherwise(F.pmod(F.xxhash64("rep"), blocks)).cast("int"))
    other = F.explode(F.when(F.col("own") < 0, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    dealt = met.withColumn("other", other).withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    dealt = dealt.withColumn("g", F.when(F.col("own") < 0, F.pmod(F.xxhash64("root"), F.lit(packs))).otherwise(F.col("root")))

    def counted(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("root", "ascending"), ("rep", "ascending")]).combine_chunks()
        rep, size, root, own = (rows[c].to_numpy() for c in ("rep", "size", "root", "own"))
        x = unit(matrix(rows["vec"]))
        out = np.zeros(len(rows), np.int64)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(root)) + 1, [len(root)]])
        for a, b in zip(edges, edges[1:], strict=False):
            sides = np.unique(own[a:b])
            if len(sides) == 2:
                one, two = (np.flatnonzero(own[a:b] == s) + a for s in sides)
                out[one], out[two] = linked_in(x[one], x[two], size[two], threshold), linked_in(x[two], x[one], size[one], threshold)
            elif rows["i"][int(a)].as_py() == rows["j"][int(a)].as_py():
                out[a:b] = linked_in(x[a:b], x[a:b], size[a:b], threshold) - size[a:b]
        return pa.table({"rep": pa.array(rep), "others": pa.array(out)})

    parts = dealt.select("g", "i", "j", "root", "rep", "size", "own", "vec").groupBy("g", "i", "j").applyInArrow(counted, "rep long, others long")
    done, done_at = stored(parts.groupBy("rep").agg(F.sum("others").alias("others")))
    release(members.sparkSession, at)
    return done


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98, passes: int = 12, window: int = 128, bits: int = 40, seed: int = 1) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable), kept."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vec"), F.col(label).alias("label"))
    fit = takes_part(F.col("vec")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    named = rows.select("vec_id", "label", "vec", fit.alias("fit"), *equal_keys(F.col("vec"), fit))
    by = ["label", "k1", "k2"]
    classes, _ = stored(named.where("fit").groupBy(*by).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("vec").alias("vec")))
    near, near_at = stored(sorted_neighbours(classes, passes, window, bits, seed))
    roots, _ = stored(components(verified_links(near, classes, threshold, window)))
    release(vectors.sparkSession, near_at)
    members = roots.select(F.col("node").alias("rep"), "root").unionByName(roots.select(F.col("root").alias("rep"), "root").distinct())
    others = completed(members.join(classes.select("rep", "size", "vec"), "rep"), threshold)
    known = classes.select(*by, "rep", "size").join(others, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select(*by, (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("root", "rep").alias("root"))
    met = named.select("vec_id", *[F.when(F.col("fit"), F.col(c)).alias(c) for c in by]).join(known, by, "left")
    out = met.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
