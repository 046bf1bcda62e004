"""The operators on vectors against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import nearest, vector_dedup
from quarry.llm.components import components


@pytest.fixture(scope="module")
def vectors(spark):
    """Random vectors, copies, near copies, and rows that take no part; columns with clashing names."""
    rnd = np.random.default_rng(3)
    rows = [rnd.standard_normal(16) for _ in range(400)]
    rows += [rows[5]] * 70 + [rows[k] + 0.01 * rnd.standard_normal(16) for k in range(60)] + [rows[7] * 2.5]
    table = [(k, [float(np.float32(x)) for x in v], k % 3 if k < 400 else (5 % 3 if k < 470 else (k - 470) % 3), 1, 2) for k, v in enumerate(rows)]
    odd = [None, [], [0.0] * 16, [None, *[1.0] * 15], [math.nan] * 16, [math.inf, *[1.0] * 15], [1.0, 2.0]]
    table += [(1000 + k, v, 1, 1, 2) for k, v in enumerate(odd)]
    table += [(2000, table[0][1], None, 1, 2), (2001, table[0][1], 0, 1, 2), (None, table[0][1], 0, 1, 2), table[3]]
    return spark.createDataFrame(table, "vec_id long, embedding array<float>, label int, rep int, dims int")


def usable(v, dims=None):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_near_vectors(vectors):
    rows = vectors.collect()
    n = len(rows)
    fit = [usable(r["embedding"]) and r["label"] is not None and r["vec_id"] is not None for r in rows]
    unit = [np.array(r["embedding"], float) / np.linalg.norm(r["embedding"]) if f else None for r, f in zip(rows, fit)]
    links = {k: set() for k in range(n)}
    for a in range(n):
        for b in range(a):
            if fit[a] and fit[b] and rows[a]["label"] == rows[b]["label"] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.98:
                links[a].add(b)
                links[b].add(a)
    want = []
    for k in range(n):
        stack, seen = [k], {k}
        while stack:
            for j in links[stack.pop()] - seen:
                seen.add(j)
                stack.append(j)
        root = min((rows[j]["vec_id"] for j in seen if rows[j]["vec_id"] is not None), default=None)
        want.append((rows[k]["vec_id"], len(links[k]), root))
    found = [(r["vec_id"], r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(vectors).collect()]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert vector_dedup.near_vectors(vectors.where("false")).count() == 0


def exact_nearest(rows, k):
    data = [(r["vec_id"], np.array(r["embedding"], float)) for r in rows if usable(r["embedding"]) and r["vec_id"] is not None]
    out = {}
    for q, x in data:
        if q % 20 == 0:
            best = sorted((-float((x * y).sum()), i) for i, y in data if i != q and len(y) == len(x))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def test_nearest_recall_and_ties(vectors):
    rows = vectors.where("vec_id <> 3 or vec_id is null").collect()
    exact = exact_nearest(rows, 20)
    kept = vectors.where("vec_id <> 3 or vec_id is null")
    found = {}
    for r in nearest.nearest(kept, kept.where("vec_id % 20 = 0")).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert set(found) == {q for q in exact if exact[q]}
    hit = total = 0
    for q, near in found.items():
        own = [near[k] for k in sorted(near)]
        assert sorted(near) == list(range(1, len(own) + 1)) and len(own) == len(exact[q])
        assert [(i) for i, _ in own] == [i for i, _ in sorted(own, key=lambda x: (-x[1], x[0]))]
        hit += len({i for i, _ in own} & {i for i, _ in exact[q]})
        total += len(exact[q])
    assert hit >= 0.9 * total
    assert nearest.nearest(vectors.where("false"), vectors.where("false")).count() == 0


@pytest.mark.parametrize("kind", ["uniform", "clustered", "lengths"])
def test_recall_with_small_cells(spark, kind):
    """Cells of a few rows in blocks of fewer: neighbours are found whether vectors are spread, in clusters or of unequal lengths."""
    rnd = np.random.default_rng(12)
    x = rnd.standard_normal((3000, 8))
    if kind == "clustered":
        x = np.repeat(rnd.standard_normal((100, 8)), 30, axis=0) + 0.05 * x
    if kind != "lengths":
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    given = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    few = {"clustered": {"reach": 1.0, "growth": 0.75}}.get(kind, {})
    for r in nearest.nearest(given, given.where("vec_id % 20 = 0"), block=40, **few).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    hit = 0
    for q in range(0, 3000, 20):
        score = x @ x[q]
        score[q] = -np.inf
        hit += len(found[q].keys() & set(np.argsort(-score)[:20].tolist()))
        assert all(abs(s - score[i]) < 1e-12 for i, s in found[q].items()) and len(found[q]) == 20
    assert hit >= 0.9 * 20 * 150


def test_cells_are_cut_from_sorted_strings():
    rnd = np.random.default_rng(5)
    strings = np.sort(np.concatenate([rnd.integers(0, 1 << nearest.BITS, 3000), (7 << 40) + rnd.integers(0, 1 << 8, 500), np.full(90, 12345)]))
    depth = nearest.cut(strings, 50, 0)
    for s, d in zip(strings.tolist(), depth.tolist()):
        shared = lambda n: int(((strings >> (nearest.BITS - n)) == s >> (nearest.BITS - n)).sum())
        assert shared(d) <= 50 or d == nearest.BITS
        assert d == 0 or shared(d - 1) > 50
    ends = nearest.cut(strings[:60], 50, 6)
    assert ends[0] >= 6 and ends[-1] >= 6


def test_ascent_stops_once_enough_is_below(spark):
    """Queries climb to prefixes of one length or the next, hold at least the goal, and less than it without one of their trees' last steps."""
    rnd = np.random.default_rng(6)
    rows = [(k, [float(c) for c in v], [k]) for k, v in enumerate(rnd.standard_normal((1500, 12)))]
    plain = spark.createDataFrame(rows, "name long, vec array<double>, ids array<bigint>").select("vec", "ids", "name")
    forest = nearest.grow(plain, 6, 5, 1.0, 0.75, 64, 3)
    goal = forest.least
    for (dims, band), want in goal.items():
        n = forest.classes.where(f"band = {band}").count()
        ways = nearest.climb(forest, plain.where("name % 50 = 0")).where(f"band = {band}").collect()
        assert forest.rows.where(f"band = {band}").count() == 6 * n
        for q in range(0, 1500, 50):
            total = sum(r["n"] for r in ways if r["name"] == q)
            assert min(want, 6 * n) <= total <= max(2.5 * want, 6 * n if want >= 3 * n else 0) or want < 64


def test_the_forest_leaves_part_of_the_table_out(spark):
    given = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("embedding").alias("vec"), F.array("vec_id").alias("ids"), F.col("vec_id").alias("name"))
    n = given.count()
    forest = nearest.grow(given, 24, 21, 3.7, 0.84, 16384, 3)
    seen = nearest.climb(forest, given.where("name % 20 = 0")).withColumnRenamed("name", "q").join(forest.rows, nearest.CELL)
    shares = [r["c"] / n for r in seen.groupBy("q").agg(F.countDistinct("name").alias("c")).collect()]
    assert len(shares) == n // 20 and 0.1 < np.mean(shares) < 0.7 and max(shares) < 0.9


def test_recall_on_the_table(spark):
    from quarry.llm import queries

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    x = np.array([r["embedding"] for r in rows], float)
    ids = np.array([r["vec_id"] for r in rows])
    found = {}
    for r in queries.op6_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = total = 0
    for k in np.flatnonzero(ids % 20 == 0):
        score = x @ x[k]
        score[k] = -np.inf
        hit += len(found[ids[k]] & set(ids[np.argsort(-score)[:20]].tolist()))
        total += 20
    assert hit >= 0.9 * total


def test_components(spark):
    rnd = random.Random(1)
    for n, m in ((40, 25), (300, 280), (500, 0)):
        pairs = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)] if m else [(k, k + 1) for k in range(n)]
        root = list(range(n + 1))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        want = sorted((x, find(x)) for x in range(n + 1) if find(x) != x)
        assert sorted((r["node"], r["root"]) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()) == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_repeated_rows_count_once_among_neighbours(vectors):
    once = vectors.where("vec_id < 400").dropDuplicates(["vec_id"])
    again = once
    for _ in range(5):
        again = again.unionByName(again.where("vec_id in (20, 40, 3)"))
    rows = lambda given: sorted(map(tuple, nearest.nearest(given, given.where("vec_id % 20 = 0")).collect()))
    want = rows(once)
    assert len(want) == 400 and rows(again) == want


@pytest.mark.parametrize("partitions", ["4", "64"])
def test_dense_groups_are_counted_exactly(spark, partitions):
    """A group larger than windows and blocks keeps all its links, over any number of ranges; pairs beside it are found."""
    rnd = np.random.default_rng(8)
    base = rnd.standard_normal(16)
    rows = [(k, [float(np.float32(x)) for x in base + 0.08 * np.linalg.norm(base) / 4 * rnd.standard_normal(16)], 0) for k in range(2600)]
    lone = rnd.standard_normal((60, 16))
    rows += [(5000 + 2 * k + j, [float(np.float32(x)) for x in v + j * 0.005 * rnd.standard_normal(16)], 0) for k, v in enumerate(lone) for j in (0, 1)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_vectors(given).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.98).sum(1) - 1
    assert links[:2600].max() > 2048 and links[:2600].min() > 24
    assert [found[k][0] for k, _, _ in rows] == links.tolist()
    assert {found[k][1] for k in range(2600)} == {0}
    assert all(found[5000 + 2 * k][1] == found[5001 + 2 * k][1] == 5000 + 2 * k for k in range(60))
