"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training progress t from 0 to 1, linear from start to end.
Its integral (start + end) / 2 is the source's overall weight; the weights share out the whole size,
no source being taken more often than max_repeats times. The demand for a source's words up to t is
the schedule's integral up to t; inverting it at the place where a document stands in its source's
stream gives the document's training position, by which the mix is range-sorted.

A source's stream is its documents in the order of an md5 of id and text, repeated as often as needed; the
mix takes what the inverted demand places before the end of training, the first target words of the
stream, so at most one document of a source is taken in part.

No source is ever gathered in one task: running sizes are built from sums over hash buckets
(two-level prefix sums), the bucket being the first hex digits of the md5. Sources themselves, one row
each with its size, are sorted in one task: their number must stay in the millions.

Edge cases: null texts have size 0 and are never taken; a null source is a source of its own, last in
order; repeated rows count as often as they occur and share their draws arbitrarily but equally sized;
empty tables give empty results; extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import partitions, word_count


def source_targets(sizes: DataFrame, weights: tuple[float, ...], max_repeats: int, tilt: float) -> DataFrame:
    """One row for each source: source_size, target, and its schedule's start and end.

    sizes: source, source_size. The cap is met as if the excess were reshared until none is above:
    sources sorted by capacity over weight, each is capped iff the level left for it and those after
    it exceeds its capacity.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    lean = F.when(F.row_number().over(order) % 2 == 0, F.lit(tilt)).otherwise(F.lit(-tilt))
    named = sizes.select("source", "source_size", weight.alias("weight"), lean.alias("lean"))
    named = named.withColumn("room", F.col("source_size") * F.lit(max_repeats)).withColumn("ratio", F.col("room") / F.col("weight"))
    before = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    total, all_weight = F.sum("source_size").over(every), F.sum("weight").over(every)
    level = (total - F.coalesce(F.sum("room").over(before), F.lit(0))) / (all_weight - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    open_level = F.max(F.when(F.col("ratio") >= F.col("level"), F.col("level"))).over(every)
    return (
        named.withColumn("level", level)
        .withColumn("target", F.least(F.col("room").cast("double"), F.col("weight") * F.coalesce(open_level, F.lit(0.0))))
        .select("source", "source_size", "target", (F.col("weight") * (1 - F.col("lean"))).alias("start"), (F.col("weight") * (1 + F.col("lean"))).alias("end"))
    )


def position(share: Column, start: Column, end: Column) -> Column:
    """The t at which a linear schedule's integral reaches this share of its whole: the inverted demand."""
    mean, slope = (start + end) / 2, end - start
    root = F.sqrt(F.greatest(start * start + 2 * slope * share * mean, F.lit(0.0)))
    return F.when(F.abs(slope) < 1e-12, share).otherwise((root - start) / slope)


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[float, ...] = (1.0, 2.0, 3.0), max_repeats: int = 3, tilt: float = 0.5) -> DataFrame:
    """doc_id, size, source, source_size, target, taken, first_position and last_position (of its first and last word
    taken in training, 0 to 1; null if none is), stream_at, start, end, mark (a hash of the text), one row for each document."""
    whole = F.coalesce(F.col(text), F.lit("")).cast("binary")
    draw = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit("/"), F.md5(whole)).cast("binary"))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("mark"), draw.alias("draw"))
    rows = rows.withColumn("cell", F.substring("draw", 1, 3))
    cells = rows.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    sources = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, max_repeats, tilt)
    up_to = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.withColumn("cell_from", F.coalesce(F.sum("cell_size").over(up_to), F.lit(0)))
    plan = offsets.alias("o").join(sources.alias("s"), F.expr("o.source <=> s.source")).select("o.source", "o.cell", "cell_from", "source_size", "target", "start", "end")
    inside = Window.partitionBy("source", "cell").orderBy("draw", "doc_id", "size", "mark").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source and d.cell = p.cell"))
    at = placed.select(F.col("d.doc_id").alias("doc_id"), "size", F.col("d.source").alias("source"), "source_size", "target", (F.col("cell_from") + F.col("before")).alias("stream_at"), "start", "end", "mark")
    # Each turn of the stream has the document's words at begun and after; the demand places those below the target.
    begun = [F.col("stream_at") + turn * F.col("source_size") for turn in range(max_repeats)]
    words = [F.least(F.greatest(F.floor("target").cast("long") - b, F.lit(0)), F.col("size")) for b in begun]
    ends = F.greatest(*[F.when(w > 0, b + w - 1) for b, w in zip(begun, words, strict=True)])
    position_of = lambda offset: position(offset / F.col("target"), F.col("start"), F.col("end"))
    mixed = at.withColumn("taken", sum(words[1:], words[0])).withColumn("first_position", F.when(words[0] > 0, position_of(begun[0]))).withColumn("last_position", F.when(words[0] > 0, position_of(ends)))
    return mixed.select("doc_id", "size", "source", "source_size", "target", "taken", "first_position", "last_position", "stream_at", "start", "end", "mark")


def takes(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Each document as often as the mix takes it, range-sorted by training position. A last take of less
    than half of the document is left out, one of more is the whole document.

    Documents are told apart by id, source and text: null ids are taken like others, and different texts with
    one id each have their own takes. Rows equal in all three each take the largest share of one of them."""
    times = (
        mixed.where(F.col("size") > 0)
        .groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("mark").alias("__mark"))
        .agg(F.max(F.struct((F.col("taken") / F.col("size")).alias("share"), "source_size", "target", "stream_at", "start", "end")).alias("__m"))
        .select("__id", "__source", "__mark", "__m.*")
        .withColumn("__turns", F.round("share").cast("int"))
        .where(F.col("__turns") > 0)
        .withColumn("__turn", F.explode(F.sequence(F.lit(0), F.col("__turns") - 1)))
        .withColumn("__position", position(F.least((F.col("stream_at") + F.col("__turn") * F.col("source_size")) / F.col("target"), F.lit(1.0)), F.col("start"), F.col("end")))
        .select("__id", "__source", "__mark", "__position")
    )
    same = docs[key].eqNullSafe(times["__id"]) & docs[source].eqNullSafe(times["__source"]) & (F.xxhash64(docs[text]) == times["__mark"])
    joined = docs.join(times, same)
    return joined.repartitionByRange(partitions(docs.sparkSession), "__position", "__id").sortWithinPartitions("__position", "__id").select(*[docs[c] for c in docs.columns])


#: The same rows in DuckDB's SQL, for weights 1, 2, 3, three repeats and a tilt of one half.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
             CASE WHEN row_number() OVER (ORDER BY source NULLS LAST) % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS lean FROM s),
r AS (SELECT *, 3 * source_size AS room, 3 * source_size / weight AS ratio FROM n),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(room) OVER b, 0))
               / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(room::DOUBLE, weight * coalesce(max(CASE WHEN ratio >= level THEN level END) OVER (), 0)) AS target,
             weight * (1 - lean) AS a, weight * (1 + lean) AS z FROM l),
p AS (SELECT doc_id, size, source_size, target, a, z - a AS slope, (a + z) / 2 AS mean, floor(target)::BIGINT AS wanted,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS begun
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, least(greatest(wanted - begun, 0), size) AS w0, least(greatest(wanted - begun - source_size, 0), size) AS w1,
             least(greatest(wanted - begun - 2 * source_size, 0), size) AS w2 FROM p),
e AS (SELECT *, CASE WHEN w0 > 0 THEN begun / target END AS first,
             CASE WHEN w2 > 0 THEN begun + 2 * source_size + w2 - 1 WHEN w1 > 0 THEN begun + source_size + w1 - 1 WHEN w0 > 0 THEN begun + w0 - 1 END / target AS last FROM q)
SELECT doc_id, size, source_size, target, (w0 + w1 + w2)::BIGINT AS taken,
       CASE WHEN w0 > 0 THEN (sqrt(greatest(a * a + 2 * slope * first * mean, 0)) - a) / slope END AS first_position,
       CASE WHEN w0 > 0 THEN (sqrt(greatest(a * a + 2 * slope * last * mean, 0)) - a) / slope END AS last_position FROM e
"""
