"""Substring dedup by level-wise doubling of repeated word windows.

A window of `length` words can only be repeated if the shorter windows inside it are. Levels double:

- level one counts windows of a quarter of the length: of those inside a full window just the one with the
  smallest hash, which is the same wherever the same words stand, so that a repeated full window always
  meets its copy there. Neighbouring full windows that share that place form a span;
- where it is repeated, level two extends it to twice its length, to the left and to the right: a full
  window has room for at least one of both. Spans go on if either is repeated;
- level three doubles again, to full windows. Whole spans are counted first, since a repeated span settles
  all its windows at once; then the windows of the other spans, and of one span out of each repeated
  kind on behalf of the rest.

At each level only what survived the one before is counted, and no candidates are left after the last.
Hashes of n + m words are mixed from those of n and of m words; spans are told apart by 128 bits and
windows by 95, the levels before them by 64, where a false equality only lets a candidate go on.

Exact copies of a text are found first: all their windows are repeated, so they lose all words (if
they have enough), and only one of them is looked into on behalf of the others.

Counts are combined before each shuffle, and what goes back to the documents are joins whose other
side has one row for each hash, so no task gathers all places of a frequent passage.

Edge cases: a null text has no words; texts shorter than the window keep all words; repeated rows are
copies of each other; windows that overlap their own copy in one document count as repeated; texts
are processed whole; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import release, stored

U = np.uint64


#: Bytes that separate words.
BLANK = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Fixed numbers that stand for bytes in word hashes.
BYTES = np.random.default_rng(7).integers(1 << 62, size=256, dtype=U) * (~BLANK)
STEP = 0x9E3779B97F4A7C15
#: The seeds list of a document packs place, status and a check of the span's hash.
CERTAIN, OPEN, SPEAKS = 1, 2, 3


def stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return stirred(a * U(STEP) + (b << U(29) | b >> U(35)))


@lru_cache(maxsize=4)
def powers(base: int, size: int) -> np.ndarray:
    out = np.full(size, U(base))
    out[0] = 1
    return np.cumprod(out)


class Words:
    """The words of some texts, one after the other: hashes, and where each text's words begin and end."""

    def __init__(self, texts: list):
        raw = [(t or "").encode() for t in texts]
        self.data = b"\n".join(raw)
        a = np.frombuffer(self.data, np.uint8)
        blank = BLANK[a].astype(np.int8)
        edge = np.diff(np.concatenate([[1], blank, [1]]).astype(np.int8))
        self.start, self.end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        size = 1 << max(19, len(a).bit_length())
        sums = np.concatenate([np.zeros(1, U), np.cumsum(BYTES[a] * powers(STEP, size)[: len(a)])])
        back = powers(pow(STEP, -1, 1 << 64), size)
        self.hash = stirred((sums[self.end] - sums[self.start]) * back[self.start] + (self.end - self.start).astype(U))
        self.second = self.second_hash()
        ends = np.cumsum([len(r) + 1 for r in raw])
        self.bounds = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)


    def second_hash(self) -> np.ndarray:
        """Hashes of the words that tell nothing of the first: eight bytes at a time, each mixed with its place in the word."""
        size = self.end - self.start
        count = (size + 7) >> 3
        first = np.cumsum(count) - count
        step = np.arange(int(count.sum())) - np.repeat(first, count)
        eight = np.ndarray(len(self.data) + 1, "<u8", self.data + b"\0" * 8, strides=(1,))
        left = np.minimum(np.repeat(size, count) - 8 * step, 8).astype(U)
        part = eight[np.repeat(self.start, count) + 8 * step] & (~U(0) >> (U(64) - U(8) * left))
        mixed = stirred(stirred(part ^ U(0xC2B2AE3D27D4EB4F)) + stirred(step.astype(U) + U(0x165667B19E3779F9)))
        return stirred(np.add.reduceat(mixed, first) + size.astype(U)) if len(size) else np.empty(0, U)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all windows of length words, by doubling."""
    n, now = 1, words
    while n < length:
        step = min(n, length - n)
        if len(now) <= step:
            return np.empty(0, U)
        now = joined(now[:-step], now[step:])
        n += step
    return now


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest (the first of equal ones) of each width values in a row, by doubling."""
    n, place = 1, np.arange(len(values))
    while n < width:
        step = min(n, width - n)
        left, right = place[:-step], place[step:]
        place = np.where(values[left] <= values[right], left, right)
        n += step
    return place


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def second_hashes(words: Words, length: int) -> np.ndarray:
    """Hashes of all windows from the second ones of their words: equal by chance apart from the first."""
    return window_hashes(words.second, length)


class Spans:
    """Runs of neighbouring full windows inside a text that share their smallest quarter window, at one place.

    first, last: the run's windows, by their first words; at: where the quarter window begins.
    """

    def __init__(self, words: Words, length: int):
        self.words, self.length, self.quarter = words, length, (length + 3) // 4
        self.full = window_hashes(words.hash, length)
        self.short = window_hashes(words.hash, self.quarter)
        least = least_places(self.short, length - self.quarter + 1) if len(self.full) else np.empty(0, np.int64)
        place = np.arange(len(self.full))
        text = np.searchsorted(words.bounds, place, "right") - 1
        inside = place + length <= words.bounds[np.minimum(text + 1, len(words.bounds) - 1)]
        new = np.ones(len(place), bool)
        new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
        new &= inside
        self.first = place[new]
        follow = np.append(self.first[1:], len(place))
        stop = words.bounds[text[self.first] + 1] - length
        self.last = np.minimum(follow - 1, stop)
        self.text, self.at = text[self.first], least[self.first]
        self.whole = self.joined_ends(self.full)

    def joined_ends(self, full: np.ndarray) -> np.ndarray:
        """A hash of all words of each span: its first and last window cover them."""
        return joined(joined(full[self.first], full[self.last]), (self.last - self.first).astype(U))

    def doubled(self) -> tuple[pa.Array, pa.Array]:
        """Hashes of the quarter window with as many words before it, and after it; null where the text has too few."""
        q, bounds = self.quarter, self.words.bounds
        double = np.append(window_hashes(self.words.hash, 2 * q), U(0))
        out = []
        for begin in (self.at - q, self.at):
            fits = (begin >= bounds[self.text]) & (begin + 2 * q <= bounds[self.text + 1])
            out.append(pa.array(signed(double[np.where(fits, begin, -1)]), mask=~fits))
        return out[0], out[1]


def pieces(batch: pa.RecordBatch, size: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about size bytes of text (column 0) each; a longer text is a part of its own."""
    at, total = 0, 0
    for k, n in enumerate(pc.binary_length(batch.column(0)).to_pylist()):
        if total and total + (n or 0) > size:
            yield batch.slice(at, k - at)
            at, total = k, 0
        total += n or 0
    if batch.num_rows > at:
        yield batch.slice(at)


def keyed(docs: DataFrame, key: str, text: str, *others: Column) -> DataFrame:
    """text, and what tells rows apart: the id (a number of its own for null) and 128 bits of the text's md5."""
    m = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    half = lambda at: F.coalesce(F.conv(F.substring(m, at, 16), 16, -10).cast("long"), F.lit(0).cast("long"))  # noqa: E731  (never null, and known not to be)
    return docs.select(F.col(text).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("id"), half(1).alias("k1"), half(17).alias("k2"), *others)


NO_ID = -(1 << 63)


def first_level(rows: DataFrame, length: int) -> DataFrame:
    """All spans: h (quarter window), before and after (its extensions), g and g2 (whole span), k1 (the text), place in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words = Words(part.column(0).to_pylist())
                spans = Spans(words, length)
                k1 = part.column(1).to_numpy()[spans.text]
                place = (spans.first - words.bounds[spans.text]).astype(np.int32)
                other = spans.joined_ends(second_hashes(words, length))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(spans.short[spans.at])), *spans.doubled(), pa.array(signed(spans.whole)), pa.array(signed(other)), pa.array(k1), pa.array(place)], names=["h", "before", "after", "g", "g2", "k1", "place"]
                )

    return rows.select("text", "k1").mapInArrow(run, "h long, before long, after long, g long, g2 long, k1 long, place int")


def repeated_longs(values: DataFrame, *keys: str) -> DataFrame:
    return values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*keys)


def second_level(met: DataFrame) -> DataFrame:
    """Spans one of whose extensions is repeated too."""
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("before").alias("d")), F.struct(F.lit(1).alias("side"), F.col("after").alias("d")))
    doubled = met.select("g", "g2", "k1", "place", F.inline(sides)).where(F.col("d").isNotNull())
    often = unplaced(repeated_longs(doubled, "side", "d"), "d")
    return doubled.join(often, ["side", "d"]).select("g", "g2", "k1", "place").distinct()


def seeded_spans(words: Words, spans: Spans, seeds: list) -> np.ndarray:
    """The status of each span: 0 where it isn't seeded. seeds: packed numbers of each text, or None."""
    status = np.zeros(len(spans.first), np.int64)
    check = signed(spans.whole) & ((1 << 30) - 1)
    for k, packed in enumerate(seeds):
        if packed is not None and len(packed):
            packed = np.asarray(packed)
            place, kind, want = packed >> 32, packed >> 30 & 3, packed & ((1 << 30) - 1)
            at = np.searchsorted(spans.first, place + words.bounds[k])
            at = np.minimum(at, len(spans.first) - 1)
            fits = (spans.first[at] == place + words.bounds[k]) & (spans.text[at] == k) & (check[at] == want)
            status[at[fits]] = kind[fits]
    return status


def third_level(rows: DataFrame, length: int) -> DataFrame:
    """Full windows of spans that aren't settled or speak for their kind: a, b (hash), k1, place, open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                words = Words(part.column(0).to_pylist())
                spans = Spans(words, length)
                status = seeded_spans(words, spans, [s.values.to_numpy() if s.is_valid else None for s in part.column(2)])
                pick = np.flatnonzero(status >= OPEN)
                many = spans.last[pick] - spans.first[pick] + 1
                where = np.repeat(spans.first[pick] - np.cumsum(many) + many, many) + np.arange(many.sum())
                span = np.repeat(pick, many)
                other = second_hashes(words, length)[where]
                text = spans.text[span]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(spans.full[where])), pa.array((other >> U(33)).astype(np.int32)), pa.array(part.column(1).to_numpy()[text]), pa.array((where - words.bounds[text]).astype(np.int32)), pa.array(status[span] == OPEN)],
                    names=["a", "b", "k1", "place", "open"],
                )

    # also is asked for so that the texts lie ready for cut() as they do here, shuffled once.
    return rows.select("text", "k1", "seeds", "id", "k2", "also").mapInArrow(run, "a long, b int, k1 long, place int, open boolean")


def cut(rows: DataFrame, length: int, as_is: bool) -> DataFrame:
    """id, kept_text, n_words, n_removed, k1, also. rows: text, id, seeds, places (of repeated windows), all (copies
    exist), k1, also. With as_is, a text that loses nothing stays as it is written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                texts = part.column(0).to_pylist()
                words = Words(texts)
                seeds = [s.values.to_numpy() if s.is_valid else None for s in part.column(2)]
                edge = np.zeros(len(words.hash) + 1, np.int64)
                if any(s is not None for s in seeds):
                    spans = Spans(words, length)
                    sure = np.flatnonzero(np.isin(seeded_spans(words, spans, seeds), [CERTAIN, SPEAKS]))
                    np.add.at(edge, spans.first[sure], 1)
                    np.add.at(edge, spans.last[sure] + length, -1)
                for k, places in enumerate(part.column(3)):
                    if places.is_valid:
                        at = places.values.to_numpy() + words.bounds[k]
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge)[:-1] > 0
                sizes = np.diff(words.bounds)
                for k, whole in enumerate(part.column(4).to_pylist()):
                    if whole and sizes[k] >= length:
                        gone[words.bounds[k] : words.bounds[k + 1]] = True
                upto = np.concatenate([[0], np.cumsum(gone)])
                lost = upto[words.bounds[1:]] - upto[words.bounds[:-1]]
                kept = []
                for text, a, b, n in zip(texts, words.bounds, words.bounds[1:], lost.tolist(), strict=False):
                    if as_is and not n:
                        kept.append(text)
                        continue
                    at = np.flatnonzero(~gone[a:b]) + a
                    kept.append(b" ".join([words.data[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]).decode())
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(kept, pa.string()), pa.array(sizes), pa.array(lost), part.column(5), part.column(6)], names=["id", "kept_text", "n_words", "n_removed", "k1", "also"])

    kind = rows.schema["also"].dataType.simpleString()
    return rows.select("text", "id", "seeds", "places", "all", "k1", "also").mapInArrow(run, f"id long, kept_text string, n_words long, n_removed long, k1 long, also {kind}")


def unplaced(df: DataFrame, *keys: str) -> DataFrame:
    """The same rows, but the planner no longer knows that they lie by key: a join on it then shuffles both
    sides, and a partition that one frequent key fills can be split at run time."""
    return df.select(*[F.col(c).bitwiseXOR(F.lit(0)).alias(c) if c in keys else F.col(c) for c in df.columns])


def remove_repeats(docs: DataFrame, length: int = 35, key: str = "doc_id", text: str = "text", also: list[str] | None = None, as_is: bool = False) -> DataFrame:
    """doc_id, kept_text (kept words joined by one space), n_words, n_removed, and the columns named in also (not doc_id):
    every word that a window of length words covers, which starts anywhere else too, is removed.

    With as_is, the text of a row that loses no word is the one given, white space included."""
    spark = docs.sparkSession
    rows = keyed(docs, key, text, F.struct(F.lit(0).alias("c"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(also or [])]).alias("also"))
    texts, _ = stored(rows.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")))
    spans, spans_at = stored(first_level(rows, length))
    met = spans.join(unplaced(repeated_longs(spans, "h"), "h"), "h")
    if length >= 3 * ((length + 3) // 4) - 1:  # else a full window may have no room for either extension
        met, met_at = stored(second_level(met))
    else:
        met, met_at = stored(met.select("g", "g2", "k1", "place").distinct())
    release(spark, spans_at)
    met = met.withColumn("occ", F.xxhash64("k1", "place"))
    kinds = met.groupBy("g", "g2").agg(F.min("occ").alias("lo"), F.max("occ").alias("hi"))
    status = F.when(F.col("lo") == F.col("hi"), OPEN).when(F.col("occ") == F.col("lo"), SPEAKS).otherwise(CERTAIN)
    packed = F.shiftleft(F.col("place").cast("long"), 32) + F.shiftleft(status.cast("long"), 30) + F.col("g").bitwiseAND(F.lit((1 << 30) - 1))
    seeds, _ = stored(met.join(unplaced(kinds, "g", "g2"), ["g", "g2"]).select("k1", packed.alias("seed")).groupBy("k1").agg(F.collect_set("seed").alias("seeds")))
    release(spark, met_at)

    by = ["id", "k1", "k2"]
    asked = rows.join(texts.join(seeds, "k1").select(*by, "seeds"), by)
    windows = third_level(asked, length)
    repeated = repeated_longs(windows, "a", "b")
    places = windows.where("open").join(unplaced(repeated, "a", "b"), ["a", "b"]).groupBy("k1").agg(F.collect_set("place").alias("places"))
    single = texts.where("copies = 1").join(seeds, "k1").join(places, "k1", "left").select(*by, "seeds", "places", F.lit(False).alias("all"))
    several = rows.select(*by).join(texts.where("copies > 1").select("k1", "k2"), ["k1", "k2"]).distinct()
    known = single.unionByName(several.select(*by, F.lit(None).cast("array<bigint>").alias("seeds"), F.lit(None).cast("array<int>").alias("places"), F.lit(True).alias("all")))
    done = cut(rows.join(known, by, "left"), length, as_is)
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "kept_text", "n_words", "n_removed", *[F.col(f"also.c{k}").alias(c) for k, c in enumerate(also or [])])
