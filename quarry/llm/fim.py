"""Fill-in-middle: texts cut at two line bounds and put in another order, by a learned index of the bounds.

The offsets of all line bounds of a text grow with their rank; they are fitted by straight pieces between
knots, halved until no bound is further than `bound` bytes from its piece. What is stored for a text are
the knots and one byte a bound, its residual: a cut predicts the offset of a rank from the knots around it
and adds the residual, which is exact. Whole numbers are used throughout. All texts of a batch are fitted
together, level by level, so that a batch of many short texts costs a few array operations.

The index counts bytes of UTF-8; cuts lie behind line ends or at the ends of a text, so never inside a
character. Texts are worked on row by row, nothing is shuffled, and a task holds a few MB of texts or one
long one.

Edge cases: null texts are empty; a text without characters, or one that holds a mark, stays plain; a null
key is written as nothing in the seeded hash; cuts may coincide, prefix, middle or suffix may be empty;
repeated rows give equal rows; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Bytes of text that are fitted together, a longer text alone.
STEP = 8 << 20
#: The largest error of a piece: a residual is one byte.
BOUND = 127
NEWLINE = 10


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + count, count)


class RankIndex:
    """Offsets by rank of the line bounds of several texts: text d is data[at[d]:at[d + 1]] and has n[d] lines, bounds 0 to n[d]."""

    def __init__(self, data: np.ndarray, at: np.ndarray, bound: int = BOUND):
        newlines = np.flatnonzero(data == NEWLINE)
        within = np.searchsorted(newlines, at)
        ended = np.diff(within)
        size = np.diff(at)
        last = data[np.maximum(at[1:] - 1, 0)] if len(data) else np.zeros(len(size), np.uint8)
        open_end = (size > 0) & (last != NEWLINE)
        self.at, self.n = at, ended + open_end
        self.base = np.concatenate([[0], np.cumsum(self.n + 1)])
        offsets = np.zeros(self.base[-1], np.int64)
        offsets[ranges(self.base[:-1] + 1, ended)] = newlines + 1 - np.repeat(at[:-1], ended)
        offsets[(self.base[1:] - 1)[open_end]] = size[open_end]
        self.fit(offsets, bound)

    def fit(self, offsets: np.ndarray, bound: int) -> None:
        """Pieces are places in offsets from one knot to the next; those with too large an error are halved."""
        self.residuals = np.zeros(len(offsets), np.int8)
        left, right = self.base[:-1][self.n > 0], (self.base[1:] - 1)[self.n > 0]
        knots = [self.base[:-1], right]
        while len(left):
            count = right - left
            place = ranges(left, count)
            error = offsets[place] - straight(offsets, np.repeat(left, count), np.repeat(right, count), place)
            bad = np.maximum.reduceat(np.abs(error), np.cumsum(count) - count) > bound
            fine = np.repeat(~bad, count)
            self.residuals[place[fine]] = error[fine]
            middle = (left[bad] + right[bad]) // 2
            knots.append(middle)
            left, right = np.concatenate([left[bad], middle]), np.concatenate([middle, right[bad]])
        self.knots = np.unique(np.concatenate(knots))
        self.heights = offsets[self.knots]

    def cut(self, texts: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """The offset of a bound in each text: predicted from the knots around it, then corrected."""
        place = self.base[texts] + ranks
        right = np.searchsorted(self.knots, place)
        left = np.where(self.knots[right] == place, right, right - 1)
        return piece(self.knots[left], self.heights[left], self.knots[right], self.heights[right], place) + self.residuals[place]


def piece(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, x: np.ndarray) -> np.ndarray:
    return y0 + (x - x0) * (y1 - y0) // np.maximum(x1 - x0, 1)


def straight(offsets: np.ndarray, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
    return piece(left, offsets[left], right, offsets[right], place)


def packed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of texts without nulls, one after another, and where each begins, with the end."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Stretches of a batch of about STEP bytes of text, with their packed texts."""
    if not len(batch):
        return
    texts = pc.fill_null(batch.column(column), "")
    data, at = packed(texts)
    first = 0
    while first < len(batch):
        last = max(first + 1, int(np.searchsorted(at, at[first] + STEP, side="right")) - 1)
        yield batch.slice(first, last - first), data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def rank_index(docs: DataFrame, key: str = "doc_id", text: str = "text", bound: int = BOUND) -> DataFrame:
    """key, n (lines), knots (rank, offset), residuals (a signed byte a bound): what a cut at any rank needs, without the text.

    Offset of rank r between knots (a, x) and (b, y): x + (r - a) * (y - x) // (b - a) + residual of r."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in portions(batch, 1):
                index = RankIndex(data, at, bound)
                cuts = np.searchsorted(index.knots, index.base)
                ranks = index.knots - np.repeat(index.base[:-1], np.diff(cuts))
                pairs = pa.StructArray.from_arrays([pa.array(ranks.astype(np.int64)), pa.array(index.heights)], ["rank", "offset"])
                knots = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pairs)
                held = index.residuals.tobytes()
                residuals = pa.array([held[a:b] for a, b in zip(index.base[:-1].tolist(), index.base[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(index.n.astype(np.int64)), knots, residuals], names=["key", "n", "knots", "residuals"])

    kind = docs.schema[key].dataType.simpleString()
    made = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n long, knots array<struct<rank:bigint,offset:bigint>>, residuals binary")
    return made.withColumnRenamed("key", key)


def draws(key: Column, seed: int, count: int = 4) -> list[Column]:
    """Whole numbers below 2^32 from the first groups of eight hex digits of the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(count)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """key, n, form ('psm', 'spm' or 'plain'), prefix_chars, middle_chars, output: one row for each row of docs.

    rate is the share in per cent of texts that are cut, spm that of the cut ones whose suffix comes first."""
    h1, h2, h3, h4 = draws(F.col(key), seed)
    body = F.coalesce(F.col(text), F.lit(""))
    held = F.contains(body, F.lit(MARKS[0])) | F.contains(body, F.lit(MARKS[1])) | F.contains(body, F.lit(MARKS[2]))
    form = F.when((body == "") | held | (h3 % 100 >= rate), F.lit("plain")).when(h4 % 100 < spm, F.lit("spm")).otherwise(F.lit("psm"))
    before, after, middle = (m.encode() for m in MARKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in portions(batch, 1):
                index = RankIndex(data, at)
                one, two = (part.column(c).to_numpy() % (index.n + 1) for c in (3, 4))
                each = np.arange(len(part))
                first, second = (at[:-1] + index.cut(each, r) for r in (np.minimum(one, two), np.maximum(one, two)))
                forms = part.column(2).to_pylist()
                made, chars = [], ([], [])
                for kind, start, a, b, end in zip(forms, at[:-1].tolist(), first.tolist(), second.tolist(), at[1:].tolist(), strict=True):
                    if kind == "plain":
                        made.append(data[start:end].tobytes())
                        spans = (None, None)
                    else:
                        x, y, z = data[start:a], data[a:b], data[b:end]
                        pieces = (before, x.tobytes(), after, z.tobytes()) if kind == "psm" else (after, z.tobytes(), before, x.tobytes())
                        made.append(b"".join((*pieces, middle, y.tobytes())))
                        spans = (points(x), points(y))
                    chars[0].append(spans[0])
                    chars[1].append(spans[1])
                # Whole lines of valid texts are valid.
                output = pa.array(made, pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(index.n.astype(np.int64)), part.column(2), *[pa.array(c, pa.int64()) for c in chars], output], names=["key", "n", "form", "prefix_chars", "middle_chars", "output"])
            pa.default_memory_pool().release_unused()

    kind = docs.schema[key].dataType.simpleString()
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    made = given.mapInArrow(run, f"key {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("key", key)


def points(data: np.ndarray) -> int:
    """Code points of UTF-8 bytes: all but the continuing ones."""
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A cut text holds no mark, so each mark stands once."""
    part = F.split(output, "|".join(MARKS), -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


#: The same for DuckDB, from lines and without an index.
FIM_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS ls, [('0x' || substr(h, 1 + 8 * i, 8))::BIGINT FOR i IN range(4)] AS hs FROM d),
c AS (SELECT *, len(ls) AS n, least(hs[1] % (len(ls) + 1), hs[2] % (len(ls) + 1)) AS a, greatest(hs[1] % (len(ls) + 1), hs[2] % (len(ls) + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR hs[3] % 100 >= 100 THEN 'plain' WHEN hs[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
p AS (SELECT *, array_to_string(ls[1:a], '') AS p, array_to_string(ls[a + 1:b], '') AS m, array_to_string(ls[b + 1:], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256 FROM p"""
