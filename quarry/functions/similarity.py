"""String similarity: edit distance in bytes, Jaro and Jaro-Winkler, and the fuzzy score built on them."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.functions.text import as_bytes


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of the lower-case forms, counting bytes."""
    return F.levenshtein(as_bytes(F.lower(a)), as_bytes(F.lower(b)))


def padded(texts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join([t.ljust(width, b"\0") for t in texts]), np.uint8).reshape(len(texts), width)


def jaro_of(a: list[bytes], b: list[bytes], width: int) -> np.ndarray:
    """Jaro similarities of byte strings of at most width bytes; transpositions are halved to a whole number."""
    x, y = padded(a, width), padded(b, width)
    size_a, size_b = (np.fromiter(map(len, t), np.int64, len(t)) for t in (a, b))
    reach = np.maximum(np.maximum(size_a, size_b) // 2 - 1, 0)[:, None]
    place, rows = np.arange(width), np.arange(len(a))
    met, free = np.zeros(x.shape, bool), place < size_b[:, None]
    for i in range(int(size_a.max(initial=0))):
        fits = free & (y == x[:, i : i + 1]) & (np.abs(place - i) <= reach) & (i < size_a)[:, None]
        first = fits.argmax(1)
        hit = fits[rows, first]
        met[:, i] = hit
        free[rows[hit], first[hit]] = False
    taken = ~free & (place < size_b[:, None])
    m = met.sum(1)
    one, two = (np.take_along_axis(t, np.argsort(~kept, 1, kind="stable"), 1) for t, kept in ((x, met), (y, taken)))
    swapped = ((one != two) & (place < m[:, None])).sum(1) // 2
    some = np.maximum(m, 1)
    return np.where(m > 0, (m / np.maximum(size_a, 1) + m / np.maximum(size_b, 1) + (m - swapped) / some) / 3, 0.0)


@F.pandas_udf(DoubleType())
def _jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    """Strings of like length are worked on together."""
    out = np.full(len(a), np.nan)
    pairs = [(max(len(x), len(y), 1), k, x, y) for k, (x, y) in enumerate(zip(a, b, strict=True)) if x is not None and y is not None]
    groups: dict[int, list] = {}
    for size, k, x, y in pairs:
        groups.setdefault(1 << (size - 1).bit_length(), []).append((k, bytes(x), bytes(y)))
    for width, group in groups.items():
        step = max(1, (1 << 18) // width)  # some fifty bytes of scratch for each
        for at in range(0, len(group), step):
            places, one, two = zip(*group[at : at + step], strict=True)
            out[list(places)] = jaro_of(list(one), list(two), width)
    return pd.Series(out).astype(object).where(~np.isnan(out), None)


#: Evaluated once for each row, whatever filters stand above.
_jaro = _jaro.asNondeterministic()


def _jaro_bytes(a: Column, b: Column) -> Column:
    return _jaro(F.encode(F.lower(a), "UTF-8"), F.encode(F.lower(b), "UTF-8"))


def jaro(a: Column, b: Column) -> Column:
    """1 for equal strings (empty ones too), whatever their case otherwise."""
    return F.when(a == b, F.lit(1.0)).otherwise(_jaro_bytes(a, b))


def common_prefix(a: Column, b: Column, most: int = 4) -> Column:
    """Length of the common prefix in bytes, as written, up to most."""
    x, y = as_bytes(a), as_bytes(b)
    out = F.lit(0)
    for n in range(1, most + 1):
        out = F.when((F.length(x) >= n) & (F.substring(x, 1, n) == F.substring(y, 1, n)), F.lit(n)).otherwise(out)
    return out


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro raised by a tenth of the rest for each byte of common prefix, at any similarity."""
    prefix = common_prefix(a, b) * F.lit(0.1)
    return F.element_at(F.transform(F.array(jaro(a, b)), lambda j: j + prefix * (1 - j)), 1)


def fuzzy_score(query: Column, target: Column) -> Column:
    """1 if equal but for case, 0.9 if the target contains the query, else a blend of the two similarities,
    which alone is computed for the rest."""
    q, t = F.lower(query), F.lower(target)
    settled = F.when(q == t, F.lit(1.0)).when(F.contains(t, q), F.lit(0.9))
    left = F.when(settled.isNull(), t)
    blend = 0.6 * jaro_winkler(q, left) + 0.4 * (1 - edit_distance(q, left) / F.greatest(F.octet_length(q), F.octet_length(left)))
    return F.coalesce(settled, blend)


def edits_of(query: bytes, x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Edit distances of the query to the rows of x, byte strings of the given sizes."""
    above = np.broadcast_to(np.arange(x.shape[1] + 1), (len(x), x.shape[1] + 1)).astype(np.int32)
    for i, c in enumerate(query):
        row = np.empty_like(above)
        row[:, 0] = i + 1
        either = np.minimum(above[:, 1:] + 1, above[:, :-1] + (x != c))
        for j in range(x.shape[1]):
            np.minimum(either[:, j], row[:, j] + 1, out=row[:, j + 1])
        above = row
    return above[np.arange(len(x)), size]


def common_of(query: bytes, x: np.ndarray) -> np.ndarray:
    """How many bytes of the query each row of x has, wherever they stand."""
    return sum((np.minimum(n, (x == c).sum(1)) for c, n in Counter(query).items()), np.zeros(len(x), np.int64))


class Scorer:
    """Fuzzy scores of many texts against one query, without those that can't matter.

    Bytes that both have bound the matches of one similarity from above and the distance of the other from below, so
    that a score has a bound which costs little. Texts whose bound is below the least score asked for aren't scored; with
    most, neither are those below the score that so many others of their group have reached."""

    def __init__(self, query: str, most: int = 0):
        self.query, self.most, self.scored = query.lower().encode(), most, 0
        self.reached: dict = {}

    def floor(self, group) -> float:
        best = self.reached.get(group, [])
        return best[0] if self.most and len(best) == self.most else -1.0

    def reach(self, group, score: float) -> None:
        best = self.reached.setdefault(group, [])
        (heapq.heappush if len(best) < self.most else heapq.heappushpop)(best, score)

    def blend(self, jaro: np.ndarray, prefix: np.ndarray, likeness: np.ndarray) -> np.ndarray:
        return 0.6 * (jaro + prefix * 0.1 * (1 - jaro)) + 0.4 * likeness

    def scores(self, texts: list[bytes], least: np.ndarray, share: np.ndarray | None = None, groups: list | None = None) -> np.ndarray:
        """Scores of lower-case texts, nan for those that aren't scored or lie below least. share is what a score counts in its group."""
        q, out = self.query, np.full(len(texts), np.nan)
        share = np.ones(len(texts)) if share is None else share
        groups = groups or [None] * len(texts)
        widths: dict[int, list[int]] = {}
        for k, t in enumerate(texts):
            if t == q or q in t:
                out[k] = 1.0 if t == q else 0.9
            else:
                widths.setdefault(1 << (max(len(t), len(q), 4) - 1).bit_length(), []).append(k)
        for k in np.flatnonzero(~np.isnan(out) & (out >= least)).tolist() if self.most else ():
            self.reach(groups[k], out[k] * share[k])
        for width, places in widths.items():
            for at in range(0, len(places), step := max(1, (1 << 22) // width)):
                some = places[at : at + step]
                self.blends([texts[k] for k in some], np.array(some), width, least, share, groups, out)
        out[out < least] = np.nan
        return out

    def blends(self, texts: list[bytes], places: np.ndarray, width: int, least: np.ndarray, share: np.ndarray, groups: list, out: np.ndarray) -> None:
        q, x = self.query, padded(texts, width)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        longer, common = np.maximum(size, len(q)), common_of(q, x)
        same = x[:, :4] == np.frombuffer(q[:4].ljust(4, b"\0"), np.uint8)
        prefix = np.logical_and.accumulate(same & (np.arange(4) < np.minimum(size, len(q))[:, None]), 1).sum(1)
        most_alike = np.where(common > 0, (common / max(len(q), 1) + common / np.maximum(size, 1) + 1) / 3, 0.0)
        bound = self.blend(most_alike, prefix, common / np.maximum(longer, 1)) + 1e-9
        order = np.argsort(-bound * share[places], kind="stable")
        order = order[bound[order] >= least[places[order]]]
        for at in range(0, len(order), 512):
            some = order[at : at + 512]
            if self.most:
                some = some[[bound[k] * share[places[k]] >= self.floor(groups[places[k]]) for k in some]]
            if not len(some):
                continue
            self.scored += len(some)
            jaro = jaro_of([q] * len(some), [texts[k] for k in some], width)
            score = self.blend(jaro, prefix[some], 1 - edits_of(q, x[some], size[some]) / longer[some])
            out[places[some]] = score
            for k, s in zip(places[some].tolist(), score.tolist(), strict=True) if self.most else ():
                if s >= least[k]:
                    self.reach(groups[k], s * share[k])


def query_scores(query: str, text: Column, least: Column, share: Column | None = None, group: Column | None = None, most: int = 0) -> Column:
    """fuzzy_score() of one query and texts; null where it is below least or, with most, where as many texts of the same group (of those
    that the task has met) have a higher share of theirs. Worked on in batches, few of which are scored."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        scorer = Scorer(query, most)
        for texts, leasts, shares, groups in batches:
            given = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
            scores = scorer.scores(given, leasts.to_numpy(zero_copy_only=False), shares.to_numpy(zero_copy_only=False), groups.to_pylist())
            yield pa.array(scores, mask=np.isnan(scores) | texts.is_null().to_numpy(zero_copy_only=False))

    made = F.arrow_udf(run, DoubleType()).asNondeterministic()
    return made(F.lower(text), least.cast("double"), (F.lit(1.0) if share is None else share).cast("double"), F.lit(0) if group is None else group)
