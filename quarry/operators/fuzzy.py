"""Identifiers, typo-tolerant scores, suggestions."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.similarity import query_scores
from quarry.functions.text import two_digits

#: Words that are never identifiers.
KEYWORDS = (
    "if", "else", "for", "return", "func", "var", "const", "type", "package", "import", "nil", "true", "false", "int", "string", "bool",
    "float64", "error", "interface", "struct", "map", "chan", "go", "defer", "switch", "case", "default", "break", "continue", "select", "range",
)
IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]*"
#: Functions and methods with their parameter lists.
FUNCTIONS = (r"func[\t\n\f\r ]+(\w+)[\t\n\f\r ]*(\([^)]*\))", r"func[\t\n\f\r ]+\([^)]+\)[\t\n\f\r ]+(\w+)[\t\n\f\r ]*(\([^)]*\))")
COMPILED = tuple(re.compile(p.encode()) for p in FUNCTIONS)
IDENTIFIER_LEAST, FUNCTION_LEAST, FUNCTION_SHARE, PER_ROOT = 0.5, 0.4, 0.9, 10


def is_keyword(word: Column) -> Column:
    return F.lower(word).isin(*KEYWORDS)


#: Bytes of identifiers stay, all others part words.
PARTED = bytes(b if chr(b) in "_0123456789" or chr(b).isalpha() and b < 128 else 32 for b in range(256))


def words_of(content: bytes) -> set[bytes]:
    """The distinct identifiers of a text: a word's leading digits don't belong to it."""
    found = set(content.translate(PARTED).split())
    return {w.lstrip(b"0123456789") for w in found}


def functions_of(content: bytes) -> Iterator[tuple[str, str]]:
    """Name and parameters of functions and methods, for each line and pattern that fits it."""
    if b"func" in content:
        for line in content.split(b"\n"):
            if b"func" in line:
                for pattern in COMPILED:
                    if m := pattern.search(line):
                        yield m[1].decode(), m[2].decode("utf-8", "replace")


#: Bytes of contents whose names a task holds at once, about.
PIECE = 2 << 20


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Stretches of a batch of about PIECE bytes by its last column, or of one row: batches come by rows, however long these are."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False))
    start, done = 0, 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(size, done + PIECE, "right")))
        yield batch.slice(start, end - start)
        start, done = end, size[end - 1]


def names(files: DataFrame, *by: str, called: bool = True) -> DataFrame:
    """by, kind (0: identifier, 1: function), text, details (parameters), n: the distinct names in files (content), with n of the times
    that a function stands there (1 for identifiers). Contents are looked at once, and the names of PIECE bytes leave together."""
    fields = files.select(*by).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in pieces(whole)):
            words: dict[tuple, set[bytes]] = {}
            functions: Counter[tuple] = Counter()
            keys = list(zip(*[batch.column(k).to_pylist() for k in range(len(by))], strict=True)) if by else [()] * len(batch)
            for key, content in zip(keys, batch.column(len(by)).cast(pa.binary()).to_pylist(), strict=True):
                if content:
                    words.setdefault(key, set()).update(words_of(content))
                    if called:
                        functions.update((key, *f) for f in functions_of(content))
            rows = [(*key, 0, t, "", 1) for key, some in words.items() for w in some if len(w) > 2 and (t := w.decode()).lower() not in KEYWORDS]
            rows += [(*key, 1, name, details, n) for (key, name, details), n in functions.items()]
            columns = list(zip(*rows, strict=True)) or [()] * (len(by) + 4)
            kinds = [*batch.schema.types[: len(by)], pa.int32(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*by, "kind", "text", "details", "n"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in fields)
    met = files.select(*by, "content").mapInArrow(run, f"{kinds}kind int, text string, details string, n long")
    key = [*by, "kind", "text", "details"]
    return met.groupBy(*key).agg(F.when(F.col("kind") == 0, 1).otherwise(F.sum("n")).cast("long").alias("n"))


def identifiers(files: DataFrame, *by: str) -> DataFrame:
    """The distinct identifiers of three characters or more that aren't keywords, for each value of by, of files (content)."""
    return names(files, *by, called=False).select(*by, "text")


def fuzzy_find_all(query: str, candidates: DataFrame, threshold: float) -> DataFrame:
    """text, score of candidates (text) at the threshold or above, best first. What can't reach it isn't scored."""
    scored = candidates.select("text", query_scores(query, F.col("text"), F.lit(threshold)).alias("score"))
    kept = scored.where(F.col("score").isNotNull()).repartition("text")  # a range sort looks at its input twice: not at the scoring
    return kept.orderBy(F.desc(F.round("score", 12)), "text")


def suggest(query: str, files: DataFrame) -> DataFrame:
    """Ranked suggestions from files (root_ord, content): the ten best of each root, then the first of each text.

    Distinct names are scored, each once, and only where they may be among the ten. Ties: identifiers before
    functions, then by text and details.
    """
    least = F.when(F.col("kind") == 0, IDENTIFIER_LEAST).otherwise(FUNCTION_LEAST)
    share = F.when(F.col("kind") == 0, 1.0).otherwise(FUNCTION_SHARE)
    found = names(files, "root_ord").withColumn("n", F.least("n", F.lit(PER_ROOT)).cast("int"))
    scored = found.withColumn("raw", query_scores(query, F.col("text"), least, share, F.col("root_ord"), PER_ROOT)).where(F.col("raw").isNotNull())
    both = scored.withColumn("score", F.when(F.col("kind") == 0, F.col("raw")).otherwise(F.col("raw") * FUNCTION_SHARE))
    repeated = both.withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("n"))))  # a function found often takes as many places
    best = Window.partitionBy("root_ord").orderBy(F.desc(F.round("score", 12)), "kind", "text", "details")
    top = repeated.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PER_ROOT)
    earliest = Window.partitionBy("text").orderBy("root_ord", "rank")
    kept = top.withColumn("n", F.row_number().over(earliest)).where("n = 1").orderBy("root_ord", "rank")
    return kept.select("text", "score", F.when(F.col("kind") == 0, F.lit("identifier")).otherwise(F.lit("function")).alias("context"), "details")


def fuzzy_rows(suggestions: DataFrame) -> DataFrame:
    """Suggestions as match rows, to be united with exact matches."""
    text = F.concat(F.lit("[fuzzy match] "), F.col("text"), F.lit(" (score: "), two_digits(F.col("score")), F.lit(")"))
    return suggestions.select(F.lit("").alias("file_path"), F.lit(0).alias("line_number"), text.alias("line_content"), F.col("text").alias("match_text"))
