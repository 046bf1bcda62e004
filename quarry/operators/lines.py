"""From files to lines to matches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.patterns import Pattern, found_in


def line_array(content: Column, strip_cr: bool = False) -> Column:
    """Lines of a text, split at newlines only; a final newline begins no further line. strip_cr drops one carriage return at each end of line."""
    body = F.when(content.endswith("\n"), F.left(content, F.length(content) - 1)).otherwise(content)
    lines = F.when(content == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))
    return F.transform(lines, lambda x: F.when(x.endswith("\r"), F.left(x, F.length(x) - 1)).otherwise(x)) if strip_cr else lines


def line_number(at: Column, files: DataFrame) -> Column:
    """The number of the line at `at` (from 0) of a content; pieces of large files (see sources.tree) say how many lines stand before them."""
    before = F.coalesce("part.before", F.lit(0).cast("long")) if "part" in files.columns else F.lit(0)
    return (before + at + 1).cast("int")


def is_own(at: Column, files: DataFrame) -> Column:
    """Whether a line belongs to the piece itself, not to the context around it."""
    return F.coalesce((at >= F.col("part.own_from")) & (at < F.col("part.own_to")), F.lit(True)) if "part" in files.columns else F.lit(True)


def to_lines(files: DataFrame, strip_cr: bool = False, within: Column | None = None) -> DataFrame:
    """One row for each line: the other columns of files, line_number (from 1), line. within is a test of whole contents, applied first."""
    kept = files if within is None else files.where(within)
    others = [c for c in files.columns if c not in ("content", "part")]
    part = [c for c in files.columns if c == "part"]
    rows = kept.select(*others, *part, F.posexplode(line_array(F.col("content"), strip_cr)).alias("at", "line"))
    return rows.where(is_own(F.col("at"), files)).select(*others, line_number(F.col("at"), files).alias("line_number"), "line")


def context_frame(lines: Column, at: Column, around: int) -> Column:
    """Lines at-around to at+around (at counts from 0), joined by newlines; the one at `at` is marked '> ', others are indented."""
    first = F.greatest(at - around, F.lit(0))
    frame = F.slice(lines, first + 1, at - first + 1 + around)
    return F.array_join(F.transform(frame, lambda x, j: F.concat(F.when(j + first == at, F.lit("> ")).otherwise(F.lit("  ")), x)), "\n")


def find_matches(files: DataFrame, pattern: Pattern, context: int = 0, strip_cr: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """Matches of the pattern in files (path, content, ...), one row for each matching line, with the columns of files in keep.

    Files that can't contain a match are dropped before they are split. With context, matching lines are
    picked inside each file's array, so that neighbours are at hand and only matches leave it.
    """
    within = pattern.within(F.col("content"))
    part = [c for c in files.columns if c == "part"]
    plain = [F.col(c).alias(c.replace(".", "_")) for c in keep]
    if not context and not pattern.is_keyword:
        return find_in_batches(files.where(within), pattern, strip_cr, keep)
    if not context:
        lines = to_lines(files.select("path", "content", *part, *plain), strip_cr, within)
        return pattern.matching(lines, "line").select(F.col("path").alias("file_path"), "line_number", F.col("line").alias("line_content"), "match_text", *[c.replace(".", "_") for c in keep])
    held = files.where(within).select("path", *part, *plain, line_array(F.col("content"), strip_cr).alias("lines")).withColumn("found", pattern.matches_of(F.col("lines")))
    at = F.filter(F.transform("found", lambda m, i: F.when(m.isNotNull() & is_own(i, files), i)), lambda i: i.isNotNull())
    spots = held.withColumn("at", at).where(F.size("at") > 0)
    framed = F.transform("at", lambda i: F.struct(line_number(i, files).alias("line_number"), context_frame(F.col("lines"), i, context).alias("line_content"), F.element_at("found", i + 1).alias("match_text")))
    return spots.select(F.col("path").alias("file_path"), F.inline(framed), *[c.replace(".", "_") for c in keep])


def find_in_batches(files: DataFrame, pattern: Pattern, strip_cr: bool, keep: tuple[str, ...]) -> DataFrame:
    """The same for regexes: a batch of whole contents is tested, those that match anywhere are split
    into lines, and only matching lines come back."""
    part = [c for c in files.columns if c == "part"]
    given = files.select(F.col("path").alias("file_path"), *[F.col(c).alias(c.replace(".", "_")) for c in keep], *part, "content")
    fields = given.drop("content").schema
    anywhere = None if strip_cr else pattern.anywhere

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = pc.not_equal(batch.column(len(fields)), "")
            if anywhere:
                held = pc.and_(held, pc.match_substring_regex(batch.column(len(fields)), anywhere))
            batch = batch.filter(pc.fill_null(held, False))
            if not len(batch):
                continue
            lines = pc.split_pattern(pc.replace_substring_regex(batch.column(len(fields)), r"\n\z", ""), "\n")
            flat, parents = lines.flatten(), pc.list_parent_indices(lines)
            if strip_cr:
                flat = pc.replace_substring_regex(flat, r"\r\z", "")
            places = pc.subtract(pa.array(np.arange(len(flat), dtype=np.int32)), lines.offsets[:-1].take(parents))
            found = found_in(flat, pattern.re2)
            hits = found.is_valid()
            rows = batch.select(range(len(fields))).take(parents.filter(hits))
            columns = [places.filter(hits), flat.filter(hits), found.filter(hits)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *columns], names=[*rows.schema.names, "at", "line_content", "match_text"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    met = given.mapInArrow(run, f"{kinds}, at int, line_content string, match_text string")
    own = met.where(is_own(F.col("at"), files))
    return own.select("file_path", line_number(F.col("at"), files).alias("line_number"), "line_content", "match_text", *[c.replace(".", "_") for c in keep])


def with_offsets(matches: DataFrame, offsets: DataFrame) -> DataFrame:
    """Matches (with root_ord and part_piece) of files that several tasks read, their line numbers raised by the lines
    before each piece (root_ord, path, piece, lines_before). Matches alone are joined, never contents."""
    named = offsets.select("root_ord", F.col("path").alias("file_path"), F.col("piece").alias("part_piece"), "lines_before")
    met = matches.join(named, ["root_ord", "file_path", "part_piece"], "left")
    return met.select("file_path", (F.col("line_number") + F.coalesce("lines_before", F.lit(0))).cast("int").alias("line_number"), "line_content", "match_text")


def find_in_messages(commits: DataFrame, pattern: Pattern) -> DataFrame:
    """Matching lines of commit messages: the hash's first eight characters for a path, line number 0, the trimmed line."""
    from quarry.functions.text import trim_space

    lines = commits.select("hash", F.explode(F.split("message", "\n")).alias("line"))
    return pattern.matching(lines, "line").select(F.substring("hash", 1, 8).alias("file_path"), F.lit(0).alias("line_number"), trim_space(F.col("line")).alias("line_content"), "match_text")
