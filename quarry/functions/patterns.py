"""Search patterns as columns: RE2 regexes, literal prefixes, line and text tests.

Keywords become substring tests. A regex that begins with literal text also gets a substring test on
that text, on lines and on whole files before they are split, which the optimizer doesn't derive.

Regexes, and keywords whose case is ignored, meet texts in Arrow's RE2 kernels, a batch at a time: first whole
files, then the lines of those that match anywhere. Time grows with the texts alone, whatever the pattern; the
JVM's matcher, which tries one way after another, was slower on all patterns but those with a literal prefix,
and no faster on these.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: RE2's word boundary, for the JVM's regexes: it looks at ASCII word characters only.
EDGE = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
NO_EDGE = r"(?:(?<![0-9A-Za-z_])(?![0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?=[0-9A-Za-z_]))"
META = set("\\.+*?()|[]{}^$")


class PatternError(ValueError):
    """The pattern isn't valid RE2 syntax."""


#: What is read as one piece: quoted stretches, escapes, classes, capturing groups' openings.
PIECE = re.compile(r"(?s)(\\Q.*?(?:\\E|\Z))|(\\.)|(\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*\])|(\(\?P?<\w+>|\((?!\?))")


def uncaptured(pattern: str) -> str:
    """The same RE2 pattern without capturing groups; PatternError if it isn't one."""

    def plain(m: re.Match) -> str:
        if m[1]:
            return quote(m[1][2:].removesuffix("\\E"))
        if m[2] == r"\C":
            raise PatternError("single bytes aren't supported")
        return "(?:" if m[4] else m[0]

    out = PIECE.sub(plain, pattern)
    for tried in (pattern, out):
        try:
            pc.match_substring_regex(pa.array([""]), tried)
        except pa.ArrowInvalid as problem:
            raise PatternError(str(problem)) from None
    return out


def quote(text: str) -> str:
    """The text as a pattern that matches just it."""
    return re.sub(r"([^0-9A-Za-z_\x80-\U0010FFFF])", r"\\\1", text).replace("\\\n", "\\n")


def has_alternatives(pattern: str) -> bool:
    """Whether a bar stands outside of all groups, classes, escapes and quoted stretches."""
    at, depth = 0, 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("\\Q", at):
            end = pattern.find("\\E", at)
            at = end + 2 if end >= 0 else len(pattern)
            continue
        if c == "\\":
            at += 1
        elif c == "[":
            m = re.compile(r"\[\^?\]?(?:\[:\^?\w+:\]|\\.|[^\]\\])*", re.S).match(pattern, at)
            at = m.end()
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            return True
        at += 1
    return False


def literal_prefix(pattern: str) -> str:
    """Text that every match begins with; may be empty."""
    if has_alternatives(pattern):
        return ""
    out, at = [], 0
    while at < len(pattern):
        c = pattern[at]
        if c == "\\" and at + 1 < len(pattern) and not pattern[at + 1].isalnum():
            step, c = 2, pattern[at + 1]
        elif c in META:
            break
        else:
            step = 1
        if re.compile(r"[*?]|\{").match(pattern, at + step):
            break
        out.append(c)
        at += step
        if pattern[at : at + 1] == "+":
            break
    return "".join(out)


@dataclass(frozen=True)
class Pattern:
    """A compiled query. re2 is None for case-sensitive keywords; literal is text that any match contains."""

    query: str
    re2: str | None
    literal: str

    @property
    def is_keyword(self) -> bool:
        return self.re2 is None

    def within(self, text: Column) -> Column:
        """A cheap necessary test for a line or a whole text."""
        return F.contains(text, F.lit(self.literal)) if self.literal else F.lit(True)

    def match(self, line: Column) -> Column:
        """The first match in the line, null if there is none."""
        return F.when(F.contains(line, F.lit(self.query)), F.lit(self.query)) if self.is_keyword else first_match(self.re2)(line)

    def matches(self, line: Column) -> Column:
        return F.contains(line, F.lit(self.query)) if self.is_keyword else self.match(line).isNotNull()

    def matching(self, rows: DataFrame, line: str) -> DataFrame:
        """Rows whose line matches, with match_text. Regexes run once for each row."""
        if self.is_keyword:
            return rows.where(self.matches(F.col(line))).withColumn("match_text", F.lit(self.query))
        found = first_match(self.re2).asNondeterministic()(F.col(line))
        return rows.where(self.within(F.col(line))).withColumn("match_text", found).where(F.col("match_text").isNotNull())

    def matches_of(self, lines: Column) -> Column:
        """For each line of an array its match, null if it has none."""
        return F.transform(lines, self.match) if self.is_keyword else first_matches(self.re2).asNondeterministic()(lines)

    @property
    def anywhere(self) -> str | None:
        """A pattern that any text matches one of whose lines does; None where the ends of a line can't be told inside a text."""
        return None if self.is_keyword or re.search(r"\\[Az]|-[imsU]*m", self.re2) else f"(?m:{self.re2})"


def found_in(lines: pa.Array, pattern: str) -> pa.Array:
    """The first match in each line, null for none, in time that grows with the lines alone."""
    hits = pc.fill_null(pc.match_substring_regex(lines, pattern), False)
    groups = pc.extract_regex(lines.filter(hits), f"(?P<match>{pattern})")
    return pc.replace_with_mask(pa.nulls(len(lines), pa.string()), hits, pc.struct_field(groups, "match").cast(pa.string()))


def first_match(pattern: str):
    """The first match in each line; null for none."""

    def found(lines: pa.Array) -> pa.Array:
        return found_in(lines, pattern)

    return F.arrow_udf(found, StringType())


def first_matches(pattern: str):
    """The same for each line of arrays of lines."""

    def found(arrays: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(arrays), 0)
        ends = pa.concat_arrays([pa.array([0], pa.int32()), pc.cumulative_sum(sizes).cast(pa.int32())])
        return pa.ListArray.from_arrays(ends, found_in(arrays.flatten(), pattern), mask=arrays.is_null())

    return F.arrow_udf(found, ArrayType(StringType()))


def compile_pattern(query: str, is_regex: bool = False, ignore_case: bool = False) -> Pattern:
    """PatternError for an invalid regex. An empty keyword matches every line."""
    if not is_regex:
        return Pattern(query, "(?i)" + quote(query), "") if ignore_case else Pattern(query, None, query)
    return Pattern(query, uncaptured(("(?i)" if ignore_case else "") + query), "" if ignore_case else literal_prefix(query))
