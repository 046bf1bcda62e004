"""Small text functions that Spark's own don't cover exactly."""

from __future__ import annotations

import calendar
import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_bytes(text: Column) -> Column:
    """One character for each byte of the UTF-8 form, for functions that count characters."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def trim_space(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def truncated(text: Column, most: int = 60) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def highlighted(line: Column, match: Column, before: str, after: str) -> Column:
    """The line with each occurrence of the match between two marks; as it is for an empty match."""
    return F.when(match != "", F.replace(line, match, F.concat(F.lit(before), match, F.lit(after)))).otherwise(line)


def two_digits(value: Column) -> Column:
    """Two decimals, exact ties to the even digit."""
    return F.format_string("%.2f", F.bround(value.cast("decimal(38,18)"), 2).cast("double"))


def time_ago(text: str, now: datetime | None = None) -> datetime:
    """'N days|weeks|months|years ago' as a time; months and years that end too early run over into the next month."""
    parts = text.split(" ")
    if len(parts) < 3:
        raise ValueError(f"invalid time {text!r}: use 'N days|weeks|months|years ago'")
    number = re.match(r"[+-]?\d+", parts[0])
    if not number:
        raise ValueError(f"invalid number {parts[0]!r}")
    n, unit, now = int(number[0]), parts[1].lower().removesuffix("s"), now or datetime.now()
    if unit in ("day", "week"):
        return now - timedelta(days=n * (7 if unit == "week" else 1))
    if unit not in ("month", "year") or parts[1].lower() not in (unit, unit + "s"):
        raise ValueError(f"unknown time unit {parts[1]!r}")
    months = now.year * 12 + now.month - 1 - n * (12 if unit == "year" else 1)
    year, month = divmod(months, 12)
    last = calendar.monthrange(year, month + 1)[1]
    return now.replace(year=year, month=month + 1, day=min(now.day, last)) + timedelta(days=max(0, now.day - last))


def is_newer(new: Column, old: Column) -> Column:
    """Compare dotted versions part by part; a leading v is ignored, what isn't a number counts 0, longer wins a tie."""

    def parts(v: Column) -> Column:
        return F.transform(F.split(F.regexp_replace(v, "^v", ""), r"\."), lambda p: F.coalesce(F.when(p.rlike(r"^[0-9]+$"), p.cast("int")), F.lit(0)))

    return parts(new) > parts(old)
