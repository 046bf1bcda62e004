"""Which files a search looks at."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import paths


def select_files(files: DataFrame, extensions=(), include=(), exclude=(), rules: list[paths.IgnoreRule] | None = None, skip_directories: bool = True, skip_binary: bool = True) -> DataFrame:
    """files: path, rel_path, content, is_binary. Tests of paths come first; they reach the scan where it can use them."""
    keep = paths.has_extension(F.col("path"), extensions) & paths.passes_globs(F.col("path"), include, exclude)
    if skip_directories:
        keep &= ~paths.in_skipped_directory(F.col("rel_path"))
    if rules:
        keep &= ~paths.below_ignored(F.col("rel_path"), rules)
    if skip_binary:
        keep &= ~F.col("is_binary")
    return files.where(keep)


def union_roots(*roots: DataFrame) -> DataFrame:
    """All rows of all roots, numbered in argument order; what lies under two roots comes twice."""
    out = None
    for k, root in enumerate(roots):
        numbered = root.withColumn("root_ord", F.lit(k))
        out = numbered if out is None else out.unionByName(numbered)
    return out
