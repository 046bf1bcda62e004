"""Version history: commits by date and author, the files they changed, and searches restricted to these."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def filter_commits(commits: DataFrame, since: datetime | Column | None = None, author: str = "") -> DataFrame:
    """Commits written at since or later, by an author whose name or address contains the text, whatever its case."""
    kept = commits
    if since is not None:
        kept = kept.where(F.col("author_when") >= (since if isinstance(since, Column) else F.lit(since)))
    if author:
        a = F.lit(author.lower())
        kept = kept.where(F.contains(F.lower("author_name"), a) | F.contains(F.lower("author_email"), a))
    return kept


def changed_files(commits: DataFrame, commit_files: DataFrame, *keep: str) -> DataFrame:
    """The distinct paths that the commits changed; with keep (say, repo), those of each of its values. Both sides are shuffled on the hash unless one is small."""
    return commit_files.join(commits.select(*keep, "hash"), [*keep, "hash"], "left_semi").select(*keep, "path").distinct()


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths that differ between two snapshots (path, blob): changed, added or removed."""
    both = before.alias("a").join(after.alias("b"), "path", "full_outer")
    return both.where(~F.col("a.blob").eqNullSafe(F.col("b.blob"))).select("path").distinct()


def restrict(files: DataFrame, changed: DataFrame) -> DataFrame:
    """Files whose rel_path is among the changed paths; changed paths without a file drop out."""
    return files.join(changed.select(F.col("path").alias("rel_path")), "rel_path", "left_semi")
