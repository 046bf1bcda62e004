"""Commits of a git repository and the files they changed, as tables.

Repositories are read by the git program (they must be reachable from the executors); output is streamed,
not held. The driver lists the hashes of a repository once, twenty bytes each, and cuts them into slices;
every slice is a partition whose task asks for its commits, or for what they changed, by hash. One long
history is so read by many tasks, and refs that move meanwhile change nothing. Conditions on date and
author are applied to that list, so that the slices hold little else than commits that are asked for.
Of more than SPREAD repositories tasks list the hashes, and the slices are dealt out to tasks anew.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.schemas import COMMIT, COMMIT_FILE

END, UNIT = "\x1e", "\x1f"


def find_repository(path: str) -> str | None:
    """The folder that holds .git, at the path or above it."""
    at = os.path.abspath(path)
    while not os.path.exists(os.path.join(at, ".git")):
        above = os.path.dirname(at)
        if above == at:
            return None
        at = above
    return at


def git(repo: str, *args: str, end: str = "\n", given: bytes = b"") -> Iterator[str]:
    """Records of a git command's output."""
    with tempfile.TemporaryFile() as source:
        source.write(given)
        source.seek(0)
        with subprocess.Popen(["git", "-C", repo, *args], stdin=source, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as run:
            rest = b""
            while chunk := run.stdout.read(1 << 16):
                *done, rest = (rest + chunk).split(end.encode())
                for record in done:
                    yield record.decode("utf-8", "replace")
            if rest:
                yield rest.decode("utf-8", "replace")
            if run.wait():
                raise ValueError(f"git {args[0]} failed in {repo}: {run.stderr.read().decode(errors='replace').strip()}")


#: Commits of one partition.
SLICE = 2000
#: Of more repositories tasks list the hashes.
SPREAD = 16
#: Rows of an Arrow batch.
BATCH = 2000


def hashes(repo: str, since: float | None = None, author: str = "") -> Iterator[bytes]:
    """All refs' commits, each once, as raw hashes; with since (seconds) or author, those that fit, by the author's date and name or address."""
    for record in git(repo, "log", "--all", f"--format=%H{UNIT}%at{UNIT}%an{UNIT}%ae"):
        h, when, name, mail = record.split(UNIT)
        if (since is None or int(when) >= since) and (not author or author.lower() in name.lower() or author.lower() in mail.lower()):
            yield bytes.fromhex(h)


def slices_of(repo: str, since: float | None, author: str, size: int) -> Iterator[Slice]:
    """The hashes of a repository, size at a time."""
    some: list[bytes] = []
    for h in hashes(repo, since, author):
        some.append(h)
        if len(some) == size:
            yield Slice(repo, b"".join(some), len(h))
            some = []
    if some:
        yield Slice(repo, b"".join(some), len(some[0]))


def asked(chosen: bytes, width: int) -> bytes:
    """Raw hashes of width bytes as lines for git."""
    return b"".join(chosen[k : k + width].hex().encode() + b"\n" for k in range(0, len(chosen), width))


def commits_of(repo: str, chosen: bytes) -> Iterator[tuple]:
    """The commits named (lines of hashes), with the author's date."""
    form = UNIT.join(("%H", "%an", "%ae", "%at", "%P", "%B")) + END
    for record in git(repo, "log", "--no-walk=unsorted", "--stdin", f"--format={form}", end=END, given=chosen):
        parts = record.lstrip("\n").split(UNIT)
        if len(parts) == 6:
            h, name, mail, when, parents, message = parts
            yield repo, h, name, mail, datetime.fromtimestamp(int(when), timezone.utc), message, parents.split(" ")[0] or None


def commit_files_of(repo: str, chosen: bytes) -> Iterator[tuple]:
    """(repo, hash, path): what each commit changed against its first parent; everything for a root commit."""
    form = f"--format={END}%H"
    for record in git(repo, "-c", "core.quotepath=off", "log", "--no-walk=unsorted", "--stdin", "--root", "--no-renames", "--diff-merges=first-parent", "--name-only", form, end=END, given=chosen):
        h, *paths = record.strip("\n").split("\n")
        for path in filter(None, paths):
            yield repo, h, path


def range_paths(repo: str, span: str) -> Iterator[str]:
    """Paths that differ between the two ends of A..B, or between R and HEAD."""
    first, _, last = span.partition("..")
    return (p for p in git(repo, "-c", "core.quotepath=off", "diff", "--name-only", "--no-renames", first, last or "HEAD") if p)


@dataclass
class Slice(InputPartition):
    """Commits of a repository, as raw hashes of width bytes."""

    repo: str
    chosen: bytes
    width: int


class HistoryReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repos, self.table, self.span = options["repos"].split("\n"), options.get("table", "commits"), options.get("span", "")
        self.since, self.author, self.size = options.get("since", ""), options.get("author", ""), int(options.get("slice", SLICE))

    def partitions(self) -> list[Slice]:
        if self.table == "range":
            return [Slice(r, b"", 0) for r in self.repos]
        slices = [s for r in self.repos for s in slices_of(r, float(self.since) if self.since else None, self.author, self.size)]
        return slices or [Slice(self.repos[0], b"", 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        if self.table == "range":
            return ((partition.repo, None, p) for p in range_paths(partition.repo, self.span))
        if not partition.chosen:
            return iter(())
        return (commit_files_of if self.table == "files" else commits_of)(partition.repo, asked(partition.chosen, partition.width))


class HistorySource(DataSource):
    """spark.read.format("gitlog").option("repos", newline-separated folders).option("table", "commits", "files" or,
    with option span, "range"): what differs between two commits, with null hashes. Options since (seconds), author and slice (commits of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return COMMIT if self.options.get("table", "commits") == "commits" else COMMIT_FILE

    def reader(self, schema) -> HistoryReader:
        return HistoryReader(self.options)


def read_history(spark: SparkSession, *repos: str, since: datetime | None = None, author: str = "", slice_size: int = SLICE) -> tuple[DataFrame, DataFrame]:
    """commits and commit_files of the repositories. With since and author, only of commits that may fit them: the exact test
    stays with filter_commits(), which knows the session's time zone."""
    early = since.timestamp() - 2 * 86400 if since else None
    author = author if author.isascii() else ""
    if len(repos) > SPREAD:
        slices = many_slices(spark, repos, early, author, slice_size)
        return slices.mapInArrow(rows_of(commits_of, COMMIT_ARROW), COMMIT), slices.mapInArrow(rows_of(commit_files_of, COMMIT_FILE_ARROW), COMMIT_FILE)
    spark.dataSource.register(HistorySource)
    reader = spark.read.format("gitlog").options(repos="\n".join(repos), since="" if early is None else str(early), author=author, slice=str(slice_size))
    return reader.load(), reader.option("table", "files").load()


def read_range(spark: SparkSession, repo: str, span: str, *more: str) -> DataFrame:
    """repo, hash (null), path: what differs between two commits of a repository, or of each of several."""
    if len(more) >= SPREAD:
        return folders(spark, (repo, *more)).mapInArrow(rows_of_ranges(span), COMMIT_FILE)
    spark.dataSource.register(HistorySource)
    return spark.read.format("gitlog").option("repos", "\n".join((repo, *more))).option("table", "range").option("span", span).load()


# --- many repositories ------------------------------------------------------------------------------

COMMIT_ARROW = pa.schema([(c, pa.timestamp("us", "UTC") if c == "author_when" else pa.string()) for c in ("repo", "hash", "author_name", "author_email", "author_when", "message", "first_parent")])
COMMIT_FILE_ARROW = pa.schema([(c, pa.string()) for c in ("repo", "hash", "path")])
SLICE_ARROW = pa.schema([("repo", pa.string()), ("chosen", pa.binary()), ("width", pa.int32())])


def tasks(spark: SparkSession) -> int:
    """A few for each core: what they cost isn't told by the bytes of their rows."""
    return 4 * spark.sparkContext.defaultParallelism


def folders(spark: SparkSession, repos: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame(pa.table({"repo": list(repos)})).repartition(tasks(spark))


def batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while some := list(islice(rows, BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), schema, strict=True)], schema=schema)


def many_slices(spark: SparkSession, repos: tuple[str, ...], since: float | None, author: str, size: int) -> DataFrame:
    """repo, chosen, width: slices that tasks have listed, dealt out, so that a long history among them is read by several tasks."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (repo for batch in given for repo in batch.column(0).to_pylist())
        yield from batches(((s.repo, s.chosen, s.width) for repo in named for s in slices_of(repo, since, author, size)), SLICE_ARROW)

    return folders(spark, repos).mapInArrow(run, "repo string, chosen binary, width int").repartition(tasks(spark))


def rows_of(read: Callable[[str, bytes], Iterator[tuple]], schema: pa.Schema):
    """What read() gives for each slice."""

    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (zip(*(c.to_pylist() for c in batch.columns), strict=True) for batch in given)
        yield from batches((row for some in named for repo, chosen, width in some for row in read(repo, asked(chosen, width))), schema)

    return run


def rows_of_ranges(span: str):
    def run(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = (repo for batch in given for repo in batch.column(0).to_pylist())
        yield from batches(((repo, None, p) for repo in named for p in range_paths(repo, span)), COMMIT_FILE_ARROW)

    return run
