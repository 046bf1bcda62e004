"""A directory tree as a table of files, including files whose names begin with a dot or underscore.

Spark's own file formats hide such files and empty ones. Here trees are listed top down, so that skipped and
ignored directories are never entered: by the driver until SPREAD directories are waiting, which it deals
out to tasks that list and read them. Files that the driver has met are dealt into partitions of about
equal bytes. Roots must be on a file system that all executors mount.

Conditions on the table reach the reader: those on paths are tested before a file is opened (and keep the
listing out of directories that can't hold such a path), is_binary after its first bytes, and those on
contents on its bytes, so that only what passes is decoded and leaves the reader, as Arrow batches.

A file larger than a piece comes as several rows of whole lines, whose column part says which lines they
are; it is null for all others. One task reads the pieces of a file one after another, or, if files are to
be split, each piece is a partition of its own and counts lines from its own first one; line_offsets() then
has the number of lines before each piece.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull, Not, StringContains, StringEndsWith, StringStartsWith

from quarry.functions.paths import IgnoreRule, glob_regex, has_extension, ignore_rules, ignored_by, skips_directory, usable_globs

#: part.before is null if lines are counted from the piece's own first one; lines own_from to own_to (from 0) of the content
#: are the piece's own, others stand there as context.
PART = pa.struct([("piece", pa.int32()), ("before", pa.int64()), ("own_from", pa.int32()), ("own_to", pa.int32())])
SCHEMA = "root_ord int, path string, rel_path string, content string, is_binary boolean, part struct<piece:int,before:bigint,own_from:int,own_to:int>"
ARROW = pa.schema([("root_ord", pa.int32()), ("path", pa.string()), ("rel_path", pa.string()), ("content", pa.string()), ("is_binary", pa.bool_()), ("part", PART)])
OFFSETS = "root_ord int, path string, piece int, starts bigint"


def path_test(extensions: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Callable[[str], bool]:
    """Whether a path has one of the extensions and passes the globs, as for tables of files."""
    ends = tuple(e.lower() for e in extensions)
    wanted, unwanted = ([re.compile(glob_regex(g).replace(r"\z", r"\Z")) for g in usable_globs(globs)] for globs in (include, exclude))

    def fits(path: str) -> bool:
        if (ends and not path.lower().endswith(ends)) or any(g.search(path) for g in unwanted):
            return False
        return not include or any(g.search(path) for g in wanted)

    return fits


#: With so many directories known, the rest of a tree is listed by tasks.
SPREAD = 256


@dataclass
class Walk:
    """How a tree is listed: below root, without what the settings leave out."""

    root: str
    skip: bool
    rules: list[IgnoreRule]
    extensions: tuple[str, ...]
    include: tuple[str, ...]
    exclude: tuple[str, ...]

    def files(self, todo: deque[str], most: int | None = None, may_hold: Callable[[str], bool] = lambda below: True) -> Iterator[tuple[str, str, int]]:
        """(path, path below the root, size) of the regular files below the directories of todo ('' or a path that
        ends in a slash), breadth first, but not of those that may_hold() rules out. With most, listing stops once so
        many directories are waiting; todo then holds them."""
        fits = path_test(self.extensions, self.include, self.exclude)
        while todo and (most is None or len(todo) < most):
            below = todo.popleft()
            with os.scandir(os.path.join(self.root, below)) as entries:
                for entry in sorted(entries, key=lambda e: e.name):
                    rel = below + entry.name
                    if entry.is_dir(follow_symlinks=False):
                        if not (self.skip and skips_directory(entry.name)) and not ignored_by(self.rules, rel, True) and may_hold(rel + "/"):
                            todo.append(rel + "/")
                    elif entry.is_file(follow_symlinks=False) and fits(entry.path) and not ignored_by(self.rules, rel, False):
                        yield entry.path, rel, entry.stat(follow_symlinks=False).st_size


def walk_of(root: str, skip: bool = True, use_ignore_file: bool = True, extensions: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> Walk:
    rules = []
    if use_ignore_file and os.path.isfile(at := os.path.join(root, ".gitignore")):
        with open(at, encoding="utf-8", errors="replace") as f:
            rules = ignore_rules(f.read())
    return Walk(root, skip, rules, extensions, include, exclude)


#: A file of more bytes comes in pieces.
PIECE = 64 << 20
#: Bytes of text in a batch, about.
BATCH = 16 << 20


@dataclass
class Share(InputPartition):
    """Files to read, as (root's place, path, path below the root, piece or -1 for all), and directories to list and read, as (root's place, walk, directory)."""

    files: list[tuple[int, str, str, int]]
    folders: list[tuple[int, Walk, str]]


def open_file(path: str) -> BinaryIO | None:
    """None for what can't be read."""
    try:
        return open(path, "rb")
    except OSError:
        return None


def texts(datas: list[bytes]) -> pa.Array:
    """UTF-8 texts; what isn't UTF-8 gets replacement characters."""
    try:
        return pa.array(datas, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([d.decode("utf-8", "replace") for d in datas], pa.string())


def skip_line(f: BinaryIO) -> None:
    while (part := f.readline(1 << 20)) and not part.endswith(b"\n"):
        pass


def own_lines(f: BinaryIO, start: int, stop: int) -> tuple[int, bytes]:
    """The lines that begin at start or later, before stop, and where they begin."""
    f.seek(max(start - 1, 0))
    if start:
        skip_line(f)
    begin = f.tell()
    if begin >= stop:
        return begin, b""
    data = f.read(stop - begin)
    return begin, data if not data or data.endswith(b"\n") else data + f.readline()


def lines_above(f: BinaryIO, begin: int, most: int) -> bytes:
    """Up to so many lines that end at begin."""
    at, data = begin, b""
    while at and data.count(b"\n") <= most:
        step = min(at, max(1 << 16, len(data)))
        at -= step
        f.seek(at)
        data = f.read(step) + data
    kept = data.split(b"\n")[-most - 1 : -1] if most and data else []
    return b"".join(x + b"\n" for x in kept)


def lines_in(data: bytes) -> int:
    return data.count(b"\n") + (not data.endswith(b"\n") and data != b"")


@dataclass
class Piece:
    """Stretches of one large file, with `around` lines of context on both sides."""

    path: str
    size: int
    bytes: int
    around: int

    def __len__(self) -> int:
        return -(-self.size // self.bytes)

    def read(self, f: BinaryIO, k: int) -> tuple[bytes, int, int]:
        """Content, the first of its own lines and the one behind the last; b'' if no line begins in the stretch."""
        begin, data = own_lines(f, k * self.bytes, min(self.size, (k + 1) * self.bytes))
        if not data:
            return b"", 0, 0
        above = lines_above(f, begin, self.around)
        f.seek(begin + len(data))
        below = b"".join(f.readline() for _ in range(self.around))
        first = above.count(b"\n")
        return above + data + below, first, first + lines_in(data)

    def starts(self, k: int) -> int:
        """How many lines begin in the stretch."""
        start, stop = k * self.bytes, min(self.size, (k + 1) * self.bytes)
        n, at = int(start == 0), max(start - 1, 0)
        with open(self.path, "rb") as f:
            f.seek(at)
            while at < stop - 1 and (data := f.read(min(1 << 20, stop - 1 - at))):
                n += data.count(b"\n")
                at += len(data)
        return n


def attribute(f: Filter) -> str | None:
    """The column that a condition is about, if it is a plain one."""
    f = f.child if isinstance(f, Not) else f
    return f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None


def holds(f: Filter, value) -> bool:
    """Whether a value that isn't null fulfils a condition; texts of contents are compared as bytes."""
    if isinstance(f, Not):
        return not holds(f.child, value)
    if isinstance(f, IsNotNull):
        return True
    wanted = [f.value] if not isinstance(f, In) else list(f.value)
    if isinstance(value, bytes):
        wanted = [w.encode() for w in wanted]
    if isinstance(f, (EqualTo, In)):
        return value in wanted
    one = wanted[0]
    return one in value if isinstance(f, StringContains) else value.startswith(one) if isinstance(f, StringStartsWith) else value.endswith(one)


def is_usable(f: Filter) -> bool:
    """Whether the reader can decide a condition; Spark keeps the others."""
    column, plain = attribute(f), f.child if isinstance(f, Not) else f
    if isinstance(plain, IsNotNull):
        return column in ("root_ord", "path", "rel_path", "content", "is_binary") and plain is f
    if isinstance(plain, (EqualTo, In)):
        return column in ("root_ord", "path", "rel_path", "is_binary") and None not in (plain.value if isinstance(plain, In) else [plain.value])
    if isinstance(plain, (StringContains, StringStartsWith, StringEndsWith)):
        # A replacement character may stand for bytes that aren't text.
        return column in ("path", "rel_path") or (column == "content" and isinstance(plain, StringContains) and "\ufffd" not in plain.value)
    return False


def can_lie_below(f: Filter, column: str, folder: str) -> bool:
    """Whether a path in the folder (which ends in a slash) may fulfil a condition on paths."""
    if attribute(f) != column or not isinstance(f, (EqualTo, In, StringStartsWith)):
        return True
    wanted = f.value if isinstance(f, In) else [f.value]
    return any(w.startswith(folder) or (isinstance(f, StringStartsWith) and folder.startswith(w)) for w in wanted)


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.filters: list[Filter] = []
        self.piece = int(options.get("piece_bytes", PIECE))
        self.around = int(options.get("around", 0))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if is_usable(f):
                self.filters.append(f)
            else:
                yield f

    def on(self, key: str, default: str = "true") -> bool:
        return str(self.options.get(key, default)).lower() == "true"

    def fits(self, column: str, value) -> bool:
        return all(holds(f, value) for f in self.filters if attribute(f) == column)

    def listed(self, walk: Walk, todo: deque[str], most: int | None = None) -> Iterator[tuple[str, str, int]]:
        """The files of a walk whose paths fulfil the conditions."""
        may_hold = lambda below: all(can_lie_below(f, "rel_path", below) and can_lie_below(f, "path", os.path.join(walk.root, below)) for f in self.filters)
        return ((path, rel, n) for path, rel, n in walk.files(todo, most, may_hold) if self.fits("path", path) and self.fits("rel_path", rel))

    def walks(self) -> Iterator[tuple[int, Walk]]:
        """The roots that are asked for, with their places."""
        extensions = tuple(e for e in self.options.get("extensions", "").split(",") if e)
        include, exclude = (tuple(g for g in self.options.get(key, "").split("\n") if g) for key in ("include", "exclude"))
        for k, root in enumerate(self.options["paths"].split("\n")):
            if not os.path.exists(root):
                raise FileNotFoundError(f"no such path: {root}")
            if self.fits("root_ord", k):
                yield k, walk_of(root, self.on("skip"), self.on("ignore_file"), extensions, include, exclude)

    def partitions(self) -> list[Share]:
        o = self.options
        limit, shares, size, spread = int(o.get("partition_bytes", 64 << 20)), [Share([], [])], 0, int(o.get("spread", SPREAD))
        for k, walk in self.walks():
            root, todo = walk.root, deque([""])
            if os.path.isfile(root):
                name = os.path.basename(root)
                fits = path_test(walk.extensions, walk.include, walk.exclude)(root) and self.fits("path", root) and self.fits("rel_path", name)
                met, todo = [(root, name, os.path.getsize(root))] if fits else [], deque()
            else:
                met = self.listed(walk, todo, spread)
            for path, rel, n in met:
                split = n > self.piece and self.on("split", "false")
                for piece in range(len(Piece(path, n, self.piece, 0))) if split else (-1,):
                    cost = self.piece if split else n + 4096
                    if shares[-1].files and size + cost > limit:
                        shares.append(Share([], []))
                        size = 0
                    shares[-1].files.append((k, path, rel, piece))
                    size += cost
            shares = [Share([], [(k, walk, below)]) for below in todo] + shares
        return shares

    def contents(self, path: str, piece: int) -> Iterator[tuple[bytes, bool, dict | None]]:
        """Content, whether it is binary, and part of a file or of its pieces, as far as the conditions hold."""
        if not (f := open_file(path)):
            return
        with f:
            size, head = os.fstat(f.fileno()).st_size, f.read(512)
            binary = b"\0" in head
            if not self.fits("is_binary", binary):
                return
            if size <= self.piece:
                data = head + f.read()
                if self.fits("content", data):
                    yield data, binary, None
                return
            cut, before = Piece(path, size, self.piece, self.around), 0
            for k in range(len(cut)) if piece < 0 else [piece]:
                data, first, end = cut.read(f, k)
                if end and self.fits("content", data):
                    yield data, binary, {"piece": k, "before": before - first if piece < 0 else -first, "own_from": first, "own_to": end}
                before += end - first

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        def named() -> Iterator[tuple[int, str, str, int]]:
            yield from partition.files
            for k, walk, below in partition.folders:
                for path, rel, _ in self.listed(walk, deque([below])):
                    yield k, path, rel, -1

        yield from batches_of((k, path, rel, *content) for k, path, rel, piece in named() for content in self.contents(path, piece))


def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of about BATCH bytes."""
    some, size = [], 0
    for row in rows:
        some.append(row)
        size += len(row[3]) + 64
        if size > BATCH:
            yield batch_of(some)
            some, size = [], 0
    if some:
        yield batch_of(some)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([texts(list(c)) if f.name == "content" else pa.array(c, f.type) for c, f in zip(columns, ARROW, strict=True)], schema=ARROW)


class OffsetReader(TreeReader):
    """Lines that begin in each piece of the files that are split; nothing else is opened."""

    def partitions(self) -> list[Share]:
        return [s for s in super().partitions() if any(piece >= 0 for *_, piece in s.files)] or [Share([], [])]

    def read(self, partition: Share) -> Iterator[tuple]:
        for k, path, _, piece in partition.files:
            if piece >= 0:
                yield k, path, piece, Piece(path, os.path.getsize(path), self.piece, 0).starts(piece)


class TreeStream(DataSourceStreamReader):
    """Files of a tree as they appear or change, each version once, in the order of (time of change, path): that pair is the offset.

    A source isn't told where a query stands that starts again, but for the batch that it repeats, nor what its trigger is: a query
    that runs until all is taken (availableNow) asks once how far that is. So a batch takes all there is, unless a query without
    such a trigger asks for max_files of the next files at most. With the option state, a file's path, the offset of the
    last batch planned is kept there, and max_files counts from the first batch on. Either way batches are dealt into
    partitions by bytes, which bound a task. Files that changed less than settle_ms ago wait, so that none can slip in
    behind an offset. The driver lists the tree for each batch."""

    def __init__(self, options: dict):
        self.reader, self.options, self.state = TreeReader(options), options, options.get("state", "")
        self.most, self.settle = int(options.get("max_files", 0)) or None, int(options.get("settle_ms", 1000))
        self.position = (-1, "") if self.state else None
        if self.state and os.path.exists(self.state):
            with open(self.state, encoding="utf-8") as f:
                self.position = tuple(json.load(f))

    def seen(self) -> list[tuple[int, str, int, str, int]]:
        """(time of change in ns, path, root's place, path below the root, size) of the files there are, in order."""
        now, found = time.time_ns() - self.settle * 1_000_000, []
        for k, walk in self.reader.walks():
            for path, rel, n in self.reader.listed(walk, deque([""])):
                if (at := os.stat(path).st_mtime_ns) <= now:
                    found.append((at, path, k, rel, n))
        return sorted(found)

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = [f for f in self.seen() if self.position is None or f[:2] > self.position]
        last = files[: self.most if self.position is not None else None][-1:]
        at, path = last[0][:2] if last else self.position or (-1, "")
        return {"changed": at, "path": path}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        first, last = (start["changed"], start["path"]), (end["changed"], end["path"])
        self.position = last
        if self.state:
            with open(self.state + "~", "w", encoding="utf-8") as f:
                json.dump(last, f)
            os.replace(self.state + "~", self.state)
        limit, shares, size = int(self.options.get("partition_bytes", 64 << 20)), [], 0
        for _, path, k, rel, n in (f for f in self.seen() if first < f[:2] <= last):
            if not shares or size + n > limit:
                shares.append(Share([], []))
                size = 0
            shares[-1].files.append((k, path, rel, -1))
            size += n + 4096
        return shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)


class TreeSource(DataSource):
    """spark.read.format("tree").option("paths", newline-separated roots); options skip, ignore_file, extensions, include and exclude (newline-separated globs of paths), partition_bytes,
    spread, piece_bytes, max_files, settle_ms and state of streams, split (large files over several partitions), around (lines of context around pieces), table ("files" or "offsets")."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return OFFSETS if self.options.get("table") == "offsets" else SCHEMA

    def reader(self, schema) -> TreeReader:
        return (OffsetReader if self.options.get("table") == "offsets" else TreeReader)(self.options)

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self.options)


def tree_reader(spark: SparkSession, roots: tuple[str, ...], **options):
    for root in roots:
        if not os.path.exists(root):
            raise FileNotFoundError(f"no such path: {root}")
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("tree").options(paths="\n".join(roots), **{k: str(v) for k, v in options.items()})


def read_tree(spark: SparkSession, *roots: str, skip: bool = True, ignore_file: bool = True, extensions: tuple[str, ...] = (), include: tuple[str, ...] = (), exclude: tuple[str, ...] = (), split: bool = False, around: int = 0, piece_bytes: int = PIECE, partition_bytes: int = 64 << 20) -> DataFrame:
    """Files of all roots, in argument order; what lies under two roots comes twice. With split, a file larger than a piece is read by several tasks."""
    options = {"skip": skip, "ignore_file": ignore_file, "extensions": ",".join(extensions), "include": "\n".join(include), "exclude": "\n".join(exclude), "split": split, "around": around, "piece_bytes": piece_bytes, "partition_bytes": partition_bytes}
    return tree_reader(spark, roots, **options).load()


def stream_tree(spark: SparkSession, *roots: str, max_files: int = 0, settle_ms: int = 1000, state: str = "", **settings) -> DataFrame:
    """Files of trees as they appear and change; see TreeStream. settings as for read_tree(); ignore files are read when a batch is listed."""
    options = {k: v if not isinstance(v, tuple) else ("," if k == "extensions" else "\n").join(v) for k, v in settings.items()}
    tree_reader(spark, roots)
    return spark.readStream.format("tree").options(paths="\n".join(roots), max_files=str(max_files), settle_ms=str(settle_ms), state=state, **{k: str(v) for k, v in options.items()}).load()


def line_offsets(spark: SparkSession, *roots: str, **settings) -> DataFrame:
    """root_ord, path, piece, lines_before: how many lines of a split file stand before each of its pieces. settings as for read_tree()."""
    options = {k: v if not isinstance(v, tuple) else ("," if k == "extensions" else "\n").join(v) for k, v in settings.items()}
    counted = tree_reader(spark, roots, **options, split=True, table="offsets").load()
    above = Window.partitionBy("root_ord", "path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return counted.select("root_ord", "path", "piece", F.coalesce(F.sum("starts").over(above), F.lit(0)).alias("lines_before"))


def read_named(named: DataFrame, root: str, extensions: tuple[str, ...] = (), by_row: bool = False) -> DataFrame:
    """The regular files below root that the paths (relative to it) name, each once; paths without one drop out. By row,
    root is the column that has each path's own root. Nothing else is listed or opened."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        reader, tops = TreeReader({}), {}
        for batch in batches:
            for at, rel in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                path = os.path.join(at, rel)
                if at not in tops:
                    tops[at] = os.path.realpath(at)
                if os.path.isfile(path) and os.path.realpath(path) == os.path.join(tops[at], rel):
                    yield from ((0, path, rel, *content) for content in reader.contents(path, -1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_of(found(batches))

    wanted = named.select((F.col(root) if by_row else F.lit(root)).alias("root"), "path")
    kept = wanted.where(F.col("path").isNotNull() & has_extension(F.col("path"), extensions)).distinct()
    # What opening a file costs isn't told by the bytes of its name.
    return kept.repartition(4 * kept.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, SCHEMA)


def write_tree(files: DataFrame, root: str) -> int:
    """Write rows (path, content) as files below root, a mounted folder, where the rows are; returns their number.
    A path that comes twice is written twice, and the last writer wins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in ((p.as_py(), c.as_py()) for p, c in zip(*batch.columns, strict=True)):  # one text at a time
                at = os.path.join(root, path)
                os.makedirs(os.path.dirname(at), exist_ok=True)
                draft = f"{at}.{os.getpid()}~"
                with open(draft, "w", encoding="utf-8", newline="") as out:
                    out.write(content)
                os.replace(draft, at)
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

    rows = files.select("path", "content").where(F.col("path").isNotNull() & F.col("content").isNotNull())
    return rows.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0
