"""Where results go: JSON and CSV files, folders of them, and the terminal."""

from __future__ import annotations

import csv
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from quarry.schemas import MATCH

FIELDS = ["file_path", "line_number", "line_content", "match_text"]
WIDTH = 60
CYAN, YELLOW, GREEN, FAINT, PLAIN = "\x1b[36m", "\x1b[33;1m", "\x1b[32m", "\x1b[2m", "\x1b[0m"


def envelope(matches: DataFrame, query: str = "", is_regex: bool = False) -> DataFrame:
    """One row: the number of matches and the query. The matches themselves stay rows: sorted_matches()."""
    return matches.agg(F.count(F.lit(1)).cast("int").alias("total_count")).select("total_count", F.lit(query).alias("query"), F.lit(is_regex).alias("is_regex"))


def sorted_matches(matches: DataFrame) -> DataFrame:
    """The matches in order, range-sorted, for write_folder(): many files, no task with all of them."""
    return matches.select(*FIELDS).orderBy(*FIELDS)


@dataclass
class Part(WriterCommitMessage):
    """What one task has written: its place among the tasks, its file and the number of matches in it."""

    place: int
    file: str
    n: int


class DocumentWriter(DataSourceArrowWriter):
    """One document of matches in order. Tasks write their parts beside it, the commit joins them under a header and a
    footer; until then the document isn't there, and a job that fails leaves nothing behind."""

    def __init__(self, options: dict):
        self.path, self.form = options["path"], options.get("form", "json")
        self.query, self.is_regex = options.get("query", ""), options.get("is_regex", "false") == "true"
        self.folder = f"{self.path}.{uuid.uuid4().hex}.parts"
        with open(self.path + ".tmp~", "w", encoding="utf-8"):  # fails here, before any task runs, where the folder can't be written to
            pass
        os.remove(self.path + ".tmp~")
        os.makedirs(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        file, n = f"{self.folder}/{task.partitionId()}-{task.taskAttemptId()}", 0
        with open(file, "w", encoding="utf-8", newline="") as out:
            table = csv.writer(out, lineterminator="\n")
            for batch in iterator:
                for row in batch.select(FIELDS).to_pylist():
                    if self.form == "csv":
                        table.writerow(row.values())
                    else:
                        body = json.dumps(row, indent=2, ensure_ascii=False).replace("\n", "\n    ")
                        out.write(f"{',' * (n > 0)}\n    {body}")
                    n += 1
        return Part(task.partitionId(), file, n)

    def commit(self, messages: list[Part | None]) -> None:
        parts = sorted((m for m in messages if m is not None and m.n), key=lambda m: m.place)
        draft = f"{self.folder}/document"
        with open(draft, "wb") as out:
            out.write((",".join(FIELDS) + "\n").encode() if self.form == "csv" else b'{\n  "matches": [')
            for k, part in enumerate(parts):
                if k and self.form == "json":
                    out.write(b",")
                with open(part.file, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
            if self.form == "json":
                end = f'],\n  "total_count": {sum(m.n for m in parts)},\n  "query": {json.dumps(self.query, ensure_ascii=False)},\n  "is_regex": {json.dumps(self.is_regex)}\n}}\n'
                out.write((("\n  " if parts else "") + end).encode())
        os.replace(draft, self.path)
        shutil.rmtree(self.folder, ignore_errors=True)

    def abort(self, messages: list[Part | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class DocumentSink(DataSource):
    """df.write.format("match_document") with options path, form ("json" or "csv"), query, is_regex. The folder must be mounted where the tasks run."""

    @classmethod
    def name(cls) -> str:
        return "match_document"

    def schema(self) -> str:
        return MATCH

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write_document(matches: DataFrame, path: str, **options) -> int:
    """The number of matches, counted by the job that writes them."""
    matches.sparkSession.dataSource.register(DocumentSink)
    seen = Observation()
    counted = matches.select(*FIELDS).observe(seen, F.count(F.lit(1)).alias("n"))
    counted.write.format("match_document").options(path=os.path.abspath(checked_folder(path)), **options).mode("append").save()
    return seen.get["n"]


def write_json(matches: DataFrame, path: str, query: str = "", is_regex: bool = False) -> int:
    """One JSON document, indented by two spaces, written by the tasks that have the matches; returns their number."""
    return write_document(matches, path, form="json", query=query, is_regex=str(is_regex).lower())


def write_csv(matches: DataFrame, path: str) -> int:
    """One CSV file with a header, quoted where needed; returns the number of matches."""
    return write_document(matches, path, form="csv")


def write_folder(matches: DataFrame, path: str, form: str = "json") -> None:
    """Large results: many files, written where the rows are."""
    writer = matches.select(*FIELDS).write
    if form == "csv":
        writer.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path)
    else:
        writer.json(path)


def with_headers(matches: DataFrame) -> DataFrame:
    """new_file is true where a file's first match stands, in the order of file and line."""
    order = Window.partitionBy("file_path").orderBy("line_number", "line_content")
    return matches.withColumn("new_file", F.row_number().over(order) == 1)


def printed(matches: DataFrame, query: str, colour: bool = True) -> Iterator[str]:
    """Lines for the terminal, as matches arrive: a heading for each file, the matches, a summary."""
    paint = lambda text, code: f"{code}{text}{PLAIN}" if colour else text
    last, n = None, 0
    for row in matches.toLocalIterator():
        if row["file_path"] != last:
            if last is not None:
                yield paint("─" * WIDTH, FAINT)
            yield paint(row["file_path"], CYAN)
            last = row["file_path"]
        text, match = row["line_content"], row["match_text"]
        yield f"  {paint(row['line_number'], GREEN)} │ {text.replace(match, paint(match, YELLOW)) if match else text}"
        n += 1
    if not n:
        yield "No matches found."
    else:
        yield from ("", paint("═" * WIDTH, FAINT), f'Found {n} matches for "{query}"', paint("═" * WIDTH, FAINT))


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """A window of an ordered result."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def checked_folder(path: str) -> str:
    """The path, if its folder can be written to."""
    folder = os.path.dirname(os.path.abspath(path))
    if not os.access(folder, os.W_OK):
        raise PermissionError(f"cannot write to {folder}")
    return path
