"""Steps whose cost once grew faster than their input: plans, partitions and batches."""

import os
import subprocess
from datetime import datetime

import pyarrow as pa
import pytest

from quarry import queries
from quarry.functions.patterns import compile_pattern
from quarry.operators import fuzzy
from quarry.operators.name_index import NameIndex
from quarry.plans import search as plans
from quarry.schemas import HistoryConfig
from quarry.sources import gitlog, tables, tree
from quarry.streaming.files import deliver, stream_matches


# --- many repositories ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def repositories(tmp_path_factory):
    """Four repositories with commits in common, as forks have, and others; the last has no commit of Ann's."""
    top = tmp_path_factory.mktemp("repositories")

    def git(at, *args, who="Ann"):
        env = os.environ | {f"GIT_{role}_{key}": v for role in ("AUTHOR", "COMMITTER") for key, v in (("NAME", who), ("EMAIL", f"{who.lower()}@x.org"), ("DATE", "2024-01-01T00:00:00+00:00"))}
        subprocess.run(["git", "-C", str(at), *args], env=env, check=True, capture_output=True)

    for k in range(4):
        at = top / f"r{k}"
        at.mkdir()
        git(at, "init", "-q", "-b", "main")
        for name, who in (("common.go", "Ann"), (f"own{k}.go", "Bob"), (f"ann{k}.go", "Ann"))[: 3 if k < 3 else 1]:
            (at / name).write_text(f"func {name[:-3]}() {{\n")
            git(at, "add", "."), git(at, "commit", "-qm", f"add func {name}", who=who if k < 3 else "Cid")
    return [str(top / f"r{k}") for k in range(4)]


def found(spark, roots, **asked):
    return sorted((r["file_path"], r["line_number"], r["line_content"], r["match_text"]) for r in plans.search(spark, HistoryConfig("func", tuple(roots), **asked)).collect())


def scans(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("MapInArrow") + plan.count("RelationV2")


@pytest.mark.parametrize("asked", [{"author": "ann"}, {"author": "ann", "commit_message": True}, {"changed_in": "HEAD~1"}, {"since": datetime(2023, 1, 1)}], ids=str)
def test_many_repositories_are_searched_by_one_plan(spark, repositories, monkeypatch, asked):
    roots = repositories if "changed_in" not in asked else repositories[:3]
    want = sorted(row for root in roots for row in found(spark, [root], **asked))
    assert found(spark, roots, **asked) == want and want
    monkeypatch.setattr(gitlog, "SPREAD", 1)
    assert found(spark, roots, **asked) == want
    assert found(spark, [*roots, roots[0]], **asked) == sorted(want + found(spark, roots[:1], **asked))
    plan = lambda some: plans.search(spark, HistoryConfig("func", tuple(some), **asked))
    assert scans(plan(roots)) == scans(plan(roots[:2]))


def test_tasks_list_the_hashes_of_many_repositories(spark, repositories, monkeypatch):
    few = [sorted(map(str, t.collect())) for t in gitlog.read_history(spark, *repositories, slice_size=1)]
    monkeypatch.setattr(gitlog, "SPREAD", 3)
    listed = []
    monkeypatch.setattr(gitlog.HistoryReader, "partitions", lambda self: listed.append(1))
    many = gitlog.read_history(spark, *repositories, slice_size=1)
    assert [sorted(map(str, t.collect())) for t in many] == few and len(few[0]) == 10 and not listed
    assert many[0].rdd.getNumPartitions() == many[1].rdd.getNumPartitions() == gitlog.tasks(spark)  # however many slices there are


# --- streams of trees ------------------------------------------------------------------------------


def test_a_stream_that_starts_again_takes_all_that_has_come(spark, tmp_path):
    root, got = tmp_path / "tree", []
    root.mkdir()
    for k in range(2):
        for n in range(1100):
            (root / f"{k}_{n}.txt").write_text("needle\n")
        matches = stream_matches(tree.stream_tree(spark, str(root), settle_ms=0), compile_pattern("needle"))
        deliver(matches, lambda batch, n: got.extend(os.path.basename(r["file_path"]) for r in batch.collect()), str(tmp_path / "state")).awaitTermination()
        assert sorted(got) == sorted(f"{j}_{n}.txt" for j in range(k + 1) for n in range(1100))


# --- compact tables, indexes -----------------------------------------------------------------------


def test_code_files_are_dealt_by_rows(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    whole = sorted(map(str, queries.code_files(spark, sf).collect()))
    monkeypatch.setattr(tables, "ROWS", 30)
    files = queries.code_files(spark, sf)
    assert files.rdd.getNumPartitions() == -(-len(whole) // 30) > 1  # the scan alone gives one
    assert sorted(map(str, files.collect())) == whole


# --- memory of Python tasks ------------------------------------------------------------------------


def test_names_leave_a_batch_piece_by_piece(spark, monkeypatch):
    texts = ["", None, "é" * 30, "x" * 500, *["some words"] * 40]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int32()), pa.array(texts)], names=["root_ord", "content"])
    monkeypatch.setattr(fuzzy, "PIECE", 100)
    parts = list(fuzzy.pieces(batch))
    assert pa.Table.from_batches(parts).to_pylist() == pa.Table.from_batches([batch]).to_pylist()
    assert [len(p) for p in parts] == [3, 1, 10, 10, 10, 10]
    assert list(fuzzy.pieces(batch.slice(0, 0))) == []
    assert sum(map(len, fuzzy.pieces(batch.slice(1, 1)))) == 1


def test_an_update_of_the_index_reads_the_files_once(spark, tmp_path):
    looked = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            looked.add(len(batch))
            yield batch

    files = spark.createDataFrame([(f"{k}.py", f"def f{k}():\n    pass\n") for k in range(10)], "path string, content string")
    index = NameIndex(spark, f"file://{tmp_path}/names")
    assert index.update(files.selectExpr("path", "'1' AS version"), lambda changed: files.join(changed, "path", "left_semi").mapInArrow(look, files.schema)) == 0
    assert looked.value == 10
    assert index.find_definition("f3").count() == 1
