"""What reaches the tree reader, large files in pieces, and regexes in linear time."""

import os
import random
import time

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from quarry.functions.patterns import PatternError, compile_pattern, found_in, uncaptured
from quarry.operators import files, lines
from quarry.plans import search as plans
from quarry.schemas import SearchConfig
from quarry.sources import tree


def put(root, **contents):
    for name, data in contents.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data if isinstance(data, bytes) else data.encode())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("pushed")
    put(root, **{"src/a.go": "needle é\nx\n", "src/b.go": "nothing", "src/deep/c.py": "a needle\r\n", "doc/d.md": "needle", "doc/bin": b"\0needle", "doc/bad": b"\xff needle", "doc/late": b"x" * 600 + b"\0needle", "empty": b""})
    return root


def plan_of(df):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def read(spark, df):
    return sorted(r["rel_path"] for r in df.collect())


def test_conditions_reach_the_reader(spark, folder):
    found = tree.read_tree(spark, str(folder))
    cases = [
        (F.contains("content", F.lit("needle")), ["doc/bad", "doc/bin", "doc/d.md", "doc/late", "src/a.go", "src/deep/c.py"], "StringContains"),
        (~F.contains("content", F.lit("needle")), ["empty", "src/b.go"], "StringContains"),
        (F.col("rel_path").startswith("src/"), ["src/a.go", "src/b.go", "src/deep/c.py"], "StringStartsWith"),
        (F.col("path").endswith(".go") & F.contains("content", F.lit("é")), ["src/a.go"], "StringEndsWith"),
        (F.col("rel_path") == "src/b.go", ["src/b.go"], "EqualTo"),
        (F.col("rel_path").isin("doc/d.md", "src/a.go", "gone"), ["doc/d.md", "src/a.go"], "In"),
        (~F.col("is_binary") & F.contains("rel_path", F.lit("doc")), ["doc/bad", "doc/d.md", "doc/late"], "is_binary"),
        (F.col("is_binary"), ["doc/bin"], "is_binary"),
        (F.col("root_ord") == 1, [], "root_ord"),
        (~(F.col("rel_path") == "empty") & ~F.col("rel_path").startswith("doc"), ["src/a.go", "src/b.go", "src/deep/c.py"], "StringStartsWith"),
    ]
    for condition, want, said in cases:
        kept = found.where(condition)
        assert read(spark, kept) == want, condition
        pushed = plan_of(kept).split("PushedFilters")[1].split("\n")[0]
        assert said in pushed and "Filter [" not in plan_of(kept), plan_of(kept)


def test_conditions_that_stay_with_spark(spark, folder):
    found = tree.read_tree(spark, str(folder))
    assert read(spark, found.where(F.col("content").contains("�"))) == ["doc/bad"]
    assert read(spark, found.where(F.length("content") == 0)) == ["empty"]
    assert read(spark, found.where(F.col("content").startswith("needle"))) == ["doc/d.md", "src/a.go"]
    assert read(spark, found.where((F.col("rel_path") == "empty") | F.col("content").contains("é"))) == ["empty", "src/a.go"]
    assert read(spark, found.where(F.col("rel_path") > "src")) == ["src/a.go", "src/b.go", "src/deep/c.py"]


def test_only_what_may_match_is_opened_and_decoded(folder, monkeypatch):
    from pyspark.sql.datasource import EqualTo, Not, StringContains, StringStartsWith

    opened, decoded, entered = [], [], []
    plain_open, plain_texts, plain_scan = tree.open_file, tree.texts, os.scandir
    monkeypatch.setattr(tree, "open_file", lambda path: opened.append(os.path.relpath(path, folder)) or plain_open(path))
    monkeypatch.setattr(tree, "texts", lambda datas: decoded.extend(datas) or plain_texts(datas))
    monkeypatch.setattr(tree.os, "scandir", lambda path: entered.append(os.path.relpath(path, folder)) or plain_scan(path))

    def run(*filters, **options):
        for seen in (opened, decoded, entered):
            seen.clear()
        reader = tree.TreeReader({"paths": str(folder), **options})
        assert list(reader.pushFilters(list(filters))) == []
        return sorted(x for share in reader.partitions() for b in reader.read(share) for x in b.column(2).to_pylist())

    for options in ({}, {"spread": "1"}):
        assert run(StringContains(("content",), "needle"), Not(EqualTo(("is_binary",), True)), **options) == ["doc/bad", "doc/d.md", "doc/late", "src/a.go", "src/deep/c.py"]
        assert len(opened) == 8 and len(decoded) == 5
        assert run(StringStartsWith(("rel_path",), "src/d"), **options) == ["src/deep/c.py"]
        assert opened == ["src/deep/c.py"] and "doc" not in entered and "src/deep" in entered
        assert run(EqualTo(("path",), str(folder / "doc/d.md")), **options) == ["doc/d.md"] and opened == ["doc/d.md"] and "src" not in entered


def test_searches_push_their_keyword(spark, folder):
    found = lines.find_matches(files.select_files(tree.read_tree(spark, str(folder)), skip_directories=False), compile_pattern("needle"))
    pushed = plan_of(found).split("PushedFilters")[1].split("\n")[0]
    assert "StringContains(content,needle)" in pushed.replace(" ", "") and "is_binary" in pushed
    assert sorted(os.path.relpath(r["file_path"], folder) for r in found.collect()) == ["doc/bad", "doc/d.md", "doc/late", "src/a.go", "src/deep/c.py"]


# --- large files --------------------------------------------------------------------------------


def by_hand(data, word, around=0):
    parts = data.decode().split("\n")
    parts = parts[:-1] if parts[-1] == "" else parts
    frame = lambda k: "\n".join(("> " if j == k else "  ") + parts[j] for j in range(max(0, k - around), min(len(parts), k + around + 1)))
    return [(k + 1, frame(k) if around else x) for k, x in enumerate(parts) if word in x]


@pytest.mark.parametrize("seed", (1, 3))
def test_pieces_have_the_right_lines(spark, tmp_path, seed):
    rnd = random.Random(seed)
    made = ["".join(rnd.choice(["ab", "c", "é", "\r"]) for _ in range(rnd.choice([0, 0, 1, 3, 9, 60]))) for _ in range(120)]
    data = "\n".join(made).encode() + b"\n" * (seed % 2) + b"\n\n" * (seed == 3)
    put(tmp_path, **{"big.txt": data, "sub/small.txt": "ab\ncab", "sub/dir/other.txt": data[: len(data) // 2].decode("utf-8", "ignore")})
    for size in (7, 90):
        for split in (False, True):
            for around in (0, 2):
                found = plans.search(spark, SearchConfig("ab", (str(tmp_path),), context=around, split=split, piece_bytes=size)).collect()
                for name in ("big.txt", "sub/small.txt", "sub/dir/other.txt"):
                    mine = sorted((r["line_number"], r["line_content"]) for r in found if r["file_path"] == str(tmp_path / name))
                    assert mine == by_hand((tmp_path / name).read_bytes(), "ab", around), (size, split, around, name)


def test_pieces_of_listed_folders_and_symbol_lines(spark, tmp_path):
    put(tmp_path, **{f"d{k}/f.py": "x = 1\n" * k + "def f(a):\n" for k in range(12)})
    options = {"paths": str(tmp_path), "spread": "2", "piece_bytes": "10", "split": "true"}
    shares = tree.TreeReader(options).partitions()
    assert any(s.folders for s in shares)
    rows = spark.read.format("tree").options(**options).load()
    got = {(r["path"][len(str(tmp_path)) :], r["line_number"]) for r in lines.to_lines(rows.select("path", "content", "part")).where("line = 'def f(a):'").collect()}
    assert got == {(f"/d{k}/f.py", k + 1) for k in range(12)}


def test_a_split_file_is_several_partitions(spark, tmp_path):
    line = b"some words of a line\n"
    put(tmp_path, **{"big.log": line * 60_000 + b"the needle\n" + line * 60_000 + b"needle"})
    found = tree.read_tree(spark, str(tmp_path), split=True, piece_bytes=1 << 18, partition_bytes=1 << 18)
    assert found.rdd.getNumPartitions() >= 10
    rows = plans.search(spark, SearchConfig("needle", (str(tmp_path),), split=True, piece_bytes=1 << 18))
    assert sorted((r["line_number"], r["line_content"]) for r in rows.collect()) == [(60_001, "the needle"), (120_002, "needle")]
    # Contents are never shuffled, only what has matched.
    shuffled = [part for part in plan_of(rows).split("\n\n") if ") Exchange" in part]
    assert shuffled and not any(" content#" in part for part in shuffled)


# --- regexes ------------------------------------------------------------------------------------


def test_time_grows_with_the_line_alone(spark):
    for pattern in (r"(?:a|aa)+\d", r"(a*)*b", r"(?:a+)+$x?b", r"(?:(?:a|a)+)+c"):
        p = compile_pattern(pattern, True)
        rows = spark.createDataFrame([("p", "a" * 10_000)], "path string, content string")
        lines.find_matches(rows, p).count()
        began = time.perf_counter()
        assert lines.find_matches(rows, p).count() == 0
        assert time.perf_counter() - began < 5
        began = time.perf_counter()
        assert found_in(pa.array(["a" * 10_000]), p.re2).to_pylist() == [None]
        assert time.perf_counter() - began < 1


def test_batches_keep_nulls_and_order():
    given = pa.array(["x1x1", None, "", "zx1", "é x1x1x1"])
    assert found_in(given, "(?:x1)+").to_pylist() == ["x1x1", None, None, "x1", "x1x1x1"]
    assert found_in(pa.array([], pa.string()), "(?:x1)+").to_pylist() == []
    assert found_in(pa.array([None], pa.string()), "(?:x)*").to_pylist() == [None]
    assert found_in(pa.array(["ab"]), "(?:x)*").to_pylist() == [""]


def test_groups_become_plain_ones():
    assert uncaptured(r"(a)(?P<n>b)(?<m>c)(?i:d)[(]\(\Q(x\E+[]([:alpha:]]") == r"(?:a)(?:b)(?:c)(?i:d)[(]\(\(x+[]([:alpha:]]"
    assert uncaptured(r"a\Qb|c") == r"ab\|c" and uncaptured(r"\\(x)") == r"\\(?:x)"
    with pytest.raises(PatternError):
        uncaptured("(a")


def test_ignoring_case_as_re2_does(spark):
    p = compile_pattern("Skip", ignore_case=True)
    given = ["SKIP", "ſkip", "sKip", "skİp", "skıp", "xskipx", "ski p"]
    rows = spark.createDataFrame([(str(k), x) for k, x in enumerate(given)], "path string, content string")
    assert sorted(r["line_content"] for r in lines.find_matches(rows, p).collect()) == sorted(["SKIP", "ſkip", "sKip", "xskipx"])


def test_whole_texts_are_tested_first():
    for query, line, hit in ((r"^b\w+$", "a\nbc\nd", True), (r"^c$", "a\nbc", False), (r"\bx", "a\nx", True), (r"a$", "a\r\n", False), (r"b|^$", "a\n\nc", True)):
        p = compile_pattern(query, True)
        assert pc.match_substring_regex(pa.array([line]), p.anywhere)[0].as_py() is hit
    assert compile_pattern(r"\Aa", True).anywhere is None and compile_pattern(r"(?-m)[a]", True).anywhere is None


@pytest.mark.parametrize("strip", [False, True])
def test_batches_find_what_single_lines_match(spark, strip):
    contents = ["", "\n", "\n\n", "ab", "ab\n", "ab\r\nb\r\n", "x\nab\n\nxab\r", None, "é ab\nAB\n"]
    rows = spark.createDataFrame([(str(k), x, 7) for k, x in enumerate(contents)], "path string, content string, extra int")
    for query in (r"[a]b", r"^$", r"b$", r"\Aab\z", r"(?:a|x)*b", r"(?i)[a]b$"):
        p = compile_pattern(query, True)
        found = lines.find_matches(rows, p, strip_cr=strip, keep=("extra",)).collect()
        split = lines.to_lines(rows.where("content is not null"), strip)
        want = split.where(F.col("line").rlike(query.replace("$", r"\z"))).select("path", "line_number", "line").collect()
        assert sorted((r["file_path"], r["line_number"], r["line_content"]) for r in found) == sorted(map(tuple, want)), query
        assert all(r["extra"] == 7 for r in found)


# --- streams ------------------------------------------------------------------------------------


def test_a_tree_as_a_stream(spark, tmp_path):
    root, got = tmp_path / "tree", []

    def run(**options):
        got.clear()
        found = lines.find_matches(tree.stream_tree(spark, str(root), settle_ms=0, state=str(tmp_path / "position"), **options), compile_pattern("needle"))
        take = lambda batch, n: got.append(sorted((os.path.relpath(r["file_path"], root), r["line_content"]) for r in batch.collect()))
        query = found.writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).start()
        query.processAllAvailable()
        query.stop()
        return sorted(x for batch in got for x in batch)

    put(root, **{f"d/{k}.txt": f"needle {k}" for k in range(5)}, **{"x.bin": b"no", ".hidden/y": "needle"})
    for k in range(5):
        os.utime(root / f"d/{k}.txt", (100, 100 + k // 2))  # some change at one time
    assert run(max_files=2) == [(f"d/{k}.txt", f"needle {k}") for k in range(5)]
    assert [len(b) for b in got if b] == [2, 2, 1]
    assert run() == []
    put(root, **{"d/1.txt": "needle anew", "new/z.txt": "needle z"})
    assert run(max_files=1) == [("d/1.txt", "needle anew"), ("new/z.txt", "needle z")]
    assert [len(b) for b in got if b] == [1, 1]
    put(root, **{"late.txt": "needle late"})
    assert run() == [("late.txt", "needle late")]


def test_recent_changes_wait(tmp_path):
    put(tmp_path, **{"a": "x", "b": "y"})
    os.utime(tmp_path / "a", (100, 100))
    stream = tree.TreeStream({"paths": str(tmp_path), "settle_ms": "60000"})
    start = stream.initialOffset()
    assert stream.latestOffset() == {"changed": 100 * 10**9, "path": str(tmp_path / "a")}
    assert [f[2] for s in stream.partitions(start, stream.latestOffset()) for f in s.files] == ["a"]
    assert stream.latestOffset() == {"changed": 100 * 10**9, "path": str(tmp_path / "a")}
