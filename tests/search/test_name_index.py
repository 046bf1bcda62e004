"""The stored name index against plain extraction, over updates."""

import pytest

from quarry.operators import lines, symbols
from quarry.operators.name_index import NameIndex

FIRST = {
    "a.go": "func Serve() {\nvar served = 1\n",
    "b.py": "def serve_all(a):\n    return Serve(a)\nclass Ab:\n",
    "c.ts": "const x = (a) => Serve\n",
    "d.go": "type É struct {\nfunc f() {\n",
    "e.py": None,
}
SECOND = {**FIRST, "a.go": "func Start() {\n", "f.py": "def reserve():\n    pass\r\ndef Serve(x):\r\n"}
del SECOND["c.ts"]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, state):
    return spark.createDataFrame([(p, c, str(hash(c)), 1) for p, c in state.items()] + [(None, "def none():", "1", 2)], "path string, content string, version string, batch int")


class Reader:
    """Reads files of a state and writes down which."""

    def __init__(self, files):
        self.files, self.asked = files, []

    def __call__(self, changed):
        self.asked = sorted(r["path"] for r in changed.collect())
        return self.files.join(changed, "path", "left_semi")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    return NameIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/names")


def check(spark, index, state):
    files = frame(spark, state).where("path is not null")
    read = Reader(files)
    split = lines.to_lines(files.na.fill("", ["content"]).select("path", "content"), strip_cr=True)
    plain = symbols.extract_symbols(split)
    for text in ("SERVE", "serve", "e", "ab", "f", "É", "er", "erve_a", "", "nowhere", "reserv"):
        assert rows_of(index.find_symbol(text)) == rows_of(symbols.find_symbol(plain, text)), text
    for name in ("Serve", "serve", "Start", "nowhere"):
        assert rows_of(index.find_definition(name)) == rows_of(symbols.find_definition(plain, name))
    for name in ("Serve", "def Serve", "return", "nowhere"):
        assert rows_of(index.find_references(name, read)) == rows_of(symbols.find_references(split, name))
    return read


def test_updates_read_changed_files_alone_and_lookups_equal_extraction(spark, index):
    assert index.find_symbol("serve").count() == 0 and index.find_definition("Serve").count() == 0
    read = Reader(frame(spark, FIRST))
    assert index.update(read.files.select("path", "version"), read) == 0 and read.asked == sorted(FIRST)
    assert check(spark, index, FIRST).asked == []
    assert index.update(read.files.select("path", "version"), read) is None
    read = Reader(frame(spark, SECOND))
    assert index.update(read.files.select("path", "version"), read) == 1 and read.asked == ["a.go", "f.py"]
    check(spark, index, SECOND)
    # A batch that broke off before its files were written doesn't count, and is written again.
    index.write("symbols", 2, index.read("symbols").where("batch = 0").drop("batch"), "bucket", "name", "file")
    check(spark, index, SECOND)
    read = Reader(frame(spark, FIRST))
    assert index.update(read.files.select("path", "version"), read) == 2 and read.asked == ["a.go", "c.ts"]
    check(spark, index, FIRST)
    with pytest.raises(ValueError):
        index.find_references("==", read)


def test_references_ask_for_files_that_hold_the_word(spark, index):
    read = Reader(frame(spark, FIRST))
    index.find_references("served", read).count()
    assert read.asked == ["a.go"]
    plan = index.find_definition("Serve")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(name), EqualTo(name,Serve)]" in plan
