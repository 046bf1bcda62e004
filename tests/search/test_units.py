"""Patterns, paths, lines, similarity, sources and sinks on the cases that matter."""

import json
import os
import re
import subprocess
from datetime import datetime

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry import cli
from quarry.functions import paths, similarity, text
from quarry.functions.patterns import PatternError, compile_pattern, literal_prefix, uncaptured
from quarry.operators import files, fuzzy, lines, symbols
from quarry.plans import search as plans
from quarry.schemas import MATCH, HistoryConfig, SearchConfig
from quarry.sources import codehost, gitlog, sinks, tree


def put(root, **contents):
    for name, data in contents.items():
        at = root / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(data if isinstance(data, bytes) else data.encode())


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- patterns ---------------------------------------------------------------------------------------

RE2_CASES = [
    (r"\bre", "éa re ré are"), (r"\Bre", "éare re"), (r"a\s+b", "a\x0bb a\tb"), (r"[\s,]+x", "\x0b, x"), (r"(?P<first>\w+) \w+", "one two"), (r"[[:alpha:]]+", "ab1é"), (r"[a[b]+", "[ab["),
    (r"a&&b", "a&&b"), (r"[a&&b]+", "a&b"), (r"x{,3}", "x{,3}"), (r"x{2,}", "xxx"), (r".$", "ab\r"), (r"a.b", "a\rb"), (r"\Qa.b\E+", "a.bb"), (r"\x{41}\x42\101", "ABA"), (r"(?i)k", "K"),
    (r"[^\S]+", "a \tb"), (r"[]a]+", "a]"), (r"\pN+\p{Greek}", "12α"), (r"(?m)^b$", "a"), (r"a|b|", "zb"), (r"\v", "\x0b"), ("é+?", "éé"), (r"^foo$", "foo"), (r"^foo$", "xfoo"), (r"(a+)+b", "aaab"),
]


def test_patterns_match_like_re2(spark):
    for pattern, line in RE2_CASES:
        found = value(spark, compile_pattern(pattern, True).match(F.lit(line)))
        want = duckdb.execute("SELECT regexp_matches(?, ?), regexp_extract(?, ?, 0)", [line, pattern, line, pattern]).fetchone()
        assert (found is not None, found or "") == want, pattern


@pytest.mark.parametrize("bad", ["(", ")", "a)", "[a", r"\C", r"(?=a)", r"(?<!a)", r"(?>a)", r"\1", "*a", "a**", "a*+", "a{1001}", r"\y", "a\\", "[[:nope:]]", "(?"])
def test_what_re2_rejects(bad):
    with pytest.raises(PatternError):
        uncaptured(bad)


def test_keywords_and_prefixes(spark):
    assert literal_prefix(r"func\s+\w+") == "func" and literal_prefix("ab*c") == "a" and literal_prefix("a|b") == "" and literal_prefix(r"a\.b+") == "a.b" and literal_prefix("(a)") == ""
    assert compile_pattern("a.b").is_keyword and compile_pattern("a.b", ignore_case=True).literal == "" and compile_pattern("(?U)a+", True).re2 == "(?U)a+"
    for query, line, hit in (("a.b", "a.b", True), ("a.b", "axb", False), ("HÉ", "hé", True), ("(x", "(X", True)):
        p = compile_pattern(query, ignore_case=query != "a.b")
        assert value(spark, p.matches(F.lit(line))) is hit
    assert value(spark, compile_pattern("HÉ", ignore_case=True).match(F.lit("a hé"))) == "hé"


@settings(max_examples=40, deadline=None)
@given(st.text("ab.*+?()[]|^$\\{}", max_size=8), st.text("ab.*(", max_size=12))
def test_keywords_are_plain_text(spark, query, line):
    assert value(spark, compile_pattern(query).matches(F.lit(line))) == (query in line)
    assert value(spark, compile_pattern(query, ignore_case=True).matches(F.lit(line))) == (query.lower() in line.lower())


def test_prefixes_stop_at_alternatives(spark):
    cases = [(r"a\\|b", ""), (r"a\|b", "a|b"), (r"f(a|b)", "f"), (r"x[|]y|z", ""), (r"\Qa|b\E", ""), (r"x\Qa|b\E", "x"), (r"a[]|]b", "a"), (r"q[[:alpha:]|]", "q"), ("ab|", ""), (r"a\\\|b", "a\\|b")]
    for pattern, want in cases:
        assert literal_prefix(pattern) == want, pattern
    rows = spark.createDataFrame([("p", "only b here\na\\ there")], "path string, content string")
    assert lines.find_matches(rows, compile_pattern(r"a\\|b", True)).count() == 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", r"\\", r"\|", "|", "[a|b]", "[|]", "(a|b)", r"\Q|\E", "a+", "b*", ".", r"\."]), max_size=6), st.text("ab|\\.", max_size=8))
def test_prefixes_begin_every_match(parts, line):
    pattern = "".join(parts)
    hit, found = duckdb.execute("SELECT regexp_matches(?, ?), regexp_extract(?, ?, 0)", [line, pattern, line, pattern]).fetchone()
    assert not hit or found.startswith(literal_prefix(pattern))


LONG = [(r"(?i)(?:x\w)+", "xé", "zz"), (r"(?:é\s)+b", "é b", "é\x0bb"), (r"(?i)(?:k\b.)*K", "K", "j"), (r"(?:[[:^alpha:]]\d)+", "a 1", "ab"), (r"([^\W]x)+$", "ax", "éx"), (r"(?:a\pL){2,}", "aéaz", "a1a2")]


def test_one_answer_for_short_and_long_lines(spark):
    """Patterns that repeat groups give RE2's answer, whatever the length of the line."""
    for pattern, *hits in LONG:
        p = compile_pattern(pattern, True)
        for line in hits:
            want = duckdb.execute("SELECT regexp_matches(?, ?)", [line, pattern]).fetchone()[0]
            rows = spark.createDataFrame([(0, line), (1, ", " * 5_000 + line)], "n int, line string")
            assert sorted(r["n"] for r in p.matching(rows, "line").collect()) == ([0, 1] if want else []), (pattern, line)
    rows = spark.createDataFrame([("p", "no\nabab\nend")], "path string, content string")
    found = lines.find_matches(rows, compile_pattern("(?:ab)+", True), 1).collect()
    assert [(r["line_number"], r["line_content"], r["match_text"]) for r in found] == [(2, "  no\n> abab\n  end", "abab")]


def jaro_by_hand(a, b):
    if not a or not b:
        return 0.0
    reach, free, first, second = max(0, max(len(a), len(b)) // 2 - 1), [True] * len(b), [], []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == c), None)
        if j is not None:
            free[j] = False
            first.append(c)
            second.append(j)
    m = len(first)
    t = sum(c != b[j] for c, j in zip(first, sorted(second))) // 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3 if m else 0.0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.text("abcd", max_size=20), st.text("abcd", max_size=20)), min_size=1, max_size=8))
def test_jaro_of_a_batch(pairs):
    found = similarity.jaro_of([a.encode() for a, _ in pairs], [b.encode() for _, b in pairs], 32)
    assert found.tolist() == pytest.approx([jaro_by_hand(a, b) for a, b in pairs], abs=1e-12)


def test_scores_run_once(spark):
    plan = fuzzy.fuzzy_find_all("func", spark.createDataFrame([("function",)], "text string"), 0.4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_tree_opens_only_what_is_searched(spark, folder, monkeypatch, tmp_path):
    reader = tree.TreeReader({"paths": str(folder), "include": "*.go\n*.md", "exclude": "*tools*"})
    assert sorted(rel for share in reader.partitions() for _, _, rel, _ in share.files) == ["_d/x.go", "app.go", "empty.go", "notes.md"]
    spread = tree.TreeReader({"paths": str(folder), "spread": "2"})
    shares = spread.partitions()
    assert any(s.folders for s in shares) and sorted(x for s in shares for b in spread.read(s) for x in b.column(2).to_pylist()) == sorted(r["rel_path"] for r in tree.read_tree(spark, str(folder)).collect())
    named = spark.createDataFrame([("app.go",), ("app.go",), ("gone.go",), ("link.go",), ("pkg",), ("notes.md",), (None,), ("../x",)], "path string")
    assert sorted(r["rel_path"] for r in tree.read_named(named, str(folder), (".go",)).collect()) == ["app.go"]
    rows = spark.createDataFrame([("a/b.txt", "x\r\n"), ("c", ""), (None, "x"), ("d", None)], "path string, content string")
    assert tree.write_tree(rows, str(tmp_path)) == 2 and (tmp_path / "a/b.txt").read_bytes() == b"x\r\n"


def test_shared_folder_must_be_shared(spark, monkeypatch):
    from quarry.sources import shared

    assert shared.mounted("file:///a/b") == "/a/b"
    with pytest.raises(ValueError):
        shared.mounted("hdfs://x/y")


def test_repeated_groups_on_long_lines(spark):
    line = "word " * 12_000
    rows = spark.createDataFrame([("p", line + "end(x)"), ("q", "a b end(y)"), ("r", line)], "path string, content string")
    found = lines.find_matches(rows, compile_pattern(r"(?:\w+\s+)+end\(", True)).collect()
    assert {r["file_path"]: r["match_text"][-8:] for r in found} == {"p": "ord end(", "q": "a b end("}


# --- paths ------------------------------------------------------------------------------------------


def test_extensions_globs_and_folders(spark):
    ext = [("clip.MP3", (".mp3",), True), ("clip.mp33", (".mp3",), False), ("x.rs", (), True), ("cargo", ("go",), True)]
    for path, extensions, kept in ext:
        assert value(spark, paths.has_extension(F.lit(path), extensions)) is kept
    globs = [("docs/plan.md", ["api/*"], [], False), ("api/old_plan.md", ["api/**"], ["**/old_*"], False), ("api/v2/b.md", ["api/*.md"], [], True), ("q.csv", [], ["?.csv"], False), ("b.h", ["[!a].h"], [], True), ("x.rst", ["*.{rst,adoc}"], [], True), ("x", ["[bad"], [], False), ("x", [], ["[bad"], True)]
    for path, include, exclude, kept in globs:
        assert value(spark, paths.passes_globs(F.lit(path), include, exclude)) is kept, path
    for path, skipped in (("a/.git/x", True), ("node_modules/x", True), (".env", False), ("a/vendor/b/c", True), ("vendored/x", False)):
        assert value(spark, paths.in_skipped_directory(F.lit(path))) is skipped


def test_ignore_rules(spark):
    rules = paths.ignore_rules("*.tmp\ncache/\n# notes\n!keep.tmp\n/top\nx/y\n[bad\n")
    cases = [("z.tmp", False, True), ("keep.tmp", False, False), ("cache", True, True), ("cache", False, False), ("lib.rs", False, False), ("a/top", False, True), ("x/y", False, True), ("z/x/y", False, False)]
    for path, folder, want in cases:
        assert value(spark, paths.is_ignored(F.lit(path), rules, folder)) is want and paths.ignored_by(rules, path, folder) is want
    assert value(spark, paths.below_ignored(F.lit("a/cache/keep.tmp"), rules)) is True
    assert value(spark, paths.below_ignored(F.lit("a"), [])) is False


def test_binary_window(spark):
    for data, want in ((b"\x00\x01", True), (b"hello", False), (b"", False), (b"a" * 511 + b"\0", True), (b"a" * 512 + b"\0", False)):
        assert value(spark, paths.is_binary(F.lit(data))) is want


# --- lines ------------------------------------------------------------------------------------------


def split_by_hand(content):
    parts = content.split("\n")
    return parts[:-1] if parts[-1] == "" else parts


@settings(max_examples=40, deadline=None)
@given(st.text("a\n\r x", max_size=14), st.integers(0, 2))
def test_lines_and_context(spark, content, around):
    rows = spark.createDataFrame([("p", content)], "path string, content string")
    want = split_by_hand(content)
    assert [r["line"] for r in lines.to_lines(rows).orderBy("line_number").collect()] == want
    found = sorted((r["line_number"], r["line_content"]) for r in lines.find_matches(rows, compile_pattern("a"), around).collect())
    hits = [k for k, x in enumerate(want) if "a" in x]
    framed = lambda k: "\n".join(("> " if j == k else "  ") + want[j] for j in range(max(0, k - around), min(len(want), k + around + 1)))
    assert found == [(k + 1, framed(k) if around else want[k]) for k in hits]


# --- similarity -------------------------------------------------------------------------------------


def test_similarity(spark):
    distance = [("kitten", "sitting", 3), ("saturday", "sunday", 3), ("function", "fucntion", 2), ("hello", "world", 4), ("abc", "", 3), ("Hello", "hello", 0), ("é", "e", 2)]
    for a, b, d in distance:
        assert value(spark, similarity.edit_distance(F.lit(a), F.lit(b))) == d
    for a, b, low, high in (("martha", "marhta", 0.9, 1), ("dixon", "dicksonx", 0.7, 0.9), ("", "abc", 0, 0), ("", "", 1, 1), ("abc", "abc", 1, 1)):
        assert low <= value(spark, similarity.jaro(F.lit(a), F.lit(b))) <= high
    assert abs(value(spark, similarity.jaro_winkler(F.lit("abcxyz"), F.lit("abqqqq"))) - (5 / 9 + 0.2 * 4 / 9)) < 1e-9
    for q, t, low in (("func", "function", 0.8), ("fucntion", "function", 0.7), ("a", "A", 1), ("", "x", 0.9)):
        assert value(spark, similarity.fuzzy_score(F.lit(q), F.lit(t))) >= low
    found = fuzzy.fuzzy_find_all("func", spark.createDataFrame([("function",), ("func",), ("factorial",), ("format",), ("xyz",)], "text string"), 0.4).collect()
    assert found[0]["text"] == "func" and [r["score"] for r in found] == sorted((r["score"] for r in found), reverse=True)


def test_suggestions_keep_the_first_of_each_text(spark):
    rows = [(0, "func handle(a int) {\nhandle handler"), (1, "handler handle func handle(b)\r\nif return"), (1, None), (1, "")]
    found = fuzzy.suggest("handle", spark.createDataFrame(rows, "root_ord int, content string")).collect()
    assert [(r["text"], r["context"]) for r in found] == [("handle", "identifier"), ("handler", "identifier")]
    many = [(0, "\n".join(f"func hand{k}le(x) {{" for k in range(40)) + "\nfunc handle()\n" * 15)]
    found = fuzzy.suggest("handle", spark.createDataFrame(many, "root_ord int, content string")).collect()
    assert [(r["text"], r["context"]) for r in found][:1] == [("handle", "identifier")] and len(found) == 10  # hand0le ... as identifiers


@settings(max_examples=40, deadline=None)
@given(st.text("abAB_é1", max_size=9), st.lists(st.text("abAB_é1c", max_size=12), min_size=1, max_size=12), st.sampled_from([0.0, 0.4, 0.7]))
def test_scores_of_a_query(spark, query, texts, least):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    found = rows.select(similarity.fuzzy_score(F.lit(query), F.col("text")).alias("s"), similarity.query_scores(query, F.col("text"), F.lit(least)).alias("q")).collect()
    assert all(r["q"] == (r["s"] if r["s"] >= least else None) for r in found)


@settings(max_examples=60, deadline=None)
@given(st.text("abc", min_size=1, max_size=8), st.lists(st.tuples(st.text("abcd", max_size=10), st.integers(0, 2), st.booleans()), min_size=1, max_size=60))
def test_the_best_of_each_group_are_scored(query, rows):
    texts, groups = [t.encode() for t, _, _ in rows], [g for _, g, _ in rows]
    least, share = np.array([0.5 if f else 0.4 for *_, f in rows]), np.array([1.0 if f else 0.9 for *_, f in rows])
    whole = similarity.Scorer(query).scores(texts, least)
    some = similarity.Scorer(query, 3).scores(texts, least, share, groups)
    for g in set(groups):
        mine = [k for k in range(len(rows)) if groups[k] == g and not np.isnan(whole[k])]
        third = sorted((whole[k] * share[k] for k in mine), reverse=True)[:3][-1] if mine else 0
        assert all(some[k] == whole[k] for k in mine if whole[k] * share[k] >= third)


def test_few_names_are_scored(spark):
    from quarry.sources.tables import document_files

    named = [r["text"].lower().encode() for r in fuzzy.identifiers(document_files(spark, "/root/testdata/sf0.01")).collect()]
    for query, least, most, share in (("Lisence", 0.6, 0, 0.2), ("goldnrod", 0.5, 10, 0.1)):
        scorer = similarity.Scorer(query, most)
        for at in range(0, len(named), 10_000):
            part = named[at : at + 10_000]
            scorer.scores(part, np.full(len(part), least))
        assert 0 < scorer.scored < share * len(named)


@settings(max_examples=100, deadline=None)
@given(st.text("ab_19 é\n.-", max_size=20))
def test_words_are_identifiers(content):
    assert {w.decode() for w in fuzzy.words_of(content.encode())} - {""} == set(re.findall(fuzzy.IDENTIFIER, content))


def test_text_functions(spark):
    now = datetime(2023, 3, 31, 12)
    assert text.time_ago("1 month ago", now) == datetime(2023, 3, 3, 12)
    assert text.time_ago("2 weeks ago", now) == datetime(2023, 3, 17, 12) and text.time_ago("1 YEAR x", now).year == 2022
    for bad in ("invalid", "1 ago", "abc days ago", "1 decades ago", ""):
        with pytest.raises(ValueError):
            text.time_ago(bad)
    assert value(spark, text.trim_space(F.lit("\t\u0085 a b　\n"))) == "a b"
    assert value(spark, text.two_digits(F.lit(0.125))) == "0.12"
    for new, old, newer in (("v1.2.0", "1.1.9", True), ("1.0", "1.0", False), ("1.0.1", "1.0", True), ("1.x", "1.1", False)):
        assert value(spark, text.is_newer(F.lit(new), F.lit(old))) is newer


# --- symbols ----------------------------------------------------------------------------------------


def test_sets_of_globs_say_what_single_patterns_say(spark):
    """Names, extensions and other globs, alone and by the hundred, against the regex of each glob; the last rule still wins."""
    names = ["a", "b.log", "x.min.js", ".log", "log", "a,b", "]", "c}", "ü.Log", "b.log.txt", "q.log/r"]
    given = sorted({*names, *(f"d/{n}" for n in names), *(f"a/e.f/{n}" for n in names), "d/a/b.log/z", "a/b", "d\nx/b.log"})
    globs = ["a", "*.log", "**.log", "d/a", "*.min.js", "a,b", "]", "c}", "*.Log", "[a-c]", "d/*", "?", "{log,q}*", "a/**/b.log", "*.", "x*.js", "\\a"]
    df = spark.createDataFrame([(p,) for p in given], "path string")
    for some in [[g] for g in globs] + [globs[:3], globs]:
        want = {p for p in given if any(re.search(paths.glob_regex(g).replace(r"\z", r"\Z"), p) for g in some)}
        assert {r["path"] for r in df.where(paths.matches_any(F.col("path"), some)).collect()} == want, some
    texts = ["a\n!d/a\n*.log\n!b.log\nd/b.log", "/a\nlog/\n!*.log\n*.js\n", "*\n!a\n!*.log\n", "\n".join(f"n{k}\n*.e{k}" for k in range(500)) + "\n*.log\n!d/b.log"]
    for text in texts:
        rules = paths.ignore_rules(text)
        for folder in (False, True):
            found = {r["path"] for r in df.where(paths.is_ignored(F.col("path"), rules, folder)).collect()}
            assert found == {p for p in given if paths.ignored_by(rules, p, folder)}, text


def test_lines_are_told_by_texts_before_the_matcher(spark):
    """What a rule needs is part of whatever it fits, and few lines of prose come to the matcher."""
    code = ["func a() {", "func (t T) B(x int) (y int) {", "type X struct {", "type Y interface{", "type Z int", "var v", "const c = 1", "\tf int", " f int", "def f(a):", "class C(B):", "v=1", "let f = (a) => a", "const g = async (a) => a", "function h(a) {", "export interface I {", "type J = K", "int f (a)"]
    df = spark.createDataFrame([(c,) for c in code], "line string")
    for rules in (symbols.GO, symbols.PYTHON, symbols.JAVASCRIPT, symbols.GENERIC):
        for rule in rules:
            fits = F.col("line").rlike(rule.pattern)
            assert df.where(fits).count() > 0
            assert df.where(fits & ~rule.may_fit(F.col("line"))).count() == 0
    prose = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.explode(F.split("text", "\n")).alias("line"))
    tried = [F.avg(sum(r.may_fit(F.col("line")).cast("int") for r in rules)) for rules in (symbols.GO, symbols.PYTHON, symbols.JAVASCRIPT, symbols.GENERIC)]
    assert all(share < 0.5 for share in prose.agg(*[t.alias(str(k)) for k, t in enumerate(tried)]).first())


def symbols_of(spark, path, content):
    found = symbols.extract_symbols(lines.to_lines(spark.createDataFrame([(path, content)], "path string, content string"), True))
    return [(r["line"], r["type"], r["name"], r["signature"]) for r in found.orderBy("line", "type").collect()]


def test_symbols(spark):
    assert symbols_of(spark, "a.go", "func main() {\nfunc (s *T) Run(a int) (int) {\nfunc f() error {\ntype X struct {\ntype Y struct\nvar z = 1\nconst (\n\treturn nil") == [
        (1, "function", "main", "()"), (2, "method", "Run", "(a int)"), (4, "struct", "X", ""), (5, "type", "Y", ""), (6, "var", "z", ""), (8, "field", "return", ""),
    ]
    assert symbols_of(spark, "a.py", "def f(a):\n  def g():\nclass C(B):\n_x = 1\nx == 1") == [(1, "function", "f", "(a)"), (3, "class", "C", ""), (5, "variable", "x", "")]
    assert symbols_of(spark, "a.ts", "const f = (a) => 1\ninterface X {") == [(1, "function", "f", "(a)"), (1, "function", "f", "(a)"), (2, "class", "X", ""), (2, "type", "X", "")]
    assert symbols_of(spark, "a.rs", "return foo(x)\n" + "w " * 20_000) == [(1, "function", "foo", "(x)")]
    refs = symbols.find_references(lines.to_lines(spark.createDataFrame([("a.go", "func Run() {\n RunE()\nx.Run(é)\ncronRun\nvar Run = 1\n\tRun ")], "path string, content string")), "Run").orderBy("line").collect()
    assert [(r["line"], r["category"], r["content"]) for r in refs] == [(1, "definition", "func Run() {"), (3, "usage", "x.Run(é)"), (5, "definition", "var Run = 1"), (6, "usage", "Run")]


# --- sources ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    put(root, **{"app.go": 'package app\n\n// serve starts it\nfunc serve() {\n\tlog.Print("up")\n}\n', "tools.go": "package app\n\nfunc pick(n int) error {\n\treturn nil\n}\n", "notes.md": "# Notes for readers\nNothing here yet.\n"})
    put(root, **{"pkg/__init__.py": "def func():\n", ".env": "func=1", "_d/x.go": "func x() {\r\n", "empty.go": b"", ".hidden/y.go": "func y() {", "node_modules/z.js": "func", "b.bin": b"\0func", "bad.txt": b"f\xfffunc", "skip.log": "func", "out/a.go": "func"})
    put(root, **{".gitignore": "*.log\nout/\n"})
    os.symlink(root / "app.go", root / "link.go")
    return root


def test_tree(spark, folder):
    found = {r["rel_path"]: r for r in tree.read_tree(spark, str(folder)).collect()}
    assert set(found) == {"app.go", "tools.go", "notes.md", "pkg/__init__.py", ".env", "_d/x.go", "empty.go", "b.bin", "bad.txt", ".gitignore"}
    assert found["b.bin"]["is_binary"] and not found["app.go"]["is_binary"]
    twice = tree.read_tree(spark, str(folder), str(folder / "app.go"), extensions=(".GO",)).collect()
    assert sorted((r["root_ord"], r["rel_path"]) for r in twice) == [(0, "_d/x.go"), (0, "app.go"), (0, "empty.go"), (0, "tools.go"), (1, "app.go")]
    with pytest.raises(FileNotFoundError):
        tree.read_tree(spark, str(folder / "none"))


def test_search_of_a_tree(spark, folder):
    rows = plans.search(spark, SearchConfig("func", (str(folder),), extensions=(".go", ".md", ".py"))).collect()
    assert sorted((os.path.relpath(r["file_path"], folder), r["line_number"]) for r in rows) == [("_d/x.go", 1), ("app.go", 4), ("pkg/__init__.py", 1), ("tools.go", 3)]
    assert any(r["line_content"].endswith("\r") for r in rows)
    both = plans.fuzzy_search(spark, SearchConfig("pikc", (str(folder),), extensions=(".go",))).collect()
    assert ("", 0, "pick") in {(r["file_path"], r["line_number"], r["match_text"]) for r in both}
    found = symbols.find_symbol(plans.tree_symbols(spark, (str(folder),)), "SERVE").collect()
    assert [(r["name"], r["type"]) for r in found] == [("serve", "function")]
    assert plans.tree_references(spark, "serve", (str(folder),)).count() == 2


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")

    def git(*args, who="Ann", when="2024-01-01T00:00:00+00:00"):
        env = os.environ | {f"GIT_{r}_{k}": v for r in ("AUTHOR", "COMMITTER") for k, v in (("NAME", who), ("EMAIL", who.lower() + "@x.org"), ("DATE", when))}
        subprocess.run(["git", "-C", root, "-c", "init.defaultBranch=main", *args], check=True, capture_output=True, env=env)

    git("init", "-q")
    put(root, **{"a.go": "func a() {}\n", "sub/b.go": "func b() {}\n"})
    git("add", "."), git("commit", "-qm", "first\n\n  fix: func a")
    git("checkout", "-qb", "side")
    put(root, **{"side.go": "func side() {}\n"})
    git("add", "."), git("commit", "-qm", "side work", who="Bob", when="2024-02-01T00:00:00+00:00")
    git("checkout", "-q", "main")
    put(root, **{"sub/b.go": "func b() {}\nfunc b2() {}\n", "é.go": "func e() {}\n"})
    git("add", "."), git("commit", "-qm", "second", when="2024-03-01T00:00:00+00:00")
    git("merge", "-q", "--no-ff", "-m", "join", "side", when="2024-04-01T00:00:00+00:00")
    git("mv", "a.go", "moved.go"), git("commit", "-qm", "move", who="Bob", when="2024-05-01T00:00:00+00:00")
    return root


def test_history(spark, repository):
    commits, changed = gitlog.read_history(spark, str(repository))
    assert commits.count() == 5
    by_message = {}
    for r in commits.join(changed, ["repo", "hash"]).collect():
        by_message.setdefault(r["message"].split("\n")[0], set()).add(r["path"])
    assert by_message == {"first": {"a.go", "sub/b.go"}, "side work": {"side.go"}, "second": {"sub/b.go", "é.go"}, "join": {"side.go"}, "move": {"a.go", "moved.go"}}
    assert sorted(r["path"] for r in gitlog.read_range(spark, str(repository), "HEAD~1").collect()) == ["a.go", "moved.go"]
    run = lambda **k: sorted((r["file_path"], r["line_number"]) for r in plans.search(spark, HistoryConfig("func", (str(repository / "sub"),), **k)).collect())
    assert run(author="BOB") == [("moved.go", 1), ("side.go", 1)]
    assert run(since=datetime(2024, 3, 1)) == [("moved.go", 1), ("side.go", 1), ("sub/b.go", 1), ("sub/b.go", 2), ("é.go", 1)]
    assert run(changed_in="HEAD~1..HEAD", author="nobody") == [("moved.go", 1)]
    message = plans.search(spark, HistoryConfig("func", (str(repository),), commit_message=True)).collect()
    assert [(len(r["file_path"]), r["line_number"], r["line_content"], r["match_text"]) for r in message] == [(8, 0, "fix: func a", "func")]


def test_a_history_is_cut_into_slices(spark, repository):
    whole, changed = gitlog.read_history(spark, str(repository))
    commits, files_ = gitlog.read_history(spark, str(repository), slice_size=2)
    assert commits.rdd.getNumPartitions() == files_.rdd.getNumPartitions() == 3
    assert sorted(map(str, commits.collect())) == sorted(map(str, whole.collect())) and sorted(map(str, files_.collect())) == sorted(map(str, changed.collect()))
    some, theirs = gitlog.read_history(spark, str(repository), since=datetime(2024, 2, 20), author="ann")
    assert sorted(r["message"].strip() for r in some.collect()) == ["join", "second"] and {r["path"] for r in theirs.collect()} == {"sub/b.go", "é.go", "side.go"}
    none, nothing = gitlog.read_history(spark, str(repository), author="nobody")
    assert none.count() == nothing.count() == 0


def test_search_outside_a_repository(spark, folder):
    with pytest.warns(UserWarning):
        assert plans.search(spark, HistoryConfig("func", (str(folder),), author="x")).count() > 0
    with pytest.raises(ValueError):
        plans.search_history(spark, HistoryConfig("func", (str(folder),), author="x"), strict=True)


def code_page(n, total, start=0):
    items = [{"name": f"f{k}.go", "path": f"d/f{k}.go", "repository": {"full_name": "o/r"}, "html_url": "", "text_matches": [{"fragment": f"\n func f{k} "}] if k % 2 else []} for k in range(start, start + n)]
    return json.dumps({"total_count": total, "incomplete_results": False, "items": items})


class RecordedReader(codehost.CodeSearchReader):
    @staticmethod
    def client(address, headers):
        page = int(re.search(r"&page=(\d+)", address)[1])
        total = 31 if "repo%3Ao%2Fr" in address else 0
        return 200, code_page(min(30, max(0, total - 30 * (page - 1))), total, 30 * (page - 1))


class RecordedSource(codehost.CodeSearchSource):
    reader_class = RecordedReader

    @classmethod
    def name(cls):
        return "recorded"


def test_remote_search(spark):
    rows = codehost.search_remote(spark, "func f", ("o/r", "o/none"), source=RecordedSource).collect()
    assert len(rows) == 31 and {r["line_number"] for r in rows} == {0}
    assert {(r["file_path"], r["line_content"], r["match_text"]) for r in rows} >= {("o/r/d/f1.go", "func f1", "f1.go"), ("o/r/d/f30.go", "", "f30.go")}
    asked = []
    pages = list(codehost.result_pages("q", "o/r", True, "t", lambda a, h: asked.append((a, h)) or (200, code_page(30, 1000))))
    assert len(pages) == 5 and asked[0][1]["Authorization"] == "token t" and "case-sensitive" not in asked[0][0]
    for status, kind in ((403, codehost.RateLimited), (401, codehost.NotAuthorised), (404, codehost.NoRepository), (500, RuntimeError)):
        with pytest.raises(kind):
            list(codehost.result_pages("q", "o/r", False, "", lambda a, h, s=status: (s, "")))
    with pytest.raises(ValueError):
        codehost.search_remote(spark, "q", ("o/r",), is_regex=True)


# --- sinks, command line ----------------------------------------------------------------------------


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("x/one.go", 12, 'func "main", x', "func"), ("two.go", 7, " func <a> ", "func")], MATCH)
    assert sinks.write_json(rows, str(tmp_path / "a.json"), "func") == 2
    read = json.loads((tmp_path / "a.json").read_text())
    assert read["total_count"] == 2 and read["query"] == "func" and read["matches"][0]["line_content"] == 'func "main", x'
    assert sinks.write_csv(rows, str(tmp_path / "a.csv")) == 2
    assert (tmp_path / "a.csv").read_text() == 'file_path,line_number,line_content,match_text\nx/one.go,12,"func ""main"", x",func\ntwo.go,7, func <a> ,func\n'
    none = rows.where("false")
    assert sinks.write_json(none, str(tmp_path / "b.json")) == 0 and json.loads((tmp_path / "b.json").read_text())["matches"] == []
    assert sinks.write_csv(none, str(tmp_path / "b.csv")) == 0 and (tmp_path / "b.csv").read_text().count("\n") == 1
    with pytest.raises(OSError):
        sinks.write_csv(rows, str(tmp_path / "no" / "c.csv"))
    sinks.write_folder(rows, str(tmp_path / "many"), "csv")
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "many")).count() == 2
    assert list(sinks.printed(none, "q")) == ["No matches found."]
    shown = list(sinks.printed(rows.coalesce(1), "func", colour=False))
    assert shown[:2] == ["x/one.go", '  12 │ func "main", x'] and shown[-2] == 'Found 2 matches for "func"'
    assert sinks.envelope(none).first()["total_count"] == 0


def lines_of_json(rows, query, is_regex):
    body = ",".join("\n    " + json.dumps(r.asDict(), indent=2, ensure_ascii=False).replace("\n", "\n    ") for r in rows)
    return f'{{\n  "matches": [{body}' + ("\n  " if rows else "") + f'],\n  "total_count": {len(rows)},\n  "query": {json.dumps(query)},\n  "is_regex": {json.dumps(is_regex)}\n}}\n'


def test_tasks_write_one_document(spark, tmp_path):
    made = spark.range(0, 1000, 1, 7).select(F.concat(F.lit("f"), F.col("id") % 3).alias("file_path"), F.col("id").cast("int").alias("line_number"), F.lit('é "x",\ty').alias("line_content"), F.when(F.col("id") % 2 == 0, "x").alias("match_text"))
    rows = made.collect()
    assert sinks.write_json(made.where("line_number < 150 or line_number > 900"), str(tmp_path / "a.json"), "q\n", True) == 249  # some parts are empty
    assert (tmp_path / "a.json").read_text() == lines_of_json([r for r in rows if r["line_number"] < 150 or r["line_number"] > 900], "q\n", True)
    assert sinks.write_csv(made, str(tmp_path / "a.csv")) == 1000
    assert (tmp_path / "a.csv").read_text().count("\n") == 1001
    failing = made.withColumn("line_number", F.when(F.col("line_number") == 900, F.raise_error(F.lit("stop"))).otherwise(F.col("line_number")))
    with pytest.raises(Exception, match="stop"):
        sinks.write_json(failing, str(tmp_path / "b.json"))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["a.csv", "a.json"]


def test_exports_run_the_plan_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([("a", k, "x", "x") for k in range(10)], MATCH).mapInArrow(look, MATCH)
    assert sinks.write_json(rows, str(tmp_path / "a.json")) == 10 and seen.value == 10


def test_command_line(spark, folder, capsys, tmp_path):
    assert cli.main(["search", "func", str(folder), "--extensions", ".go", "--json", str(tmp_path / "o.json")]) == 0
    assert json.loads((tmp_path / "o.json").read_text())["total_count"] == 3
    for args, said in ((["search", "readers", str(folder)], "Found 1 matches"), (["search", "(", str(folder), "--regex"], "error"), (["find-symbol", "nothing", str(folder)], "No symbols found"), (["find-definition", "serve", str(folder)], "[function] serve"), (["find-references", "pick", str(folder)], "[def]"), (["search", "pikc", str(folder), "--suggest"], "1. pick")):
        cli.main(args)
        out = capsys.readouterr()
        assert said in out.out + out.err


def test_roots_are_united_with_repeats(spark):
    one = spark.createDataFrame([("a", "x")], "path string, content string")
    assert sorted(r["root_ord"] for r in files.union_roots(one, one).collect()) == [0, 1]


@pytest.mark.parametrize("name", ["symbol_index", "export_envelope"])
def test_no_group_is_gathered_in_one_row(spark, name):
    from quarry import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_sorted_entries_and_matches(spark):
    rows = spark.createDataFrame([("b", "type", "y", 2, 0, ""), ("a", "type", "z", 1, 0, ""), ("b", "type", "x", 9, 0, "")], "name string, type string, file string, line int, column int, signature string")
    assert [(r["name"], r["file"]) for r in symbols.sorted_symbols(rows).collect()] == [("a", "z"), ("b", "x"), ("b", "y")]
    assert {(r["name"], r["n"], r["first"]["file"]) for r in symbols.symbol_index(rows).collect()} == {("a", 1, "z"), ("b", 2, "x")}
    found = spark.createDataFrame([("f", 2, "l", "m"), ("e", 3, "l", "m")], "file_path string, line_number int, line_content string, match_text string")
    assert [r["file_path"] for r in sinks.sorted_matches(found).collect()] == ["e", "f"]
