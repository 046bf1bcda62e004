"""The registered queries of the search operators, and their SQL for DuckDB."""

from __future__ import annotations

import os
import subprocess
from collections.abc import Callable
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import paths, similarity, text
from quarry.functions.patterns import compile_pattern
from quarry.operators import files, fuzzy, history, lines, symbols
from quarry.operators.name_index import NameIndex
from quarry.plans import search as plans
from quarry.schemas import MATCH, HistoryConfig, SearchConfig
from quarry.sources import codehost, gitlog, sinks, tree
from quarry.sources.shared import mounted, new_folder
from quarry.sources.tables import as_files, chat_files, dealt, document_files, line_commit_files, order_commits, page_files, part_files, spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# --- SQL that several oracles share -------------------------------------------------------------

DOC_PATH = "source || '/doc_' || doc_id || '.' || lang"
TREE_PATH = "source || '/' || (CASE doc_id % 5 WHEN 0 THEN 'vendor/' WHEN 1 THEN '.cache/' ELSE 'lib/' END) || 'doc_' || doc_id || '.' || lang"
CHAT_PATH = "conv_id || '/' || turn || '.' || role"


def sql_lines(source: str, content: str = "content", keep: str = "path") -> str:
    """keep, line_number and line of each line."""
    return f"""(SELECT {keep}, unnest(range(1, len(ls) + 1))::INT AS line_number, unnest(ls) AS line FROM (
      SELECT {keep}, CASE WHEN {content} = '' THEN []::VARCHAR[] WHEN ends_with({content}, chr(10)) THEN string_split({content}, chr(10))[:-2] ELSE string_split({content}, chr(10)) END AS ls FROM {source}))"""


DOCS = f"(SELECT {DOC_PATH} AS path, text AS content FROM documents)"
TREE = f"(SELECT {TREE_PATH} AS path, text AS content FROM documents)"
CHATS = f"(SELECT {CHAT_PATH} AS path, text AS content FROM conversations)"
PAGES = "(SELECT url AS path, html AS content FROM pages)"
DOC_LINES, CHAT_LINES, PAGE_LINES = sql_lines(DOCS), sql_lines(CHATS), sql_lines(PAGES)


def sql_matches(source: str, test: str, match: str) -> str:
    return f"SELECT path AS file_path, line_number, line AS line_content, {match} AS match_text FROM {source} WHERE {test}"


def sql_regex(source: str, pattern: str, where: str = "true") -> str:
    p = pattern.replace("'", "''")
    return sql_matches(source, f"regexp_matches(line, '{p}') AND {where}", f"regexp_extract(line, '{p}', 0)")


def tree_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents below vendor, .cache or lib folders of their source."""
    folder = F.when(F.col("doc_id") % 5 == 0, "vendor/").when(F.col("doc_id") % 5 == 1, ".cache/").otherwise("lib/")
    path = F.concat("source", F.lit("/"), folder, F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    return as_files(table(spark, sf_dir, "documents"), path, F.col("text"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written out as source files in four languages: the names in them come from the table."""
    name = F.regexp_replace("p_name", "[^A-Za-z0-9_]", "_")
    brand = F.regexp_replace("p_brand", "[^A-Za-z0-9_]", "_")
    size = F.col("p_size").cast("string")
    kind = F.col("p_partkey") % 4

    def written(*parts):
        return F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])

    go = written("package p", size, "\n\ntype ", brand, " struct {\n\tSize int\n}\n\nfunc ", name, "(a int) {\n\treturn ", name, "\n}\n\nfunc (b *", brand, ") Get", size, "() (int) {\n}\nvar v", size, " = 1\ntype T", size, " int\ntype I", size, " interface {\n}\nfunc bare", size, "() error {\n")
    py = written("class ", brand, "(Base):\n    pass\n\ndef ", name, "(a, b):\n    return ", name, "\n_hidden = 1\nv", size, " = ", name, "(", size, ")\nv == 1")
    js = written("export class ", brand, " {\n}\nconst ", name, " = (a) => a\nfunction f", size, "(x, y) {\n", name, "(1)\ninterface I", size, " {\ntype T", size, " = string\n")
    java = written("public static int ", name, "(int a) {\n  return go", size, "(a)\n\t}\n// ", brand, "\r\n")
    content = F.when(kind == 0, go).when(kind == 1, py).when(kind == 2, js).otherwise(java)
    end = F.when(kind == 0, ".go").when(kind == 1, ".py").when(kind == 2, ".ts").otherwise(".java")
    path = F.concat(F.lit("src/"), size, F.lit("/"), F.col("p_partkey").cast("string"), end)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return as_files(dealt(parts, "p_partkey"), path, content)


CODE = """(SELECT 'src/' || p_size || '/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.go' WHEN 1 THEN '.py' WHEN 2 THEN '.ts' ELSE '.java' END AS path,
  replace(CASE p_partkey % 4
    WHEN 0 THEN 'package p' || p_size || '~~type ' || brand || ' struct {~' || chr(9) || 'Size int~}~~func ' || name || '(a int) {~' || chr(9) || 'return ' || name || '~}~~func (b *' || brand || ') Get' || p_size || '() (int) {~}~var v' || p_size || ' = 1~type T' || p_size || ' int~type I' || p_size || ' interface {~}~func bare' || p_size || '() error {~'
    WHEN 1 THEN 'class ' || brand || '(Base):~    pass~~def ' || name || '(a, b):~    return ' || name || '~_hidden = 1~v' || p_size || ' = ' || name || '(' || p_size || ')~v == 1'
    WHEN 2 THEN 'export class ' || brand || ' {~}~const ' || name || ' = (a) => a~function f' || p_size || '(x, y) {~' || name || '(1)~interface I' || p_size || ' {~type T' || p_size || ' = string~'
    ELSE 'public static int ' || name || '(int a) {~  return go' || p_size || '(a)~' || chr(9) || '}~// ' || brand || chr(13) || '~' END, '~', chr(10)) AS content
  FROM (SELECT *, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS name, regexp_replace(p_brand, '[^A-Za-z0-9_]', '_', 'g') AS brand FROM part))"""
CODE_LINES = f"(SELECT path, line_number, regexp_replace(line, '\\r$', '') AS line FROM {sql_lines(CODE)})"


# --- search ---------------------------------------------------------------------------------------


@query(sql_matches(DOC_LINES, "contains(line, 'License')", "'License'"))
def search_literal(spark, sf_dir):
    return lines.find_matches(document_files(spark, sf_dir), compile_pattern("License"))


@query(sql_regex(DOC_LINES, "(?i)license"))
def search_literal_icase(spark, sf_dir):
    return lines.find_matches(document_files(spark, sf_dir), compile_pattern("license", ignore_case=True))


@query(sql_regex(DOC_LINES, r"[Ll]icen[sc]ed?\s+\w+"))
def search_regex(spark, sf_dir):
    return lines.find_matches(document_files(spark, sf_dir), compile_pattern(r"[Ll]icen[sc]ed?\s+\w+", is_regex=True))


@query(sql_regex(DOC_LINES, r"(?i)é\w+ (the|LE|les)\b"))
def search_regex_icase(spark, sf_dir):
    return lines.find_matches(document_files(spark, sf_dir), compile_pattern(r"é\w+ (the|LE|les)\b", True, True))


@query(sql_regex(DOC_LINES, r"Licensed\s+under\s+(?:the\s+)?\w+"))
def search_regex_prefix(spark, sf_dir):
    return lines.find_matches(document_files(spark, sf_dir), compile_pattern(r"Licensed\s+under\s+(?:the\s+)?\w+", True))


@query(sql_regex(DOC_LINES, r"^[A-Z]\w+\s.*\.$"))
def search_regex_anchored(spark, sf_dir):
    return lines.find_matches(document_files(spark, sf_dir), compile_pattern(r"^[A-Z]\w+\s.*\.$", True))


@query(sql_matches(CHAT_LINES, "true", "''"))
def search_empty_query(spark, sf_dir):
    return lines.find_matches(chat_files(spark, sf_dir), compile_pattern(""))


@query(sql_regex(DOC_LINES, r"\bre\w*"))
def search_word_boundary_accents(spark, sf_dir):
    return lines.find_matches(document_files(spark, sf_dir), compile_pattern(r"\bre\w*", True))


@query(sql_regex(PAGE_LINES, r'<a href="/[[:alpha:]]+">'))
def search_posix_class(spark, sf_dir):
    return lines.find_matches(page_files(spark, sf_dir), compile_pattern(r'<a href="/[[:alpha:]]+">', True))


@query(sql_matches(DOC_LINES, "contains(line, 'the') AND (ends_with(lower(path), '.fr') OR ends_with(lower(path), '.de'))", "'the'"))
def search_ext(spark, sf_dir):
    kept = files.select_files(document_files(spark, sf_dir), extensions=(".FR", ".de"))
    return lines.find_matches(kept, compile_pattern("the"))


@query(sql_matches(DOC_LINES, r"contains(line, 'License') AND regexp_matches(path, '\Asrc1[0-9]*/.*\z')", "'License'"))
def search_include_glob(spark, sf_dir):
    kept = files.select_files(document_files(spark, sf_dir), include=("src1/*", "src1?/*"))
    return lines.find_matches(kept, compile_pattern("License"))


@query(sql_matches(DOC_LINES, r"contains(line, 'License') AND NOT regexp_matches(path, '\A(.*/doc_[13].*|src[4-6]/.*)\z')", "'License'"))
def search_exclude_glob(spark, sf_dir):
    kept = files.select_files(document_files(spark, sf_dir), include=("**",), exclude=("**/doc_[13]*", "src[4-6]/**", "[bad"))
    return lines.find_matches(kept, compile_pattern("License"))


@query(sql_matches(sql_lines(TREE), "contains(line, 'License') AND NOT contains(path, '/vendor/') AND NOT contains(path, '/.cache/')", "'License'"))
def search_skipdir(spark, sf_dir):
    return lines.find_matches(files.select_files(tree_documents(spark, sf_dir)), compile_pattern("License"))


#: An ignore file: a suffix, an exception to it, a folder, an anchored name.
IGNORE = "*.de\n!doc_2*.de\n# comment\nsrc1*/\n/doc_1.en\nvendor/"


@query(sql_matches(sql_lines(TREE), r"contains(line, 'en') AND NOT (ends_with(path, '.de') AND NOT regexp_matches(path, '/doc_2[^/]*\.de$')) AND NOT starts_with(path, 'src1') AND NOT contains(path, '/vendor/') AND NOT ends_with(path, '/doc_1.en')", "'en'"))
def search_ignore_file(spark, sf_dir):
    kept = files.select_files(tree_documents(spark, sf_dir), rules=paths.ignore_rules(IGNORE), skip_directories=False)
    return lines.find_matches(kept, compile_pattern("en"))


@query(f"SELECT path AS file_path, length(content)::INT AS n FROM (SELECT {DOC_PATH} AS path, doc_id, text AS content FROM documents) WHERE NOT (doc_id % 3 = 0 AND (doc_id % 2 = 0 OR strlen(content) < 512))")
def search_binary_skip(spark, sf_dir):
    """A NUL before the text of every third document if its id is even, else behind it; only the first 512 bytes count."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    nul = F.when(F.col("doc_id") % 3 == 0, F.lit("\0")).otherwise("")
    content = F.when(F.col("doc_id") % 2 == 0, F.concat(nul, "text")).otherwise(F.concat("text", nul))
    kept = files.select_files(as_files(docs, path, content))
    return kept.select(F.col("path").alias("file_path"), F.length(F.replace("content", F.lit("\0"), F.lit(""))).alias("n"))


@query(f"""WITH d AS (SELECT path, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT path, string_split(content, chr(10)) AS ls FROM {DOCS}))
SELECT path AS file_path, i::INT AS line_number, 'License' AS match_text,
  array_to_string(list_transform(range(greatest(i - 2, 1), least(i + 2, len(ls)) + 1), lambda j: (CASE WHEN j = i THEN '> ' ELSE '  ' END) || ls[j]), chr(10)) AS line_content
FROM d WHERE contains(ls[i], 'License')""")
def search_context(spark, sf_dir):
    return lines.find_matches(document_files(spark, sf_dir), compile_pattern("License"), context=2)


@query(f"SELECT * FROM ({sql_matches(DOC_LINES, "contains(line, 'License')", "'License'")}) UNION ALL SELECT * FROM ({sql_matches(CHAT_LINES, "contains(line, 'License')", "'License'")}) UNION ALL SELECT * FROM ({sql_matches(CHAT_LINES, "contains(line, 'License')", "'License'")})")
def search_multi_root(spark, sf_dir):
    chats = chat_files(spark, sf_dir)
    return lines.find_matches(files.union_roots(document_files(spark, sf_dir), chats, chats), compile_pattern("License"))


@query(f"SELECT count(*) AS total_count FROM {DOC_LINES} WHERE contains(line, 'ing')")
def search_count(spark, sf_dir):
    return lines.find_matches(document_files(spark, sf_dir), compile_pattern("ing")).agg(F.count(F.lit(1)).alias("total_count"))


@query(f"SELECT path AS file_path, count(*) AS n FROM {DOC_LINES} WHERE contains(line, 'ing') GROUP BY path")
def search_count_by_file(spark, sf_dir):
    return lines.find_matches(document_files(spark, sf_dir), compile_pattern("ing")).groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT path AS file_path, line_number, row_number() OVER (PARTITION BY path ORDER BY line_number) = 1 AS new_file FROM {DOC_LINES} WHERE contains(line, 'ing')")
def result_headers(spark, sf_dir):
    return sinks.with_headers(lines.find_matches(document_files(spark, sf_dir), compile_pattern("ing"))).select("file_path", "line_number", "new_file")


@query(f"SELECT path AS file_path, line_number, replace(line, 'License', '[License]') AS shown FROM {DOC_LINES} WHERE contains(line, 'License')")
def result_highlight(spark, sf_dir):
    found = lines.find_matches(document_files(spark, sf_dir), compile_pattern("License"))
    return found.select("file_path", "line_number", text.highlighted(F.col("line_content"), F.col("match_text"), "[", "]").alias("shown"))


@query(f"SELECT path AS file_path, line_number, CASE WHEN length(line) > 60 THEN substring(line, 1, 57) || '...' ELSE line END AS shown FROM {CHAT_LINES}")
def result_truncate(spark, sf_dir):
    found = lines.find_matches(chat_files(spark, sf_dir), compile_pattern(""))
    return found.select("file_path", "line_number", text.truncated(F.col("line_content")).alias("shown"))


@query(f"SELECT * FROM ({sql_matches(DOC_LINES, "contains(line, 'License')", "'License'")}) ORDER BY file_path, line_number LIMIT 20 OFFSET 5")
def result_page(spark, sf_dir):
    """A page of results: rows 6 to 25."""
    return sinks.page(lines.find_matches(document_files(spark, sf_dir), compile_pattern("License")), ["file_path", "line_number"], 5, 20)


@query(f"SELECT count(*)::INT AS total_count, 'License' AS query, false AS is_regex, count(*) AS n_matches FROM {DOC_LINES} WHERE contains(line, 'License')")
def export_envelope(spark, sf_dir):
    found = sinks.envelope(lines.find_matches(document_files(spark, sf_dir), compile_pattern("License")), "License")
    return found.select("total_count", "query", "is_regex", F.col("total_count").cast("long").alias("n_matches"))


@query(f"SELECT path, sha256(content) AS sha256 FROM {DOCS}")
def file_checksums(spark, sf_dir):
    return document_files(spark, sf_dir).select("path", F.sha2("content", 256).alias("sha256"))


@query("SELECT l_orderkey, l_linenumber, list_transform(string_split(new, '.'), lambda p: p::INT) > list_transform(string_split(old, '.'), lambda p: p::INT) AS newer FROM (SELECT l_orderkey, l_linenumber, l_partkey || '.' || l_linenumber AS new, l_suppkey || '.' || l_linenumber || '.0' AS old FROM lineitem)")
def version_compare(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    new = F.concat(F.lit("v"), F.col("l_partkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"))
    old = F.concat(F.col("l_suppkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string"), F.lit(".0"))
    return items.select("l_orderkey", "l_linenumber", text.is_newer(new, old).alias("newer"))


@query(sql_regex(DOC_LINES, r"\\\\|License|^Das"))
def search_regex_alternation_escape(spark, sf_dir):
    """A bar behind an escaped backslash parts alternatives, so no text begins every match."""
    return lines.find_matches(document_files(spark, sf_dir), compile_pattern(r"\\\\|License|^Das", True))


LONG_LINES = f"(SELECT path, line_number, line FROM {DOC_LINES} UNION ALL SELECT {DOC_PATH} || '.long', 1, replace(text, chr(10), ' ') FROM documents WHERE text <> '')"


@query(sql_regex(LONG_LINES, r"(?i)\b(?:the |of |la |Les? ){2,}"))
def search_regex_repeated_groups(spark, sf_dir):
    """One pattern with a repeated group over lines and, in another file, all of a document as one long line."""
    docs = document_files(spark, sf_dir)
    long = docs.withColumn("path", F.concat("path", F.lit(".long"))).withColumn("content", F.replace("content", F.lit("\n"), F.lit(" ")))
    return lines.find_matches(docs.unionByName(long), compile_pattern(r"(?i)\b(?:the |of |la |Les? ){2,}", True))


CR_LINES = sql_lines(f"(SELECT {DOC_PATH} AS path, replace(text, chr(10), chr(13) || chr(10)) AS content FROM documents)")


@query(sql_regex(CR_LINES, r"[[.]e?.$"))
def search_carriage_returns(spark, sf_dir):
    """A dot matches a carriage return, and the end of a line lies behind it; a bracket stands for itself inside a class."""
    docs = document_files(spark, sf_dir).withColumn("content", F.replace("content", F.lit("\n"), F.lit("\r\n")))
    return lines.find_matches(docs, compile_pattern(r"[[.]e?.$", True))


#: Patterns that regex engines read differently.
DIALECT = {
    "negated_posix": r"[[:^alpha:]]{6}", "posix_in_class": r"[[:digit:]x-z]{3}", "quoted": r"\Q|\E \w", "hex": r"\x{41}\x6e", "octal": r"\101n", "named": r"(?P<first>[A-Z]\w+) de\b",
    "one_letter_class": r"\pL{18}", "script": r"\p{Latin}{18}", "negated_class": r"[^\S]é", "no_edge": r"\Bß", "scoped_flag": r"(?i:LICENSE)d", "late_flag": r"ense(?i)D U", "braces": r"x{,3}|d{2,}", "end": r"\.$", "bracket_first": r"[]|]", "vertical_tab": r"\v|\|", "dot_all": r"(?s)L.cense", "lazy": r"L\w+?d", "ampersands": r"[a&&e]{3}", "ungreedy": r"(?U)L\w+d",
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS pattern, count(*) AS n, min(path) AS first_file, min(regexp_extract(line, '{p}', 0)) AS least_match FROM {DOC_LINES} WHERE regexp_matches(line, '{p}')" for name, p in DIALECT.items()))
def regex_dialect(spark, sf_dir):
    """How many lines each pattern matches, the first file and the smallest match."""
    rows = lines.to_lines(document_files(spark, sf_dir).select("path", "content"))
    tests = [F.struct(F.lit(name).alias("pattern"), compile_pattern(p, True).match(F.col("line")).alias("match")) for name, p in DIALECT.items()]
    met = rows.select("path", F.inline(F.array(*tests))).groupBy("pattern")
    return met.agg(F.count("match").alias("n"), F.min(F.when(F.col("match").isNotNull(), F.col("path"))).alias("first_file"), F.min("match").alias("least_match"))


@query(f"SELECT path AS file_path, line_number, line AS line_content, 'License' AS match_text FROM {DOC_LINES} WHERE contains(line, 'License') AND NOT ends_with(path, '.de') AND regexp_matches(path, '(^|/)src[0-9]')")
def tree_search(spark, sf_dir):
    """Documents written out as a directory tree and searched there: listing, globs, ignore file and reading included."""
    root = mounted(new_folder(spark, "tree"))
    tree.write_tree(document_files(spark, sf_dir), root)
    tree.write_tree(spark.range(1).select(F.lit(".gitignore").alias("path"), F.lit("*.de\n").alias("content")), root)
    found = tree.read_tree(spark, root, include=("**/src[0-9]*/**",), exclude=("**/.gitignore",))
    matches = lines.find_matches(files.select_files(found.withColumn("path", F.col("rel_path"))), compile_pattern("License"))
    return matches.select("file_path", "line_number", "line_content", "match_text")


@query(sql_matches(DOC_LINES, "contains(path, 'doc_1') AND NOT ends_with(path, '.fr') AND contains(line, 'the')", "'the'"))
def tree_pushed(spark, sf_dir):
    """Plain conditions on a tree's paths and contents, which its reader decides: other files aren't opened, or not decoded."""
    root = mounted(new_folder(spark, "tree"))
    tree.write_tree(document_files(spark, sf_dir), root)
    found = tree.read_tree(spark, root)
    kept = found.where(F.contains("rel_path", F.lit("doc_1")) & ~F.col("rel_path").endswith(".fr") & ~F.col("is_binary"))
    return lines.find_matches(kept.withColumn("path", F.col("rel_path")), compile_pattern("the"))


@query(sql_matches(DOC_LINES, "contains(line, 'the')", "'the'"))
def tree_split_files(spark, sf_dir):
    """A tree whose files of more than 4 KB are read in pieces, by several tasks, with the lines before each piece counted apart."""
    root = mounted(new_folder(spark, "tree"))
    tree.write_tree(document_files(spark, sf_dir), root)
    found = plans.search(spark, SearchConfig("the", (root,), split=True, piece_bytes=4096))
    return found.withColumn("file_path", F.substr("file_path", F.lit(len(root) + 2)))


@query(sql_matches(DOC_LINES, "contains(line, 'License')", "'License'"))
def tree_named_files(spark, sf_dir):
    """The same tree, of which only files that a table names are opened."""
    root = mounted(new_folder(spark, "tree"))
    docs = document_files(spark, sf_dir)
    tree.write_tree(docs, root)
    named = docs.where(F.contains("content", F.lit("License"))).select("path")
    found = tree.read_named(named, root)
    return lines.find_matches(found.withColumn("path", F.col("rel_path")), compile_pattern("License"))


@query(sql_matches(DOC_LINES, "contains(line, 'License')", "'License'"))
def export_csv_folder(spark, sf_dir):
    """Matches written as CSV files and read back."""
    at = new_folder(spark, "csv")
    sinks.write_folder(lines.find_matches(document_files(spark, sf_dir), compile_pattern("License")), at, "csv")
    return spark.read.schema(MATCH).option("header", True).option("escape", '"').option("multiLine", True).csv(at)


@query(sql_matches(CHAT_LINES, "contains(line, 'the')", "'the'"))
def export_json_document(spark, sf_dir):
    """Matches written as one JSON document by the tasks that have them, and read back."""
    folder = mounted(new_folder(spark, "json"))
    os.makedirs(folder)
    sinks.write_json(lines.find_matches(chat_files(spark, sf_dir), compile_pattern("the")), f"{folder}/matches.json", "the")
    read = spark.read.schema(f"matches array<struct<{MATCH}>>").option("multiLine", True).json(f"{folder}/matches.json")
    return read.select(F.inline("matches"))


@query(sql_matches(DOC_LINES, "contains(line, 'License')", "'License'"))
def export_csv_document(spark, sf_dir):
    """The same as one CSV file."""
    folder = mounted(new_folder(spark, "csv"))
    os.makedirs(folder)
    sinks.write_csv(lines.find_matches(document_files(spark, sf_dir), compile_pattern("License")), f"{folder}/matches.csv")
    return spark.read.schema(MATCH).option("header", True).option("escape", '"').option("multiLine", True).csv(f"{folder}/matches.csv")


@query(sql_matches(CHAT_LINES, "contains(line, 'the')", "'the'"))
def export_json_folder(spark, sf_dir):
    """Matches written as JSON lines and read back."""
    at = new_folder(spark, "json")
    sinks.write_folder(lines.find_matches(chat_files(spark, sf_dir), compile_pattern("the")), at)
    return spark.read.schema(MATCH).json(at).select("file_path", "line_number", "line_content", "match_text")


# --- identifiers, similarity, suggestions -----------------------------------------------------------

#: Fixed values, written out for SQL.
KEYWORD_LIST = (
    "'if', 'else', 'for', 'return', 'func', 'var', 'const', 'type', 'package', 'import', 'nil', 'true', 'false', 'int', 'string', 'bool', "
    "'float64', 'error', 'interface', 'struct', 'map', 'chan', 'go', 'defer', 'switch', 'case', 'default', 'break', 'continue', 'select', 'range'"
)
IDENTIFIERS = f"(SELECT DISTINCT text FROM (SELECT unnest(regexp_extract_all(line, '[a-zA-Z_][a-zA-Z0-9_]*')) AS text FROM {DOC_LINES}) WHERE length(text) > 2 AND lower(text) NOT IN ({KEYWORD_LIST}))"


def sql_scores(q: str) -> str:
    """jaro, jw, lev and score of text against the query, as columns over a table x with text."""
    prefix = "(" + " + ".join(f"(CASE WHEN length(text) >= {n} AND starts_with(text, '{q[:n]}') THEN 1 ELSE 0 END)" for n in range(1, 5)) + ")"
    low = "(" + " + ".join(f"(CASE WHEN length(text) >= {n} AND starts_with(lower(text), '{q.lower()[:n]}') THEN 1 ELSE 0 END)" for n in range(1, 5)) + ")"
    j = f"(CASE WHEN text = '{q}' THEN 1.0::DOUBLE ELSE jaro_similarity('{q.lower()}', lower(text)) END)"
    jl = f"(CASE WHEN lower(text) = '{q.lower()}' THEN 1.0::DOUBLE ELSE jaro_similarity('{q.lower()}', lower(text)) END)"
    jw = f"({jl} + {low} * 0.1::DOUBLE * (1 - {jl}))"
    lev = f"levenshtein('{q.lower()}', lower(text))"
    score = f"(CASE WHEN lower(text) = '{q.lower()}' THEN 1.0::DOUBLE WHEN contains(lower(text), '{q.lower()}') THEN 0.9::DOUBLE ELSE 0.6::DOUBLE * {jw} + 0.4::DOUBLE * (1 - {lev}::DOUBLE / greatest({len(q)}, strlen(text))) END)"
    return f"{lev}::INT AS lev, {j} AS jaro, ({j} + {prefix} * 0.1::DOUBLE * (1 - {j})) AS jw, {score} AS score"


def document_identifiers(spark, sf_dir):
    return fuzzy.identifiers(spread(document_files(spark, sf_dir).select("content")))


@query(f"SELECT text FROM {IDENTIFIERS}")
def identifiers_distinct(spark, sf_dir):
    return document_identifiers(spark, sf_dir)


@query(f"SELECT lower(word) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(line, '[a-zA-Z_][a-zA-Z0-9_]*')) AS word FROM {DOC_LINES}) WHERE lower(word) IN ({KEYWORD_LIST}) GROUP BY 1")
def keyword_filter(spark, sf_dir):
    words = lines.to_lines(document_files(spark, sf_dir).select("path", "content")).select(F.explode(F.regexp_extract_all("line", F.lit(fuzzy.IDENTIFIER), F.lit(0))).alias("word"))
    return words.where(fuzzy.is_keyword(F.col("word"))).groupBy(F.lower("word").alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT text, lev FROM (SELECT text, {sql_scores('Lisence')} FROM {IDENTIFIERS})")
def levenshtein_scores(spark, sf_dir):
    return document_identifiers(spark, sf_dir).select("text", similarity.edit_distance(F.lit("Lisence"), F.col("text")).alias("lev"))


@query("SELECT c_custkey, n_nationkey, levenshtein(lower(c_name) || '-é', lower(n_name))::INT AS lev FROM customer JOIN nation ON c_nationkey = n_nationkey")
def levenshtein_bytes(spark, sf_dir):
    """Every customer's name against its nation's; characters of several bytes count as several."""
    met = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return met.select("c_custkey", "n_nationkey", similarity.edit_distance(F.concat("c_name", F.lit("-é")), F.col("n_name")).alias("lev"))


@query("SELECT p_partkey, levenshtein(lower(p_name) || '-é', lower(p_type))::INT AS lev FROM part")
def levenshtein_bytes_parts(spark, sf_dir):
    """Every part's name, with a character of two bytes, against its type."""
    return table(spark, sf_dir, "part").select("p_partkey", similarity.edit_distance(F.concat("p_name", F.lit("-é")), F.col("p_type")).alias("lev"))


@query(f"SELECT text, round(jaro, 6) AS jaro FROM (SELECT text, {sql_scores('Lisence')} FROM {IDENTIFIERS})")
def jaro_scores(spark, sf_dir):
    return document_identifiers(spark, sf_dir).select("text", F.round(similarity.jaro(F.lit("Lisence"), F.col("text")), 6).alias("jaro"))


@query(f"SELECT text, round(jw, 6) AS jw FROM (SELECT text, {sql_scores('Lisence')} FROM {IDENTIFIERS})")
def jaro_winkler_scores(spark, sf_dir):
    return document_identifiers(spark, sf_dir).select("text", F.round(similarity.jaro_winkler(F.lit("Lisence"), F.col("text")), 6).alias("jw"))


@query(f"SELECT text, round(score, 6) AS score FROM (SELECT text, {sql_scores('Lisence')} FROM {IDENTIFIERS})")
def fuzzy_score(spark, sf_dir):
    return document_identifiers(spark, sf_dir).select("text", F.round(similarity.fuzzy_score(F.lit("Lisence"), F.col("text")), 6).alias("score"))


@query(f"SELECT text, round(score, 6) AS score FROM (SELECT text, {sql_scores('Lisence')} FROM {IDENTIFIERS}) WHERE score >= 0.6")
def fuzzy_find_all(spark, sf_dir):
    return fuzzy.fuzzy_find_all("Lisence", document_identifiers(spark, sf_dir), 0.6).select("text", F.round("score", 6).alias("score"))


ROOT_LINES = f"(SELECT 0 AS root_ord, line FROM {DOC_LINES} UNION ALL SELECT 1 AS root_ord, line FROM {CODE_LINES})"
SUGGESTED = f"""(WITH l AS (SELECT * FROM {ROOT_LINES}),
i AS (SELECT DISTINCT root_ord, text FROM (SELECT root_ord, unnest(regexp_extract_all(line, '[a-zA-Z_][a-zA-Z0-9_]*')) AS text FROM l) WHERE length(text) > 2 AND lower(text) NOT IN ({KEYWORD_LIST})),
f AS (SELECT root_ord, regexp_extract(line, 'func\\s+(\\w+)\\s*(\\([^)]*\\))', 1) AS text, regexp_extract(line, 'func\\s+(\\w+)\\s*(\\([^)]*\\))', 2) AS details FROM l WHERE regexp_matches(line, 'func\\s+(\\w+)\\s*(\\([^)]*\\))')
      UNION ALL SELECT root_ord, regexp_extract(line, 'func\\s+\\([^)]+\\)\\s+(\\w+)\\s*(\\([^)]*\\))', 1), regexp_extract(line, 'func\\s+\\([^)]+\\)\\s+(\\w+)\\s*(\\([^)]*\\))', 2) FROM l WHERE regexp_matches(line, 'func\\s+\\([^)]+\\)\\s+(\\w+)\\s*(\\([^)]*\\))')),
s AS (SELECT root_ord, text, 0 AS kind, '' AS details, score FROM (SELECT *, {sql_scores('goldnrod')} FROM i) WHERE score >= 0.5
      UNION ALL SELECT root_ord, text, 1, details, score * 0.9::DOUBLE FROM (SELECT *, {sql_scores('goldnrod')} FROM f) WHERE score >= 0.4),
r AS (SELECT *, row_number() OVER (PARTITION BY root_ord ORDER BY round(score, 12) DESC, kind, text, details) AS rank FROM s QUALIFY rank <= 10)
SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY text ORDER BY root_ord, rank) = 1)"""


def suggestions(spark, sf_dir):
    both = files.union_roots(*[spread(f.select("content")) for f in (document_files(spark, sf_dir), code_files(spark, sf_dir))])
    return fuzzy.suggest("goldnrod", both)


@query(f"SELECT text, round(score, 6) AS score, CASE kind WHEN 0 THEN 'identifier' ELSE 'function' END AS context, details FROM {SUGGESTED}")
def suggest_topk_dedupe(spark, sf_dir):
    return suggestions(spark, sf_dir).select("text", F.round("score", 6).alias("score"), "context", "details")


@query(f"SELECT path AS file_path, line_number, 'goldenrod' AS match_text FROM {CODE_LINES} WHERE contains(line, 'goldenrod') UNION ALL SELECT '' AS file_path, 0 AS line_number, text AS match_text FROM {SUGGESTED}")
def fuzzy_search_union(spark, sf_dir):
    exact = lines.find_matches(code_files(spark, sf_dir), compile_pattern("goldenrod"), strip_cr=True)
    return exact.unionByName(fuzzy.fuzzy_rows(suggestions(spark, sf_dir))).select("file_path", "line_number", "match_text")


# --- history ----------------------------------------------------------------------------------------

COMMITS = "(SELECT o_orderkey::VARCHAR AS hash, c_name AS author_name, lower(c_mktsegment) || '@example.com' AS author_email, o_orderdate AS author_when, o_orderpriority AS message FROM orders JOIN customer ON o_custkey = c_custkey)"
SINCE = datetime(1996, 6, 1)
RECENT = f"(SELECT * FROM {COMMITS} WHERE author_when >= TIMESTAMP '1996-06-01' AND (contains(lower(author_name), '7') OR contains(lower(author_email), '7')))"
CHANGED = f"(SELECT DISTINCT l_partkey::VARCHAR AS path FROM lineitem WHERE l_orderkey::VARCHAR IN (SELECT hash FROM {RECENT}))"


def recent_commits(spark, sf_dir):
    return history.filter_commits(order_commits(spark, sf_dir), SINCE, "7")


@query(f"SELECT hash, author_name FROM {COMMITS} WHERE author_when >= TIMESTAMP '1996-06-01'")
def git_since(spark, sf_dir):
    return history.filter_commits(order_commits(spark, sf_dir), SINCE).select("hash", "author_name")


@query(f"SELECT hash, author_name FROM {COMMITS} WHERE contains(lower(author_name), 'building') OR contains(author_email, 'building')")
def git_author(spark, sf_dir):
    return history.filter_commits(order_commits(spark, sf_dir), author="BUILDING").select("hash", "author_name")


@query(f"SELECT path FROM {CHANGED}")
def git_changed_files(spark, sf_dir):
    return history.changed_files(recent_commits(spark, sf_dir), line_commit_files(spark, sf_dir))


@query(f"SELECT path AS file_path, 1 AS line_number, p_name AS line_content, 'green' AS match_text FROM {CHANGED} JOIN part ON path = p_partkey::VARCHAR WHERE contains(p_name, 'green')")
def git_changed_search(spark, sf_dir):
    changed = history.changed_files(recent_commits(spark, sf_dir), line_commit_files(spark, sf_dir))
    return lines.find_matches(history.restrict(part_files(spark, sf_dir), changed), compile_pattern("green"), strip_cr=True)


@query(f"SELECT path AS file_path, 1 AS line_number, p_name AS line_content, 'widget' AS match_text FROM {CHANGED} JOIN part ON path = p_partkey::VARCHAR WHERE contains(p_name, 'widget')")
def git_changed_search_widgets(spark, sf_dir):
    """Parts with widgets in their names among those that recent orders touched."""
    changed = history.changed_files(recent_commits(spark, sf_dir), line_commit_files(spark, sf_dir))
    return lines.find_matches(history.restrict(part_files(spark, sf_dir), changed), compile_pattern("widget"), strip_cr=True)


@query(f"SELECT hash FROM {COMMITS} WHERE author_when >= TIMESTAMP '1997-03-03 12:00:00'")
def git_since_relative(spark, sf_dir):
    """Commits since a month before 31 March 1997, noon: February's missing days run over into March."""
    since = text.time_ago("1 month ago", datetime(1997, 3, 31, 12))
    return history.filter_commits(order_commits(spark, sf_dir), since).select("hash")


@query(f"SELECT substring(hash, 1, 8) AS file_path, 0 AS line_number, trim(message) AS line_content, regexp_extract(message, '[0-9]-[A-Z]+', 0) AS match_text FROM {RECENT} WHERE regexp_matches(message, '[0-9]-[A-Z]+')")
def git_commit_message(spark, sf_dir):
    return lines.find_in_messages(recent_commits(spark, sf_dir), compile_pattern("[0-9]-[A-Z]+", True))


@query("""SELECT coalesce(a.path, b.path) AS path FROM
 (SELECT l_partkey::VARCHAR AS path, sum(l_quantity) AS blob FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' GROUP BY 1) a
 FULL JOIN (SELECT l_partkey::VARCHAR AS path, sum(l_quantity) AS blob FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-03-01' GROUP BY 1) b ON a.path = b.path WHERE a.blob IS DISTINCT FROM b.blob""")
def git_range(spark, sf_dir):
    """What differs between two states of a tree: parts by the quantity shipped before two dates."""
    items = table(spark, sf_dir, "lineitem")
    state = lambda end: items.where(F.col("l_shipdate") < F.lit(end)).groupBy(F.col("l_partkey").cast("string").alias("path")).agg(F.sum("l_quantity").alias("blob"))
    return history.snapshot_changes(state(datetime(1995, 1, 1)), state(datetime(1995, 3, 1)))


SALES = "(SELECT (c_custkey // 500)::VARCHAR AS repo, c_custkey, c_name, lower(c_mktsegment) AS segment, lower(c_mktsegment) || '/' || c_custkey || '.txt' AS path FROM customer)"


def write_repositories(commits: DataFrame, root: str, checkout: bool) -> list[str]:
    """Make a git repository below root, a mounted folder, of each value of repo, where its rows are; with its files, or their history alone.

    commits: repo, seq (order), author_name, author_email, author_when, message, path, content: each row is a
    commit of one file. A repository's history must fit in a task. Returns the folders."""

    def made(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq").to_pylist()
        folder = os.path.join(root, rows[0]["repo"])
        os.makedirs(folder)
        stream = []
        for r in rows:
            who = f"{r['author_name']} <{r['author_email']}> {r['at']} +0000"
            message, content = r["message"].encode(), r["content"].encode()
            stream += [f"commit refs/heads/main\nauthor {who}\ncommitter {who}\ndata {len(message)}\n".encode(), message, f"\nM 100644 inline {r['path']}\ndata {len(content)}\n".encode(), content, b"\n"]
        steps = [(("init", "-q", "-b", "main", "--template="), b""), (("fast-import", "--quiet"), b"".join(stream))]
        for args, given in steps + [(("reset", "-q", "--hard"), b"")] * checkout:
            subprocess.run(["git", "-C", folder, "-c", "core.fsync=none", *args], input=given, check=True, capture_output=True)
        return pa.table({"folder": [folder]})

    timed = commits.withColumn("at", F.unix_timestamp("author_when"))
    dealt = timed.repartition(4 * timed.sparkSession.sparkContext.defaultParallelism, "repo")  # what a repository costs isn't told by the bytes of its rows
    return sorted(r["folder"] for r in dealt.groupBy("repo").applyInArrow(made, "folder string").collect())


def customer_repositories(spark, sf_dir, checkout: bool = False) -> list[str]:
    """Git repositories of 500 customers each, one commit and one file for each customer."""
    c = table(spark, sf_dir, "customer").withColumn("segment", F.lower("c_mktsegment"))
    key = F.col("c_custkey").cast("string")
    made = c.select(
        F.floor(F.col("c_custkey") / 500).cast("string").alias("repo"), F.col("c_custkey").alias("seq"), F.col("c_name").alias("author_name"), F.concat("segment", F.lit("@example.com")).alias("author_email"),
        F.timestamp_seconds(F.col("c_custkey") * 3600 + 800_000_000).alias("author_when"), F.concat(F.lit("add "), "segment", F.lit("\n\nfor "), "c_name").alias("message"),
        F.concat("segment", F.lit("/"), key, F.lit(".txt")).alias("path"), F.concat(F.lit("name\n"), "c_name", F.lit("\r\n")).alias("content"),
    )
    return write_repositories(made, mounted(new_folder(spark, "git")), checkout)


@query(f"SELECT repo, c_name AS author_name, segment || '@example.com' AS author_email, c_custkey * 3600 + 800000000 AS seconds, 'add ' || segment AS subject, path FROM {SALES}")
def git_source_log(spark, sf_dir):
    """Commits and the files they changed, read from git repositories made of the customers."""
    commits, changed = gitlog.read_history(spark, *customer_repositories(spark, sf_dir))
    both = commits.join(changed, ["repo", "hash"])
    return both.select(F.element_at(F.split("repo", "/"), -1).alias("repo"), "author_name", "author_email", F.unix_timestamp("author_when").alias("seconds"), F.element_at(F.split("message", "\n"), 1).alias("subject"), "path")


@query(f"SELECT repo, c_name AS author_name, path FROM {SALES} WHERE segment = 'building' AND c_custkey * 3600 + 800000000 >= 800090000")
def git_source_slices(spark, sf_dir):
    """The same histories, each read by several tasks, for one author and since a time, both known to the source."""
    since = datetime(1995, 5, 10, 9)
    commits, changed = gitlog.read_history(spark, *customer_repositories(spark, sf_dir), since=since, author="building@", slice_size=50)
    chosen = history.filter_commits(commits, F.timestamp_seconds(F.lit(800_090_000)), "building@")
    return chosen.join(changed, ["repo", "hash"]).select(F.element_at(F.split("repo", "/"), -1).alias("repo"), "author_name", "path")


@query(f"SELECT repo, path FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY c_custkey DESC) AS n FROM {SALES}) WHERE n <= 10 AND repo = '0'")
def git_source_range(spark, sf_dir):
    """What the last ten commits of a repository changed, by the git program's own comparison of two commits."""
    repo = customer_repositories(spark, sf_dir)[0]
    return gitlog.read_range(spark, repo, "HEAD~10").select(F.element_at(F.split("repo", "/"), -1).alias("repo"), "path")


@query(f"SELECT path AS file_path, 2 AS line_number, c_name AS line_content, 'Customer#0' AS match_text FROM {SALES} WHERE segment = 'building'")
def git_source_search(spark, sf_dir):
    """A search of the files that one author's commits changed, in the repositories' working trees."""
    return plans.search(spark, HistoryConfig("Customer#0", tuple(customer_repositories(spark, sf_dir, checkout=True)), author="BUILDING@"))


@query(f"SELECT 0 AS line_number, 'for ' || c_name AS line_content, 'for C' AS match_text FROM {SALES} WHERE segment = 'machinery'")
def git_source_messages(spark, sf_dir):
    """A search of commit messages by date and author."""
    found = plans.search(spark, HistoryConfig("for C", tuple(customer_repositories(spark, sf_dir)), author="machinery", since=datetime(1995, 1, 1), commit_message=True))
    return found.select("line_number", "line_content", "match_text")


# --- symbols ----------------------------------------------------------------------------------------


#: Fixed values in RE2 syntax, for SQL only: type ('' for group 1), pattern, group of the name, signature, further condition.
SQL_RULES = {
    "go": [
        ("function", r"^func\s+(\w+)\s*(\([^)]*\))?\s*(\([^)]*\))?\s*\{", 1, "trim({2})", ""),
        ("method", r"^func\s+\([^)]+\)\s+(\w+)\s*(\([^)]*\))?\s*(\([^)]*\))?\s*\{", 1, "trim({2})", ""),
        ("struct", r"^type\s+(\w+)\s+struct\s*\{", 1, "''", ""),
        ("interface", r"^type\s+(\w+)\s+interface\s*\{", 1, "''", ""),
        ("type", r"^type\s+(\w+)\s+\w+", 1, "''", r" AND NOT regexp_matches(line, '^type\s+(\w+)\s+(struct|interface)\s*\{')"),
        ("", r"^(var|const)\s+(\w+)\s*", 2, "''", ""),
        ("field", r"^\s+(\w+)\s+\w+", 1, "''", ""),
    ],
    "python": [
        ("function", r"^def\s+(\w+)\s*\(([^)]*)\)", 1, "'(' || {2} || ')'", ""),
        ("class", r"^class\s+(\w+)\s*\(?\s*\w*\s*\)?", 1, "''", ""),
        ("variable", r"^(\w+)\s*=\s*", 1, "''", " AND NOT starts_with(line, '_')"),
    ],
    "js": [
        ("function", r"(?:function|const|let|var)\s+(\w+)\s*=?\s*(?:function)?\s*\(([^)]*)\)", 1, "'(' || {2} || ')'", ""),
        ("function", r"(?:const|let)\s+(\w+)\s*=\s*(?:async\s+)?\(([^)]*)\)\s*=>", 1, "'(' || {2} || ')'", ""),
        ("class", r"(?:export\s+)?(?:class|interface)\s+(\w+)", 1, "''", ""),
        ("type", r"(?:type|interface)\s+(\w+)\s*(?:=|\{)", 1, "''", ""),
    ],
    "generic": [("function", r"(?:(?:public|private|protected)\s+)?(?:static\s+)?(?:\w+\s+)+(\w+)\s*\(([^)]*)\)", 1, "'(' || {2} || ')'", "")],
}


def sql_symbols(language: str, where: str) -> str:
    parts = []
    for kind, p, name, signature, more in SQL_RULES[language]:
        group = lambda n, p=p: f"regexp_extract(line, '{p}', {n})"
        parts.append(f"SELECT {group(name)} AS name, {f"'{kind}'" if kind else group(1)} AS type, path AS file, line_number AS line, 0 AS \"column\", {signature.replace('{2}', group(2))} AS signature FROM {CODE_LINES} WHERE {where} AND regexp_matches(line, '{p}'){more}")
    return " UNION ALL ".join(parts)


LANGUAGES = {"go": ".go", "python": ".py", "js": ".ts", "generic": ".java"}
SYMBOLS = "(" + " UNION ALL ".join(sql_symbols(language, f"ends_with(path, '{end}')") for language, end in LANGUAGES.items()) + ")"


def code_lines(spark, sf_dir):
    kept = code_files(spark, sf_dir).where(paths.is_supported(F.col("path")))
    return lines.to_lines(kept.select("path", "content"), strip_cr=True)


def code_symbols(spark, sf_dir):
    return symbols.extract_symbols(code_lines(spark, sf_dir))


def of_language(language: str):
    def run(spark, sf_dir):
        kept = code_files(spark, sf_dir).where(F.col("path").endswith(LANGUAGES[language]))
        return symbols.extract_symbols(lines.to_lines(kept.select("path", "content"), strip_cr=True))

    return run


for _language, _end in LANGUAGES.items():
    QUERIES[f"symbols_{_language}"] = of_language(_language)
    ORACLE[f"symbols_{_language}"] = sql_symbols(_language, f"ends_with(path, '{_end}')")


@query(f"SELECT regexp_extract(line, '\\w\\s+(\\w+)\\s*\\(([^)]*)\\)', 1) AS name, path AS file, line_number AS line FROM {DOC_LINES} WHERE regexp_matches(line, '\\w\\s+(\\w+)\\s*\\(([^)]*)\\)')")
def symbols_generic_documents(spark, sf_dir):
    """The generic rule over long prose lines."""
    found = symbols.extract_symbols(lines.to_lines(document_files(spark, sf_dir).select("path", "content")), symbols.GENERIC)
    return found.select("name", "file", "line")


CALLS = sql_lines(f"(SELECT {DOC_PATH} AS path, replace(text, ', ', ' (a, b) ') AS content FROM documents)")


@query(f"SELECT regexp_extract(line, '(?:\\w+\\s+)+(\\w+)\\s*\\(([^)]*)\\)', 1) AS name, path AS file, line_number AS line FROM {CALLS} WHERE regexp_matches(line, '(?:\\w+\\s+)+(\\w+)\\s*\\(([^)]*)\\)')")
def symbols_generic_calls(spark, sf_dir):
    """The generic rule over prose whose commas are written as parameter lists."""
    calls = document_files(spark, sf_dir).select("path", F.replace("content", F.lit(", "), F.lit(" (a, b) ")).alias("content"))
    return symbols.extract_symbols(lines.to_lines(calls), symbols.GENERIC).select("name", "file", "line")


@query(f"SELECT * FROM {SYMBOLS} WHERE contains(lower(name), 'brand')")
def find_symbol(spark, sf_dir):
    return symbols.find_symbol(code_symbols(spark, sf_dir), "BRAND")


@query(f"SELECT * FROM {SYMBOLS} WHERE name = 'v10'")
def find_definition(spark, sf_dir):
    return symbols.find_definition(code_symbols(spark, sf_dir), "v10")


@query(f"SELECT name, count(*) AS n, min(file) AS first_file FROM {SYMBOLS} GROUP BY name")
def symbol_index(spark, sf_dir):
    return symbols.symbol_index(code_symbols(spark, sf_dir)).select("name", "n", F.col("first.file").alias("first_file"))


REFERENCES = r"""(SELECT 'Brand_13' AS name, path AS file, line_number AS line, 0 AS "column", trim(line, ' ' || chr(9)) AS content,
  CASE WHEN regexp_matches(line, '\bfunc\s+Brand_13\b') OR regexp_matches(line, '\btype\s+Brand_13\b') OR regexp_matches(line, '\b(?:var|const)\s+Brand_13\b') THEN 'definition' ELSE 'usage' END AS category
  FROM """ + CODE_LINES + r""" WHERE regexp_matches(line, '\bBrand_13\b'))"""


@query(f"SELECT * FROM {REFERENCES}")
def find_references(spark, sf_dir):
    return symbols.find_references(code_lines(spark, sf_dir), "Brand_13")


@query(f"SELECT category, count(*) AS n FROM {REFERENCES} GROUP BY category")
def reference_categories(spark, sf_dir):
    return symbols.find_references(code_lines(spark, sf_dir), "Brand_13").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def code_index(spark, sf_dir):
    """A name index of the code files after an update: a third of them held other code before, and some files are gone."""
    at = new_folder(spark, "code")  # the files are there before an index is: they aren't made anew for each look at them
    code_files(spark, sf_dir).where(paths.is_supported(F.col("path"))).select("path", "content").write.parquet(at)
    kept = spark.read.schema("path string, content string").parquet(at)
    other = F.crc32(F.col("path").cast("binary")) % 3 == 0
    before = kept.withColumn("content", F.when(other, F.replace("content", F.lit("Brand"), F.lit("Old_Brand"))).otherwise(F.col("content")))
    before = before.unionByName(kept.where(other).withColumn("path", F.concat(F.lit("gone/"), "path")))
    index = NameIndex(spark, new_folder(spark, "index"))
    for state in (before, kept):
        index.update(state.select("path", F.sha2("content", 256).alias("version")), lambda changed, state=state: state.join(changed, "path", "left_semi"))
    return index, kept


@query(f"SELECT * FROM {SYMBOLS} WHERE contains(lower(name), 'brand')")
def name_index_find_symbol(spark, sf_dir):
    return code_index(spark, sf_dir)[0].find_symbol("BRAND")


@query(f"SELECT * FROM {SYMBOLS} WHERE name = 'v10'")
def name_index_find_definition(spark, sf_dir):
    return code_index(spark, sf_dir)[0].find_definition("v10")


@query(f"SELECT * FROM {REFERENCES}")
def name_index_references(spark, sf_dir):
    index, kept = code_index(spark, sf_dir)
    return index.find_references("Brand_13", lambda named: kept.join(named, "path", "left_semi"))


# --- remote results, streams ------------------------------------------------------------------------


@query("SELECT source || '/' || lang || '/doc_' || doc_id AS file_path, 0 AS line_number, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'n = ' || n_chars END AS line_content, 'doc_' || doc_id AS match_text FROM documents")
def remote_items_flatten(spark, sf_dir):
    """Result pages, written as JSON from documents, read back as matches."""
    docs = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    fragments = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<struct<fragment:string>>")).otherwise(F.array(F.struct(F.concat(F.lit("\t n = "), F.col("n_chars").cast("string"), F.lit(" \n")).alias("fragment"))))
    item = F.struct(name.alias("name"), F.concat("lang", F.lit("/"), name).alias("path"), F.struct(F.col("source").alias("full_name")).alias("repository"), fragments.alias("text_matches"))
    pages = docs.groupBy("source", F.floor(F.col("doc_id") / 30).alias("p")).agg(F.collect_list(item).alias("items"))
    return codehost.matches_of_pages(pages.select(F.to_json(F.struct(F.size("items").alias("total_count"), "items")).alias("page")))


@query(sql_matches(DOC_LINES, "contains(line, 'License')", "'License'"))
def search_stream(spark, sf_dir):
    """The stream of document files, run to its end into a table of the shared folder."""
    from quarry.streaming.files import deliver, stream_matches, stream_table

    at = new_folder(spark, "stream")
    stored = table(spark, sf_dir, "documents")
    given = stream_table(spark, f"{sf_dir}/documents.parquet*", stored.schema)
    path = F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    found = stream_matches(as_files(given, path, F.col("text")), compile_pattern("License"))
    deliver(found, lambda batch, n: batch.write.mode("overwrite").parquet(f"{at}/out/batch={n}"), f"{at}/state").awaitTermination()
    return spark.read.schema(found.schema).option("basePath", f"{at}/out").parquet(f"{at}/out").select("file_path", "line_number", "line_content", "match_text")


@query(sql_matches(DOC_LINES, "contains(line, 'License')", "'License'"))
def search_tree_stream(spark, sf_dir):
    """A directory tree as a stream: a search that ends, and goes on from its checkpoint when the other half of the documents has come."""
    from quarry.streaming.files import deliver, stream_matches

    root, at, docs = mounted(new_folder(spark, "tree")), new_folder(spark, "stream"), document_files(spark, sf_dir)
    second = F.crc32(F.col("path").cast("binary")) % 2 == 1
    for k, half in enumerate((docs.where(~second), docs.where(second))):
        tree.write_tree(half, root)
        found = stream_matches(tree.stream_tree(spark, root, settle_ms=0), compile_pattern("License"))
        deliver(found, lambda batch, n, k=k: batch.write.mode("overwrite").parquet(f"{at}/out/batch={k}_{n}"), f"{at}/state").awaitTermination()
    read = spark.read.schema(found.schema).option("basePath", f"{at}/out").parquet(f"{at}/out")
    return read.select(F.substr("file_path", F.lit(len(root) + 2)).alias("file_path"), "line_number", "line_content", "match_text")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n FROM events WHERE contains(props, 'a') OR contains(event_type, 'a') GROUP BY 1")
def event_match_rate(spark, sf_dir):
    from quarry.streaming.files import event_rate

    return event_rate(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "a")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_literal(spark, sf_dir)
