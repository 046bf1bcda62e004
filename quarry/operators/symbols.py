"""Symbols of source files: tables of patterns for each language, index, lookup, references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.paths import any_of
from quarry.functions.patterns import EDGE, quote
from quarry.functions.text import trim_space

S = r"[\t\n\f\r ]"


@dataclass(frozen=True)
class Rule:
    """A pattern of a language: the group that is the name, the group that is the signature ('(' + it + ')' if wrapped).

    Whatever fits begins with one of starts and holds one text of each of needs, so that most lines are told by
    these, without the matcher; name and signature are taken of lines that fit only."""

    kind: str
    pattern: str
    name: int = 1
    signature: int = 0
    wrapped: bool = False
    starts: tuple[str, ...] = ()
    needs: tuple[tuple[str, ...], ...] = ()

    def may_fit(self, line: Column) -> Column:
        test = F.lit(True)
        if self.starts:
            test &= any_of([line.startswith(s) for s in self.starts])
        for texts in self.needs:
            test &= any_of([F.contains(line, F.lit(t)) for t in texts])
        return test


#: What counts as a symbol in each language, in the order in which one line's symbols come.
GO = (
    Rule("function", rf"^func{S}+(\w+){S}*(\([^)]*\))?{S}*(\([^)]*\))?{S}*\{{", signature=2, starts=("func",), needs=(("{",),)),
    Rule("method", rf"^func{S}+\([^)]+\){S}+(\w+){S}*(\([^)]*\))?{S}*(\([^)]*\))?{S}*\{{", signature=2, starts=("func",), needs=((")",), ("{",))),
    Rule("struct", rf"^type{S}+(\w+){S}+struct{S}*\{{", starts=("type",), needs=(("struct",), ("{",))),
    Rule("interface", rf"^type{S}+(\w+){S}+interface{S}*\{{", starts=("type",), needs=(("interface",), ("{",))),
    Rule("type", rf"^type{S}+(\w+){S}+\w+", starts=("type",)),
    Rule("", rf"^(var|const){S}+(\w+){S}*", name=2, starts=("var", "const")),
    Rule("field", rf"^{S}+(\w+){S}+\w+", starts=("\t", "\n", "\f", "\r", " ")),
)
PYTHON = (
    Rule("function", rf"^def{S}+(\w+){S}*\(([^)]*)\)", signature=2, wrapped=True, starts=("def",), needs=(("(",), (")",))),
    Rule("class", rf"^class{S}+(\w+){S}*\(?{S}*\w*{S}*\)?", starts=("class",)),
    Rule("variable", rf"^(\w+){S}*={S}*", needs=(("=",),)),
)
JAVASCRIPT = (
    Rule("function", rf"(?:function|const|let|var){S}+(\w+){S}*=?{S}*(?:function)?{S}*\(([^)]*)\)", signature=2, wrapped=True, needs=(("function", "const", "let", "var"), ("(",), (")",))),
    Rule("function", rf"(?:const|let){S}+(\w+){S}*={S}*(?:async{S}+)?\(([^)]*)\){S}*=>", signature=2, wrapped=True, needs=(("const", "let"), ("=>",))),
    Rule("class", rf"(?:export{S}+)?(?:class|interface){S}+(\w+)", needs=(("class", "interface"),)),
    Rule("type", rf"(?:type|interface){S}+(\w+){S}*(?:=|\{{)", needs=(("type", "interface"), ("=", "{"))),
)
#: Any run of words before a name and parentheses; written without nested repeats, which exhaust the matcher's stack on long lines.
GENERIC = (Rule("function", rf"\w{S}+(\w+){S}*\(([^)]*)\)", signature=2, wrapped=True, needs=(("(",), (")",))),)
BY_EXTENSION = {".go": GO, ".py": PYTHON, ".js": JAVASCRIPT, ".ts": JAVASCRIPT}


def extension(path: Column) -> Column:
    """The last dot of the file's name and what follows, as written."""
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def rule_symbol(rule: Rule, line: Column, rules: tuple[Rule, ...]) -> Column:
    """(name, type, signature) if the rule fits the line, else null."""
    fits = rule.may_fit(line) & line.rlike(rule.pattern)
    name = F.regexp_extract(line, rule.pattern, rule.name)
    kind = F.lit(rule.kind) if rule.kind else F.regexp_extract(line, rule.pattern, 1)
    if rules is GO and rule.kind == "type":
        for special in ("struct", "interface"):
            other = next(r for r in GO if r.kind == special)
            fits &= ~(other.may_fit(line) & line.rlike(other.pattern))
    if rules is PYTHON and rule.kind == "variable":
        fits &= ~name.startswith("_")
    signature = F.regexp_extract(line, rule.pattern, rule.signature) if rule.signature else F.lit("")
    signature = F.concat(F.lit("("), signature, F.lit(")")) if rule.wrapped else trim_space(signature)
    return F.when(fits, F.struct(name.alias("name"), kind.alias("type"), signature.alias("signature")))


def line_symbols(line: Column, rules: tuple[Rule, ...]) -> Column:
    return F.array_compact(F.array(*[rule_symbol(r, line, rules) for r in rules]))


def extract_symbols(lines: DataFrame, rules: tuple[Rule, ...] | None = None) -> DataFrame:
    """Symbols of lines (path, line_number, line), by the file's extension or by the rules given. Columns are always 0."""
    line, end = F.col("line"), extension(F.col("path"))
    if rules is None:
        found = F.when(F.lit(False), line_symbols(line, GENERIC))
        for kind, table in ((GO, [".go"]), (PYTHON, [".py"]), (JAVASCRIPT, [".js", ".ts"])):
            found = found.when(end.isin(*table), line_symbols(line, kind))
        found = found.otherwise(line_symbols(line, GENERIC))
    else:
        found = line_symbols(line, rules)
    rows = lines.select("path", "line_number", F.inline(found))
    return rows.select("name", "type", F.col("path").alias("file"), F.col("line_number").alias("line"), F.lit(0).alias("column"), "signature")


def symbol_index(symbols: DataFrame) -> DataFrame:
    """name -> n, its number of symbols, and the first of them in order of file and line."""
    entry = F.struct("file", "line", "type", "column", "signature")
    return symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min(entry).alias("first"))


def sorted_symbols(symbols: DataFrame) -> DataFrame:
    """The index's entries as rows, range-sorted by name, file and line: a frequent name fills as many ranges as it needs."""
    return symbols.orderBy("name", "file", "line", "type", "column", "signature")


def find_symbol(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols whose name contains the text, whatever its case."""
    return symbols.where(F.contains(F.lower("name"), F.lit(name.lower())))


def find_definition(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.where(F.col("name") == name)


def find_references(lines: DataFrame, name: str) -> DataFrame:
    """Lines on which the name stands alone, each a definition or a usage."""
    word = EDGE + quote(name) + EDGE
    after = quote(name) + EDGE
    defined = F.lit(False)
    for keyword in ("func", "type", "(?:var|const)"):
        defined |= F.col("line").rlike(f"{EDGE}{keyword}{S}+{after}")
    found = lines.where(F.contains("line", F.lit(name)) & F.col("line").rlike(word))
    return found.select(F.lit(name).alias("name"), F.col("path").alias("file"), F.col("line_number").alias("line"), F.lit(0).alias("column"), trim_space(F.col("line")).alias("content"), F.when(defined, F.lit("definition")).otherwise(F.lit("usage")).alias("category"))
