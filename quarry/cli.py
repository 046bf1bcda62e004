"""Command line: search, find-symbol, find-definition, find-references."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quarry.functions.patterns import PatternError
from quarry.functions.text import time_ago, truncated, two_digits
from quarry.operators import symbols
from quarry.plans import search as plans
from quarry.schemas import HistoryConfig
from quarry.sources import sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="quarry", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    s = commands.add_parser("search")
    s.add_argument("query")
    s.add_argument("paths", nargs="+")
    for flag in ("regex", "ignore-case", "github", "commit-message", "fuzzy", "suggest", "split"):
        s.add_argument(f"--{flag}", action="store_true")
    for flag in ("github-token", "json", "csv", "extensions", "exclude", "include", "since", "author", "changed-in"):
        s.add_argument(f"--{flag}", default="")
    s.add_argument("--context", type=int, default=0)
    for name in ("find-symbol", "find-definition", "find-references"):
        c = commands.add_parser(name)
        c.add_argument("name")
        c.add_argument("paths", nargs="+")
        c.add_argument("--ext", default="")
    return top


def listed(text: str) -> tuple[str, ...]:
    return tuple(x for x in text.split(",") if x)


def run_search(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    config = HistoryConfig(
        a.query, tuple(a.paths), a.regex, a.ignore_case, a.context, listed(a.extensions), listed(a.include), listed(a.exclude), a.github, a.github_token,
        since=time_ago(a.since) if a.since else None, author=a.author, changed_in=a.changed_in, commit_message=a.commit_message, split=a.split,
    )
    if a.suggest:
        rows = plans.suggest(spark, a.query, config.paths, config.extensions).select("text", two_digits(F.col("score")).alias("score"), "context").collect()
        return [f"{k}. {r['text']} (score: {r['score']}) - {r['context']}" for k, r in enumerate(rows, 1)] or ["No matches found."]
    matches = plans.fuzzy_search(spark, config) if a.fuzzy else plans.search(spark, config)
    done = []
    if a.json:
        done.append(f"{sinks.write_json(matches, a.json, a.query, a.regex)} matches written to {a.json}")
    if a.csv:
        done.append(f"{sinks.write_csv(matches, a.csv)} matches written to {a.csv}")
    return done or list(sinks.printed(matches, a.query, sys.stdout.isatty()))


def run_symbols(spark: SparkSession, a: argparse.Namespace) -> list[str]:
    roots, extensions = tuple(a.paths), listed(a.ext)
    if a.command == "find-references":
        rows = plans.tree_references(spark, a.name, roots, extensions).orderBy("file", "line").withColumn("content", truncated(F.col("content"))).collect()
        return [f"  {'[def]  ' if r['category'] == 'definition' else '[usage]'} {r['file']}:{r['line']}  {r['content']}" for r in rows] or ["No references found"]
    found = plans.tree_symbols(spark, roots, extensions)
    rows = (symbols.find_symbol if a.command == "find-symbol" else symbols.find_definition)(found, a.name).orderBy("file", "line", "type").collect()
    none = f'No symbols found matching "{a.name}"' if a.command == "find-symbol" else "No definition found"
    return [f"  [{r['type']}] {r['name']} {r['file']}:{r['line']} {r['signature']}" for r in rows] or [none]


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("quarry").getOrCreate()
    try:
        for line in (run_search if a.command == "search" else run_symbols)(spark, a):
            print(line)
    except (PatternError, ValueError, OSError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
