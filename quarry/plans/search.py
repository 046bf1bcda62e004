"""Whole searches, from settings to matches: which source, which tests, in which order."""

from __future__ import annotations

import warnings
from collections import Counter
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.patterns import Pattern, compile_pattern
from quarry.operators import files, fuzzy, history, lines, symbols
from quarry.schemas import HistoryConfig, SearchConfig
from quarry.sources import codehost, gitlog, tree


def search(spark: SparkSession, config: SearchConfig) -> DataFrame:
    """Match rows for the settings; remote and history searches included."""
    if isinstance(config, HistoryConfig) and (config.since or config.author or config.changed_in or config.commit_message):
        return search_history(spark, config)
    if config.remote:
        return codehost.search_remote(spark, config.query, config.paths, config.ignore_case, config.is_regex, config.token)
    pattern = compile_pattern(config.query, config.is_regex, config.ignore_case)
    settings = {"extensions": config.extensions, "include": config.include, "exclude": config.exclude, "piece_bytes": config.piece_bytes}
    found = tree.read_tree(spark, *config.paths, split=config.split, around=config.context, **settings)
    kept = files.select_files(found, skip_directories=False)
    if not config.split:
        return lines.find_matches(kept, pattern, config.context)
    matches = lines.find_matches(kept, pattern, config.context, keep=("root_ord", "part.piece"))
    return lines.with_offsets(matches, tree.line_offsets(spark, *config.paths, **settings))


def search_history(spark: SparkSession, config: HistoryConfig, strict: bool = False) -> DataFrame:
    """Searches of commit messages, or of the present files that chosen commits changed.

    A root outside any repository is searched without regard to history (an error if strict). A commit
    range stands alone: date and author don't narrow it; message searches ignore the range.
    """
    pattern = compile_pattern(config.query, config.is_regex, config.ignore_case)
    met, outside = Counter(), []
    for root in config.paths:
        if (repo := gitlog.find_repository(root)) is not None:
            met[repo] += 1
            continue
        if strict:
            raise ValueError(f"{root} is in no repository")
        warnings.warn(f"{root} is in no repository; its history is ignored", stacklevel=2)
        outside.append(root)
    # One plan for all repositories; those that several roots lie in are searched once more for each.
    parts = [search_repositories(spark, config, pattern, [r for r, n in met.items() if n > k]) for k in range(max(met.values(), default=0))]
    if outside:
        parts.append(search(spark, SearchConfig(config.query, tuple(outside), config.is_regex, config.ignore_case, config.context, config.extensions, config.include, config.exclude)))
    return reduce(DataFrame.unionByName, parts)


def search_repositories(spark: SparkSession, config: HistoryConfig, pattern: Pattern, repos: list[str]) -> DataFrame:
    if config.changed_in and not config.commit_message:
        named = gitlog.read_range(spark, repos[0], config.changed_in, *repos[1:])
    else:
        commits, changed = gitlog.read_history(spark, *repos, since=config.since, author=config.author)
        chosen = history.filter_commits(commits, config.since, config.author)
        if config.commit_message:
            return lines.find_in_messages(chosen, pattern)
        named = history.changed_files(chosen, changed, "repo")
    present = tree.read_named(named, "repo", config.extensions, by_row=True)
    return lines.find_matches(present.withColumn("path", F.col("rel_path")), pattern, config.context, strip_cr=True)


def tree_lines(spark: SparkSession, roots: tuple[str, ...], extensions: tuple[str, ...] = (), supported_only: bool = False) -> DataFrame:
    """Lines of files, carriage returns dropped, ignore files not looked at."""
    from quarry.functions.paths import SUPPORTED

    found = tree.read_tree(spark, *roots, ignore_file=False, extensions=extensions or (SUPPORTED if supported_only else ()))
    return lines.to_lines(found.select("root_ord", "path", "content", "part"), strip_cr=True)


def suggest(spark: SparkSession, query: str, roots: tuple[str, ...], extensions: tuple[str, ...] = ()) -> DataFrame:
    return fuzzy.suggest(query, tree.read_tree(spark, *roots, ignore_file=False, extensions=extensions))


def fuzzy_search(spark: SparkSession, config: SearchConfig) -> DataFrame:
    """Exact matches, then suggestions as match rows."""
    return search(spark, config).unionByName(fuzzy.fuzzy_rows(suggest(spark, config.query, config.paths, config.extensions)))


def tree_symbols(spark: SparkSession, roots: tuple[str, ...], extensions: tuple[str, ...] = ()) -> DataFrame:
    return symbols.extract_symbols(tree_lines(spark, roots, extensions, supported_only=True))


def tree_references(spark: SparkSession, name: str, roots: tuple[str, ...], extensions: tuple[str, ...] = ()) -> DataFrame:
    return symbols.find_references(tree_lines(spark, roots, extensions, supported_only=True), name)


