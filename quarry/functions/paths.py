"""Predicates on file paths: extensions, globs, skipped directories, ignore files."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from functools import reduce
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories that are never entered, besides those whose names begin with a dot.
SKIPPED = (".git", ".svn", ".hg", "node_modules", "vendor", ".vscode", ".idea", "__pycache__", ".venv")
#: Extensions whose symbols are extracted unless others are asked for.
SUPPORTED = (".go", ".py", ".js", ".ts", ".java", ".c", ".cpp", ".h", ".rs")


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def has_extension(path: Column, extensions: tuple[str, ...] | list[str]) -> Column:
    """The path ends in one of them, whatever the case; true for an empty list."""
    return any_of([F.lower(path).endswith(e.lower()) for e in extensions]) if extensions else F.lit(True)


def is_supported(path: Column, extensions: tuple[str, ...] | list[str] = ()) -> Column:
    return has_extension(path, extensions or SUPPORTED)


def glob_regex(glob: str) -> str:
    """A regex for the whole path. * and ** cross slashes, ? is one character, [!a-z] and {a,b} work; ValueError if malformed."""
    out, at, depth = [], 0, 0
    while at < len(glob):
        c = glob[at]
        if c == "*":
            while glob[at + 1 : at + 2] == "*":
                at += 1
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "[":
            m = re.compile(r"\[(!?)((?:\\.|[^\]\\])+)\]").match(glob, at)
            if not m:
                raise ValueError(f"malformed glob {glob!r}")
            out.append(f"[{'^' if m[1] else ''}{re.sub(r'([\[&^])', r'\\\1', m[2])}]")
            at = m.end() - 1
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "\\":
            if at + 1 == len(glob):
                raise ValueError(f"malformed glob {glob!r}")
            at += 1
            out.append(re.escape(glob[at]))
        else:
            out.append(re.escape(c))
        at += 1
    if depth:
        raise ValueError(f"malformed glob {glob!r}")
    return r"\A" + "".join(out) + r"\z"


def usable_globs(globs: tuple[str, ...] | list[str]) -> list[str]:
    """The globs but malformed ones, with a warning for each of these."""
    out = []
    for glob in globs:
        try:
            glob_regex(glob)
            out.append(glob)
        except ValueError as problem:
            warnings.warn(str(problem), stacklevel=2)
    return out


def matches_any(path: Column, globs: list[str], name: Column | None = None) -> Column:
    """Whether one of the globs matches the whole path (or the name, if given).

    Globs without wildcards and those like *.ext are looked up in sets, however many there are; the others are one
    pattern. Malformed globs match nothing."""
    tests = [path] if name is None else [path, name]
    whole, ends, rest = [], [], []
    for glob in globs:
        if not set(glob) & set("*?[{\\"):
            whole.append(glob)
        elif re.fullmatch(r"\*+\.[^*?\[{\\./]+", glob):
            ends.append(glob.lstrip("*"))
        else:
            rest.append(glob_regex(glob).removeprefix(r"\A").removesuffix(r"\z"))
    found = [t.isin(whole) for t in tests] if whole else []
    if ends:
        found.append(F.concat(F.lit("."), F.substring_index(path, ".", -1)).isin(ends) & F.contains(path, F.lit(".")))
    if rest:
        found += [t.rlike(r"\A(?:" + "|".join(rest) + r")\z") for t in tests]
    return any_of(found)


def passes_globs(path: Column, include: tuple[str, ...] | list[str] = (), exclude: tuple[str, ...] | list[str] = ()) -> Column:
    """No exclude glob matches, and one of the include globs does if any are given (even if none is usable)."""
    kept = ~matches_any(path, usable_globs(exclude))
    return kept & matches_any(path, usable_globs(include)) if include else kept


def skips_directory(name: str) -> bool:
    return name in SKIPPED or name.startswith(".")


def in_skipped_directory(rel_path: Column) -> Column:
    """Whether a directory below the root is one that isn't entered."""
    parts = F.split(rel_path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda d: d.isin(*SKIPPED) | d.startswith("."))


@dataclass(frozen=True)
class IgnoreRule:
    negated: bool
    directories_only: bool
    globs: tuple[str, ...]
    regexes: tuple[str, ...]


def ignore_rules(text: str) -> list[IgnoreRule]:
    """The rules of an ignore file, in order."""
    rules = []
    for line in text.splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        line = line[negated:]
        directories = line.endswith("/")
        line = line[: len(line) - directories]
        plain = line.removeprefix("/")
        variants = [plain] if "/" in plain or plain != line else [plain, "**/" + plain]
        globs, regexes = [], []
        for v in variants:
            try:
                regexes.append(glob_regex(v))
                globs.append(v)
            except ValueError:
                continue
        if regexes:
            rules.append(IgnoreRule(negated, directories, tuple(globs), tuple(regexes)))
    return rules


def is_ignored(rel_path: Column, rules: list[IgnoreRule], is_directory: bool = False) -> Column:
    """The last rule that matches the path or its last part decides. Rules in a row that say the same are tested together."""
    name = F.element_at(F.split(rel_path, "/"), -1)
    fitting = [r for r in rules if is_directory or not r.directories_only]
    verdict = F.lit(False)
    for negated, run in groupby(fitting, key=lambda r: r.negated):
        globs = [g for r in run for g in r.globs]
        # A name at any depth is found as the last part, *.ext as the path's end.
        deeper = {f"**/{g}" for g in globs if re.fullmatch(r"[^*?\[{\\/]+|\*+\.[^*?\[{\\./]+", g)}
        verdict = F.when(matches_any(rel_path, [g for g in globs if g not in deeper], name), F.lit(not negated)).otherwise(verdict)
    return verdict


def below_ignored(rel_path: Column, rules: list[IgnoreRule]) -> Column:
    """Whether the path or any directory above it is ignored; rules can't bring back what lies in an ignored directory."""
    if not rules:
        return F.lit(False)
    parts = F.split(rel_path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return is_ignored(rel_path, rules) | ((F.size(parts) > 1) & F.exists(above, lambda d: is_ignored(d, rules, True)))


def ignored_by(rules: list[IgnoreRule], rel_path: str, is_directory: bool) -> bool:
    """The same verdict for one path, for pruning while a tree is listed."""
    verdict, name = False, rel_path.rsplit("/", 1)[-1]
    for rule in rules:
        if (is_directory or not rule.directories_only) and any(re.search(r.replace(r"\z", r"\Z"), x) for r in rule.regexes for x in (rel_path, name)):
            verdict = not rule.negated
    return verdict


def is_binary(content: Column) -> Column:
    """A NUL among the first 512 bytes; content is binary."""
    return F.coalesce(F.call_function("position", F.lit(b"\x00"), F.substring(content, 1, 512)) > 0, F.lit(False))
