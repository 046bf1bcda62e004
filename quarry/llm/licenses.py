"""License scans: TF-IDF cosine of headers and licence files to templates, then directory inheritance.

DataFrame operations only. Every line of a file is a possible header; a licence file is also compared
as a whole, with the same sentences and with full licence texts. A term that stands n times counts 1 + ln n
times its weight, which falls with the number of templates that have it; terms of no template weigh most.

The terms that a text shares with a template bound their cosine: without any of the template's heaviest
terms, as many as make the rest too light, it stays below the threshold however often the others stand. One
look for the heavy terms of all templates, first in whole texts, then in lines, and then the bound itself,
therefore leave few lines; only those are taken apart, a row for each term, and joined with the sparse template
vectors, a table of fixed size.

A file without a licence of its own gets that of the nearest ancestor directory whose licence file has
one: distinct directories are joined with the licensed ones on each of their ancestor paths, so a
directory with very many files counts once.

Edge cases: null and empty texts have no licence of their own but may inherit; null paths neither own a
directory nor inherit; equal scores go to the smaller template name, several licence files in one
directory to the best score, then the smaller name, then the smaller path; repeated rows with one path
share the best score among them; texts are scanned whole; extra columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from itertools import groupby
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import stored

#: How files state the common licences.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file", "SPDX-License-Identifier: BSD-3-Clause"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "LGPL-3.0": ["This library is licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "MIT": ["Released under the MIT License", "SPDX-License-Identifier: MIT"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "SPDX-License-Identifier: MPL-2.0"],
}
#: Names of files that state the licence of their directory.
FILES = r"(?i)^(licen[cs]e|copying|unlicense)(\.(txt|md|rst))?$"
#: Full texts, named by their licence; there is none of the CC licences, which their files' title lines state.
TEXTS = Path(__file__).parent / "license_texts"
SPLIT = "[^a-z0-9.]+"
THRESHOLD = 0.7
#: Templates of so many terms in all are bounded term by term too, before a line is taken apart.
FEW = 500


@lru_cache(maxsize=1)
def full_texts() -> dict[str, list[str]]:
    return {f.stem: [f.read_text(encoding="utf-8")] for f in sorted(TEXTS.glob("*.txt"))}


def template_terms(templates: dict[str, list[str]]) -> tuple[list[tuple[str, int, str, float, float]], float]:
    """(licence, template, term, its share of the unit vector, weight) and the weight of a term in no template."""
    split = lambda text: [t for t in (t.strip(".") for t in re.split(SPLIT, text.lower())) if t]
    bags = [(name, k, Counter(split(text))) for name, texts in templates.items() for k, text in enumerate(texts)]
    held = Counter(term for _, _, bag in bags for term in bag)
    weight = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in held.items()}
    rows = []
    for name, k, bag in bags:
        size = {t: weight[t] * (1 + math.log(n)) for t, n in bag.items()}
        norm = math.sqrt(sum(x * x for x in size.values()))
        rows += [(name, k, t, x / norm, weight[t]) for t, x in sorted(size.items())]
    return rows, math.log(1 + len(bags)) + 1


#: Words that most texts have: looked for only where a template's other terms don't weigh enough.
COMMON = {"a", "and", "be", "by", "can", "file", "found", "in", "is", "of", "or", "that", "the", "this", "to", "under", "use", "work"}


def heavy_terms(rows: list[tuple[str, int, str, float, float]], threshold: float) -> set[str]:
    """Terms one of which a text must have to come up to the threshold with any template."""
    heavy = set()
    for _, own in groupby(rows, key=lambda r: r[:2]):
        shares = sorted((term in COMMON, -share, term) for _, _, term, share, _ in own)
        rest = 1.0
        for _, share, term in shares:
            if rest < (threshold - 1e-5) ** 2:
                break
            heavy.add(term)
            rest -= share * share
    return heavy


def has_any(text: Column, terms: set[str]) -> Column:
    """Whether a lower-case text may have one of the terms."""
    return F.regexp_like(text, F.lit("(?<![a-z0-9])(?:" + "|".join(re.escape(t) for t in sorted(terms)) + ")(?![a-z0-9])"))


def may_reach(text: Column, rows: list[tuple[str, int, str, float, float]], threshold: float) -> Column:
    """Whether the terms that a text may have are heavy enough for some template: their shares bound the cosine."""
    bounds = [sum((F.when(F.contains(text, F.lit(term)), share * share).otherwise(0.0) for _, _, term, share, _ in own), F.lit(1e-5)) for _, own in groupby(rows, key=lambda r: r[:2])]
    return F.greatest(*bounds, F.lit(0.0)) >= threshold**2


def terms(text: Column) -> Column:
    """The terms of a lower-case text, with repeats."""
    return F.filter(F.transform(F.split(text, SPLIT), lambda t: F.btrim(t, F.lit("."))), lambda t: t != "")


def own_licences(files: DataFrame, path: str, text: str, templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """path, license, score (6 digits) of files that state a licence."""
    whole = F.regexp_like(F.element_at(F.split(path, "/"), -1), F.lit(FILES))
    named = files.where(F.col(path).isNotNull()).select(F.col(path).alias("path"), F.lower(text).alias("text"), whole.alias("whole"))
    lines = F.split("text", "\n")
    passages = lambda kept: kept.select("path", F.explode(F.when(F.col("whole"), F.concat(lines, F.array("text"))).otherwise(lines)).alias("line"))
    scores = stated(named, passages, templates, threshold)
    texts = {name: kept for name, kept in full_texts().items() if name in templates}
    if texts:
        scores = scores.unionByName(stated(named.where("whole"), lambda kept: kept.select("path", F.col("text").alias("line")), texts, threshold))
    best = scores.groupBy("path").agg(F.max(F.struct("score", rank_down(templates).alias("r"), "license")).alias("m"))
    return best.select("path", F.col("m.license").alias("license"), F.col("m.score").alias("score"))


def stated(files: DataFrame, passages: Callable[[DataFrame], DataFrame], templates: dict[str, list[str]], threshold: float) -> DataFrame:
    """path, license, score of passages (path, line) of files (path, text in lower case) that reach the threshold."""
    spark = files.sparkSession
    rows, unknown = template_terms(templates)
    values = ", ".join(f"('{name}', {k}, '{term}', {share!r}D, {weight!r}D)" for name, k, term, share, weight in rows)
    vectors = spark.sql(f"SELECT * FROM VALUES {values} AS t(license, template, term, share, weight)")
    heavy = heavy_terms(rows, threshold)
    lines = passages(files.where(has_any(F.col("text"), heavy))).where(has_any(F.col("line"), heavy))
    if len(rows) <= FEW:
        lines = lines.where(may_reach(F.col("line"), rows, threshold))
    found = lines.withColumn("at", F.md5("line")).dropDuplicates(["path", "at"])  # a line that is repeated scores alike
    counted = found.select("path", "at", F.explode(terms(F.col("line"))).alias("term")).groupBy("path", "at", "term").agg(F.count(F.lit(1)).alias("n"))
    weights = vectors.select("term", "weight").distinct()
    weighed = counted.join(F.broadcast(weights), "term", "left").withColumn("w", (1 + F.log("n")) * F.coalesce("weight", F.lit(unknown)))
    sized = weighed.withColumn("norm", F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("path", "at"))))
    dots = sized.join(F.broadcast(vectors.drop("weight")), "term").groupBy("path", "at", "license", "template")
    scores = dots.agg(F.round(F.sum(F.col("share") * F.col("w")) / F.first("norm"), 6).alias("score"))
    return scores.where(F.col("score") >= threshold).select("path", "license", "score")


def rank_down(templates: dict[str, list[str]]) -> Column:
    """Larger for the smaller name, so that max() of (score, this) prefers it."""
    names = sorted(templates)
    order = F.lit(0)
    for k, name in enumerate(names):
        order = F.when(F.col("license") == name, F.lit(len(names) - k)).otherwise(order)
    return order


def parent(path: Column) -> Column:
    """The directory of a path; '' for the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def scan_licences(files: DataFrame, path: str = "path", text: str = "text", templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """path, license, score, origin ('own', 'inherited' or null), license_path: one row for each row of files."""
    own, _ = stored(own_licences(files, path, text, templates, threshold))  # joined twice, and small
    name = F.element_at(F.split("path", "/"), -1)
    order = rank_down(templates)
    given = own.where(F.regexp_like(name, F.lit(FILES))).select(parent(F.col("path")).alias("dir"), "path", "license", "score")
    best = F.min(F.struct((-F.col("score")).alias("s"), (-order).alias("r"), "path", "license")).alias("g")
    given = given.groupBy("dir").agg(best).select("dir", "g.license", F.col("g.path").alias("license_path"))
    rows = files.select(F.col(path).alias("path")).withColumn("dir", parent(F.col("path")))
    steps = F.split("dir", "/")
    ancestors = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))
    climbs = rows.select("dir").where("dir is not null").distinct().select("dir", F.explode(F.array_distinct(ancestors)).alias("up"))
    nearest = climbs.join(given.withColumnRenamed("dir", "up"), "up").groupBy("dir").agg(F.max_by(F.struct("license", "license_path"), F.length("up")).alias("n"))
    out = rows.join(own, "path", "left").join(nearest, "dir", "left")
    mine = F.col("license").isNotNull()
    return out.select(
        "path",
        F.coalesce("license", "n.license").alias("license"),
        "score",
        F.when(mine, F.lit("own")).when(F.col("n").isNotNull(), F.lit("inherited")).alias("origin"),
        F.when(mine, F.col("path")).otherwise(F.col("n.license_path")).alias("license_path"),
    )
