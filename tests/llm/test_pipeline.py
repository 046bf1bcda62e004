"""The pipeline's stages against brute-force versions, each on its own input."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import mixing
from tests.llm.test_texts import SMALL, grouped, simhash_by_hand, without_repeats


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def odd(spark, docs):
    rows = [(-1, None, None, None, None), (-2, "", "en", "s", 0), (-3, "123 ...", "en", None, 7), (None, "the of and", "en", "s", 10), (-4, "the of and", "en", "s", 10)]
    return docs.unionByName(spark.createDataFrame(rows, docs.schema)).unionByName(docs.limit(3))


def test_language_stage_keeps_what_has_letters(spark, docs):
    given = odd(spark, docs)
    kept = corpus_pipeline.language_id(spark, given, SMALL)
    assert kept.columns == docs.columns
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept.collect()) == sorted((str(r["doc_id"]), r["text"]) for r in given.collect() if any(c.isalpha() for c in r["text"] or ""))


def test_near_duplicate_stage_keeps_one_of_each_group(spark, docs):
    rows = odd(spark, docs).collect()
    marks = [(r["doc_id"], simhash_by_hand(r["text"])) for r in rows]
    least = {}
    for i, f in marks:
        if i is not None:
            least[f] = min(i, least.get(f, i))
    want = sorted(set(grouped(least).values()))
    kept = corpus_pipeline.near_duplicates(spark, odd(spark, docs), SMALL)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == want


def test_passage_stage(spark, docs):
    given = odd(spark, docs)
    rows = given.collect()
    want = sorted((str(r["doc_id"]), kept if gone else r["text"]) for r, (n, gone, kept) in zip(rows, without_repeats([r["text"] for r in rows], 35)) if not gone or gone < n)
    out = corpus_pipeline.repeated_passages(spark, given, SMALL).collect()
    assert sorted(((str(r["doc_id"]), r["text"]) for r in out), key=str) == sorted(want, key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in out if r["text"])


def test_all_stages(spark, docs):
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert out and all(r["exact"] and r["n_tokens"] == len(r["ids"]) > 0 for r in out)
    assert corpus_pipeline.STAGES[-1][1](spark, docs.where("false"), SMALL).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SMALL).count() == 0


def test_mixing_stage_takes_null_and_repeated_ids(spark, docs):
    given = docs.unionByName(spark.createDataFrame([(None, "the of and a null id", "en", "s", 20), (None, "another one", "en", None, 11), (-1, "one two three four", "en", "a", 18), (-1, "five six", "en", "b", 8), (-1, "seven eight nine ten", "en", "b", 20)], docs.schema))
    want = {}
    for r in mixing.mix(given).collect():
        if r["size"]:
            want[r["doc_id"], r["source"], r["mark"]] = max(want.get((r["doc_id"], r["source"], r["mark"]), 0), math.floor(r["taken"] / r["size"] + 0.5))
    out = corpus_pipeline.mixing_sources(spark, given, SMALL)
    found = Counter((r["doc_id"], r["source"], r["mark"]) for r in out.select("doc_id", "source", F.xxhash64("text").alias("mark")).collect())
    assert found == {k: n for k, n in want.items() if n}
    assert any(i is None for i, _, _ in found)
