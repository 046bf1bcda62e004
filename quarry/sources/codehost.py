"""Remote code search at github.com: pages of results for each repository, one partition each.

At most 5 pages of 30 results are read for a repository. The HTTP client can be replaced, which tests
do; an error in any page fails the read.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quarry.functions.text import trim_space
from quarry.schemas import CODE_PAGE

#: The public address of the code search, and how far it is read.
ADDRESS = "https://api.github.com/search/code"
PAGES, PER_PAGE, TIMEOUT = 5, 30, 30


class RateLimited(RuntimeError):
    pass


class NotAuthorised(RuntimeError):
    pass


class NoRepository(RuntimeError):
    pass


def page_address(query: str, repo: str, page: int, ignore_case: bool = False) -> str:
    q = urllib.parse.quote_plus(f"{query} repo:{repo}") + ("" if ignore_case else "+is:case-sensitive")
    return f"{ADDRESS}?q={q}&per_page={PER_PAGE}&page={page}"


def fetch(address: str, headers: dict[str, str]) -> tuple[int, str]:
    """Status and body of an address."""
    try:
        with urllib.request.urlopen(urllib.request.Request(address, headers=headers), timeout=TIMEOUT) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as problem:
        return problem.code, ""


def result_pages(query: str, repo: str, ignore_case: bool, token: str, client: Callable[[str, dict], tuple[int, str]] = fetch) -> Iterator[str]:
    headers = {"Accept": "application/vnd.github.v3.text-match+json"} | ({"Authorization": f"token {token}"} if token else {})
    seen = 0
    for page in range(1, PAGES + 1):
        status, body = client(page_address(query, repo, page, ignore_case), headers)
        if status != 200:
            kind = {403: RateLimited, 401: NotAuthorised, 404: NoRepository}.get(status, RuntimeError)
            raise kind(f"{repo}: the code search answered with status {status}")
        yield body
        answer = json.loads(body)
        items = answer.get("items") or []
        seen += len(items)
        if seen >= answer.get("total_count", 0) or len(items) < PER_PAGE:
            break


class RepoPartition(InputPartition):
    def __init__(self, repo: str):
        self.repo = repo


class CodeSearchReader(DataSourceReader):
    client = staticmethod(fetch)

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[RepoPartition]:
        return [RepoPartition(r) for r in self.options["repos"].split("\n")]

    def read(self, partition: RepoPartition) -> Iterator[tuple]:
        o = self.options
        for body in result_pages(o["query"], partition.repo, o.get("ignore_case") == "true", o.get("token", ""), self.client):
            yield (partition.repo, body)


class CodeSearchSource(DataSource):
    """spark.read.format("codesearch") with options repos, query, ignore_case, token: (repo, page) rows of JSON."""

    reader_class = CodeSearchReader

    @classmethod
    def name(cls) -> str:
        return "codesearch"

    def schema(self) -> str:
        return "repo string, page string"

    def reader(self, schema) -> CodeSearchReader:
        return self.reader_class(self.options)


def matches_of_pages(pages: DataFrame) -> DataFrame:
    """Match rows of result pages (page: JSON): the file's name stands for the match, line numbers aren't known."""
    items = pages.select(F.explode(F.from_json("page", CODE_PAGE)["items"]).alias("i"))
    fragment = trim_space(F.try_element_at(F.col("i.text_matches"), F.lit(1))["fragment"])
    return items.select(F.concat("i.repository.full_name", F.lit("/"), "i.path").alias("file_path"), F.lit(0).alias("line_number"), F.coalesce(fragment, F.lit("")).alias("line_content"), F.col("i.name").alias("match_text"))


def search_remote(spark: SparkSession, query: str, repos: tuple[str, ...], ignore_case: bool = False, is_regex: bool = False, token: str = "", source: type[DataSource] = CodeSearchSource) -> DataFrame:
    if is_regex:
        raise ValueError("the remote code search has no regex mode")
    spark.dataSource.register(source)
    token = token or os.environ.get("GITHUB_TOKEN", "")
    reader = spark.read.format(source.name()).option("repos", "\n".join(repos)).option("query", query)
    return matches_of_pages(reader.option("ignore_case", str(ignore_case).lower()).option("token", token).load())
