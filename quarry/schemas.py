"""Row types that operators exchange, and the settings of a search."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

MATCH = "file_path string, line_number int, line_content string, match_text string"
SYMBOL = "name string, type string, file string, line int, column int, signature string"
REFERENCE = "name string, file string, line int, column int, content string, category string"
SUGGESTION = "text string, score double, context string, details string"
COMMIT = "repo string, hash string, author_name string, author_email string, author_when timestamp, message string, first_parent string"
COMMIT_FILE = "repo string, hash string, path string"
CODE_PAGE = "total_count int, incomplete_results boolean, items array<struct<name: string, path: string, repository: struct<full_name: string>, html_url: string, text_matches: array<struct<fragment: string>>>>"


@dataclass(frozen=True)
class SearchConfig:
    """What to search for and where. Lists may be empty, which means no restriction."""

    query: str
    paths: tuple[str, ...] = ()
    is_regex: bool = False
    ignore_case: bool = False
    context: int = 0
    extensions: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    remote: bool = False
    token: str = ""
    #: Files of more than piece_bytes are read in pieces of whole lines, by several tasks with split.
    split: bool = False
    piece_bytes: int = 64 << 20


@dataclass(frozen=True)
class HistoryConfig(SearchConfig):
    """A search restricted by version history; commit_message searches messages instead of files."""

    since: datetime | None = None
    author: str = ""
    changed_in: str = ""
    commit_message: bool = False
