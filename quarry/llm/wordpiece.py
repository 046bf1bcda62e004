"""Token counts by a linear longest-match automaton.

Words are cut greedily into the longest vocabulary entries. The automaton is the vocabulary's trie;
where a character can't be followed, a failure link leads to the node that spells what is left once
the longest entries are popped, and carries how many were popped. One pass over a word adds those
counts up, so no piece is ever built.

Edge cases: null and empty texts count 0; a word with a part that no entry matches counts as one
unknown token, as word-piece tokenizers have it; so does one that no starting entry fits, such as
unspaced Chinese, Japanese or Thai, unless inner_start lets inner entries start it; texts of any length count whole; repeated rows
repeat; extra columns pass through and an existing output column is replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.llm.common import map_texts

CACHE = 400_000
NONE = -1


class PieceCounter(dict):
    """Number of greedy word-pieces of a word (as bytes); a dict that fills itself, bounded by CACHE.

    initial: entries that may start a word; inner: entries that may stand later in one. With inner_start, a
    word that no initial entry starts is cut into inner ones from its start on.
    """

    def __init__(self, initial: set[bytes], inner: set[bytes], inner_start: bool = False):
        super().__init__()
        self.inner_start = inner_start
        self.next: list[dict[int, int]] = [{}, {}]  # the roots: a word's start, and its inside
        self.entry = [False, False]
        for root, entries in ((0, initial), (1, inner)):
            for entry in entries:
                node = root
                for byte in entry:
                    if byte not in self.next[node]:
                        self.next[node][byte] = len(self.next)
                        self.next.append({})
                        self.entry.append(False)
                    node = self.next[node][byte]
                self.entry[node] = True
        self.link, self.popped = [NONE] * len(self.next), [0] * len(self.next)
        level = [0, 1]
        while level:
            below = []
            for node in level:
                for byte, child in self.next[node].items():
                    below.append(child)
                    if self.entry[child]:
                        self.link[child], self.popped[child] = 1, 1
                        continue
                    at, count = self.link[node], self.popped[node]
                    while at != NONE and byte not in self.next[at]:
                        count += self.popped[at]
                        at = self.link[at]
                    if at != NONE:
                        self.link[child], self.popped[child] = self.next[at][byte], count
            level = below

    def count(self, word: bytes) -> int:
        found = self.pieces(word, 0)
        if self.inner_start and not found and not self.starts(word):
            found = self.pieces(word, 1)
        return found or 1

    def starts(self, word: bytes) -> bool:
        """Whether an entry that may start a word starts this one."""
        node = 0
        for byte in word:
            if byte not in self.next[node]:
                return False
            node = self.next[node][byte]
            if self.entry[node]:
                return True
        return False

    def pieces(self, word: bytes, node: int) -> int:
        """Pieces from this root on; 0 if a part matches no entry."""
        total = 0
        for byte in word:
            while byte not in self.next[node]:
                if self.link[node] == NONE:
                    return 0
                total += self.popped[node]
                node = self.link[node]
            node = self.next[node][byte]
        while node != 1:
            if self.link[node] == NONE:
                return 0
            total += self.popped[node]
            node = self.link[node]
        return total

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        found = self.count(word)
        if len(word) <= 64:
            self[word] = found
        return found


@lru_cache(maxsize=4)
def counter(path: str, inner_start: bool = False) -> PieceCounter:
    """From a rank file: entries that begin with a space start words, all others stand inside them."""
    with open(path, "rb") as lines:
        entries = [base64.b64decode(line.split()[0]) for line in lines]
    initial = {e[1:] for e in entries if e[:1] == b" " and len(e) > 1 and b" " not in e[1:]}
    return PieceCounter(initial, {e for e in entries if e.strip() == e}, inner_start)


def count_tokens(docs: DataFrame, path: str, text: str = "text", out: str = "n_tokens", inner_start: bool = False) -> DataFrame:
    """Append the number of word-pieces in each whole text."""

    def make():
        pieces = counter(path, inner_start)
        return lambda texts: [pa.array([sum(map(pieces.__getitem__, (t or "").encode().split())) for t in texts], pa.int64())]

    return map_texts(docs.drop(out), text, f"{out} long", make)
