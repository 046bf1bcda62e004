"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every byte prefix of a piece, the last token of that prefix's encoding is unique: it is the one
token that ends there and stands validly after the last token of the shorter prefix. Keeping the last
tokens of all prefixes makes appending exact, and lets an edit recompute only what lies near it. The
different short pieces of a batch are worked on together, one prefix length after the other, in numpy.

A pair of tokens stands validly when encoding their joined bytes gives just that pair. That is decided
by undoing the merges of both tokens, the later one first, and looking whether a merge across their
border would have come earlier than the one just undone.

Edge cases: a null text encodes like an empty one, to no ids; null ids decode to empty bytes; ids
outside the vocabulary raise KeyError; texts of any length are encoded whole; repeated rows give
repeated results; extra columns pass through, and an existing column named like an output is replaced.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm.common import map_texts

#: Words of which a worker keeps the ids, in each of two generations; results don't depend on it.
WORDS = 200_000
#: Words of more characters are known for one batch only, so that what is kept is bounded in bytes too.
LONGEST = 64
#: Texts that are worked on together.
STEP = 128
#: Pair tests that a worker keeps: two to the power of this.
PAIR_BITS = 20
#: Pieces of more bytes are worked on alone.
PIECE = 24
NONE = 1 << 60


class ByteBPE:
    """A vocabulary of ranks, with exact encoding of byte pieces.

    spaced promises that pattern never matches across the start of a single space, or either side of a
    single newline, that stands between other characters. Texts are then cut there before the pattern
    is tried, so that it sees each different word just once.
    """

    def __init__(self, path: str, pattern: str, spaced: bool = False):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.split, self.spaced = regex.compile(pattern), spaced
        self.longest = max(map(len, self.ranks))
        self.ends = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self.ends.make_automaton()
        self.lengths = np.zeros(max(self.tokens) + 1, np.int64)
        self.lengths[list(self.tokens)] = [len(t) for t in self.tokens.values()]
        self.made: dict[int, tuple[int, ...] | None] = {}
        self.valid: dict[tuple[int, int], bool] = {}
        self.pair_keys = np.full(1 << PAIR_BITS, -1, np.int64)
        self.pair_valid = np.zeros(1 << PAIR_BITS, bool)
        self.words: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}
        self.long: list[str] = []
        self.edges, self.child, self.entry = self.trie()

    def trie(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The vocabulary's trie: its edges as sorted numbers 256 * node + byte, the node each leads to, and each node's token or -1."""
        edges: dict[int, int] = {}
        entry = [-1]
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                node = edges.setdefault(node << 8 | byte, len(entry))
                if node == len(entry):
                    entry.append(-1)
            entry[node] = rank
        order = np.sort(np.fromiter(edges, np.int32, len(edges)))
        return order, np.fromiter(map(edges.__getitem__, order.tolist()), np.int32, len(order)), np.array(entry, np.int32)

    def below(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes that edges lead to; 0 where there is none."""
        edge = node << 8 | byte
        at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
        return np.where(self.edges[at] == edge, self.child[at], 0)

    def merged(self, data: bytes, least: int = 1) -> list[int]:
        """The plain merging procedure, until `least` parts are left; for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        rank_of = self.ranks.get
        while len(parts) > least:
            found = [rank_of(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
            low = min(found)
            if low == NONE:
                break
            at = found.index(low)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def parts_of(self, token: int) -> tuple[int, ...] | None:
        """The two tokens whose merge makes this one, () for a byte; None unless all merges below it come in the order of ranks."""
        if token not in self.made:
            data, parts = self.tokens[token], ()
            if len(data) > 1:
                parts = tuple(self.merged(data, 2))
                if len(parts) != 2 or max(parts) >= token or None in map(self.parts_of, parts):
                    parts = None
            self.made[token] = parts
        return self.made[token]

    def stands(self, a: int, b: int) -> bool:
        """Whether the joined bytes of the tokens encode to just these two."""
        tokens, rank_of, parts_of = self.tokens, self.ranks.get, self.parts_of
        of_a, of_b = parts_of(a), parts_of(b)
        if of_a is None or of_b is None:
            return self.merged(tokens[a] + tokens[b]) == [a, b]
        limit = NONE
        while True:
            if rank_of(tokens[a] + tokens[b], NONE) < limit:
                return False
            # Of equal merges the left one comes first, so the right one is undone first, and one across would have beaten it.
            if of_a and (a > b or not of_b):
                limit, a = a, of_a[1]
                of_a = parts_of(a)
            elif of_b:
                limit, b = b + 1, of_b[0]
                of_b = parts_of(b)
            else:
                return True

    def follows(self, before: int, token: int) -> bool:
        """Whether token may stand after before; -1 is the start of the piece."""
        if before >= 0:
            return self.stands(before, token)
        return self.parts_of(token) is not None or self.merged(self.tokens[token]) == [token]

    def all_follow(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """follows() of many pairs; what it answered is kept until another pair takes the place."""
        key = (before.astype(np.int64) + 1 << 32) + token
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        valid = self.pair_valid[slot]
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            keys, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = np.array([self.follows((k >> 32) - 1, k & 0xFFFFFFFF) for k in keys.tolist()], bool)
            valid[new] = found[back]
            self.pair_keys[slot[new[first]]], self.pair_valid[slot[new[first]]] = keys, found
        return valid

    def extend(self, piece: bytes, last: list[int], settled=None) -> list[int]:
        """Fill last, which holds the last token of each prefix so far, up to the whole piece.

        settled(i) may say that the rest is known already; then extending stops after prefix i.
        """
        done = len(last)
        start = max(0, done - self.longest)
        at = done
        for end, (token, length) in self.ends.iter(piece[start:].decode("latin-1")):
            end += start
            if end == at and self.follows_again(last[end - length] if end >= length else -1, token):
                last.append(token)
                at += 1
                if settled and settled(at):
                    break
        return last

    def follows_again(self, before: int, token: int) -> bool:
        known = self.valid.get((before, token))
        if known is None:
            if len(self.valid) >= 1 << PAIR_BITS - 3:
                self.valid.clear()
            known = self.valid[before, token] = self.follows(before, token)
        return known

    def last_tokens(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Row k: the last token of each prefix of pieces[k]; and the pieces' sizes, which must ascend. For short pieces."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(sizes[-1])
        data = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(-1, width)
        last = np.full((len(pieces), width + 1), -1, np.int32)  # column 0: the empty prefix
        for first in range(width):
            rows = np.arange(np.searchsorted(sizes, first, "right"), len(pieces))
            node = np.zeros(len(rows), np.int32)
            for end in range(first + 1, width + 1):
                node = self.below(node, data[rows, end - 1])
                on = (node > 0) & (sizes[rows] >= end)
                rows, node = rows[on], node[on]
                token = self.entry[node]
                some = np.flatnonzero(token >= 0)
                if len(some):
                    fits = some[self.all_follow(last[rows[some], first], token[some])]
                    last[rows[fits], end] = token[fits]
                if not len(rows):
                    break
        return last[:, 1:], sizes

    def encode_pieces(self, pieces: set[str]) -> dict[str, bytes]:
        """The packed 32-bit ids of different pieces."""
        out, short = {}, []
        for piece in pieces:
            data = piece.encode()
            whole = self.ranks.get(data)
            if whole is not None:
                out[piece] = whole.to_bytes(4, "little")
            elif len(data) <= PIECE:
                short.append((len(data), data, piece))
            else:
                out[piece] = array("i", self.ids_of(self.extend(data, []))).tobytes()
        short.sort()
        for at in range(0, len(short), 1 << 16):
            part = short[at : at + (1 << 16)]
            last, sizes = self.last_tokens([data for _, data, _ in part])
            ids = np.zeros_like(last)
            left, used, rows = sizes.copy(), np.full(len(part), last.shape[1]), np.arange(len(part))
            while len(rows):  # walk back from each whole piece's last token
                token = last[rows, left[rows] - 1]
                used[rows] -= 1
                ids[rows, used[rows]] = token
                left[rows] -= self.lengths[token]
                rows = rows[left[rows] > 0]
            packed, row = ids.tobytes(), 4 * last.shape[1]
            for k, (begin, (_, _, piece)) in enumerate(zip((4 * used).tolist(), part, strict=True)):
                out[piece] = packed[k * row + begin : (k + 1) * row]
        return out

    def ids_of(self, last: list[int]) -> list[int]:
        """Walk back from the whole piece's last token."""
        out, at = [], len(last)
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(self.tokens[token])
        return out[::-1]

    def learn(self, words: set[str]) -> None:
        """Add the packed ids of new words; None for a word that touches other white space than the one before it."""
        if len(self.words) + len(words) > WORDS:
            self.words, self.older = {w: self.words[w] for w in words & self.words.keys()}, self.words
        new, split, pieces = words - self.words.keys(), {}, set()
        self.long = [w for w in new if len(w) > LONGEST]
        for word in new:
            if word in self.older:
                self.words[word] = self.older[word]
                continue
            plain = word.removeprefix("\n")
            if not plain or plain[0].isspace() or plain[-1].isspace():
                self.words[word] = None
                continue
            split[word] = [" " + word] if word.isalpha() else self.split.findall(word if len(plain) < len(word) else " " + word)
            pieces.update(split[word])
        known = self.encode_pieces(pieces)
        for word, own in split.items():
            self.words[word] = known[own[0]] if len(own) == 1 else b"".join([known[p] for p in own])

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        packed: list[bytes | None] = [None] * len(texts)
        if self.spaced:
            # The first word follows no space: it is cut off with a mark that no word begins with.
            cut = [(t or "").replace("\n", " \n").split(" ") for t in texts]
            self.learn(set().union(*[c[1:] for c in cut]))
            firsts = self.encode_whole([c[0] for c in cut])
            word = self.words.__getitem__
            for k, (first, c) in enumerate(zip(firsts, cut, strict=True)):
                rest = list(map(word, c[1:]))
                if None not in rest and not c[0][-1:].isspace():
                    packed[k] = b"".join([first, *rest])
        open_ = [k for k, p in enumerate(packed) if p is None]
        for k, ids in zip(open_, self.encode_whole([texts[k] or "" for k in open_]), strict=True):
            packed[k] = ids
        for word in self.long:
            del self.words[word]
        self.long = []
        return [np.frombuffer(p, np.int32) for p in packed]

    def encode_whole(self, texts: list[str]) -> list[bytes]:
        """The packed ids of texts, by the pattern alone."""
        split = [self.split.findall(t) for t in texts]
        known = self.encode_pieces(set().union(*split))
        return [b"".join([known[p] for p in own]) for own in split]

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]


class Decoder:
    """The bytes of each id in one Arrow array, from which rows of ids are gathered at once."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            tokens = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
        self.table = pa.array([tokens.get(k) for k in range(max(tokens) + 1)], pa.large_binary())
        self.known = np.array([k in tokens for k in range(max(tokens) + 1)])

    def decode(self, flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """Row k's ids are flat[offsets[k] : offsets[k + 1]]."""
        n = len(offsets) - 1
        if not len(flat):
            return pa.array([b""] * n, pa.binary())
        if flat.min() < 0 or flat.max() >= len(self.table) or not self.known[flat].all():
            raise KeyError("an id is not in the vocabulary")
        taken = self.table.take(pa.array(flat))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(flat) + 1]
        return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(ends[offsets].copy()), taken.buffers()[2]]).cast(pa.binary())


@lru_cache(maxsize=4)
def decoder(path: str) -> Decoder:
    return Decoder(path)


class EditablePiece:
    """One piece's bytes with the last token of each prefix: exact appends, edits re-encode near the change."""

    def __init__(self, bpe: ByteBPE, data: bytes = b""):
        self.bpe, self.data, self.last, self.work = bpe, b"", [], 0
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)
        self.work = len(more)

    def edit(self, at: int, remove: int, insert: bytes) -> None:
        """Replace remove bytes at at. Prefixes before at stand; after the change, once as many last tokens
        in a row as the longest token has bytes equal the former ones, all later ones do too."""
        bpe, old = self.bpe, self.last
        tail_from = at + remove
        self.data = self.data[:at] + insert + self.data[tail_from:]
        last, shift = old[:at], len(insert) - remove
        run = 0

        def settled(prefix: int) -> bool:
            nonlocal run
            before = prefix - shift
            run = run + 1 if before > tail_from and old[before - 1] == last[prefix - 1] else 0
            return run >= bpe.longest and before - run >= tail_from

        bpe.extend(self.data, last, settled)
        self.work = len(last) - at
        if len(last) < len(self.data):
            last += old[len(last) - shift :]
        self.last = last

    @property
    def ids(self) -> list[int]:
        whole = self.bpe.ranks.get(self.data)
        return [whole] if whole is not None else self.bpe.ids_of(self.last)


@lru_cache(maxsize=4)
def vocabulary(path: str, pattern: str, spaced: bool) -> ByteBPE:
    """One vocabulary for each worker process, whatever number of tasks it runs."""
    return ByteBPE(path, pattern, spaced)


def joined(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All rows one after the other, and where each begins and ends."""
    offsets = np.zeros(len(rows) + 1, np.int32)
    np.cumsum([len(r) for r in rows], out=offsets[1:])
    return np.concatenate([np.empty(0, np.int32), *rows]), offsets


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", spaced: bool = False) -> DataFrame:
    """Append the token ids of each whole text. path is a rank file that every executor can open; spaced as for ByteBPE."""

    def make():
        bpe = vocabulary(path, pattern, spaced)

        def work(texts: list) -> list[pa.Array]:
            flat, offsets = joined(bpe.encode_all(texts))
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

        return work

    return map_texts(docs.drop(ids), text, f"{ids} array<int>", make, STEP)


def decode_documents(docs: DataFrame, path: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """Append the bytes that each row's ids stand for."""

    def make():
        return lambda rows: [decoder(path).decode(*joined([np.array(r or [], np.int32) for r in rows]))]

    return map_texts(docs.drop(data), ids, f"{data} binary", make, STEP)


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", data: str = "decoded", spaced: bool = False) -> DataFrame:
    """Append the token ids of each whole text and the bytes that these ids decode to, in one pass."""

    def make():
        bpe = vocabulary(path, pattern, spaced)

        def work(texts: list) -> list[pa.Array]:
            flat, offsets = joined(bpe.encode_all(texts))
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoder(path).decode(flat, offsets)]

        return work

    return map_texts(docs.drop(ids, data), text, f"{ids} array<int>, {data} binary", make, STEP)
