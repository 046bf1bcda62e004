"""Chat formatting by incremental rendering of a template that is a black box.

A template is any function from a list of (role, text) to a string. The turns are rendered once for each
prefix of them; what one prefix's output has beyond the one before it is the span of its last turn. If an
output doesn't hold the one before it whole, but for a closing stretch that stays at the end, the template
rewrites history: the place is reported and no spans are given, since they would point at text that
changed. Where a turn's text lies inside its span is found by rendering the same prefix with two
different one-letter texts in its place: what those have in common is the template's. Texts of learned
roles make the loss mask.

Rendering all prefixes costs the square of a conversation's length. Conversations are therefore cut into
segments of at most `segment` consecutive turns and about `chars` characters, each rendered as one; a
template's opening or closing text comes once for each segment, and history is that of the segment. Turns
are dealt out by conversation and block of `segment` turn numbers, and streamed in order, so that neither
a huge conversation nor many turns of one number fill a task's memory or keep one task busy alone.

TURNS marks each turn's start and end, and writes a backslash before marks and backslashes inside texts;
read() gives the turns back.

Edge cases: null texts and roles are empty; rows without a conversation id make one conversation of their
own; turns without a number come first; turns of the same number follow by role, then text; repeated
rows are turns of their own; an empty table gives an empty result; extra columns aren't read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

#: Texts that no template treats apart.
PROBES = ("\ue000", "\ue001")
SPAN = pa.struct([("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("learned", pa.bool_())])
SPANS = "array<struct<role:string,start:bigint,end:bigint,text_start:bigint,text_end:bigint,learned:boolean>>"

LABELS = {"system": "System", "user": "User", "assistant": "Assistant"}
ROLES = {label: role for role, label in LABELS.items()}
OPEN, CLOSE = "### ", "</turn>"
CONTROL = re.compile(rf"\\|{OPEN}|{CLOSE}")
TURN = re.compile(rf"(?s){OPEN}((?:[^\\:]|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+){CLOSE}\n")


def escaped(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescaped(text: str) -> str:
    return re.sub(r"(?s)\\(.)", r"\1", text)


def turns(given: list[Turn]) -> str:
    """'### User: text</turn>' lines; a role without a label is written out behind an equals sign."""
    label = lambda role: LABELS.get(role) or "=" + re.sub(r"[\\:]", lambda m: "\\" + m[0], role)
    return "".join(f"{OPEN}{label(role)}: {escaped(text)}{CLOSE}\n" for role, text in given)


def read(text: str) -> Iterator[Turn]:
    """The turns of a text that turns() made; ValueError for any other."""
    at = 0
    while at < len(text):
        if not (m := TURN.match(text, at)):
            raise ValueError(f"no turn at {at}")
        yield ROLES[m[1]] if m[1] in ROLES else unescaped(m[1][1:]), unescaped(m[2])
        at = m.end()


def shared(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def shared_end(a: str, b: str) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        middle = (low + high + 1) // 2
        if a[len(a) - middle : len(a) - low] == b[len(b) - middle : len(b) - low]:
            low = middle
        else:
            high = middle - 1
    return low


def added(before: str, after: str, done: int) -> tuple[int, int] | None:
    """The one stretch put into before, behind its first done characters; None if after is no such text. Where several
    places give the same text, the first counts."""
    grown = len(after) - len(before)
    if grown < 0:
        return None
    start = len(before) if after.startswith(before) else max(len(before) - shared_end(before, after), done)
    return (start, start + grown) if start <= shared(before, after) else None


def locate(template: Template, given: list[Turn], learned: tuple[str, ...] = ("assistant",)) -> tuple[str, list[dict] | None, int | None]:
    """The rendered text, a span for each turn, and the first turn (from 0) whose rendering changed what stood before it; spans are None then."""
    before, spans, done = template([]), [], 0
    for k, (role, text) in enumerate(given):
        after = template(given[: k + 1])
        span = added(before, after, done)
        if span is None:
            return template(given), None, k
        one, two = (template([*given[:k], (role, probe)]) for probe in PROBES)
        head, tail = shared(one, two), shared_end(one, two)
        stop = len(after) - tail
        shown = one != two and span[0] <= head <= stop <= span[1] and after[:head] == one[:head] and after[stop:] == one[len(one) - tail :]
        spans.append({"role": role, "start": span[0], "end": span[1], "text_start": head if shown else None, "text_end": stop if shown else None, "learned": shown and role in learned})
        before, done = after, span[1]
    return before, spans, None


def format_conversations(
    rows: DataFrame, template: Template = turns, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learned: tuple[str, ...] = ("assistant",), segment: int = 256, chars: int = 1 << 20
) -> DataFrame:
    """key, block, piece (the order of a conversation's segments), text, spans, rewritten_at: one row for each segment.

    spans: role, start, end, text_start, text_end (code points of text; null where the template doesn't show
    the turn's text as it shows others), learned."""
    kind = rows.schema[key].dataType.simpleString()
    number = F.col(turn).cast("long")
    plain = rows.select(F.col(key).alias("key"), F.floor(number / segment).cast("long").alias("block"), number.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    dealt = plain.repartition("key", "block").sortWithinPartitions("key", "block", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, piece, given, size = None, 0, [], 0
        key_type = None

        def made() -> pa.RecordBatch:
            shown, spans, rewritten = locate(template, given, learned)
            columns = [pa.array([own[0]], key_type), pa.array([own[1]], pa.int64()), pa.array([piece], pa.int64()), pa.array([shown]), pa.array([spans], pa.list_(SPAN)), pa.array([rewritten], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["key", "block", "piece", "text", "spans", "rewritten_at"])

        for batch in batches:
            key_type = batch.schema.field(0).type
            for k, b, r, t in zip(*[batch.column(c).to_pylist() for c in (0, 1, 3, 4)], strict=True):
                if own != (k, b) or len(given) >= segment or size + len(t) > chars:
                    if given:
                        yield made()
                    piece = piece + 1 if own == (k, b) and given else 0
                    own, given, size = (k, b), [], 0
                given.append((r, t))
                size += len(t)
        if given:
            yield made()

    out = dealt.mapInArrow(run, f"key {kind}, block long, piece long, text string, spans {SPANS}, rewritten_at long")
    return out.withColumnRenamed("key", key)


def digests(segments: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of segments formatted by turns(), read back from them.

    A hash of a whole conversation takes its text in order: segments of one conversation are streamed through one
    task, one batch in memory at a time; all rendering was done before, by segment."""
    kind = segments.schema[key].dataType.simpleString()
    dealt = segments.select(F.col(key).alias("key"), "block", "piece", "text", "spans").repartition("key").sortWithinPartitions("key", "block", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [None, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        own, begun = None, False
        n, chars, size, all_turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        done: list[tuple] = []
        for batch in batches:
            types[0] = batch.schema.field(0).type
            for k, shown, spans in zip(*[batch.column(c).to_pylist() for c in (0, 3, 4)], strict=True):
                if not begun or k != own:
                    if begun:
                        done.append((own, n, all_turns.hexdigest(), chars, loss.hexdigest(), size))
                    own, begun = k, True
                    n, chars, size, all_turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in read(shown):
                    all_turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                for span in spans:
                    if span["learned"]:
                        text = unescaped(shown[span["text_start"] : span["text_end"]])
                        loss.update(text.encode())
                        chars += len(text)
                size += len(shown)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
                done = []
        if begun:
            last = (own, n, all_turns.hexdigest(), chars, loss.hexdigest(), size)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types, strict=True)], names=names)

    out = dealt.mapInArrow(run, f"key {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("key", key)


#: The rows that op13 adds, and its result for DuckDB.
ADDED = ((-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"))
CHAT_SQL = r"""WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))),
w AS (SELECT *, CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 1 + length(regexp_replace(role, '([\\:])', '\\\1', 'g')) END
  + length(regexp_replace(text, '(\\|### |</turn>)', '\\\1', 'g')) + length('### : </turn>') + 1 AS size FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM w GROUP BY conv_id"""
