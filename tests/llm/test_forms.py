"""Fill-in-middle, hard negatives and chat formatting against brute force, on odd rows too."""

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, fim, negatives, queries


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fill-in-middle -----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    lines = lambda n, most: "".join("é日x "[rnd.randrange(4)] * rnd.randrange(most) + "\n" for _ in range(n))
    long = lines(3000, 90) + "x" * 100_000 + "\n" + lines(2000, 5) + "no end"
    return [None, "", "\n", "\n\n\n", "one", "one\ntwo", "one\ntwo\n", "a <P> b\n", "<S>", "x\n<M>", "ends with <", "P>\nS>\nM>\n<\n", "r\r\n \x0b\x0c\x85 not ends", lines(7, 4), lines(300, 200), long, "same\ntext\n", "same\ntext\n", *[lines(rnd.randrange(12), 9) + "z" * (k % 2) for k in range(60)]]


def cut_by_hand(key, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(m in text for m in fim.MARKS):
        return key, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    spm = h4 % 100 < 50
    return key, n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_by_hand(spark, texts):
    rows = [(k if k else None, t, 1, "q", "h") for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[9]], "doc_id long, text string, n int, form string, h1 string")
    made = fim.fill_in_middle(docs).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in made))) == sorted(str(cut_by_hand(r[0], r[1])) for r in [*rows, rows[9]])
    given = {k: t or "" for k, t, *_ in rows}
    assert all(r["back"] == given[r["doc_id"]] for r in made)
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(docs.where("false")).count() == 0
    shares = fim.fill_in_middle(docs, rate=0).select("form").distinct().collect()
    assert [r[0] for r in shares] == ["plain"]


def packed(texts):
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def test_the_index_is_exact_and_its_pieces_bounded(texts):
    given = [t or "" for t in texts]
    for bound in (0, 3, 127):
        data, at = packed(given)
        index = fim.RankIndex(data, at, bound)
        for d, text in enumerate(given):
            bounds = np.cumsum([0, *(len(u.encode()) for u in re.findall(r"[^\n]*\n|[^\n]+", text))])
            assert index.n[d] == len(bounds) - 1
            ranks = np.arange(len(bounds))
            assert (index.cut(np.full(len(ranks), d), ranks) == bounds).all()
        assert np.abs(index.residuals.astype(int)).max() <= bound
    assert len(index.knots) < len(index.residuals) / 4  # straight pieces stand for many bounds


def test_a_stored_index_cuts_without_the_text(spark, texts):
    rows = list(enumerate(texts))
    for r in fim.rank_index(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        bounds = np.cumsum([0, *(len(u.encode()) for u in re.findall(r"[^\n]*\n|[^\n]+", texts[r["doc_id"]] or ""))])
        knots = [(k["rank"], k["offset"]) for k in r["knots"]]
        held = np.frombuffer(bytes(r["residuals"]), np.int8)
        assert len(held) == r["n"] + 1 == len(bounds) and knots[0] == (0, 0) and knots[-1][0] == r["n"]
        for (a, x), (b, y) in zip(knots, knots[1:]):
            assert [x + (k - a) * (y - x) // (b - a) + int(held[k]) for k in range(a, b + 1)] == bounds[a : b + 1].tolist()


def test_batches_are_cut_into_portions(monkeypatch, texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["k", "t"]).slice(3)
    monkeypatch.setattr(fim, "STEP", 50)
    parts = list(fim.portions(batch, 1))
    assert len(parts) > 5 and sum(len(p) for p, _, _ in parts) == len(batch)
    for part, data, at in parts:
        assert [data[a:b].tobytes().decode() for a, b in zip(at, at[1:])] == [t or "" for t in part.column(1).to_pylist()]


# --- hard negatives -----------------------------------------------------------------------------


def mined_by_hand(rows, k=10, positives=5):
    fit, seen = [], {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [min(max(math.floor(256 * x), -negatives.LARGEST), negatives.LARGEST) for x in v]
            seen[i] = min(seen.get(i, (str(label), q)), (str(label), q))
    fit = [(i, label, q) for i, (label, q) in seen.items()]
    out = []
    for a, label, q in fit:
        if a % 5:
            continue
        scored = [(sum(x * y for x, y in zip(q, p)), i, other == label) for i, other, p in fit if i != a and len(p) == len(q)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, i, _ in [s for s in scored if s[2]][:positives]:
            inside = [s for s in scored if not s[2] and 30 * p <= 100 * s[0] <= 90 * p][:k]
            out += [(a, i, r + 1, j, p, s) for r, (s, j, _) in enumerate(inside)]
    return sorted(out)


def test_hard_negatives_by_hand(spark):
    rnd = np.random.default_rng(8)
    centre = rnd.standard_normal(8)
    rows = [(k, [float(np.float32(x)) for x in centre * 0.5 + rnd.standard_normal(8) * 0.6], k % 3 if k % 2 else 0) for k in range(500)]
    rows += [(500 + k, rows[7][1], k % 2) for k in range(300)]  # a large group of copies with two labels
    rows += [(900 + k, [float(x) for x in rnd.integers(-2, 3, 8) / 4], k % 3) for k in range(200)]  # many ties
    rows += [(2000, None, 1), (2005, [None] * 8, 1), (2010, [math.nan] * 8, 1), (2015, [math.inf] * 8, 1), (2020, [1.0] * 8, None), (None, [1.0] * 8, 1)]
    rows += [(3000, [], 1), (3001, [], 2), (3005, [1.0, 2.0], 7), (3006, [1.0, 1.0], 7), (3007, [0.5, 0.5], 8), (3010, [1e30] * 3, 1), (3011, [1e30] * 3, 1), (3012, [1e29, 1.0, -1e8], 2)]
    rows += [(4000, [-5.0] * 8, 9), (4005, [5.0] * 8, 9), (4010, [0.0] * 8, 9), rows[10], (15, [2.0] * 8, 2)]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, part int, score int")
    float32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    want = mined_by_hand(float32)
    for block in (16384, 150):
        found = negatives.hard_negatives(table, F.col("vec_id") % 5 == 0, block=block)
        assert sorted(map(tuple, found.collect())) == want
    assert len(want) > 1000
    assert negatives.hard_negatives(table.where("false"), F.col("vec_id") % 5 == 0).count() == 0


def test_products_are_exact():
    big = np.array([[negatives.LARGEST, -negatives.LARGEST + 1, 3]], np.int64)
    assert negatives.products(big, big)[0, 0] == sum(int(x) ** 2 for x in big[0])


# --- chat formatting ----------------------------------------------------------------------------


ODD = ["", "\\", "\\\\", "</turn>", "<", "</", "### ", "#### User: x", r"\### Assistant: </turn> ok", "a: b", "line\n\n", " ", "", "=user", "日本 \U0001f600", "x" * 300]


def test_turns_are_read_back():
    given = [(role, text) for role in ("user", "assistant", "system", "", "User", "tool: x\\", "=") for text in ODD]
    text, spans, rewritten = chat.locate(chat.turns, given)
    assert list(chat.read(text)) == given and rewritten is None
    assert [s["start"] for s in spans] == [0, *(s["end"] for s in spans[:-1])] and spans[-1]["end"] == len(text)
    assert [chat.unescaped(text[s["text_start"] : s["text_end"]]) for s in spans] == [t for _, t in given]
    assert [s["learned"] for s in spans] == [r == "assistant" for r, _ in given]
    with pytest.raises(ValueError):
        list(chat.read(text + "x"))


def test_templates_of_other_kinds():
    given = [("user", "ab"), ("assistant", "b "), ("user", "x"), ("assistant", "")]
    wrapped = lambda turns: "<s>" + "".join(f"[{r}] {t} |" for r, t in turns) + "</s>"
    text, spans, rewritten = chat.locate(wrapped, given)
    assert rewritten is None and text == wrapped(given)
    assert [text[s["text_start"] : s["text_end"]] for s in spans] == [t for _, t in given]
    counted = lambda turns: f"{len(turns)} turns\n" + wrapped(turns)
    assert chat.locate(counted, given) == (counted(given), None, 0)
    last_only = lambda turns: "".join(f"{r}: {t if k == len(turns) - 1 or r == 'user' else '...'}\n" for k, (r, t) in enumerate(turns))
    assert chat.locate(last_only, given)[1:] == (None, 2)
    merged = lambda turns: "\n".join(t for _, t in reversed(turns))
    assert chat.locate(merged, given)[1:] == (None, 1)
    trimmed = lambda turns: "".join(f"{r}: {t.strip()}\n" for r, t in turns)
    text, spans, _ = chat.locate(trimmed, given)
    assert text[spans[1]["text_start"] : spans[1]["text_end"]] == "b"
    hidden = lambda turns: "".join(f"{r}\n" for r, _ in turns)
    assert all(s["text_start"] is None and not s["learned"] for s in chat.locate(hidden, given)[1])


def test_formatting_by_hand(spark):
    rnd = random.Random(6)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "tool", None]), rnd.choice([*ODD, None])) for c in (1, 2, 3, None) for t in range(rnd.randrange(1, 40))]
    rows += [(9, t, "assistant" if t % 2 else "user", f"turn {t} " + "é" * (t % 7)) for t in range(1500)]
    rows += [(10, 5, "user", f"t{k % 50}") for k in range(120)] + [(11, None, "user", "first"), (11, -3, "assistant", "second"), (11, 10**12, "user", "third"), rows[0]]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, block int, spans string")
    for segment in (256, 16):
        made = chat.format_conversations(table, segment=segment)
        assert all(len(r["spans"]) <= segment and r["rewritten_at"] is None for r in made.collect())
        found = {r[0]: tuple(r)[1:] for r in chat.digests(made).collect()}
        assert set(found) == {r[0] for r in rows}
        for key, own in found.items():
            order = sorted((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == key)
            said = [t for *_, r, t in order if r == "assistant"]
            assert own[:4] == (len(order), sha("".join(f"{r}\n{t}\n" for *_, r, t in order)), sum(map(len, said)), sha("".join(said)))
            assert own[4] == len(chat.turns([(r, t) for *_, r, t in order]))
    assert chat.digests(chat.format_conversations(table.where("false"))).count() == 0


def test_long_segments_are_cut_by_characters(spark):
    rows = [(1, t, "user", "x" * 400) for t in range(10)]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), chars=1000)
    assert sorted((r["piece"], len(r["spans"])) for r in made.collect()) == [(k, 2) for k in range(5)]


def test_a_template_that_rewrites_is_reported(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "c")]
    numbered = lambda turns: f"{len(turns)}" + "".join(t for _, t in turns)
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), numbered)
    assert sorted((r["conv_id"], r["text"], r["spans"], r["rewritten_at"]) for r in made.collect()) == [(1, "2ab", None, 0), (2, "1c", None, 0)]


def test_the_added_conversation(spark):
    found = {r["conv_id"]: r for r in queries.op13_chat_formatting(spark, "/root/testdata/sf0.001").collect()}
    text = chat.ADDED[0][3]
    assert found[-7]["turns_sha256"] == sha(f"user\n{text}\nassistant\n{text}\n") and found[-7]["loss_sha256"] == sha(text)
