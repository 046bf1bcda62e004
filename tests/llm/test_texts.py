"""The operators on texts against brute-force versions, on odd rows: nulls, empties, repeats, clashing columns."""

import base64
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash

from quarry.llm import bpe, langid, licenses, mixing, queries, simhash, substring, toxicity, wordpiece

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(queries.VOCABULARY)
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    """doc_id, text, lang, source, n_chars, and columns whose names operators use themselves."""
    rnd = random.Random(5)
    vocabulary = ["the", "of", "tion", "élan", "日本", "x", "reing", "edsh", "and,", "Onha."]
    prose = [" ".join(rnd.choice(vocabulary) + str(rnd.randrange(40)) for _ in range(n)) for n in (1, 2, 20, 34, 35, 36, 80, 150, 400)]
    shared = " ".join(f"w{k}" for k in range(60))
    texts = [None, "", " \t\n\r\x0b\x0c", "...", "12 34", "a", "A b", *prose, *prose[6:], prose[8] + "\n" + shared, "q " * 5 + shared, shared + " tail", "same " * 120, "one two three " * 60, prose[7].upper(), prose[7].replace("x", "y", 1), "é 　b \U0001d400\U0001f600 c", "It's we'll  I'm\n\n\n   end  "]
    rows = [(k * 7, t, (None, "en", "fr")[k % 3], (None, "b", "a", "a", "é")[k % 5], len(t or ""), "w", 1, 2) for k, t in enumerate(texts)]
    rows += [rows[9], (None, prose[5], "en", "a", 1, "w", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, size int, ids int")


def empty(docs):
    return docs.where("false")


def test_bpe_is_exact(docs):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.decode_documents(bpe.encode_documents(docs, PATH, public_tokenizers.PATTERN), PATH).collect()
    assert len(coded) == docs.count()
    for row in coded:
        assert row["ids"] == exact.encode_ordinary(row["text"] or "")
        assert bytes(row["decoded"]) == (row["text"] or "").encode()
    assert bpe.encode_documents(empty(docs), PATH, public_tokenizers.PATTERN).count() == 0


def test_bpe_edits_equal_encoding_anew():
    vocabulary, rnd = bpe.ByteBPE(PATH, public_tokenizers.PATTERN), random.Random(2)
    for _ in range(150):
        piece = bpe.EditablePiece(vocabulary, bytes(rnd.choice(b"the ation ingre") for _ in range(rnd.randrange(300))))
        for _ in range(4):
            at = rnd.randrange(len(piece.data) + 1)
            piece.edit(at, rnd.randrange(min(5, len(piece.data) - at) + 1), bytes(rnd.choice(b"the ation") for _ in range(rnd.randrange(5))))
            piece.append(b"ing"[: rnd.randrange(4)])
            assert piece.last == bpe.EditablePiece(vocabulary, piece.data).last
    long = bpe.EditablePiece(vocabulary, b"thing" * 2000)
    long.edit(100, 1, b"e")
    assert long.work < 200 and long.last == bpe.EditablePiece(vocabulary, long.data).last


def test_bpe_of_any_white_space_and_long_pieces():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(3)
    signs = [" ", " ", "\n", "\t", "a", "b's", "'", "1", ".", "é", "\u3000", "\x1c", "\x85", "\r", "日", "ll", "the"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randrange(14))) for _ in range(6000)]
    texts += ["thing" * 200_000, "aaaa" * 400, "x" * 24 + "y" * 25, None, ""]
    spaced = bpe.ByteBPE(PATH, public_tokenizers.PATTERN, True)
    for at in range(0, len(texts), 500):
        for text, ids in zip(texts[at : at + 500], spaced.encode_all(texts[at : at + 500]), strict=True):
            if len(text or "") < 10_000:
                assert ids.tolist() == exact.encode_ordinary(text or "")
            else:  # 1 MB without a break: too long for the other encoder, so by its own bytes and a shorter one's end
                assert bpe.decoder(PATH).decode(ids, [0, len(ids)])[0].as_py() == text.encode()
                assert ids[:500].tolist() == exact.encode_ordinary(text[:4000])[:500]


def test_pair_tests_equal_merging():
    own, rnd = bpe.ByteBPE(PATH, public_tokenizers.PATTERN), random.Random(6)
    tokens = sorted(own.tokens)
    twins = [t for t in tokens if len(set(own.tokens[t])) <= 2]
    for a, b in [(rnd.choice(tokens), rnd.choice(tokens)) for _ in range(4000)] + [(rnd.choice(twins), rnd.choice(twins)) for _ in range(8000)]:
        assert own.stands(a, b) == (own.merged(own.tokens[a] + own.tokens[b]) == [a, b])
    with pytest.raises(KeyError):
        bpe.decoder(PATH).decode(np.array([1 << 20], np.int32), np.array([0, 1]))


def test_op1_over_a_table(spark):
    rows = {r["doc_id"]: r for r in queries.op1_byte_bpe(spark, SMALL).collect()}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = exact.encode_ordinary(row["text"] or "")
        found = rows[row["doc_id"]]
        assert found["n_tokens"] == len(ids)
        assert found["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found["decoded_sha256"] == hashlib.sha256((row["text"] or "").encode()).hexdigest()


def greedy(word, initial, inner):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (initial if at == 0 else inner)), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_word_pieces_are_greedy(docs):
    tokens = [base64.b64decode(line.split()[0]) for line in open(PATH, "rb")]
    initial, inner = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1 and b" " not in t[1:]}, {t for t in tokens if t == t.strip()}
    for row in wordpiece.count_tokens(docs, PATH).collect():
        assert row["n_tokens"] == sum(greedy(w, initial, inner) for w in (row["text"] or "").encode().split())
    rnd = random.Random(4)
    for _ in range(300):
        entries = {bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 5))) for _ in range(8)}
        own = wordpiece.PieceCounter(entries, entries)
        word = bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 14)))
        assert own.count(word) == greedy(word, entries, entries)


def test_language_of_held_out_rows(spark):
    rows = queries.op3_language_id(spark, "/root/testdata/sf0.01").collect()
    lang = {r["doc_id"]: r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(r["lang_pred"] == lang[r["doc_id"]]["lang"] for r in held) > 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_odd_rows(docs):
    model = langid.fit(docs)
    for row in langid.identify(docs, model).collect():
        lettered = any(c.isalpha() for c in row["text"] or "")
        assert (row["lang_pred"] == "und") == (not lettered)
    assert {r["lang_pred"] for r in langid.identify(docs, langid.fit(empty(docs))).collect()} == {"und"}


def test_language_of_rows_without_letters_and_repeats(spark):
    """Nothing to learn from gives und; an id that repeats, with other languages too, is learned from once for each."""
    rows = [(1, "123", "en"), (2, None, "en"), (3, "...", "fr"), (4, "", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert {r["lang_pred"] for r in langid.identify(docs.unionByName(spark.createDataFrame([(9, "the text", None)], docs.schema)), model).collect()} == {"und"}
    rows = [(1, "the thing that", "en")] * 50 + [(1, "ééé èè", "fr")] * 50 + [(2, "777", "de"), (None, "xx", "de")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["en", "fr"] and model.present.shape[0] == 2
    assert model.predict(["that thing", "é è", "", "5" * 100_000])[0] == ["en", "fr", "und", "und"]


def test_kernel_equals_counting_by_hand(docs):
    """Presence kernels against sets of grams, without cells."""
    texts = [r["text"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")][:12]
    found = [np.unique(langid.grams(t)) for t in texts]
    cells = np.unique(np.concatenate(found))
    present = np.array([np.isin(cells, f) for f in found], np.float32)
    values, lettered = langid.Classifier(["x"], cells, present, np.zeros((len(found), 1), np.float32)).kernel(texts)

    def grams_of(text):
        plain = " " + re.sub(r" +", " ", "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text)) + " "
        return {plain[k : k + n] for n in (1, 2, 3) for k in range(len(plain) - n + 1)}

    for i, a in enumerate(map(grams_of, texts)):
        for j, b in enumerate(map(grams_of, texts)):
            assert abs(values[i, j] - len(a & b) / (len(a) * len(b)) ** 0.5) < 0.02
    assert lettered.all()


def capped(sizes, weights):
    """Shares by weight; what exceeds three times a source is shared again."""
    target, closed, left = {}, set(), sum(sizes.values())
    while True:
        free = {s: weights[s] for s in sizes if s not in closed}
        if not free or not left:
            return target | dict.fromkeys(free, 0.0)
        rest = left - sum(3 * sizes[s] for s in closed)
        target = {s: 3.0 * sizes[s] for s in closed} | {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        closed |= over


def test_mixing_meets_targets(spark, docs):
    for rows in (docs, spark.read.parquet(f"{SMALL}/documents.parquet")):
        texts = rows.select("doc_id", "source", "text").collect()
        sizes, own = {}, []
        for r in texts:
            sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORDS.findall(r["text"] or ""))
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        target = capped(sizes, {s: k % 3 + 1 for k, s in enumerate(order)})
        own = mixing.mix(rows).collect()
        assert len(own) == len(texts)
        taken = dict.fromkeys(sizes, 0)
        for r in own:
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, r["target"])
            assert r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        assert all(abs(taken[s] - target[s]) <= 1 for s in sizes)
        assert sorted(map(str, mixing.mix(rows).collect())) == sorted(map(str, own))
        placed = [r for r in own if r["taken"]]
        for r in placed:
            assert 0 <= r["first_position"] <= r["last_position"] <= 1
        # Along each source's stream positions rise, and by each of them the words taken are what the schedule's integral asks for.
        for name in sizes:
            stream = sorted((r["stream_at"], r["first_position"], r) for r in placed if r["source"] == name)
            assert [p for _, p, _ in stream] == sorted(p for _, p, _ in stream)
            for begun, t, r in stream:
                asked = (r["start"] * t + (r["end"] - r["start"]) * t * t / 2) / ((r["start"] + r["end"]) / 2) * r["target"]
                assert abs(asked - begun) < 1e-6 * max(1, begun)
        ordered = [r["first_position"] for r in queries.op5_mixing(spark, SMALL).collect() if r["first_position"] is not None]
        assert ordered == sorted(ordered)
        repeats = mixing.takes(rows, mixing.mix(rows))
        assert repeats.columns == rows.columns and repeats.count() <= 3 * len(texts)
    assert mixing.mix(empty(docs)).count() == 0


def test_mixing_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken, first_position, last_position FROM ({mixing.MIX_SQL})").fetchall())
    assert sorted(map(tuple, queries.op5_mixing(spark, SMALL).collect())) == want


def without_repeats(texts, length):
    words = [WORDS.findall(t or "") for t in texts]
    seen = {}
    for w in words:
        for k in range(len(w) - length + 1):
            key = tuple(w[k : k + length])
            seen[key] = seen.get(key, 0) + 1
    out = []
    for w in words:
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if seen[tuple(w[k : k + length])] > 1:
                gone[k : k + length] = [True] * length
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def test_substring_dedup_is_exact(spark, docs):
    for rows, length in ((docs, 35), (docs, 4), (spark.read.parquet(f"{SMALL}/documents.parquet"), 35)):
        texts = rows.select("doc_id", "text").collect()
        want = sorted((-1 if r["doc_id"] is None else r["doc_id"], *x) for r, x in zip(texts, without_repeats([r["text"] for r in texts], length)))
        found = substring.remove_repeats(rows, length).collect()
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in found) == want
    assert substring.remove_repeats(empty(docs)).count() == 0


def test_substring_dedup_of_random_overlaps(spark):
    rnd = random.Random(8)
    for _ in range(3):
        base = [str(rnd.randrange(3)) for _ in range(400)]
        texts = [" ".join(base[a : a + rnd.randrange(5, 90)]) for a in (rnd.randrange(350) for _ in range(60))]
        rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        want = sorted((k, *x) for k, x in enumerate(without_repeats(texts, 9)))
        assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(rows, 9).collect()) == want


def test_very_long_texts(spark):
    """A text of 2 MB beside short ones, for every operator on texts."""
    rnd = random.Random(11)
    words = [f"w{rnd.randrange(9000)}" for _ in range(60_000)]
    long = " ".join(words + ["lang" * 50_000] + words[100:160] + ["x" * 1_300_000])
    rows = spark.createDataFrame([(1, long, "en", "a"), (2, " ".join(words[200:240]), "en", "a"), (3, "short", "fr", "b")], "doc_id long, text string, lang string, source string")
    want = sorted((k + 1, *x) for k, x in enumerate(without_repeats([r["text"] for r in sorted(rows.collect())], 35)))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in substring.remove_repeats(rows).collect()) == want
    assert want[0][2] >= 60 and want[1][2] == 40
    marks = {r["doc_id"]: r["fp"] & (1 << 64) - 1 for r in simhash.near_duplicates(rows).collect()}
    assert marks == {r["doc_id"]: simhash_by_hand(r["text"]) for r in rows.collect()}
    assert {r["lang_pred"] for r in langid.identify(rows, langid.fit(rows)).collect()} <= {"en", "fr"}
    some = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_documents(rows, toxicity.fit(rows, some)).collect())
    coded = bpe.round_trip(rows, PATH, public_tokenizers.PATTERN, spaced=True).collect()
    assert all(bytes(r["decoded"]).decode() == r["text"] for r in coded)
    assert {r["size"] for r in mixing.mix(rows).collect()} == {60_062, 40, 1}


def test_toxicity_of_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = queries.op8_toxicity(spark, sf).collect()
    held = [(r["score"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert sum((s >= 0.5) == bool(t) for s, t in held) > 0.97 * len(held)
    good, bad = [s for s, t in held if t], [s for s, t in held if not t]
    assert sum(s >= 0.5 for s in good) > 0.85 * len(good)  # recall
    assert sum(s >= 0.5 for s in good) > 0.9 * sum(s >= 0.5 for s in good + bad)  # precision
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) > 0.95 * len(good) * len(bad)  # area under the curve


def test_nnpu_on_planted_words():
    """Positives carry one of three words, a fifth of the unlabelled rows too: these are told apart, by the corrected risk."""
    rnd = np.random.default_rng(4)
    marks, noise = np.array([11, 12, 13]), np.arange(100, 400)
    row = lambda toxic: np.unique(np.concatenate([rnd.choice(noise, 30), rnd.choice(marks, 1) if toxic else []]).astype(np.int64))
    positive, truth = [row(True) for _ in range(200)], np.arange(600) % 5 == 0
    unlabelled = [row(t) for t in truth]
    clear = toxicity.chosen_clear(positive, unlabelled, 0.2)
    weights, bias = toxicity.fit_nnpu(positive, unlabelled, 0.2, clear)
    scores = np.array([weights[r].sum() + bias for r in unlabelled])
    assert ((scores > 0) == truth).mean() > 0.97
    by_hand = 0.2 * np.mean([np.log1p(np.exp(-(weights[r].sum() + bias))) for r in positive]) + max(0, np.mean(np.log1p(np.exp(scores))) - 0.2 * np.mean([np.log1p(np.exp(weights[r].sum() + bias)) for r in positive]))
    assert abs(toxicity.risk((weights, bias), positive, unlabelled, 0.2) - by_hand) < 1e-5


def test_toxicity_of_odd_rows(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.score_documents(docs, toxicity.fit(docs, none)).collect()} == {0.0}
    again = docs.where("doc_id = 14")
    for _ in range(4):
        docs = docs.unionByName(again)
    some = spark.createDataFrame([(14, 1), (14, 1), (21, 0), (None, 1), (28, None)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_documents(docs, toxicity.fit(docs, some)).collect())
    assert toxicity.score_documents(empty(docs), toxicity.fit(empty(docs), some)).count() == 0


def simhash_by_hand(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    parts = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def grouped(fps):
    """Smallest id reachable from each, by single links of three bits at most."""
    best = {f: i for f, i in fps.items()}
    keys = list(fps)
    near = {f: [g for g in keys if bin(f ^ g).count("1") <= 3] for f in keys}
    seen = {}
    for f in keys:
        if f not in seen:
            stack, group = [f], {f}
            while stack:
                for g in near[stack.pop()]:
                    if g not in group:
                        group.add(g)
                        stack.append(g)
            low = min(best[g] for g in group)
            seen |= dict.fromkeys(group, low)
    return seen


def test_simhash_groups(spark, docs):
    for rows in (docs.where("doc_id is not null"), spark.read.parquet(f"{SMALL}/documents.parquet")):
        texts = rows.select("doc_id", "text").collect()
        marks = [(r["doc_id"], simhash_by_hand(r["text"])) for r in texts]
        least = {}
        for i, f in marks:
            least[f] = min(i, least.get(f, i))
        groups = grouped(least)
        found = simhash.near_duplicates(rows).collect()
        assert sorted((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in found) == sorted((i, f, groups[f]) for i, f in marks)
    assert simhash.near_duplicates(docs).count() == docs.count()
    assert simhash.near_duplicates(empty(docs)).count() == 0


@pytest.mark.parametrize("crowd", [0, 3, 64])
def test_similar_pairs_are_complete(spark, crowd, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rnd = random.Random(crowd)
    fps = set()
    for _ in range(25):
        base = rnd.getrandbits(64)
        fps |= {base} | {base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 5))) for _ in range(8)}
    half = rnd.getrandbits(32) << 32
    fps |= {half | rnd.getrandbits(9) for _ in range(60)}
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    found = [(r["a"], r["b"]) for r in simhash.similar_pairs(spark.createDataFrame(signed, "fp long")).collect()]
    values = sorted(s for s, in signed)
    want = [(a, b) for k, a in enumerate(values) for b in values[k + 1 :] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    assert sorted(found) == sorted(want)


def test_licences(spark):
    rows = [
        ("a/b/c.py", "# Licensed under the Apache License, Version 2.0\ncode"),
        ("a/LICENSE", "Released under the MIT License."),
        ("a/b/d.py", "nothing here\nthe of and"),
        ("a/b/e/f.py", None),
        ("a/b/e/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("z/q.py", ""),
        ("top.txt", "plain"),
        (None, "Released under the MIT License."),
        ("z/q.py", "released under the mit license"),
    ]
    found = {(r["path"], r["license"], r["origin"], r["license_path"]) for r in licenses.scan_licences(spark.createDataFrame(rows, "path string, text string").withColumnRenamed("x", "y")).collect()}
    assert found == {
        ("a/b/c.py", "Apache-2.0", "own", "a/b/c.py"),
        ("a/LICENSE", "MIT", "own", "a/LICENSE"),
        ("a/b/d.py", "MIT", "inherited", "a/LICENSE"),
        ("a/b/e/f.py", "GPL-3.0", "inherited", "a/b/e/COPYING"),
        ("a/b/e/COPYING", "GPL-3.0", "own", "a/b/e/COPYING"),
        ("z/q.py", "MIT", "own", "z/q.py"),
        ("top.txt", None, None, None),
        (None, None, None, None),
    }


def cosines_by_hand(passage, templates):
    """Cosine of a passage to each template, from counts of terms."""
    import math
    from collections import Counter

    bag_of = lambda text: Counter(t.strip(".") for t in re.split("[^a-z0-9.]+", text.lower()) if t.strip("."))
    bags = {(name, k): bag_of(text) for name, texts in templates.items() for k, text in enumerate(texts)}
    weight = lambda t: math.log((1 + len(bags)) / (1 + sum(t in b for b in bags.values()))) + 1
    vector = lambda bag: {t: weight(t) * (1 + math.log(n)) for t, n in bag.items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    own = vector(bag_of(passage))
    return {name: sum(own.get(t, 0) * x for t, x in v.items()) / (norm(own) * norm(v)) for name, v in ((n, vector(b)) for n, b in bags.items())} if own else {}


def test_licence_scores_equal_cosines(spark):
    """Scores of whole files against cosines by hand, near the threshold, with repeated terms and without."""
    rnd = random.Random(9)
    passages = []
    for text in (t for texts in licenses.TEMPLATES.values() for t in texts):
        for _ in range(4):
            words = [w for w in text.split() if rnd.random() < 0.8]
            passages.append(" ".join(words + rnd.choices(["the", "of", "whatever", "code", "licensed"], k=rnd.randrange(5)) + rnd.choices(words or ["x"], k=rnd.randrange(4))))
    rows = [(f"d{k}/x.py", p) for k, p in enumerate(passages)]
    found = {r["path"]: (r["license"], r["score"]) for r in licenses.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    near = 0
    for k, p in enumerate(passages):
        best = max(((round(c, 6), name) for (name, _), c in cosines_by_hand(p, licenses.TEMPLATES).items()), default=(0, None))
        near += 0.6 < best[0] < 0.8
        assert found[f"d{k}/x.py"][1] == (pytest.approx(best[0], abs=2e-6) if best[0] >= licenses.THRESHOLD else None), p
    assert near > 5


def test_several_licence_files_in_one_directory(spark):
    rows = [
        ("b/COPYING", "Released under the MIT License anyway"), ("b/LICENSE", "Licensed under the Apache License, Version 2.0"), ("b/x.py", "code"),
        ("c/LICENSE", "Released under the MIT License"), ("c/COPYING", "Released under the MIT License"), ("c/d/x.py", None), ("c/license.txt", "SPDX-License-Identifier: MPL-2.0"),
    ]
    found = {r["path"]: (r["license"], r["license_path"], r["score"]) for r in licenses.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert 0.7 <= found["b/COPYING"][2] < found["b/LICENSE"][2]
    assert found["b/x.py"][:2] == ("Apache-2.0", "b/LICENSE") and found["c/d/x.py"][:2] == ("MIT", "c/COPYING")


def test_heavy_terms_bound_the_cosine():
    for templates in (licenses.TEMPLATES, licenses.full_texts()):
        rows, _ = licenses.template_terms(templates)
        heavy = licenses.heavy_terms(rows, licenses.THRESHOLD)
        rest = {}
        for name, k, term, share, _ in rows:
            rest[name, k] = rest.get((name, k), 0) + share**2 * (term not in heavy)
        assert all(x < licenses.THRESHOLD**2 for x in rest.values()) and len(heavy) < len({r[2] for r in rows})


def test_inheritance_of_the_registered_query(spark):
    """Origin, licence and path of every row of op4 against a walk up its directories."""
    found = [tuple(r) for r in queries.op4_license_scans(spark, "/root/testdata/sf0.1").select("path", "license", "score", "origin", "license_path").collect()]
    files = {}
    for path, name, score, origin, at in found:
        if origin == "own":
            assert at == path
            folder, _, last = path.rpartition("/")
            if re.match(licenses.FILES, last):
                files[folder] = min(files.get(folder, (0, "~", "~")), (-score, name, path))
    inherited = 0
    for path, name, score, origin, at in found:
        if origin != "own":
            folder = path.rpartition("/")[0]
            while folder and folder not in files:
                folder = folder.rpartition("/")[0]
            _, want, given = files.get(folder, (0, None, None))
            assert (name, at, score, origin) == (want, given, None, "inherited" if want else None)
            inherited += want is not None
    assert inherited


def test_words_that_one_polynomial_takes_for_equal(spark):
    """Thue-Morse words and their complements agree in any polynomial hash of whole machine words."""
    word = "".join("ab"[bin(k).count("1") % 2] for k in range(2048))
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " ".join(f"w{k}" for k in range(34))
    docs = spark.createDataFrame([(1, f"{word} {tail}", "x"), (2, f"{other} {tail}", "y")], "doc_id long, text string, __also string")
    assert sorted((r["doc_id"], r["n_removed"]) for r in substring.remove_repeats(docs).collect()) == [(1, 0), (2, 0)]
    one = substring.Words([f"{word} {other} {word}", "", " x "])
    assert one.second[0] == one.second[2] != one.second[1]
    words = substring.Words(["a", "a\n", "abcdefgh abcdefghi hgfedcba", "éa a\0 a"])
    assert len(words.second) == 8 and len(set(words.second.tolist())) == 6


def test_long_words_are_not_kept():
    rnd = random.Random(1)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    exact = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.ByteBPE(PATH, public_tokenizers.PATTERN, True)
    texts = ["x " + "".join(rnd.choice("abcdef0123") for _ in range(3000)) + f" short{k}" for k in range(40)]
    known = [exact.encode_ordinary(t) for t in texts]
    assert [ids.tolist() for ids in encoder.encode_all(texts)] == known
    assert [ids.tolist() for ids in encoder.encode_all(texts)] == known
    assert encoder.words and all(len(w) <= bpe.LONGEST for w in [*encoder.words, *encoder.older])


def test_op2_over_a_table(spark):
    tokens = [base64.b64decode(line.split()[0]) for line in open(PATH, "rb")]
    initial, inner = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1 and b" " not in t[1:]}, {t for t in tokens if t == t.strip()}
    found = {r["doc_id"]: r["n_tokens"] for r in queries.op2_token_counts(spark, SMALL).collect()}
    for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        assert found[row["doc_id"]] == sum(greedy(w, initial if any(w[:n] in initial for n in range(1, len(w) + 1)) else inner, inner) for w in (row["text"] or "").encode().split())


def test_planted_licence_lines(spark):
    rows = queries.virtual_files(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    found = {r["path"]: r for r in queries.op4_license_scans(spark, "/root/testdata/sf0.01").collect()}
    for r in rows:
        stated = re.search(r"(Apache License|MIT License|General Public License|CC BY-NC)", r["text"] or "")
        if not r["path"].endswith("LICENSE"):
            assert (found[r["path"]]["origin"] == "own") == bool(stated), r["path"]


def test_licence_files_with_more_text(spark):
    """Lines of licence files count like other lines, and full licence texts are known."""
    full = licenses.full_texts()
    rows = [(f"{name}/LICENSE", f"Copyright 2001 Somebody Else\n\n{texts[0]}") for name, texts in full.items()]
    rows += [("p/LICENSE", "Copyright 2001 Somebody Else\nReleased under the MIT License.\n" + "and some more prose " * 50), ("p/q/x.py", "code"), ("u/LICENSE", "nothing of the kind " * 9), ("u/x.py", "code")]
    rows += [(f"{name}/x.py", "code") for name in full]
    found = {r["path"]: (r["license"], r["origin"], r["license_path"]) for r in licenses.scan_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert len(full) == 6
    for name in full:
        assert found[f"{name}/LICENSE"] == (name, "own", f"{name}/LICENSE")
        assert found[f"{name}/x.py"] == (name, "inherited", f"{name}/LICENSE")
    assert found["p/LICENSE"] == ("MIT", "own", "p/LICENSE") and found["p/q/x.py"] == ("MIT", "inherited", "p/LICENSE")
    assert found["u/LICENSE"] == found["u/x.py"] == (None, None, None)


def test_planted_lines_of_licence_files_are_inherited(spark):
    rows = queries.virtual_files(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()
    found = {r["path"]: r for r in queries.op4_license_scans(spark, "/root/testdata/sf0.1").collect()}
    for r in rows:
        stated = re.search(r"(Apache License|MIT License|General Public License|CC BY-NC)", r["text"] or "")
        if r["path"].endswith("LICENSE"):
            assert (found[r["path"]]["origin"] == "own") == bool(stated), r["path"]
    assert any(r["origin"] == "inherited" for r in found.values())


def test_words_that_no_starting_entry_fits(spark, tmp_path):
    """op2 cuts unspaced Chinese, Japanese and Thai into inner entries."""
    tokens = [base64.b64decode(line.split()[0]) for line in open(PATH, "rb")]
    initial, inner = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1 and b" " not in t[1:]}, {t for t in tokens if t == t.strip()}
    texts = ["日本語" * 40, "中文 the", "ไทย" * 9 + " élan tion", "plain words", ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["n_tokens"] for r in queries.op2_token_counts(spark, str(tmp_path)).collect()}
    for k, text in enumerate(texts):
        assert found[k] == sum(greedy(w, initial if any(w[:n] in initial for n in range(1, len(w) + 1)) else inner, inner) for w in text.encode().split())
    assert found[0] > 1
