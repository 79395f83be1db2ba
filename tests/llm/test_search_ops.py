"""Decontamination, near-duplicates, repeats and embeddings against brute force, with the odd rows of real tables."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
import regex

from unitweave.llm import decontaminate, embeddings, graph, near_duplicates, repeats
from unitweave.llm import textarrays as ta

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ré", "sí") for b in ("da", "fo", "ga", "hi", "ju", "x1")]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, id string, rep string, size string"


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, ids=None):
    """Documents with columns that clash with the operators' own names."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None, None, "k", None, "r", "s") for i, t in zip(ids, texts)], SCHEMA)


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["", "A", "é", "Hello, WORLD 42!", "a\x7fb\x00c", "Straße İs ÇA", *("".join(rng.choice("aZ9 -.é日\n") for _ in range(rng.randint(0, 60))) for _ in range(200))]
    pattern = regex.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    want = [[w.encode() for w in pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))] for t in texts]
    assert [ta.text_words(t) for t in texts] == want
    for first, buf, offsets in ta.blocks(pa.array([*texts, None]), 64):
        starts, ends, count = ta.words(buf, offsets)
        low = ta.LOWER[buf].tobytes()
        for i in range(len(offsets) - 1):
            if first + i < len(texts):
                assert [low[a:b] for a, b in zip(starts[count[i] : count[i + 1]], ends[count[i] : count[i + 1]])] == want[first + i]
        hashes = ta.word_hashes(buf, starts, ends)
        assert len({(h, low[a:b]) for h, a, b in zip(hashes.tolist(), starts, ends)}) == len({low[a:b] for a, b in zip(starts, ends)})


@pytest.mark.parametrize("count", [0, 1, 4, 5, 9])
def test_shingles_of_short_texts(count):
    text = " ".join(WORDS[:count]).encode()
    buf, offsets = np.frombuffer(text + text, np.uint8), np.array([0, len(text), 2 * len(text)])
    starts, ends, first = ta.words(buf, offsets)
    h, row = ta.shingles(ta.word_hashes(buf, starts, ends), first)
    each = min(count, 1) if count < 5 else count - 4
    assert row.tolist() == [0] * each + [1] * each and h[:each].tolist() == h[each:].tolist()


@pytest.fixture(scope="module")
def leaks():
    rng = random.Random(2)
    items = [(i, prose(rng, n)) for i, n in enumerate((30, 12, 10, 9, 3, 1))] + [(7, ""), (8, None), (1, prose(rng, 15)), (None, prose(rng, 11))]
    texts = [prose(rng, 40), "", None, "?!", "".join(c.upper() if c.isascii() else c for c in items[0][1]), prose(rng, 5) + " " + items[1][1] + ". " + prose(rng, 4), " - ".join(items[2][1].split()), items[3][1], items[3][1][:-1], items[4][1] + " x", items[5][1], items[9][1] + " end"]
    texts += [" ".join(items[0][1].split()[5:25]), texts[5], prose(rng, 3000) + " " + items[8][1] + " " + prose(rng, 3000)]
    return items, texts


def test_decontamination(spark, leaks):
    items, texts = leaks
    test = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.build_index(frame(spark, texts))
    rows = {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(decontaminate.search(index, test)).collect()}
    assert rows == decontaminate.brute(list(enumerate(texts)), items)
    assert rows[4][4] and not rows[1][4]


def test_decontamination_in_blocks_and_empty(spark, leaks, monkeypatch):
    items, texts = leaks
    test = spark.createDataFrame(items, "item_id long, text string")
    index = decontaminate.build_index(frame(spark, texts))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 200)
    rows = {r.doc_id: tuple(r)[1:] for r in decontaminate.digest(decontaminate.search(index, test)).collect()}
    assert rows == decontaminate.brute(list(enumerate(texts)), items)
    monkeypatch.undo()
    assert all(not r.contaminated for r in decontaminate.digest(decontaminate.search(index, test.limit(0))).collect())
    assert decontaminate.digest(decontaminate.search(decontaminate.build_index(frame(spark, texts).limit(0)), test)).count() == 0


def test_proximity(spark):
    items = spark.createDataFrame([(1, "kada lofo miga")], "item_id long, text string")
    texts = ["miga x1 kada lofo", "kada a b c d e f lofo miga", "kada lofo", "lofo a kada b miga"]
    rows = {r.doc: list(r.hits) for r in decontaminate.search(decontaminate.build_index(frame(spark, texts)), items, span=5).collect()}
    assert rows == {0: [0, 1, 2, 3], 1: [], 2: [], 3: [0, 1, 2, 3, 4]}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def test_near_duplicates(spark, monkeypatch):
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(6)]
    texts = [None, "", "", "?", "kada", "KADA!", "kada lofo", None]
    for b in base:
        texts += [b, b, *(edited(rng, b, rng.choice((1, 2, 3, 6, 9, 14))) for _ in range(10)), b.upper()]
    texts += [prose(rng, 20_000)] * 2 + [prose(rng, 50) for _ in range(20)]
    docs = frame(spark, texts)
    want = near_duplicates.brute(list(enumerate(texts)))
    for star in (near_duplicates.STAR, 2):
        monkeypatch.setattr(near_duplicates, "STAR", star)
        rows = near_duplicates.near_duplicates(docs).collect()
        assert {r.doc_id: r.class_id for r in rows} == want and all(r.kept == (r.doc_id == r.class_id) for r in rows)
    monkeypatch.setattr(near_duplicates, "SMALL", 1)
    assert {r.doc_id: r.class_id for r in near_duplicates.near_duplicates(docs).collect()} == want


@pytest.mark.parametrize("block", [512, 100])
def test_near_copies_in_a_family_of_one_template(spark, monkeypatch, block):
    """1,000 texts that are 0.7 alike, the last 300 of them with a near copy: none may hide behind the family's least."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block, raising=False)
    rng = random.Random(5)
    template = " ".join(f"{rng.choice(WORDS)}{i}" for i in range(280))
    texts = [template + "".join(f" own{i}x{k}" for k in range(6)) for i in range(1000)]
    texts += [t[:-1] + "y" for t in texts[700:]]
    rows = near_duplicates.near_duplicates(frame(spark, texts)).collect()
    assert {r.doc_id: r.class_id for r in rows} == {i: i if i < 1000 else i - 300 for i in range(1300)}


def test_buckets_of_many_members(spark):
    keys = [(i, k) for i in range(500) for k in {0, i % 7 + 1, 1000 + i}]  # one key that all have, seven of some 71, own ones
    rows = near_duplicates.buckets(spark.createDataFrame(keys, "rep long, key long")).collect()
    held = {}
    for rep, key in keys:
        held.setdefault(key, []).append(rep)
    assert sorted(map(tuple, rows)) == sorted((key, rep, min(reps), len(reps)) for key, reps in held.items() if len(reps) > 1 for rep in reps)
    assert near_duplicates.buckets(spark.createDataFrame([], "rep long, key long")).count() == 0


def test_near_duplicates_of_odd_tables(spark):
    assert near_duplicates.near_duplicates(frame(spark, ["a"]).limit(0)).count() == 0
    rows = near_duplicates.near_duplicates(frame(spark, ["a b c", "a b c", "d e f", "a b c"], [5, 5, 7, None])).collect()
    assert sorted((r.doc_id or 0, r.class_id, r.kept) for r in rows) == [(0, None, True), (5, 5, True), (5, 5, True), (7, 7, True)]


def test_sampling_agrees_as_often_as_sets_are_alike():
    rng = np.random.default_rng(4)
    feature = rng.integers(1, 1 << 44, 400, dtype=np.uint64)
    a, b = rng.gamma(2, 1, 400).astype(np.float32), rng.gamma(2, 1, 400).astype(np.float32)
    b[:300] = a[:300]
    sampler = near_duplicates.Sampler(2000)
    order = np.argsort(feature)
    one, two = (sampler.signatures(np.zeros(400, np.int64), feature[order], w[order], 1)[0] for w in (a, b))
    assert abs((one == two).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_merge_of_front_coded_runs():
    rng = random.Random(5)
    for _ in range(100):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(1, 6))]
        for r in runs:
            assert repeats.front_decode(*repeats.front_code(r)) == r
        coded = [(r, repeats.front_code(r)[0]) for r in runs]
        out = [(coded[i][0][j], h) for i, j, h in repeats.merge(coded)]
        assert [x for x, _ in out] == sorted(sum(runs, []))
        assert all(h == repeats.common(x, y, 0) for (x, _), (y, h) in zip(out, out[1:]))


def test_repeats(spark, monkeypatch):
    rng = random.Random(6)
    some = lambda n: "".join(rng.choice("abcdefgé ") for _ in range(n))
    p, q = some(700), some(401)
    texts = [some(300) + p + some(200), some(50) + p[100:] + some(900), p[:399] + some(10), p[:401], some(500), "x" * 1000, "ab" * 450, None, "", q, q, some(100) + q, q + some(30) + q, some(2000) + p[50:650] + q, some(399), "x" * 400, "y" * 400, "z" * 401]
    texts += [some(250) + p[:350] + p[340:] + some(9), None, ""]
    want = repeats.brute(texts)
    for run, per_range, ranges in ((repeats.RUN, repeats.RANGE, 9), (7, 9, 9), (7, 9, 2)):
        monkeypatch.setattr(repeats, "RUN", run)
        monkeypatch.setattr(repeats, "MAX_RANGES", ranges)
        monkeypatch.setattr(repeats, "RANGE", per_range)
        rows = repeats.removed(frame(spark, texts)).collect()
        assert {r.doc_id: tuple(r)[1:5] for r in rows} == dict(enumerate(want))
    assert repeats.removed(frame(spark, texts).limit(0)).count() == 0


def test_repeats_within_repeated_rows(spark):
    rng = random.Random(7)
    t = "".join(rng.choice("abcdefgh") for _ in range(450))
    rows = repeats.removed(frame(spark, [t, t, t[:420]], [1, 1, None])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in rows) == [(0, 420), (1, 450), (1, 450)]


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(100, 100), (200, 201), (201, 200), (None, 3), (300, 7)], "a long, b long")
    rows = {r.id: r.component for r in graph.connected_components(edges).collect()}
    assert rows == {**{i: 0 for i in range(41)}, 300: 0, 200: 200, 201: 200}
    assert graph.connected_components(edges.limit(0)).count() == 0


def brute_links(x, cosine):
    n = np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x / n) @ (x / n).T >= cosine
    np.fill_diagonal(linked, False)
    return linked


@pytest.mark.parametrize("limits", [None, (40, 16)])
def test_embeddings(spark, monkeypatch, limits):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 64))
    for i in range(120):
        x[200 + i] = x[i % 30] + rng.normal(size=64) * rng.uniform(0.05, 0.3)
    x[330:340] = x[0]
    x = x.astype(np.float32).astype(float)
    if limits:
        monkeypatch.setattr(embeddings, "BUCKET", limits[0])
        monkeypatch.setattr(embeddings, "BLOCK", limits[1])
    rows = embeddings.near_duplicates(spark.createDataFrame([(i, v.tolist(), "l") for i, v in enumerate(x)], "vec_id long, embedding array<float>, rep string")).collect()
    linked = brute_links(x, 0.95)
    label = embeddings._stars(linked)
    found, true = sum(r.n_links for r in rows), int(linked.sum())
    assert found <= true and found >= 0.97 * true
    assert sum(r.component_id != label[r.vec_id] for r in rows) <= 4


@pytest.mark.parametrize("bucket", [16, 4096])
def test_buckets_lose_no_candidates(spark, monkeypatch, bucket):
    """Over the limit or not, what a bucket holds is chained as all of its pairs would chain it."""
    monkeypatch.setattr(embeddings, "BUCKET", bucket)
    rng = np.random.default_rng(3)
    code = rng.integers(0, 1 << 63, 1200, dtype=np.uint64)
    code[:4] = [0, 63, 3, 15]  # 0 - 3 - 15 - 63: a chain of two bits a step
    code[600:900] = code[300:600] ^ np.uint64(1)  # pairs
    code[900:950] = code[250:300]  # equal ones
    rows = spark.createDataFrame([(7, i, c) for i, c in enumerate(code.view(np.int64).tolist())], "key long, rep long, code long")
    got = graph.connected_components(embeddings.candidate_edges(rows, 2)).collect()
    label = embeddings._stars(np.bitwise_count(code[:, None] ^ code) <= 2)
    alone = np.bincount(label, minlength=len(code))[label] == 1
    assert {r.id: r.component for r in got} == {i: int(label[i]) for i in np.flatnonzero(~alone)}


def test_embeddings_of_odd_rows(spark):
    odd = [(1, None), (2, [0.0, 0.0]), (3, [1.0, None]), (4, [1.0, 2.0]), (5, [2.0, 4.0]), (5, [1.0, 2.0]), (None, [1.0, 2.0]), (6, [float("nan"), 1.0]), (7, [1.0]), (8, []), (9, [1.0, 2.0001]), (10, [float("inf"), 1.0]), (11, [-0.0, -1.0]), (12, [0.0, -1.0])]
    df = spark.createDataFrame(odd, "vec_id long, embedding array<float>")
    rows = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embeddings.near_duplicates(df).collect())
    alone = [(i, 0, i, True) for i in (1, 2, 3, 6, 7, 8, 10)]
    assert rows == sorted([*alone, (0, 0, None, False), (4, 3, 4, True), (5, 3, 4, False), (5, 3, 4, False), (9, 3, 4, False), (11, 1, 11, True), (12, 1, 11, False)])
    assert embeddings.near_duplicates(df.limit(0)).count() == 0
    assert [r.n_links for r in embeddings.near_duplicates(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [0]


def test_passages_of_over_fifty_words(spark):
    """Runs of 51 words that two documents have, most of them too short for the rule of 400 bytes."""
    rng = random.Random(5)
    word = lambda: rng.choice("ab") * rng.randint(1, 2) + rng.choice(("la", "no", "Ri", "té"))
    some = lambda n: " ".join(word() for _ in range(n))
    parts = [some(n) for n in (49, 50, 51, 52, 60, 75)]
    texts = [None, "", "a", parts[2], parts[1], some(51), some(300)]
    texts += [", ".join((some(rng.randint(0, 40)), p, some(rng.randint(0, 40)))) for p in parts for _ in range(3)]
    texts += [" ".join(["of"] * 60), " ".join(["of"] * 55), texts[6], f"{parts[5]} {some(9)} {parts[4]}", f"{some(200)} {parts[5].upper()} {parts[5]}"]
    want = repeats.brute_passages(texts)
    assert want[3] == 51 and want[4] == 0 and want[6] == 300 and sum(x > 0 for x in want) > 15
    rows = {r.doc_id: r for r in repeats.removed(frame(spark, texts)).collect()}
    assert [rows[i].n_passage_words for i in range(len(texts))] == want
    assert rows[3].n_removed == 0 and rows[3].n_bytes < 400
