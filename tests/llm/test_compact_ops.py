"""Fill-in-the-middle, language-model scores and vector codes against plain versions of the same rules."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from unitweave.llm import fill_middle, language_model, vector_codes

ODD = [None, "", " ", " \t\n", "a", " a", "a ", "a b  c\n", "é" * 70 + "  日本語 \x0b x", "x" * 150_000, "w " * 60_000, "<P> held", "a <M", "<", "a b c", "a b  c\n"]
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_cut(doc_id, text):
    t = text or ""
    units = UNIT.findall(t)
    assert "".join(units) == t
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(units), "plain", None, None, t
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts(rng, n):
    return [*ODD, *("".join(rng.choice(["ka", "é", "\n", " ", " ", "  ", "日", "<"]) for _ in range(rng.randint(0, 60))) for _ in range(n))]


def test_fill_middle_against_regular_expressions(spark):
    rows = [(i, t, i) for _ in range(2) for i, t in enumerate(texts(random.Random(1), 400))]
    done = fill_middle.rearranged(spark.createDataFrame(rows, "doc_id long, text string, output int"))
    got = sorted((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in done.collect())
    assert got == sorted(((i, *plain_cut(i, t)) for i, t, _ in rows), key=lambda r: r[:3])
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    for r in fill_middle.digest(done).collect():
        assert r.restored_sha256 == hashlib.sha256((rows[r.doc_id][1] or "").encode()).hexdigest()


def test_fill_middle_sql_and_null_ids(spark):
    rows = [(None if i == 7 else i, t) for i, t in enumerate(texts(random.Random(2), 200))]
    got = fill_middle.digest(fill_middle.rearranged(spark.createDataFrame(rows, "doc_id long, text string"))).toPandas()
    c = duckdb.connect()
    c.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    out = c.sql(fill_middle.SQL)
    assert out.columns == list(got.columns)
    key = lambda r: tuple(str(None if x is None or x != x else int(x) if isinstance(x, float) else x) for x in r)
    assert sorted(map(key, got.itertuples(index=False))) == sorted(map(key, out.fetchall()))
    assert fill_middle.rearranged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_select_and_restore():
    rng = random.Random(3)
    for n in (1, 63, 64, 65, 1000):
        bits = rng.getrandbits(n) | 1 << n - 1
        places = [i for i in range(n) if bits >> i & 1]
        assert [fill_middle.select(bits, k + 1) for k in range(len(places))] == places
    with pytest.raises(ValueError):
        fill_middle.restored(b"no marker", "spm")


def plain_scores(rows):
    """Everything from dictionaries, for (id, text)."""
    train = [(t or "").encode() for i, t in rows if i is None or zlib.crc32(str(i).encode()) % 7 != 2]
    trie = language_model.Trie()
    count = Counter()
    for t in train:
        trie.coded(t, score=False)
        count.update([*t.lower().split(), None])
    total, kinds, known = sum(count.values()), len(count), {}
    for i, t in rows:
        t = (t or "").encode()
        tokens = [*t.lower().split(), None]
        if t not in known:
            known[t] = trie.coded(t, learn=False)
        base = sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in tokens)
        yield i, i is not None and zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(count[w] > 0 for w in tokens), total, base, known[t]


def by_id(rows):
    return sorted((tuple(f"{x:.9g}" if isinstance(x, float) else x for x in r) for r in rows), key=str)


def test_language_model_against_a_trie(spark, monkeypatch):
    rng = random.Random(4)
    words = ["ka", "lomi", "Nepu", "été", "日本", "re", "sita"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))) for i in range(150)]
    rows += [(200 + i, t) for i, t in enumerate([None, "", " ", "zzzz qqq 0x1f", "ka\x0blomi re", "x" * 3000, "\x00\x01"])]
    rows += [(None, "ka ka"), (3, "lomi"), (3, "lomi"), *rows[:5]]
    monkeypatch.setattr(language_model, "BLOCK", 4000)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).repartition(3)
    got = language_model.scored(docs)
    assert by_id(tuple(r) for r in got.collect()) == by_id(plain_scores(rows))
    assert got.where("held_out").count() and got.where("NOT held_out").count()


def test_language_model_windows_and_totals(monkeypatch):
    monkeypatch.setattr(language_model, "WINDOW", 7)
    text = "Ab  cdé fgh\nijklmnopqrstuv w ".encode()
    texts = [text, b"", b" \x0b", b"xy"]
    cut = [(row, part.to_pylist(), language_model.words(part)[0].to_pylist()) for row, part in language_model.slices(pa.array(texts, pa.binary()))]
    assert [row for row, _, _ in cut] == [0, 1] and [t for _, p, _ in cut for t in p] == texts
    assert [w for _, _, p in cut for w in p] == [w for t in texts for w in t.lower().split()]
    flat, n = language_model.words(pa.array(texts, pa.binary()))
    assert flat.to_pylist() == [w for t in texts for w in t.lower().split()] and n.tolist() == [len(t.split()) for t in texts]
    coded = [(done + i, int(g).to_bytes(6, "big")) for done, code in language_model.grams(texts) for i, g in enumerate(code)]
    assert coded == list(enumerate(s[i : i + 6] for s in (b"\xff" * 5 + t + b"\xfe" for t in texts) for i in range(len(s) - 5)))
    trie = language_model.Trie(2)
    for t in (b"abracadabra", b"abc", b""):
        trie.coded(t, score=False)
    for context in (b"", b"a", b"ab", b"zz", b"za", b"\xff\xff"):
        assert math.isclose(sum(10 ** trie.log10(context, s) for s in range(255)), 1, rel_tol=1e-9)


def test_language_model_without_rows_or_training(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert language_model.scored(empty).count() == 0
    held = [i for i in range(60) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = [(i, "some text") for i in held]
    assert by_id(tuple(r) for r in language_model.scored(spark.createDataFrame(rows, empty.schema)).collect()) == by_id(plain_scores(rows))
    got = language_model.adaptive(spark.createDataFrame([(1, "abab" * 30), (2, None)], empty.schema)).collect()
    assert math.isclose(got[0].score, language_model.Trie().coded(b"abab" * 30)) and got[0].score > -30 and math.isclose(got[1].score, -math.log10(255))


def plain_codes(rows, rounds=4):
    """Plain integers and loops, for (id, vector, label)."""
    kept = [(i, v, y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    length = len(kept[0][1])
    width = -(-length // 4)
    whole = lambda v: [int(x) * 1024 if abs(x) > 2**60 else math.floor(1024 * x) for x in v] + [0] * (4 * width - length)
    ints = [whole(v) if len(v) == length else None for _, v, _ in kept]
    own = [v for v in ints if v is not None]
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for v in own[:256]] for p in range(4)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for v in own:
                groups.setdefault(nearest(p, cut(v, p))[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for (i, _, y), v in zip(kept, ints):
        found = v and [nearest(p, cut(v, p)) for p in range(4)]
        error = sum(d for d, _ in found) if found else None
        error = error if error is None or error < 2**63 else None
        out.append((i, "".join(f"{k:02x}" for _, k in found) if found else None, error, y))
        if error is not None:
            sums[y] = sums.get(y, 0) + error
    return sorted(((i, c, e, s if (s := sums.get(y)) is None or s < 2**63 else None, digest) for i, c, e, y in out), key=str)


SCHEMA = "vec_id long, embedding array<float>, label int"


def as_floats(rows):
    return [(i, v and [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


@pytest.mark.parametrize("n, length, grid", [(700, 64, 0), (600, 16, 3), (300, 10, 2), (40, 8, 0), (400, 4, 5)])
def test_codes_against_plain_integers(spark, n, length, grid):
    rng = np.random.default_rng(n)
    v = rng.integers(-grid, grid + 1, (n, length)) / 1024 if grid else rng.normal(0, 0.3, (n, length))  # a coarse grid has ties
    rows = as_floats([(i, v[i].tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(n).tolist()])
    rows += rows[:9]
    rows += [(n + 1, None, 1), (n + 2, [float("nan")] * length, 1), (n + 3, [None] * length, 2), (n + 4, [float("inf")] + [0.0] * (length - 1), 2), (n + 5, [0.5] * (length + 4), 7), (n + 6, [], 1), (None, rows[0][1], None)]
    got = vector_codes.compressed(spark.createDataFrame(rows, SCHEMA).withColumn("code", F.lit(1)))
    assert sorted(map(tuple, got.collect()), key=str) == plain_codes(rows)


def test_codes_of_large_components(spark):
    rng = np.random.default_rng(5)
    scale = [1e3, 1e9, 1e20, 3e38]
    rows = as_floats([(i, (rng.normal(0, 0.3, 8) * scale[i % 4]).clip(-3e38, 3e38).tolist(), i % 5) for i in range(120)])
    assert sorted(map(tuple, vector_codes.compressed(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == plain_codes(rows)


def test_code_sql_salts_and_empty_tables(spark):
    rng = np.random.default_rng(6)
    rows = as_floats([(i, rng.normal(0, 0.2, 16).tolist(), i % 3 or None) for i in range(400)] + [(1000, None, 1)])
    df = spark.createDataFrame(rows, SCHEMA)
    c = duckdb.connect()
    c.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    c.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    assert sorted(c.sql(vector_codes.SQL).fetchall(), key=str) == sorted(map(tuple, vector_codes.compressed(df).collect()), key=str)
    done = vector_codes.kept_rows(df, "vec_id", "embedding", "label")
    books = vector_codes.learn(done)
    done = vector_codes.coded(done, books)
    sums = done.groupBy(F.col("_label").alias("_l")).agg(F.sum("error").alias("label_error"))
    one, two = (sorted(map(tuple, vector_codes.joined_by_label(done, sums, most).select("_id", "label_error").collect())) for most in (0, 100))
    assert one == two and len(one) == 400
    for none in ([], [(1, None, 1)]):
        assert vector_codes.compressed(spark.createDataFrame(none, SCHEMA)).collect() == []


def test_tree_visits_few_entries_and_keeps_ties():
    rng = np.random.default_rng(7)
    centres = rng.integers(-2000, 2000, (16, 6))
    entries = (centres.repeat(16, 0) + rng.integers(-20, 20, (256, 6))).astype(float)
    entries[200] = entries[3]
    tree, asked = vector_codes.Tree(entries), []
    plain = vector_codes._squares
    vector_codes._squares = lambda x, e: (asked.append(len(x) * len(e)), plain(x, e))[1]
    try:
        x = entries[rng.integers(0, 256, 500)] + rng.integers(-5, 5, (500, 6))
        index, best = tree.nearest(x)
    finally:
        vector_codes._squares = plain
    d = plain(x, entries)
    assert (index == d.argmin(1)).all() and (best == d.min(1)).all() and 3 in index and 200 not in index
    assert sum(asked) < 0.3 * 500 * 256
