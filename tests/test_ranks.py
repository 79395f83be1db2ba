"""Ranks from ranges, medians from ranks, runs of codes, walks, and durations with spectra."""

from __future__ import annotations

import random
import statistics
from collections import Counter

from pyspark.sql import functions as F

from unitweave.operators import search, select, waves


def test_ranks_with_many_partitions_and_ties(spark):
    rng = random.Random(1)
    rows = [(7 if rng.random() < 0.4 else rng.randint(0, 40), rng.choice("abcdefgh") * 9, i) for i in range(1500)] + [(None, "x", 9000), (None, None, 9001), (7, None, 9002)]
    df = spark.createDataFrame(rows, "a int, b string, rank_of long")
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "", r[2])
    want = {r[2]: i for i, r in enumerate(sorted(rows, key=key))}
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("4", "2000"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
            ranked = select.ranked_globally(df, ["a", "b", "rank_of"], "r")
            assert ranked.columns == ["a", "b", "rank_of", "r"]
            got = {r.rank_of: r.r for r in ranked.collect()}
            assert got == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
    texts = select.ranked_globally(df, ["b", "rank_of"], "r").collect()
    assert [r.rank_of for r in sorted(texts, key=lambda r: r.r)] == [r[2] for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[2]))]


def test_hot_values_are_cut_by_the_second_column(spark):
    df = spark.range(2000).select(F.lit("same").alias("a"), F.col("id").alias("b"))
    plan = select.ranked_globally(df, ["a", "b"], "r")
    assert [r.r for r in plan.orderBy("b").collect()] == list(range(2000))
    assert select.ranked_globally(df.limit(0), ["a", "b"], "r").count() == 0


def test_medians_and_modes(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.choice([None, 1.5, 2.0, 7.25, 8.0]), rng.choice("xyz")) for _ in range(400)] + [(4, None, "x")]
    df = spark.createDataFrame(rows, "k int, v double, t string")
    want = {k: (len(v), statistics.median(v)) for k in (1, 2, 3) if (v := [x for a, x, _ in rows if a == k and x is not None])}
    assert {r.k: (r.n, r["median"]) for r in select.group_medians(df, "k", "v").collect()} == want
    modes = {k: min((-n, t) for t, n in Counter(t for a, _, t in rows if a == k).items())[1] for k in (1, 2, 3, 4)}
    assert {r.k: r["mode"] for r in select.group_modes(df, "k", "t").collect()} == modes


def test_runs_of_codes(spark):
    rng = random.Random(3)
    rows = [(u, i, rng.randint(0, 3)) for u in "ab" for i in range(20) if (u, i) != ("a", 7)]
    codes = {(u, i): c for u, i, c in rows}
    got = {(r.u, r.ix, r.n, r.gram) for r in search._runs_of(spark.createDataFrame(rows, "u string, ix int, code int"), "u", 4, 2).collect()}
    want = set()
    for u, i in codes:
        for n in (2, 3, 4):
            run = [codes.get((u, i + j)) for j in range(n)]
            if None not in run:
                want.add((u, i, n, " ".join(map(str, run))))
    assert got == want


def test_walks_follow_transitions(spark):
    rng = random.Random(4)
    rows = [(i, "p" if rng.random() < 0.6 else rng.choice("qr"), "LR"[i % 2]) for i in range(200)]
    units = spark.createDataFrame(rows, "unit_id long, phone string, half string")
    starts = units.where("unit_id % 20 = 0").select(F.col("unit_id").alias("walk"), "unit_id")
    got = search.transition_walks(units, starts, 4)
    assert got.schema.names == ["walk", "step", "unit_id"]
    by = {}
    for r in got.collect():
        by.setdefault(r.walk, {})[r.step] = r.unit_id
    phone, half = {i: p for i, p, _ in rows}, {i: h for i, _, h in rows}
    assert len(by) == 10 and all(sorted(w) == list(range(len(w))) for w in by.values()) and any(len(w) == 5 for w in by.values())
    for w in by.values():
        for k in range(len(w) - 1):
            assert half[w[k]] != half[w[k + 1]]
            if half[w[k]] == "L":
                assert phone[w[k]] == phone[w[k + 1]]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.transition_walks(units, starts, 4).collect()))


def test_low_f0_between_frames_is_unvoiced_and_spectra_follow(spark):
    f0 = [0.0, 200.0, 200.0, 0.0, 0.0, 200.0]
    frames = [[float(i), 10.0 * i] for i in range(10)]  # two more on either side
    rows = [("a", i, f0, frames, 60.0, 1.0) for i in range(5)]
    out = {r.step: r for r in waves.durations_imposed(spark.createDataFrame(rows, "utt string, step int, f0 array<double>, frames array<array<double>>, target_ms double, confidence double")).collect()}
    assert out[0].f0 == f0 and out[4].frames == frames
    k = len(out[2].f0)
    assert k == int(6 * 60.0 / 30.0) and all(x == 0 or x >= 100 for x in out[2].f0) and 0.0 in out[2].f0 and 200.0 in out[2].f0
    places = [i * 9 / (k + 3) for i in range(k + 4)]
    assert [[round(x, 9) for x in v] for v in out[2].frames] == [[round(p, 9), round(10 * p, 9)] for p in places]


def test_octaves_beside_a_plain_walk(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows, want = [], {}
    for utt in range(30):
        lengths = rng.integers(1, 14, 6)
        segment = np.repeat(np.arange(6), lengths)
        f0 = np.where(rng.random(len(segment)) < 0.15, 0.0, rng.choice([60.0, 110.0, 200.0, 390.0], 6)[segment] * rng.uniform(0.9, 1.1, len(segment)))
        rows += [(utt, i, int(s), float(x)) for i, (s, x) in enumerate(zip(segment, f0))]
        factor = np.ones(len(f0))
        for s in range(1, 6):
            a, b = np.flatnonzero((segment == s - 1) & (f0 > 0)), np.flatnonzero((segment == s) & (f0 > 0))
            if len(a) < 5 or len(b) < 5 or b[0] - a[-1] >= 8:
                continue
            old, new = np.median((f0 * factor)[a[-5:-1]]), np.median(f0[b[1:5]])
            own = np.flatnonzero(segment == s)
            r = np.round(max(old, new) / min(old, new))
            if new > old and (f0[own[1:]] / r > 48).all():
                factor[own] = 1 / r
            elif new <= old and (f0[own[1:]] * r < 420).all():
                factor[own] = r
        if (f0 > 0).any():
            values, counts = np.unique(np.round(factor[f0 > 0], 9), return_counts=True)
            factor = factor / values[counts.argmax()]
        want |= {(utt, i): (round(float(x * y), 6), round(float(y if x > 0 else 1.0), 6)) for i, (x, y) in enumerate(zip(f0, factor))}
    got = waves.transposed(spark.createDataFrame(rows, "utt int, frame int, segment int, f0 double")).collect()
    assert {(r.utt, r.frame): (round(r.f0, 6), round(r.factor, 6)) for r in got} == want
