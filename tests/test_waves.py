"""Waveform operators, walks and balancing by hand-made cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitweave.operators import search, select, tuning, waves


def test_dilated_filter():
    rows = waves.dilated_filter(1.5, 3)
    assert [len(r) for r in rows] == [6, 6, 6] and [r.index(1.0) for r in rows] == [5, 3, 1]
    wide = waves.dilated_filter(2.0, 4)
    assert all(abs(sum(r) - 1) < 1e-12 for r in wide)


def test_transposed(spark):
    low, high = [100.0] * 8, [200.0] * 8
    rows = [("a", i, i // 8, x) for i, x in enumerate(low + high + low)] + [("b", i, i // 8, 0.0) for i in range(16)]
    rows += [("c", i, i // 8, x) for i, x in enumerate(low + [0.0] * 9 + high)]  # too far apart
    out = {}
    for r in waves.transposed(spark.createDataFrame(rows, "utt string, frame int, segment int, f0 double")).collect():
        out.setdefault(r.utt, []).append((r.frame, r.f0))
    f0 = {u: [x for _, x in sorted(v)] for u, v in out.items()}
    assert f0["a"] == [100.0] * 24 and f0["b"] == [0.0] * 16
    assert f0["c"] == low + [0.0] * 9 + high


def test_durations_imposed(spark):
    f0 = [0.0] * 10  # 50 ms
    rows = [("a", i, f0 if i != 3 else [1.0, 2.0], 100.0, 1.0) for i in range(5)]
    out = {r.step: r.f0 for r in waves.durations_imposed(spark.createDataFrame(rows, "utt string, step int, f0 array<double>, target_ms double, confidence double")).collect()}
    assert [len(out[i]) for i in range(5)] == [10, 10, 20, 2, 10]


def test_segments_stay_inside_the_source(spark):
    marks = spark.createDataFrame([("s", i, 10 * i, i / 10) for i in range(8)], "src string, pm_ix long, pos long, t double")
    units = spark.createDataFrame([("u", 0, "s", 0.0, 0.21), ("u", 1, "s", 0.3, 0.45), ("u", 2, "s", 0.5, 0.7)], "utt string, step long, src string, start double, end double")
    got = {r.step: (r.first_pm, r.last_pm, r.from_pos, r.to_pos, r.added_before, r.added_after) for r in waves.segment_bounds(units, marks, 3).collect()}
    assert got == {0: (1, 5, 0, 60, 0, 3), 1: (1, 6, 0, 70, 2, 2), 2: (2, 6, 10, 70, 3, 0)}
    samples = spark.range(0, 80).select(F.lit("s").alias("src"), F.col("id").alias("pos"), F.col("id").cast("double").alias("value"))
    bounds = waves.segment_bounds(units, marks, 3)
    assert waves.segment_samples(bounds, samples).groupBy("step").count().count() == 3
    assert waves.concatenated(bounds, samples, 5).count() == 61 + 71 + 61 - 2 * 5


def test_ranks_do_not_depend_on_how_rows_lie(spark):
    rows = spark.range(0, 1000).select((F.col("id") * 7919 % 1000 / 10).cast("int").alias("a"), "id")
    one = {r.id: r["rank"] for r in select.ranked_globally(rows, ["a", "id"]).collect()}
    two = {r.id: r["rank"] for r in select.ranked_globally(rows.repartition(13), ["a", "id"]).collect()}
    assert one == two and sorted(one.values()) == list(range(1000))
    assert [i for i, _ in sorted(one.items(), key=lambda x: x[1])] == [r.id for r in rows.orderBy("a", "id").collect()]


def test_tiles(spark):
    corpus = spark.createDataFrame(list(enumerate("abcabd")), "ix long, code string")
    paths = spark.createDataFrame([("u", i, c) for i, c in enumerate("abdxcab")], "utt string, ix long, code string")
    got = sorted((r.ix, r.n, r["at"]) for r in search.tile_paths(paths, corpus, 3).collect())
    assert got == [(0, 3, 3), (3, 1, -1), (4, 3, 2)]
