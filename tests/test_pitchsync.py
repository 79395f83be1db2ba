"""Overlap-add at marks, fragments, and changes of rate, against numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitweave.operators import assemble, pitchsync


def window(left, right, length):
    out, middle = np.zeros(length), length // 2
    for i in range(length):
        o = i - middle
        side = left if o < 0 else right
        if o == 0:
            out[i] = 1
        elif abs(o) <= side:
            out[i] = np.hanning(2 * side + 1)[side + o if o < 0 else side - o]
    return out


def test_frames_at_marks(spark):
    rng = np.random.default_rng(1)
    pos = np.cumsum(rng.integers(3, 9, 12))
    x = rng.normal(size=(12, 20))
    left = np.diff(np.r_[0, pos])
    right = np.r_[left[1:], left[-1]]
    want = np.zeros(pos[-1] + 40)
    for k in range(12):
        for i, v in enumerate(x[k] * window(left[k], right[k], 20)):
            if pos[k] + i - 10 >= 0:
                want[pos[k] + i - 10] += v
    frames = spark.createDataFrame([("u", k, x[k].tolist()) for k in range(12)], "utt string, frame int, samples array<double>")
    marks = spark.createDataFrame([("u", k, int(p)) for k, p in enumerate(pos)] + [("u", 99, None), (None, 0, 3)], "utt string, frame int, pos int")
    got = {r.pos: r.value for r in pitchsync.pitch_overlap_added(frames, marks).collect()}
    assert min(got) >= 0 and all(np.isclose(got.get(p, 0.0), v) for p, v in enumerate(want))


def test_a_constant_hop_is_plain_overlap_add(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6, 8))
    frags = spark.createDataFrame([("u", k, i, [float(v)]) for k, row in enumerate(x) for i, v in enumerate(row)], "utt string, step int, pos int, v array<double>")
    plain = {r.pos: r.value for r in assemble.overlap_added(frags, 4, 4, 4).collect()}
    frames = frags.groupBy("utt", F.col("step").alias("frame")).agg(F.array_sort(F.collect_list(F.struct("pos", (F.col("v")[0] * assemble.V.taper(F.col("pos"), F.lit(8), 4)).alias("x")))).alias("s")).select("utt", "frame", F.col("s.x").alias("samples"))
    marks = spark.createDataFrame([("u", k, 2 + 4 * k) for k in range(6)], "utt string, frame int, pos int")
    got = {r.pos: r.value for r in pitchsync.pitch_overlap_added(frames, marks, window=False).collect()}
    assert all(np.isclose(got[p], v) for p, v in plain.items() if p in got) and len(set(plain) - set(got)) <= 2


def test_fragments(spark):
    x = np.arange(1.0, 31.0)
    samples = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "src string, pos int, value double")
    cuts = spark.createDataFrame([("u", 0, "s", 1, 9), ("u", 1, "s", 20, 28), ("u", 2, "s", 9, 3)], "utt string, step int, src string, start int, end int")

    def column(df, step):
        return [r.value for r in df.where(f"step = {step}").orderBy("i").collect()]

    assert column(pitchsync.cut_fragments(cuts, samples), 0) == x[1:10].tolist()
    got = pitchsync.cut_fragments(cuts, samples, 6)
    wide = np.r_[np.zeros(3), x, np.zeros(3)]
    for step, (a, b) in enumerate(((1, 9), (20, 28))):
        frag = wide[a : b + 7].copy()
        frag[:3] *= np.hanning(6)[:3]
        frag[-3:] *= np.hanning(6)[3:]
        assert np.allclose(column(got, step), frag)
    epochs = cuts.where("step < 2").withColumn("middle", F.col("start") + 3)
    frag = x[1:10] * np.r_[np.hanning(6)[:3], np.hanning(12)[6:]]
    assert np.allclose(column(pitchsync.cut_fragments(epochs, samples), 0), frag)


def test_rates_there_and_back(spark):
    rate, hop = 1000, 0.005
    y = 4 + 3 * np.sin(np.arange(1, 60) / 9.0)
    shift = spark.createDataFrame([("u", k + 1, float(v)) for k, v in enumerate(y)] + [("w", 1, 0.0)], "utt string, k int, shift double")
    x = np.arange(1, 60) * 5.0
    pos, out = x[-1], []
    while pos >= x[0]:
        out.append((pos, np.interp(pos, x, y)))
        pos -= out[-1][1]
    marks = pitchsync.marks_from_shifts(shift, rate, hop)
    got = [(r.pos, r["shift"]) for r in marks.where("utt = 'u'").orderBy("mark").collect()]
    assert np.allclose(got, out[::-1]) and marks.where("utt = 'w'").count() == 1
    v = np.cos(x / 40)
    frames = spark.createDataFrame([("u", k + 1, [float(a), float(k)]) for k, a in enumerate(v)], "utt string, k int, v array<double>")
    there = pitchsync.variable_rate(frames, marks, rate, hop)
    rows = there.orderBy("mark").collect()
    assert np.allclose([r.v[0] for r in rows], np.interp([p for p, _ in got], x, v))
    back = {r.k: r.v for r in pitchsync.constant_rate(there, rate, hop).collect()}
    assert len(back) >= 55 and max(abs(w[0] - v[k - 1]) for k, w in back.items()) < 0.02 and max(abs(w[1] - (k - 1)) for k, w in back.items()) < 1e-9


def line(x, y, at):
    """Linear between and beyond the points."""
    k = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    return y[k] + (y[k + 1] - y[k]) * (at - x[k]) / (x[k + 1] - x[k])


@pytest.mark.parametrize("convention, first", [("world", 0.0), ("straight", 10.0)])
def test_upsampling(spark, convention, first):
    rng = np.random.default_rng(3)
    a, f0 = rng.normal(size=8), np.array([0, 120, 130, 0, 0, 90, 95, 0.0])
    frames = spark.createDataFrame([("u", k, [float(p), float(q)]) for k, (p, q) in enumerate(zip(a, f0))] + [("one", 0, [1.0, 0.0])], "utt string, ix int, v array<double>")
    lengths = spark.createDataFrame([("u", 75), ("one", 3), ("none", 4), ("empty", 0)], "utt string, n int")
    rows = pitchsync.upsampled(frames, lengths, 1000, 0.01, convention, f0=1).collect()
    got = sorted((r.pos, r.v) for r in rows if r.utt == "u")
    x, at = first + 10.0 * np.arange(8), np.arange(75.0)
    assert [p for p, _ in got] == list(range(75))
    assert np.allclose([v[0] for _, v in got], line(x, a, at))
    nearest = np.array([int(np.argmin(np.abs(x - t))) for t in at])
    want = np.where(f0[nearest] > 0, line(x[f0 > 0], f0[f0 > 0], at), -1000.0)
    assert np.allclose([v[1] for _, v in got], want)
    assert sorted((r.pos, r.v) for r in rows if r.utt == "one") == [(i, [1.0, -1000.0]) for i in range(3)] and len(rows) == 78


def test_upsampled_reads_all_in_one_pass(spark):
    """Vectors, F0 and voicing without a join, so that samples are sorted once in each direction."""
    frames = spark.createDataFrame([("a", i, [float(i), float(i % 3)]) for i in range(6)] + [("b", 0, [1.0, 0.0])], "utt string, ix long, v array<double>")
    out = pitchsync.upsampled(frames, spark.createDataFrame([("a", 20), ("b", 3), ("c", 2)], "utt string, n long"), 300, 0.01, f0=1)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("utt = 'a'").count() == 20 and {tuple(r.v) for r in out.where("utt = 'b'").collect()} == {(1.0, -1000.0)} and out.where("utt = 'c'").count() == 0
