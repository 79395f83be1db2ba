"""Operators on small fixtures with known results."""

from __future__ import annotations

import math
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitweave.functions import labels, scalars, vectors
from unitweave.operators import assemble, diagnostics, features, joins, knn, search, select, series, tuning
from unitweave.sources import files, tables


def track(spark, values, utt="u"):
    return spark.createDataFrame([(utt, i, float(x)) for i, x in enumerate(values)], "utt string, ix long, f0 double")


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


@pytest.mark.parametrize(
    ("values", "length", "overlap", "end", "want"),
    [
        (range(10), 4, 2, "cut", [[0, 1, 2, 3], [2, 3, 4, 5], [4, 5, 6, 7], [6, 7, 8, 9]]),
        (range(11), 4, 2, "cut", [[0, 1, 2, 3], [2, 3, 4, 5], [4, 5, 6, 7], [6, 7, 8, 9]]),
        (range(11), 4, 2, "pad", [[0, 1, 2, 3], [2, 3, 4, 5], [4, 5, 6, 7], [6, 7, 8, 9], [8, 9, 10, 0]]),
        (range(11), 4, 2, "wrap", [[0, 1, 2, 3], [2, 3, 4, 5], [4, 5, 6, 7], [6, 7, 8, 9], [8, 9, 10, 0]]),
    ],
)
def test_segments(spark, values, length, overlap, end, want):
    assert column(series.segmented(track(spark, values), "utt", "ix", "f0", length, overlap, end), "values", "segment") == want


@pytest.mark.parametrize(
    ("f0", "ends", "want"),
    [
        ([0, 100, 0, 120, 0], "extrapolate", [90, 100, 110, 120, 130]),
        ([100, 0, 0, 130, 140], "hold", [100, 110, 120, 130, 140]),
        ([0, 100, 0, 120, 0], "hold", [100, 100, 110, 120, 120]),
        ([0, 0], "extrapolate", [0, 0]),
        ([0, 80, 0], "extrapolate", [80, 80, 80]),
    ],
)
def test_gaps(spark, f0, ends, want):
    out = series.gap_filled(track(spark, f0), "utt", "ix", "f0", ends)
    assert column(out, "filled", "ix") == pytest.approx(want) and column(out, "vuv", "ix") == [int(x > 0) for x in f0]


@pytest.mark.parametrize(("f0", "want"), [([0, 100, 0, 120, 0], [100, 100, 120, 120, 120]), ([100, 0, 0, 130, 140], [100, 115, 130, 130, 140]), ([100, 0, 120], [100, 100, 100])])
def test_older_gap_filler(f0, want):
    assert series.held_in_place(f0) == pytest.approx(want)


def test_windows_and_tapers(spark):
    assert vectors.hann(5) == pytest.approx([0, 0.5, 1, 0.5, 0])
    one = spark.range(1)
    assert one.select(vectors.taper_in(F.lit(1), 1)).first()[0] == pytest.approx(0.5)
    for length in (3, 8):
        ends = one.select(*(vectors.taper_in(F.lit(i), length) for i in range(1, length + 1))).first()
        assert all(a + b == pytest.approx(1) for a, b in zip(ends, reversed(ends)))
    assert len(vectors.window_weights("blackman", 7)) == 7 and vectors.window_weights("flat", 3) == [1, 1, 1]


def test_standardising_and_statistics(spark):
    z = vectors.standardised(vectors.literal([-1000, 7]), vectors.literal([5, 5]), vectors.literal([0.25, 0.5]))
    assert spark.range(1).select(z).first()[0] == [-5.0, 4.0]
    frames = spark.createDataFrame([([1.0, 10.0, 0.0],), ([3.0, 16.0, 2.0],), ([float("nan"), 1.0, 1.0],)], "v array<double>")
    rows = {(r.stream, r.d): (r["mean"], r["std"]) for r in features.stream_statistics(frames, "v", (("a", 2), ("f0", 1)), ("f0",)).collect()}
    assert rows == {("a", 0): (2.0, 3.0), ("a", 1): (13.0, 3.0), ("f0", 0): (1.5, 0.5)}


def test_names(spark):
    row = spark.range(1).select(*labels.backoff_names(F.lit("d/v/E_L/n/tS"))).first()
    assert list(row) == ["d/v/E_L/n/tS", "v/E_L/n", "v/E_L", "E_L"]
    assert spark.range(1).select(labels.backoff_names(F.lit("d/v/E_R/n/tS"))[2], labels.monophone(F.lit("d/v/E_R/n/tS"))).first() == ("E_R/n", "E")


def test_scalars(spark):
    x = F.lit(-0.3)
    row = spark.range(1).select(scalars.mu_law_inverse(scalars.mu_law(x)), scalars.from_decibels(scalars.decibels(F.lit(2.0))), scalars.clipped_sample(F.lit(1e9)), scalars.stem(F.lit("/a/b.c/d.e.wav")), scalars.protected_log(F.lit(0.0)), scalars.hz_to_bin(F.lit(62.5), 1000, 8)).first()
    assert list(row) == [pytest.approx(-0.3), pytest.approx(2.0), 32767, "d.e", -1e10, 0]


def lattice(spark):
    rows = [("u", s, u, c) for s, (ids, costs) in enumerate((([4, 8], [0.1, 0.3]), ([4, 7], [0.33, 0.25]), ([2, 5], [0.01, 0.41]))) for u, c in zip(ids, costs)]
    return spark.createDataFrame(rows, "utt string, step long, unit_id long, tcost double")


def test_viterbi(spark):
    c = lattice(spark)
    costs = search.candidate_pairs(c).withColumn("cost", F.lit(0.0))
    rows = search.viterbi(c, costs).orderBy("step").collect()
    assert [r.unit_id for r in rows] == [4, 7, 2] and rows[0].total == pytest.approx(0.36)
    some = costs.where("from_id <> 7")
    assert [r.unit_id for r in search.viterbi(c, some).orderBy("step").collect()] == [4, 4, 2]
    none = costs.where("to_id not in (2, 5)")
    assert search.viterbi(c, none).count() == 0
    assert search.viterbi(c, none, last_resort=True).first().total > vectors.EMERGENCY
    assert search.candidate_pairs(c, n_units=8).count() == 2 + 0 * len(rows) or search.candidate_pairs(c, n_units=8).where("to_id >= 7 or from_id >= 7").count() == 0


def test_greedy_forms_agree(spark):
    rng = np.random.default_rng(1)
    units = spark.createDataFrame([(i, rng.normal(size=2).tolist(), rng.normal(size=3).tolist(), rng.normal(size=2).tolist()) for i in range(60)], "unit_id long, prev array<double>, target array<double>, cur array<double>")
    targets = spark.createDataFrame([(u, s, rng.normal(size=3).tolist(), [1, 2, 3 + s]) for u in range(4) for s in range(1 + u // 2)], "utt long, step long, target array<double>, held array<long>")
    a, b = (sorted((r.utt, r.step, r.unit_id) for r in search.greedy_search(units, targets, limit=n).collect()) for n in (1 << 30, 0))
    assert a == b and not {u for _, _, u in a} & {1, 2}


def test_path_diagnostics(spark):
    path = spark.createDataFrame([("u", i, u) for i, u in enumerate([7, 8, 9, 20, 21])], "utt string, step long, unit_id long")
    assert tuple(diagnostics.join_rate(path).first()) == ("u", 1, 25.0)
    assert [(r.first_id, r.length) for r in diagnostics.contiguous_runs(path).orderBy("run").collect()] == [(7, 3), (20, 2)]
    values = spark.createDataFrame([(0.0,), (2.0,), (4.0,), (0.0,)], "x double")
    assert values.agg(diagnostics.positive_mean(F.col("x"))).first()[0] == 3.0
    assert values.where("x = 0").agg(diagnostics.positive_mean(F.col("x"))).first()[0] == 0.0


def test_time_joins(spark):
    marks = spark.createDataFrame([("u", t, f"m{t}") for t in (0, 10, 20)], "utt string, t long, name string")
    points = spark.createDataFrame([("u", t) for t in (-5, 4, 5, 6, 15, 99)] + [("none", 1)], "utt string, t long")
    got = {(r.utt, r.t): r.near_name for r in joins.nearest(points, marks, "utt", "t", ["name"]).collect()}
    assert got == {("u", -5): "m0", ("u", 4): "m0", ("u", 5): "m0", ("u", 6): "m10", ("u", 15): "m10", ("u", 99): "m20", ("none", 1): None}
    spans = marks.select("utt", F.col("t").alias("start"), "name")
    got = {(r.utt, r.t): r.name for r in joins.interval_joined(points, spans, "utt", "t", "start", ["name"]).collect()}
    assert got[("u", -5)] is None and got[("u", 10 - 4)] == "m0" and got[("u", 15)] == "m10" and got[("u", 99)] == "m20"


@pytest.mark.parametrize("names", [50_000, 0])
def test_backoff_of_a_name_that_all_targets_have(spark, monkeypatch, names):
    """Targets are not dealt by their names; rows of one target and missing names count as before."""
    monkeypatch.setattr(joins, "NAMES", names, raising=False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        units = spark.createDataFrame([(i, f"n{i % 7}", "same") for i in range(40)] + [(99, None, None)], "unit_id long, long_ string, short string")
        targets = spark.createDataFrame([(t, f"n{t % 9}", "same") for t in range(50)] + [(3, "n5", None), (77, None, "none")], "t long, long_ string, short string")
        out = joins.backoff(targets, units, "t", [(F.col(c), F.col(c)) for c in ("long_", "short")], "unit_id", 8)
        got = sorted(out.select("t", "rank", "unit_id", "level").collect())
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = []
    for t in range(50):
        exact = {i for i in range(40) if i % 7 == t % 9 or t == 3 and i % 7 == 5}
        best = sorted((0 if i in exact else 1, i) for i in range(40))[:8]
        want += [(t, r + 1, i, level) for r, (level, i) in enumerate(best)]
    assert got == want
    assert names == 0 or "SortMergeJoin" not in plan


def test_backoff(spark):
    units = spark.createDataFrame([(0, "aa", "a"), (1, "ab", "a"), (2, "aa", "a"), (3, "c", "c")], "unit_id long, long_ string, short string")
    targets = spark.createDataFrame([("x", "aa", "a"), ("y", "q", "q")], "t string, long_ string, short string")
    out = joins.backoff(targets, units, "t", [(F.col(c), F.col(c)) for c in ("long_", "short")], "unit_id", 3, fallback=1)
    assert sorted(map(tuple, out.collect())) == [("x", 1, 0, 0), ("x", 2, 2, 0), ("x", 3, 1, 1), ("y", 1, 1, -1)]


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(90, 5))
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "q long, v array<double>")
    u = q.withColumnRenamed("q", "u")
    d = ((x[:, None] - x) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    monkeypatch.setattr(knn, "CHUNK", 25)
    got = {(r.q, r["rank"]): r.u for r in knn.k_nearest(q, u, 4, exclude_self=True).collect()}
    assert got == {(i, k + 1): int(j) for i in range(90) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    assert {r.q: r.n for r in knn.radius_counts(q, u, 2.0).collect()} == {i: int((d[i] <= 4).sum()) + 1 for i in range(90)}


def test_assembly(spark):
    frames = spark.createDataFrame([("s", i, [float(i + 1)]) for i in range(6)], "src string, frame long, v array<double>")
    path = spark.createDataFrame([("u", 0, "s", 0), ("u", 1, "s", 4)], "utt string, step long, src string, frame long")
    frags = assemble.fragments(path, frames, 2, 1, 1)
    assert [r.v[0] for r in frags.orderBy("step", "pos").collect()] == [0, 1, 2, 3, 4, 5, 6, 0]
    whole = assemble.overlap_added(assemble.fragments(path.withColumn("frame", F.lit(1).cast("long")), spark.createDataFrame([("s", i, [1.0]) for i in range(6)], "src string, frame long, v array<double>"), 2, 1, 1), 2, 2, 2)
    assert column(whole, "value", "pos")[1:-1] == pytest.approx([1.0] * (len(column(whole, "value", "pos")) - 2))


def test_choosing(spark):
    names = spark.createDataFrame([(f"u{i:02}",) for i in range(20)], "utt string")
    assert sorted(r.utt for r in select.training_set(names, "utt", 5, ["3"]).collect()) == ["u00", "u01", "u02", "u04"]
    assert [r.utt for r in select.training_set(names, "utt", "u1", ["5"]).where("utt < 'u12'").orderBy("utt").collect()] == ["u10", "u11"]
    assert select.test_set(names, "utt", ["u1"], names.where("utt < 'u15'"), 2).count() == 2
    assert sorted((r.utt, r["rank"]) for r in select.ranked_globally(names, ["utt"]).collect()) == [(f"u{i:02}", i) for i in range(20)]
    assert select.sample_rows(names, 3, "utt").collect() == select.sample_rows(names.repartition(5), 3, "utt").collect()


def test_units(spark):
    frames = spark.createDataFrame([("u", i, [float(i)]) for i in range(20)], "utt string, frame long, v array<double>")
    cuts = spark.createDataFrame([("u", i, a, b) for i, (a, b) in enumerate(((0, 1), (1, 5), (5, 12), (12, 17)))], "utt string, unit_ix long, start long, end long")
    assert column(features.cut_contexts(cuts, frames), "frame", "cut_ix") == [0, 1, 5, 12, 17]
    states = spark.createDataFrame([("u", s, 3 * s, 3 * s + 3, str(2 + s % 5)) for s in range(10)], "utt string, seq int, start long, end long, state string")
    halves = features.halfphones(states)
    assert [(r.phone_ix, r.half, r.start, r.middle, r.end) for r in halves.orderBy("phone_ix", "half").collect()] == [(0, "L", 0, 3, 6), (0, "R", 6, 9, 15), (1, "L", 15, 18, 21), (1, "R", 21, 24, 30)]
    assert features.halfphone_vectors(halves.where("end <= 15"), frames).orderBy("phone_ix", "half").first().target == [0.0, 3.0, 5.0]
    fixed = features.length_matched(frames, spark.createDataFrame([("u", 22)], "utt string, n long"), "utt", "frame", "v", 1)
    assert fixed.count() == 22 and features.length_matched(frames, spark.createDataFrame([("u", 99)], "utt string, n long"), "utt", "frame", "v", 1).count() == 0
    sil = spark.createDataFrame([("u", 0, 2, "#"), ("u", 2, 22, "a"), ("u", 22, 25, "#")], "utt string, start long, end long, phone string")
    out = features.silence_restored(frames, sil, 1)
    assert column(out, "frame", "frame") == list(range(25)) and column(out, "v", "frame")[2][0] == 0.0


def test_files(spark, tmp_path):
    (tmp_path / "a.f0").write_bytes(b"\0" * 12 + files.floats(1, 2, 3, 4))
    (tmp_path / "b.bad").write_bytes(files.floats(1, 2, 3))
    rows = files.read_matrix(spark, str(tmp_path), 2, header=True, pattern="*.f0").orderBy("frame").collect()
    assert [(r.utt, r.frame, r.v) for r in rows] == [("a", 0, [1, 2]), ("a", 1, [3, 4])]
    assert files.read_matrix(spark, str(tmp_path), 2, pattern="*.bad", skip_bad=True).count() == 0
    files.write_matrix(spark.createDataFrame(rows), str(tmp_path / "out"), ".f0")
    assert (tmp_path / "out" / "a.f0").read_bytes() == files.floats(1, 2, 3, 4)
    waves = files.wave_bytes(spark.createDataFrame([("w", 16000, [0.0, 1e6, -3.0])], "utt string, rate int, samples array<double>"))
    files.write_files(waves, str(tmp_path / "wav"), ".wav")
    assert waves.first().clipped == 1 and tuple(files.read_wave(spark, str(tmp_path / "wav"), mono=True).first()) == ("w", 16000, [0, 32767, -3])
    (tmp_path / "good.pm").write_text("EST_File Track\nEST_Header_End\n0.1 1\n0.2 0\n0.3 1\n")
    (tmp_path / "falls.pm").write_text("EST_Header_End\n0.2 1\n0.1 1\n")
    assert [(r.utt, r.pm_ix, r.t_sec, r.voiced) for r in files.read_marks(spark, str(tmp_path), pattern="*.pm", drop_last=True).orderBy("pm_ix").collect()] == [("good", 0, 0.1, 1), ("good", 1, 0.2, 0)]
    (tmp_path / "x.lab").write_text("0 500000 a^b-c+d=e[2]\n500000 1000000 a^b-c+d=e[3]\n")
    lab = files.read_labels(spark, str(tmp_path), r"^([^^]+)\^([^-]+)-([^+]+)\+([^=]+)=([^\[]+)", "*.lab").orderBy("seq").collect()
    assert [(r.start, r.end, r.c, r.rr, r.state) for r in lab] == [(0, 10, "c", "e", "2"), (10, 20, "c", "e", "3")]


def test_tables(spark, tmp_path):
    store = tables.UnitDatabase(spark, str(tmp_path), {"a": 1})
    store.write("units", spark.range(3))
    with pytest.raises(Exception, match="exist"):
        store.write("units", spark.range(3))
    store.write("units", spark.range(4), overwrite=True)
    assert store.read("units").count() == 4 and store.path != tables.UnitDatabase(spark, str(tmp_path), {"a": 2}).path
    t = spark.createDataFrame([(0, 1, True, False, None, False, None), (0, 2, False, False, None, False, None)], tables.TRANSITIONS)
    done = tables.with_labels(t, spark.createDataFrame([(0, 2, True)], "from_index int, to_index int, ok boolean")).orderBy("to_index").collect()
    assert [(r.labelled, r.labelled_ok) for r in done] == [(False, None), (True, True)]


def test_marks_from_f0(spark):
    out = series.synthetic_marks(track(spark, [100.0] * 50 + [0.0] * 30), "utt", "ix", "f0", 1000)
    assert column(out, "sample", "mark_ix") == [*range(0, 51, 10), *range(55, 80, 5)]
    assert column(series.resampled(track(spark, [0, 10, 20]).withColumn("x", F.col("ix") * 1.0), spark.createDataFrame([("u", x) for x in (-1.0, 0.5, 1.75, 9.0)], "utt string, x double"), "utt", "x", "f0"), "f0", "x") == [0, 5, 17.5, 20]


def test_stream_of_targets(spark, tmp_path):
    from unitweave.streaming import online

    units = spark.createDataFrame([(i, [float(i)], [float(i % 7)], [float(i) / 2]) for i in range(20)], "unit_id long, prev array<double>, target array<double>, cur array<double>")
    rows = [("a", s, [float(s)]) for s in range(6)] + [("b", s, [float(5 - s)]) for s in range(4)]
    schema = "utt string, step long, target array<double>"
    want = sorted((r.utt, r.step, r.unit_id) for r in search.greedy_search(units, spark.createDataFrame(rows, schema)).collect())
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        online.attach(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), units, f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    got = sorted((r.utt, r.step, r.unit_id) for r in spark.read.parquet(f"{tmp_path}/state").collect())
    assert got == want


def test_nothing_outside_imports_the_training_data_subpackage():
    root = Path(__file__).resolve().parent.parent
    for p in [*root.glob("unitweave/**/*.py"), *root.glob("tests/*.py")]:
        if "llm" not in p.parts and p.name != Path(__file__).name:
            assert "unitweave.llm" not in p.read_text() and "from unitweave import llm" not in p.read_text(), p
    code = "import sys; sys.modules['unitweave.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'greedy_search' in e.queries() and 'pipeline' not in e.queries(); assert not [n for n in e.queries() if n.startswith('op')]"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0


def test_settings():
    from unitweave.plans.config import Settings, stale

    a = Settings.of({"streams": [["mag", 3], ["lf0", 1]], "join_cost_weight": 0.2})
    b = Settings.of({"streams": [["mag", 3], ["lf0", 1]], "join_cost_weight": 0.3})
    assert a.name != b.name and stale(a, a) == [] and stale(a, b) == ["weighted", "candidates"]
    for bad in ({"nonsense": 1}, {"join_cost_weight": 2}, {"streams": [["a", 1]], "target_weights": [1, 2]}):
        with pytest.raises(ValueError):
            Settings.of(bad)


def test_edges_levels_and_records(spark, tmp_path):
    t = track(spark, [0, 0, 5, 0, 7, 0])
    assert column(series.edges_replaced(t, "utt", "ix", "f0", F.col("f0") <= 0, -10.0), "value_out", "ix") == [-10, -10, 5, 0, 7, -10]
    assert series.run_text(t.withColumn("v", (F.col("f0") > 0).cast("int")), "utt", "ix", "v").first().text == "0*2 1*1 0*1 1*1 0*1"
    s = spark.createDataFrame([("u", 0, 0.3), ("u", 1, -0.3), ("z", 0, 0.0)], "utt string, pos long, value double")
    out = {(r.utt, r.pos): r.value for r in assemble.level_normalised(s).collect()}
    assert out[("u", 0)] == pytest.approx(10**-1.3) and out[("z", 0)] == 0.0
    for i in range(2):
        tables.record_run(spark, f"{tmp_path}/runs", f"r{i}", {"w": i}, i / 2)
    assert spark.read.parquet(f"{tmp_path}/runs").count() == 2
    assert [r.unit_id for r in search.every_nth_unit(spark, 7, 3).orderBy("step").collect()] == [0, 3, 6]


def test_hann_of_one():
    assert vectors.hann(1) == [1.0] and math.isclose(sum(vectors.window_weights("bartlett", 3)), 1.0)


def test_next_values_take_one_pass(spark):
    """No frame ends with the track: Spark would go through it anew for each row."""
    from unitweave.operators import features, joins, pitchsync, series

    t = spark.createDataFrame([("a", i, float(i % 3)) for i in range(9)], "utt string, ix long, f0 double")
    v = t.select("utt", F.col("ix").cast("double").alias("pos"), F.array("f0").alias("v"))
    grid = t.select("utt", (F.col("ix") + 0.5).alias("pos"))
    phones = t.select("utt", F.col("ix").alias("start"), (F.col("ix") + 1).alias("end"), F.lit("x").alias("phone"))
    plans = [
        joins.nearest(t, t.where("ix % 2 = 0").withColumnRenamed("f0", "m"), "utt", "ix", ["m"]), joins.binned_clipped(t, t.withColumn("z", F.col("ix")), "utt", "ix", "z", ["f0"]),
        pitchsync.read_between(v, grid, "pos", "v", "extend"), series.resampled(v.select("utt", "pos", F.col("v")[0].alias("y")), grid, "utt", "pos", "y"), series.gap_filled(t, "utt", "ix", "f0"),
        series.edges_replaced(t, "utt", "ix", "f0", F.col("f0") <= 0, -1.0), series.voiced_interpolated(t, "utt", "ix", "f0", F.col("f0") > 0), features.silence_restored(v.select("utt", F.col("pos").alias("frame"), "v"), phones, 1),
    ]
    for df in plans:
        assert "currentrow$(), unboundedfollowing$()" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert plans[2].orderBy("pos").first().v == [0.5]
