"""Transition tables in buckets, mini-batches, and weight searches in bulk."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitweave.operators import tuning
from unitweave.sources import tables


def test_a_unit_is_looked_up_in_one_bucket(spark, tmp_path):
    table = tables.TransitionTable(spark, f"{tmp_path}/t", buckets=8)
    pairs = [(i, (i * 7) % 50) for i in range(50)] + [(None, 3), (3, None)]
    table.append(spark.createDataFrame(pairs, "from_index int, to_index int"))
    table.append(spark.createDataFrame([(i, i + 1) for i in range(49)] + [(3, 21)], "from_index int, to_index int"), confidence=F.lit(0.9).cast("float"))
    rows = table.of(3)
    assert sorted((r.to_index, r.natural, round(r.confidence, 3)) for r in rows.collect()) == [(4, True, 0.9), (21, False, 0.5), (21, False, 0.9)]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(from_index)" in plan
    files = {f.rpartition("/")[0] for f in rows.inputFiles()}
    assert len({f.rpartition("bucket=")[2] for f in table.scan().inputFiles()}) > 1 and len(files) <= 8
    assert table.scan().count() == 100 and table.scan().columns == rows.columns
    many = table.of_all(spark.createDataFrame([(3,), (3,), (49,), (77,)], "unit_id long")).collect()
    assert sorted((r.from_index, r.to_index) for r in many) == [(3, 4), (3, 21), (3, 21), (49, 43)]
    answers = spark.createDataFrame([(3, 4, True)], "from_index int, to_index int, ok boolean")
    assert tables.with_labels(table.scan(), answers).where("labelled").count() == 1


def test_batches_cover_an_epoch_and_resume(spark):
    a = spark.createDataFrame([(f"u{i % 5}", i, [float(i)]) for i in range(103)], "utt string, frame long, v array<double>")
    b = a.where("frame <> 50").withColumn("v", F.transform("v", lambda x: -x))

    def rows(epoch, **more):
        return sorted((r.batch, r.row, r.frame, r.a[0], r.b[0]) for r in tables.mini_batches({"a": a, "b": b}, 10, epoch, **more).collect())

    zero, one = rows(0), rows(1)
    assert [r[:2] for r in zero] == [(k // 10, k % 10) for k in range(102)]
    assert sorted(r[2] for r in zero) == sorted(r[2] for r in one) == [i for i in range(103) if i != 50] and zero != one
    assert all(x == f and y == -f for _, _, f, x, y in zero)
    assert rows(0, first=4) == [r for r in zero if r[0] >= 4] and rows(0) == zero
    train, held = tables.split(a, "utt", 0.4)
    assert train.count() + held.count() == 103 and not {r.utt for r in train.collect()} & {r.utt for r in held.collect()}
    assert tables.mini_batches({"a": a.limit(0), "b": b}, 10, 0).count() == 0


def test_balance_gives_groups_equal_shares(spark):
    base = {"j": 4.0, "t1": 1.0, "t2": 1.0}
    start = spark.createDataFrame([(0, "j", "join", 1.0), (0, "t1", "target", 1.0), (0, "t2", "target", 1.0)], "cand int, stream string, group string, weight double")
    factor = F.create_map(*(F.lit(x) for p in base.items() for x in p))
    course = tuning.balanced(start, lambda w: w.select("cand", "stream", (F.col("weight") * factor[F.col("stream")]).alias("cost")), 12)
    losses = [r.loss for r in course.select("epoch", "loss").distinct().orderBy("epoch").collect()]
    best = {r.stream: r.weight * base[r.stream] for r in tuning.best_weights(course).collect()}
    assert min(losses) < losses[0] / 3 and {r.goal for r in course.where("stream = 'j'").collect()} == {3.0}
    assert abs(best["j"] - 3) < 0.5 and abs(best["t1"] - 1.5) < 0.3


def test_a_step_turns_and_stops(spark):
    schema = "cand int, stream string, group string, weight double, step double, direction double, goal double"
    state = spark.createDataFrame([(0, "a", "g", 1.0, 0.1, 1.0, 2.0), (0, "b", "g", 0.05, 0.1, 1.0, 2.0), (0, "c", "g", 1.0, 0.1, -1.0, 2.0)], schema)
    costs = spark.createDataFrame([(0, "a", 1.0), (0, "b", 3.0), (0, "c", 2.0)], "cand int, stream string, cost double")
    got = {r.stream: (round(r.next_weight, 6), round(r.next_step, 6), r.next_direction) for r in tuning.balance_step(state, costs).collect()}
    assert got == {"a": (1.12, 0.12, 1.0), "b": (0.0, 0.05, -1.0), "c": (1.0, 0.1, 0.0)}


def test_searches_try_points_together(spark):
    jobs = []

    def many(points):
        jobs.append(len(points))
        return [float(((p - np.array([1, -2])[: len(p)]) ** 2).sum()) for p in points]

    assert tuning.simplex_search(many, [0, 0]) == pytest.approx([1, -2], abs=1e-3) and set(jobs) == {3, 6}
    assert tuning.section_search(many, -3, 3, 1e-5) == pytest.approx(1, abs=1e-5)
    assert tuning.coordinate_search(many, [0, 0], -5, 5, 1e-4) == pytest.approx([1, -2], abs=1e-3)
    loss = tuning.table_losses(spark, ["x", "y"], lambda w: w.groupBy("cand").agg(F.sum((F.col("weight") - F.when(F.col("stream") == "x", 1.0).otherwise(-2.0)) ** 2).alias("loss")))
    assert loss([np.array([1.0, -2.0]), np.array([0.0, 0.0])]) == [0.0, 5.0]


def test_only_what_changed_is_made_anew(spark, tmp_path):
    from unitweave.plans.config import Project, Settings

    def run(**settings):
        project = Project(spark, str(tmp_path), Settings(**settings))
        project.table("units", ["n_train"], [], lambda: spark.range(5).toDF("u"))
        project.table("weighted", ["join_cost_weight"], ["units"], lambda u: u.withColumn("w", F.lit(project.settings.join_cost_weight)))
        project.table("candidates", ["candidates"], ["weighted"], lambda u: u.limit(project.settings.candidates))
        return project

    first, again, other, back = run(), run(), run(join_cost_weight=0.25), run()
    assert first.built == ["units", "weighted", "candidates"] and again.built == back.built == []
    assert other.built == ["weighted", "candidates"] and other.paths["units"] == first.paths["units"] and other.paths["weighted"] != first.paths["weighted"]
    assert run(candidates=2).built == ["candidates"]
    (tmp_path / first.paths["units"].rpartition("/")[2] / "_SUCCESS").unlink()
    assert run().built == ["units"]
    with pytest.raises(ValueError):
        first.table("x", ["nothing"], [], lambda: spark.range(1))
