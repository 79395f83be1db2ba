"""The neighbour index, greedy search over it and shortest paths, against plain versions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from unitweave.functions.vectors import EMERGENCY
from unitweave.operators import knn, search

UNITS = "u long, v array<double>, y int"


def clustered(n=600, seed=1, dims=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 10, (10, dims))
    v = centres[rng.integers(0, 10, n)] + rng.normal(0, 0.5, (n, dims))
    v[50:170] = v[7]  # copies
    v[300:303] = 1e6
    return v


@pytest.fixture(scope="module")
def units(spark):
    v = clustered()
    return v, spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], UNITS).cache()


def plain(v, k, take=lambda i, j: True):
    out = {}
    for i in range(len(v)):
        d = ((v - v[i]) ** 2).sum(1)
        near = [j for j in np.lexsort((np.arange(len(v)), d)).tolist() if take(i, j)][:k]
        out |= {(i, r + 1): j for r, j in enumerate(near)}
    return out


def got(df):
    return {(r.q, r["rank"]): r.u for r in df.collect()}


@pytest.fixture(scope="module")
def index(units):
    return knn.build(units[1], copies=5, size=32)


def test_index_prunes_and_is_read_again(spark, units, index, tmp_path):
    v, df = units
    assert index.cells.count() > 10 and index.points.agg(F.sum("n")).first()[0] == len(v)
    sizes = [r["count"] for r in index.points.groupBy("c", "cell").count().collect()]
    assert max(sizes) <= 32
    q = df.withColumnRenamed("u", "q")
    want = plain(v, 4, lambda i, j: i != j)
    assert got(knn.k_nearest(q, df, 4, exclude_self=True, index=index)) == want
    assert got(knn.k_nearest(q, df, 4, exclude_self=True)) == want  # one cell
    n = knn.meetings(q, index, 4)
    assert n["met"] < n["all"] / 3
    knn.build(df, copies=2, size=64, path=f"{tmp_path}/index")
    again = knn.read(spark, f"{tmp_path}/index")
    assert again.copies == 2 and got(knn.k_nearest(q.where("q < 50"), df, 2, index=again)) == {k: u for k, u in plain(v, 2).items() if k[0] < 50}
    with pytest.raises(ValueError):
        knn.k_nearest(q, df, 3, index=again)


def test_descent_by_joins_and_radius(units, index):
    v, df = units
    q = df.where("u % 4 = 0").withColumnRenamed("u", "q")
    assert got(knn.k_nearest(q, df, 3, index=index, limit=0)) == {k: u for k, u in plain(v, 3).items() if k[0] % 4 == 0}
    d = ((v[:, None] - v) ** 2).sum(2)
    for radius, limit in ((0.0, None), (1.5, 0), (20.0, None)):
        counts = knn.radius_counts(q, df, radius, exclude_self=True, index=index, limit=limit)
        assert {r.q: r.n for r in counts.collect()} == {i: int((d[i] <= radius**2).sum()) - 1 for i in range(0, len(v), 4)}


def test_neighbours_by_class(units, spark):
    v, df = units
    q = df.withColumnRenamed("u", "q")
    by = knn.build(df, by="y", copies=4, size=32)
    want = plain(v, 3, lambda i, j: i != j and i % 3 == j % 3)
    assert got(knn.k_nearest(q, df, 3, by="y", exclude_self=True, index=by)) == want
    odd = spark.createDataFrame([(1, v[0].tolist(), None), (2, None, 1), (3, v[0].tolist(), 9), (4, v[0].tolist(), 0), (4, v[0].tolist(), 0)], "q long, v array<double>, y int")
    found = got(knn.k_nearest(odd, df, 2, by="y", index=by))
    assert {k[0] for k in found} == {4} and len(found) == 2
    none = df.limit(0)
    assert knn.k_nearest(q, none, 2).count() == 0 and knn.k_nearest(q.limit(0), df, 2, index=by).count() == 0
    assert knn.k_nearest(q, none, 2, index=knn.build(none)).count() == 0
    assert {r.n for r in knn.radius_counts(q, none, 1.0).collect()} == {0}


def test_cells_in_memory():
    rng = np.random.default_rng(3)
    v = clustered(seed=4)
    ids = rng.permutation(5000)[: len(v)]
    index = knn.LocalIndex(ids, v)
    for q in v[::17] + rng.normal(0, 0.1, (len(v[::17]), v.shape[1])):
        d = ((index.v - q) ** 2).sum(1)
        assert index.nearest(q) == (int(d.argmin()), d.min())
        held = index.ids[np.argsort(d)[:5]]
        row, cost = index.nearest(q, held)
        assert index.ids[row] not in held and cost == np.where(np.isin(index.ids, held), np.inf, d).min()
        assert index.nearest(q, eps=0.5)[1] <= 2.25 * d.min() + 1e-12
    index.looked = 0
    for q in v:
        index.nearest(q)
    assert index.looked < len(v) ** 2 / 3
    assert knn.LocalIndex(ids[:0], v[:0]).nearest(v[0]) is None


def speech(n=120, seed=5):
    """Units whose prev is the cur of the unit before."""
    rng = np.random.default_rng(seed)
    cur, target = rng.normal(size=(n, 3)), rng.normal(size=(n, 4))
    prev = np.vstack([np.zeros(3), cur[:-1]])
    return prev, target, cur


JOINT = "unit_id long, prev array<double>, target array<double>, cur array<double>"


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_natural_resynthesis_gives_the_units_back(spark, limit):
    prev, target, cur = speech()
    units = spark.createDataFrame([(i, p.tolist(), t.tolist(), c.tolist()) for i, (p, t, c) in enumerate(zip(prev, target, cur))], JOINT)
    chunks = {"a": range(0, 2), "b": range(40, 42), "c": range(118, 120)}
    rows = [(utt, s, target[u].tolist(), prev[r[0]].tolist()) for utt, r in chunks.items() for s, u in enumerate(r)]
    targets = spark.createDataFrame(rows, "utt string, step long, target array<double>, begin array<double>")
    found = sorted((r.utt, r.step, r.unit_id, r.cost) for r in search.greedy_search(units, targets, limit=limit).collect())
    assert found == [(utt, s, u, 0.0) for utt, r in chunks.items() for s, u in enumerate(r)]
    holding = targets.withColumn("held", F.sequence(F.lit(0).cast("long"), F.lit(44).cast("long")))
    without = search.greedy_search(units, holding, limit=limit).collect()
    assert len(without) == len(rows) and min(r.unit_id for r in without) >= 45


@pytest.mark.parametrize("limit", [1 << 30, 0])
def test_greedy_keeps_its_bound(spark, limit):
    prev, target, cur = speech(seed=6)
    rng = np.random.default_rng(7)
    units = spark.createDataFrame([(i, p.tolist(), t.tolist(), c.tolist()) for i, (p, t, c) in enumerate(zip(prev, target, cur))], JOINT)
    wanted = rng.normal(size=(2, 2, 4))
    targets = spark.createDataFrame([(u, s, wanted[u, s].tolist()) for u in range(2) for s in range(2)] + [(None, 0, [0.0] * 4), (5, 0, None)], "utt long, step long, target array<double>")
    for eps in (0.0, 0.5):
        rows = sorted((r.utt, r.step, r.unit_id, r.cost) for r in search.greedy_search(units, targets, limit=limit, eps=eps).collect())
        assert len(rows) == 4
        state = np.zeros(3)
        for utt, step, unit, cost in rows:
            state = np.zeros(3) if step == 0 else state
            all_ = ((prev - state) ** 2).sum(1) + ((target - wanted[utt, step]) ** 2).sum(1)
            assert np.isclose(cost, all_[unit]) and cost <= (1 + eps) ** 2 * all_.min() + 1e-9
            assert eps or unit == all_.argmin()
            state = cur[unit]


def plain_path(steps, arcs, last_resort):
    """steps: {step: {unit: cost}}, arcs {(from, to): cost}."""
    order = sorted(steps)
    reached, vias = dict(steps[order[0]]), []
    for a, b in zip(order, order[1:]):
        now, via = {}, {}
        for u, c in steps[b].items():
            own = sorted((reached[f] + arcs[f, u], f) for f in reached if (f, u) in arcs) if b == a + 1 else []
            if not own and last_resort:
                own = sorted((c0 + EMERGENCY, f) for f, c0 in reached.items())
            if own:
                now[u], via[u] = own[0][0] + c, own[0][1]
        reached = now
        vias.append(via)
        if not now:
            return []
    total, at = min((c, u) for u, c in reached.items())
    path = [at]
    for via in reversed(vias):
        path.append(via[path[-1]])
    return [(s, u, total) for s, u in zip(order, reversed(path))]


@pytest.mark.parametrize("segment", [64, 4, 1])
@pytest.mark.parametrize("last_resort", [False, True])
def test_shortest_paths_in_segments(spark, segment, last_resort):
    rng = np.random.default_rng(8)
    rows, arcs = [], {(f, t): float(rng.random()) for f in range(30) for t in range(30) if rng.random() < 0.4}
    lattices = {}
    for utt, (steps, gap) in {"long": (range(3, 26), None), "short": (range(0, 3), None), "one": (range(9, 10), None), "gap": (range(0, 14), 6), "wide": (range(0, 14), (5, 6, 7, 8))}.items():
        steps = [s for s in steps if s != gap and (not isinstance(gap, tuple) or s not in gap)]
        lattices[utt] = {s: {int(u): float(rng.random()) for u in rng.choice(30, rng.integers(1, 9), replace=False)} for s in steps}
        rows += [(utt, s, u, c) for s, own in lattices[utt].items() for u, c in own.items()]
    candidates = spark.createDataFrame(rows + rows[:4] + [("long", None, 1, 0.0), (None, 1, 1, 0.0)], "utt string, step long, unit_id long, tcost double")
    costs = spark.createDataFrame([(f, t, c) for (f, t), c in arcs.items()], "from_id long, to_id long, cost double")
    found = {}
    for r in search.viterbi(candidates, costs, last_resort, segment).collect():
        found.setdefault(r.utt, []).append((r.step, r.unit_id, pytest.approx(r.total, rel=1e-12)))
    want = {u: p for u, own in lattices.items() if (p := plain_path(own, arcs, last_resort))}
    assert {u: sorted(p, key=lambda r: r[0]) for u, p in found.items()} == want and ("gap" in want) == last_resort
    assert search.viterbi(candidates.limit(0), costs).count() == 0


def test_walks_of_many_starts(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(90, 3))
    units = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v) if i != 40], "unit_id long, v array<double>")
    starts = spark.createDataFrame([("a", 0), ("b", 39), ("c", 89), ("d", 5), ("gone", 40)], "walk string, unit_id long")
    got = {}
    for r in search.random_walks(units, starts, 2, k=3, span=4).collect():
        got.setdefault(r.walk, {})[r.step] = r.unit_id
    assert sorted(got) == ["a", "b", "c", "d"] and all(sorted(w) == [0, 1, 2] for w in got.values())
    for w in got.values():
        for n in (1, 2):
            at = w[n - 1]
            near = [j for j in np.lexsort((np.arange(90), ((v - v[at]) ** 2).sum(1))) if not at - 4 <= j <= at and j not in (39, 40, 89)][:3]
            assert w[n] - 1 in near


def test_samples_follow_the_last_ones(spark):
    rng = np.random.default_rng(10)
    context, target, sample = rng.normal(size=(70, 2)), rng.normal(size=(70, 3)), rng.normal(size=70)
    units = spark.createDataFrame([(i, c.tolist(), t.tolist(), float(x)) for i, (c, t, x) in enumerate(zip(context, target, sample))], "unit_id long, context array<double>, target array<double>, sample double")
    wanted = rng.normal(size=(2, 2, 3))
    frames = spark.createDataFrame([(u, s, wanted[u, s].tolist()) for u in range(2) for s in range(2)], "utt long, step long, target array<double>")
    rows = {(r.utt, r.step): (r.unit_id, r["sample"]) for r in search.next_samples(units, frames, 2).collect()}
    for u in range(2):
        last = np.zeros(2)
        for s in range(2):
            best = int((((context - last) ** 2).sum(1) + ((target - wanted[u, s]) ** 2).sum(1)).argmin())
            assert rows[u, s] == (best, sample[best])
            last = np.r_[last[1:], sample[best]]
    assert search.next_samples(units, frames.limit(0), 2).count() == 0


def test_queries_travel_to_shelves_not_to_cells(spark, monkeypatch):
    """Where nothing can be pruned a query travels once to each shelf, however many cells there are."""
    v = np.random.default_rng(12).normal(size=(300, 24))
    units = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "u long, v array<double>")
    index = knn.build(units, copies=3, size=16)
    assert index.cells.count() > 18
    sent, meet = [], knn.meet

    def counted(left, *args, **more):
        sent.append(left.count())
        return meet(left, *args, **more)

    monkeypatch.setattr(knn, "meet", counted)
    q = units.withColumnRenamed("u", "q")
    assert got(knn.k_nearest(q, units, 2, exclude_self=True, index=index)) == plain(v, 2, lambda i, j: i != j)
    assert sum(sent) <= 4 * len(v)  # to homes, of which small ones are not enough, and to the only shelf
    sent.clear()
    counts = knn.radius_counts(q, units, 6.0, index=index)
    d = ((v[:, None] - v) ** 2).sum(2)
    assert {r.q: r.n for r in counts.collect()} == {i: int((d[i] <= 36).sum()) for i in range(len(v))}
    assert sum(sent) <= len(v)


def test_small_meetings_keep_all_cores_busy(spark):
    """The rows of one key are some meetings for each core, in tasks of their own, however few bytes they have."""
    n = 6 * knn.BLOCK
    left = spark.range(n).select(F.lit("").alias("c"), F.col("id").alias("q"))
    right = spark.range(5).select(F.lit("").alias("c"), F.col("id").alias("u"))

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        return pa.table({"task": [TaskContext.get().partitionId()], "rows": [x.num_rows], "others": [y.num_rows]})

    met = knn.meet(left, right, ["c"], "q", work, "task int, rows long, others long", chunk=1 << 16).collect()
    assert sum(r.rows for r in met) == n and {r.others for r in met} == {5}
    assert len(met) > 1 and len({r.task for r in met}) > 1


@pytest.mark.parametrize("seed", [1, 2])
def test_shelves_within_are_those_of_the_nodes_within(seed):
    rng = np.random.default_rng(seed)
    table = pa.table({"cell": np.arange(60), "v": pa.array(rng.normal(size=(60, 4)).tolist()), "shelf": rng.permutation(60) // 7 * 5, "radius": rng.random(60), "n": np.ones(60, int)})
    x = pa.table({"q": np.arange(40), "v": pa.array(rng.normal(size=(40, 4)).tolist()), "bound": rng.random(40)})
    nodes = knn.Nodes(table)
    rows, at, _ = nodes.within(knn.matrix(x["v"]), x["bound"].to_numpy())
    found = knn._shelves_within(x, nodes)
    assert list(zip(found["q"].to_pylist(), found["shelf"].to_pylist())) == sorted({(r, s) for r, s in zip(rows.tolist(), nodes.shelf[at].tolist())})
    assert knn._shelves_within(x, knn.Nodes(table.slice(0, 0))).num_rows == 0


@pytest.mark.parametrize("eps", [0.0, 0.5])
def test_many_queries_at_once(eps):
    """A block of queries finds what each of them finds alone, held units and ties included."""
    rng = np.random.default_rng(13)
    v = np.vstack([rng.normal(size=(200, 5)), np.repeat(rng.normal(size=(3, 5)), 20, axis=0)])
    ids = rng.permutation(1000)[: len(v)]
    index = knn.LocalIndex(ids, v)
    q = np.vstack([v[::7], rng.normal(size=(40, 5))])
    held = [None if i % 3 == 0 else rng.choice(ids, 30).tolist() + [5000] for i in range(len(q))]
    held[1] = ids.tolist()
    rows, dist = index.nearest_of_all(q, held, eps)
    assert rows[1] == -1
    for i, x in enumerate(q):
        free = ~np.isin(index.ids, held[i] or [])
        d = np.where(free, ((index.v - x) ** 2).sum(1), np.inf)
        if i != 1:
            assert free[rows[i]] and dist[i] == d[rows[i]] and dist[i] <= (1 + eps) ** 2 * d.min() + 1e-12
            assert eps or rows[i] == d.argmin()
    assert len(knn.LocalIndex(ids[:0], v[:0]).nearest_of_all(q)[0]) == len(q)
