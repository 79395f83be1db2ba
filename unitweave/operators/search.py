"""Sequence search: greedy joint search, shortest paths through candidate lattices, tiling, walks.

Greedy search is sequential along an utterance and runs side by side over utterances, by the pruned neighbour index of
``knn``: a unit table up to ``BROADCAST_BYTES`` goes to every task as cells in memory, where ``TOGETHER`` utterances take
their next step at once; a larger one stays in a stored index, and all utterances take their next step together. Shortest paths are min-plus
products of dense step matrices, cut into segments where utterances are long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from unitweave.functions.vectors import EMERGENCY
from unitweave.operators import knn
from unitweave.sources.scratch import drop, fresh_path, kept

#: Doubles of a unit table that goes to every task, in bytes.
BROADCAST_BYTES = 256 << 20
#: Utterances that a task takes through the units at once.
TOGETHER = 128


def _arrays(units: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    t = units.select("unit_id", F.col("prev").cast("array<double>").alias("prev"), F.col("target").cast("array<double>").alias("target"), F.col("cur").cast("array<double>").alias("cur")).toArrow().sort_by("unit_id")
    return t["unit_id"].to_numpy(), knn.matrix(t["prev"]), knn.matrix(t["target"]), knn.matrix(t["cur"])


def greedy_search(units: DataFrame, targets: DataFrame, start: list[float] | None = None, limit: int = BROADCAST_BYTES, eps: float = 0.0, index: knn.Index | None = None) -> DataFrame:
    """(utt, step, unit_id, cost): for each target of an utterance, in order, the unit whose (prev, target) is nearest
    to (the last chosen unit's cur, the target vector); of equally near ones the least id.

    units (unit_id, prev, target, cur), targets (utt, step, target). A column ``held`` of targets (array of unit ids)
    keeps those units out. The first state is ``start``, zeros if none is given; a column ``begin`` of targets gives an
    utterance its own (on its first step, where not null). cost is the squared distance. With ``eps`` each chosen unit
    is at most 1 + eps times as far as the nearest one. ``index``: ``joint_index`` of the units, which then stay in
    place; it has to keep as many copies as the longest list ``held`` has, and one. A target without any unit left is
    left out, and the state stays. Steps of an utterance differ; a null target or utterance has no row."""
    first = units.select(F.size("prev").alias("j"), F.size("target").alias("t")).first()
    targets = targets.where("utt IS NOT NULL AND target IS NOT NULL")
    if first is None:
        return targets.select("utt", F.col("step").cast("long"), F.lit(None).cast("long").alias("unit_id"), F.lit(None).cast("double").alias("cost")).limit(0)
    begin = start or [0.0] * first.j
    if index is None and units.count() * (2 * first.j + first.t) * 8 <= limit:
        return _greedy_local(units, targets, begin, eps)
    return _greedy_steps(units, targets, begin, eps, index)


def joint_index(units: DataFrame, held: int = 0, size: int | None = None, path: str | None = None) -> knn.Index:
    """The index of (prev, target) for searches that hold out up to ``held`` units a target."""
    return knn.build(units.select(F.col("unit_id").alias("u"), F.concat(F.col("prev").cast("array<double>"), F.col("target").cast("array<double>")).alias("v")), copies=held + 1, size=size, path=path)


def _greedy_local(units: DataFrame, targets: DataFrame, begin: list[float], eps: float) -> DataFrame:
    ids, prev, target, cur = _arrays(units)
    held = targets.sparkSession.sparkContext.broadcast((knn.LocalIndex(ids, np.hstack([prev, target])), cur[np.argsort(ids, kind="stable")]))
    del prev, target, cur
    keep_out, own = "held" in targets.columns, "begin" in targets.columns
    schema = T.StructType([targets.schema["utt"], T.StructField("step", T.LongType()), T.StructField("unit_id", T.LongType()), T.StructField("cost", T.DoubleType())])
    want = to_arrow_schema(schema)

    def run(t: pa.Table) -> pa.Table:
        index, cur = held.value
        t = t.append_column("_u", t["utt"].combine_chunks().dictionary_encode().indices).sort_by([("_u", "ascending"), ("step", "ascending")])
        number = t["_u"].to_numpy()
        start = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        length = np.diff(np.r_[start, len(number)])
        wanted = knn.matrix(t["target"])
        given = t["begin"].take(pa.array(start)).to_pylist() if own else [None] * len(start)
        state = np.array([begin if x is None else x for x in given], float)
        chosen, cost = np.full(len(number), -1), np.zeros(len(number))
        for n in range(int(length.max())):
            now = np.flatnonzero(length > n)
            at = start[now] + n
            out = t["held"].take(pa.array(at)).to_pylist() if keep_out else None
            chosen[at], cost[at] = index.nearest_of_all(np.hstack([state[now], wanted[at]]), out, eps)
            some = chosen[at] >= 0
            state[now[some]] = cur[chosen[at[some]]]
        found = np.flatnonzero(chosen >= 0)
        some = t.take(pa.array(found))
        return pa.table([some["utt"], some["step"], pa.array(index.ids[chosen[found]]), pa.array(cost[found])], names=want.names).cast(want)

    # Utterances of a group take their steps together.
    numbers = targets.select("utt").distinct()
    groups = max(1, -(-numbers.count() // TOGETHER))
    rows = targets.select("utt", F.col("step").cast("long").alias("step"), F.col("target").cast("array<double>").alias("target"), *(["held"] if keep_out else []), *([F.col("begin").cast("array<double>").alias("begin")] if own else []))
    return rows.groupBy(F.pmod(F.xxhash64("utt"), F.lit(groups)).alias("_g")).applyInArrow(run, schema)


def _draw(seed: int, *parts: str) -> Column:
    """A number below 2**32 that follows from the seed and columns."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") for p in parts)).cast("binary")), 1, 8), 16, 10).cast("long")


def _together(targets: DataFrame, first: Column, units: DataFrame, index: knn.Index, k: int, place: Column, after: Column, eps: float = 0.0) -> DataFrame:
    """All utterances of targets (utt, step, target[, held], ...) take a step together; a row (utt, step, unit_id, cost,
    and the columns of ``units``) for each step that found something.

    Their queries (state, target) meet the index, ``place`` (of x, the k nearest, and the columns utt and step) says
    which of these is taken, and ``after`` is the next state, of ``state`` and the columns of ``units``. States and
    results are tables; the driver counts steps. A step reads the units' columns once."""
    spark = targets.sparkSession
    held = ["held"] if "held" in targets.columns else []
    order = F.row_number().over(Window.partitionBy("utt").orderBy("step")) - 1
    targets = kept(targets.withColumn("_n", order).withColumn("_first", first).select("utt", F.col("step").cast("long").alias("step"), F.col("target").cast("array<double>").alias("target"), "_n", "_first", *held).sortWithinPartitions("_n"), "targets")
    units = kept(units, "units")
    state = kept(targets.where("_n = 0").select("utt", F.col("_first").alias("state")), "state")
    path, steps, schema = fresh_path(spark, "steps"), targets.agg(F.max("_n")).first()[0], None
    for n in range(0 if steps is None else steps + 1):
        now = targets.where(F.col("_n") == n)
        queries = now.join(state, "utt").select(F.col("utt").alias("q"), F.lit("").alias("c"), F.concat("state", "target").alias("v"), *held)
        found = knn.search(queries, index, k, eps)
        best = found.where(F.size("x") > 0).withColumnRenamed("q", "utt").join(now.select("utt", "step"), "utt").withColumn("x", F.get("x", place))
        new = kept(best.select("utt", "step", F.col("x.u").alias("unit_id"), F.col("x.dist2").alias("cost")).join(units, "unit_id"), "new")
        new.write.mode("append").parquet(path)
        schema = new.schema
        done = state.join(new.drop("step", "cost", "unit_id"), "utt", "left").select("utt", F.coalesce(after, "state").alias("state"))
        done = kept(done, "state")
        drop(found, new, state)
        state = done
    drop(state, targets, units)
    if schema is None:
        return spark.createDataFrame([], T.StructType([targets.schema["utt"], T.StructField("step", T.LongType()), T.StructField("unit_id", T.LongType()), T.StructField("cost", T.DoubleType()), *(f for f in units.schema.fields if f.name != "unit_id")]))
    return spark.read.schema(schema).parquet(path)


def _greedy_steps(units: DataFrame, targets: DataFrame, begin: list[float], eps: float, index: knn.Index | None) -> DataFrame:
    first = F.array(*(F.lit(float(x)) for x in begin))
    if "begin" in targets.columns:
        first = F.coalesce(F.col("begin").cast("array<double>"), first)
    if index is None:
        most = targets.agg(F.max(F.array_size("held"))).first()[0] if "held" in targets.columns else 0
        index = joint_index(units, most or 0)
    ends = units.select(F.col("unit_id").cast("long").alias("unit_id"), F.col("cur").cast("array<double>").alias("cur"))
    return _together(targets, first, ends, index, 1, F.lit(0), F.col("cur"), eps).select("utt", "step", "unit_id", "cost")


def candidate_pairs(candidates: DataFrame, n_units: int | None = None, repeats: bool = True, regressions: bool = True) -> DataFrame:
    """(from_id, to_id) of candidates of neighbouring steps (utt, step, unit_id), each once. With n_units, only ids in
    [1, n_units - 1) can be joined; repeats and regressions of the source position can be left out."""
    a = candidates.select("utt", F.col("step").alias("_s"), F.col("unit_id").alias("from_id"))
    b = candidates.select("utt", (F.col("step") - 1).alias("_s"), F.col("unit_id").alias("to_id"))
    if n_units is not None:
        a = a.where((F.col("from_id") >= 1) & (F.col("from_id") < n_units - 1))
        b = b.where((F.col("to_id") >= 1) & (F.col("to_id") < n_units - 1))
    out = a.join(b, ["utt", "_s"]).select("from_id", "to_id").distinct()
    if not repeats:
        out = out.where("from_id <> to_id")
    return out if regressions else out.where("to_id >= from_id")


def join_costs(pairs: DataFrame, contexts: DataFrame) -> DataFrame:
    """(from_id, to_id, cost): the distance from one unit's end to the next one's start; 0 for natural neighbours.
    contexts (unit_id, start, end)."""
    from unitweave.functions.vectors import distance

    a = contexts.select(F.col("unit_id").alias("from_id"), F.col("end").cast("array<double>").alias("_e"))
    b = contexts.select(F.col("unit_id").alias("to_id"), F.col("start").cast("array<double>").alias("_b"))
    cost = F.when(F.col("to_id") == F.col("from_id") + 1, F.lit(0.0)).otherwise(distance(F.col("_e"), F.col("_b")))
    return pairs.join(a, "from_id").join(b, "to_id").select("from_id", "to_id", cost.alias("cost"))


def _repeated(column: pa.ChunkedArray, n: int) -> pa.Array:
    """The first value of a column, n times."""
    return pa.array([column[0].as_py()] * n, column.type)


#: Steps of a lattice that one task takes; longer lattices are cut into segments of so many.
SEGMENT = 64


class _Segment:
    """The steps of a segment as dense matrices of the costs of their arcs, target costs of the later step included.

    ids[0] are the candidates of the step before the segment where it has one (its entry), else of its first step."""

    def __init__(self, nodes: pa.Table, arcs: pa.Table, last_resort: bool):
        nodes = nodes.sort_by([("step", "ascending"), ("unit_id", "ascending")])
        step, unit, cost, entry = (nodes[c].to_numpy() for c in ("step", "unit_id", "tcost", "entry"))
        self.steps, first = np.unique(step, return_index=True)
        self.ids, costs = np.split(unit, first[1:]), np.split(cost, first[1:])
        self.has_entry = bool(entry[0])
        self.first = np.zeros(len(self.ids[0])) if self.has_entry else costs[0]
        a_step, a_from, a_to, a_cost = (arcs[c].to_numpy() for c in ("step", "from_id", "to_id", "cost"))
        order = np.argsort(a_step, kind="stable")
        cut = np.searchsorted(a_step[order], [self.steps, self.steps + 1])
        self.arcs = []
        for k in range(1, len(self.steps)):
            own = order[cut[0][k] : cut[1][k]]
            m = np.full((len(self.ids[k - 1]), len(self.ids[k])), np.inf)
            if self.steps[k - 1] + 1 == self.steps[k]:
                np.minimum.at(m, (np.searchsorted(self.ids[k - 1], a_from[own]), np.searchsorted(self.ids[k], a_to[own])), a_cost[own])
            if last_resort:
                m[:, np.isinf(m).all(0)] = EMERGENCY
            self.arcs.append(m + costs[k])

    def product(self) -> np.ndarray:
        """Least costs from each candidate of the entry (or, without one, from the start) to each one of the last step."""
        out = np.where(np.eye(len(self.ids[0])), 0.0, np.inf) if self.has_entry else self.first[None]
        for m in self.arcs:
            out = np.array([(row[:, None] + m).min(0) for row in out])
        return out

    def path(self, entry: int | None = None, leave: int | None = None) -> tuple[list[int], float]:
        """(ids, cost) of the least path, from and to given candidates where they are given; of equal ones that of lesser
        ids from the end. No ids where none is finite."""
        reached = [self.first if entry is None else np.where(self.ids[0] == entry, 0.0, np.inf)]
        via = []
        for m in self.arcs:
            through = reached[-1][:, None] + m
            via.append(through.argmin(0))
            reached.append(through.min(0))
        at = int(reached[-1].argmin()) if leave is None else int(np.searchsorted(self.ids[-1], leave))
        total = float(reached[-1][at])
        if not np.isfinite(total):
            return [], total
        places = [at]
        for back in reversed(via):
            places.append(int(back[places[-1]]))
        ids = [int(own[p]) for own, p in zip(self.ids, reversed(places))]
        return ids[self.has_entry :], total


def _chain(rows: list[tuple], last_resort: bool) -> list[tuple]:
    """(segment, entry id, last id, total) of the least path through the segments (segment, entry ids or None, last ids,
    product), in order."""
    reached, before = None, []
    for _, entry, last, product in rows:
        before.append(reached)
        if entry is not None:
            reached = (reached[:, None] + product).min(0) if reached is not None else np.full(len(last), np.inf)
        elif reached is None:
            reached = product[0]
        else:  # steps are missing before it
            reached = reached.min() + EMERGENCY + product[0] if last_resort else np.full(len(last), np.inf)
    at, total = int(reached.argmin()), float(reached.min())
    if not np.isfinite(total):
        return []
    out = []
    for (segment, entry, last, product), old in zip(reversed(rows), reversed(before)):
        leave = last[at]
        if entry is not None:
            at = int((old + product[:, at]).argmin())
        elif old is not None:
            at = int(old.argmin())
        out.append((segment, entry[at] if entry is not None else None, leave, total))
    return out


def viterbi(candidates: DataFrame, costs: DataFrame, last_resort: bool = False, segment: int = SEGMENT) -> DataFrame:
    """(utt, step, unit_id, total): the path of the least sum of target and join costs through candidates (utt, step,
    unit_id, tcost); pairs without a join cost are not in the graph. Of equal paths the one of lesser ids from the end.
    An utterance without a path has no rows. With ``last_resort`` a candidate that cannot be reached is joined at the
    emergency cost. Repeated candidates count once, at their least cost; rows with a null are left out.

    Steps are dense matrices, and paths their min-plus products. These are associative: a lattice of more steps than
    ``segment`` is cut, each segment's product is a task of its own, an utterance's products (a matrix for each segment)
    choose the candidates at the cuts, and then each segment finds its path between these."""
    a = candidates.where("utt IS NOT NULL AND step IS NOT NULL AND unit_id IS NOT NULL AND tcost IS NOT NULL").groupBy("utt", F.col("step").cast("long").alias("step"), F.col("unit_id").cast("long").alias("unit_id")).agg(F.min(F.col("tcost").cast("double")).alias("tcost"))
    a = kept(a.withColumn("seg", F.floor(F.col("step") / segment)), "lattice")
    steps = a.select("utt", "step", "seg", F.col("unit_id").alias("to_id"))
    before = a.select("utt", (F.col("step") + 1).alias("step"), F.col("unit_id").alias("from_id"))
    arcs = kept(steps.join(before, ["utt", "step"]).join(costs.select("from_id", "to_id", F.col("cost").cast("double").alias("cost")).where("cost IS NOT NULL"), ["from_id", "to_id"]).select("utt", "seg", "step", "from_id", "to_id", "cost"), "arcs")
    entry = a.where(F.pmod(F.col("step") + 1, F.lit(segment)) == 0).withColumn("seg", F.col("seg") + 1)
    there = a.groupBy("utt", "seg").agg(F.count(F.lit(1)).alias("_"))  # a segment that only has an entry is none
    nodes = a.withColumn("entry", F.lit(False)).unionByName(entry.join(there.drop("_"), ["utt", "seg"], "left_semi").withColumn("entry", F.lit(True)))
    many = there.groupBy("utt").agg(F.count(F.lit(1)).alias("segs"))
    nodes = kept(nodes.join(many, "utt"), "nodes")
    kind = candidates.schema["utt"].dataType.simpleString()
    out = f"utt {kind}, step long, unit_id long, total double"

    def rows(t: pa.Table, seg: _Segment, ids: list[int], total: float) -> pa.Table:
        own = seg.steps[seg.has_entry :] if ids else seg.steps[:0]
        return pa.table([_repeated(t["utt"], len(own)), pa.array(own, pa.int64()), pa.array(ids, pa.int64()), pa.array(np.full(len(own), total), pa.float64())], want.names).cast(want)

    def alone(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows:
            return want.empty_table()
        seg = _Segment(x, y, last_resort)
        return rows(x, seg, *seg.path())

    want = to_arrow_schema(T.StructType.fromDDL(out))
    keys = ["utt", "seg"]
    parts = nodes.where("segs = 1").groupBy(*keys).cogroup(arcs.join(many.where("segs = 1"), "utt", "left_semi").groupBy(*keys)).applyInArrow(alone, out)
    if nodes.where("segs > 1").isEmpty():
        return parts
    long_nodes, long_arcs = nodes.where("segs > 1"), arcs.join(many.where("segs > 1"), "utt", "left_semi")
    matrix = f"utt {kind}, seg long, entry array<long>, last array<long>, cost array<double>"
    flat = to_arrow_schema(T.StructType.fromDDL(matrix))

    def products(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows:
            return flat.empty_table()
        seg = _Segment(x, y, last_resort)
        row = [x["utt"][:1], x["seg"][:1], pa.array([seg.ids[0].tolist() if seg.has_entry else None], flat.types[2]), pa.array([seg.ids[-1].tolist()], flat.types[3]), pa.array([seg.product().ravel().tolist()], flat.types[4])]
        return pa.table(row, flat.names).cast(flat)

    ends = f"utt {kind}, seg long, came long, leave long, total double"
    end = to_arrow_schema(T.StructType.fromDDL(ends))

    def chain(t: pa.Table) -> pa.Table:
        t = t.sort_by("seg")
        found = [(s, e, l, np.array(c).reshape(-1, len(l))) for s, e, l, c in zip(*(t[c].to_pylist() for c in ("seg", "entry", "last", "cost")))]
        done = _chain(found, last_resort)
        return pa.table([_repeated(t["utt"], len(done)), *(pa.array([r[i] for r in done], end.types[i + 1]) for i in range(4))], end.names).cast(end)

    met = long_nodes.groupBy(*keys).cogroup(long_arcs.groupBy(*keys)).applyInArrow(products, matrix)
    chosen = kept(met.groupBy("utt").applyInArrow(chain, ends), "cuts")

    def between(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows:
            return want.empty_table()
        seg = _Segment(x, y, last_resort)
        ids, _ = seg.path(x["came"][0].as_py(), x["leave"][0].as_py())
        return rows(x, seg, ids, x["total"][0].as_py())

    found = long_nodes.join(chosen, keys).groupBy(*keys).cogroup(long_arcs.groupBy(*keys)).applyInArrow(between, out)
    return parts.unionByName(found)


def ngrams(tokens: DataFrame, doc: str, ix: str, token: str, size: int) -> DataFrame:
    """(doc, ix, gram): runs of ``size`` tokens, joined by a blank."""
    from pyspark.sql import Window

    w = Window.partitionBy(doc).orderBy(ix).rowsBetween(0, size - 1)
    return tokens.withColumn("_g", F.collect_list(token).over(w)).where(F.size("_g") == size).select(doc, ix, F.array_join("_g", " ").alias("gram"))


def nearest_by_level(targets: DataFrame, codes: list[DataFrame], key: str) -> DataFrame:
    """(key, level, position) of the finest codebook that knows a target's code. codes[i] (code_i, position)."""
    from functools import reduce

    found = [targets.join(c, f"code_{i}").select(key, F.lit(i).alias("level"), "position") for i, c in enumerate(codes)]
    return reduce(DataFrame.unionAll, found).groupBy(key).agg(F.min(F.struct("level", "position")).alias("m")).select(key, "m.level", "m.position")


def random_walks(units: DataFrame, starts: DataFrame, steps: int, k: int = 10, seed: int = 1234, span: int = 5, index: knn.Index | None = None) -> DataFrame:
    """(walk, step, unit_id): walks from starts (walk, unit_id), all a step at a time: to the unit after one of the k
    nearest units to the present one, by a seeded draw; the ``span`` units before it and itself are none of them, nor are
    units without a next one. units (unit_id, v). A walk ends where there is nothing to go to. ``index``: ``walk_index``
    of the units."""
    index = index or walk_index(units, k, span)
    at = F.col("unit_id").cast("long")
    v = kept(units.select(at.alias("unit_id"), F.col("v").cast("array<double>").alias("v")), "units")
    now, path = kept(starts.select("walk", at.alias("unit_id")).join(v, "unit_id"), "walks"), fresh_path(units.sparkSession, "walks")
    schema = now.select("walk", F.lit(0).cast("long").alias("step"), "unit_id").schema
    now.select("walk", F.lit(0).cast("long").alias("step"), "unit_id").write.parquet(path)
    for n in range(1, steps + 1):
        held = F.sequence(F.col("unit_id") - span, F.col("unit_id"))
        found = knn.search(now.select(F.col("walk").alias("q"), F.lit("").alias("c"), "v", held.alias("held")), index, k)
        taken = F.get("x", (_draw(seed, "q", "_n") % F.size("x")).cast("int"))["u"] + 1
        after = found.where(F.size("x") > 0).withColumn("_n", F.lit(n)).select(F.col("q").alias("walk"), taken.alias("unit_id"))
        old, now = now, kept(after.join(v, "unit_id").select("unit_id", "walk", "v"), "walks")
        now.select("walk", F.lit(n).cast("long").alias("step"), "unit_id").write.mode("append").parquet(path)
        drop(found, old)
    drop(now, v)
    return units.sparkSession.read.schema(schema).parquet(path)


def walk_index(units: DataFrame, k: int = 10, span: int = 5, path: str | None = None) -> knn.Index:
    """The index of the units that have a next one."""
    after = units.select((F.col("unit_id") - 1).alias("unit_id"))
    return knn.build(units.join(after, "unit_id", "left_semi").select(F.col("unit_id").alias("u"), "v"), copies=k + span + 1, path=path)


def next_samples(units: DataFrame, frames: DataFrame, context: int, k: int = 1, seed: int = 1234, index: knn.Index | None = None) -> DataFrame:
    """(utt, step, unit_id, sample): autoregressive sample selection. The nearest unit to (the last ``context``
    samples, the frame) gives the next sample, or one of the ``k`` nearest by a seeded draw; units (unit_id, context,
    target, sample), frames (utt, step, target); zeros come before the first sample. All utterances take a step
    together, over ``index`` (``knn.build`` of (context, target), with k copies)."""
    doubles = lambda c: F.col(c).cast("array<double>")
    index = index or knn.build(units.select(F.col("unit_id").alias("u"), F.concat(doubles("context"), doubles("target")).alias("v")), copies=k)
    given = units.select(F.col("unit_id").cast("long").alias("unit_id"), F.col("sample").cast("double").alias("sample"))
    place = (_draw(seed, "utt", "step") % F.size("x")).cast("int") if k > 1 else F.lit(0)
    after = F.when(F.col("sample").isNotNull(), F.concat(F.slice("state", 2, context - 1), F.array("sample")) if context > 1 else F.slice(F.array("sample"), 1, context))
    rows = _together(frames.select("utt", "step", "target"), F.array_repeat(F.lit(0.0), context), given, index, k, place, after)
    return rows.select("utt", "step", "unit_id", "sample")


def every_nth_unit(spark, n: int, size: int = 1) -> DataFrame:
    """(step, unit_id): contiguous units 0, size, 2 size, ... below n, a path to check assembly with."""
    return spark.range(0, n, size).select((F.col("id") / size).cast("long").alias("step"), F.col("id").alias("unit_id"))


def transition_walks(units: DataFrame, starts: DataFrame, steps: int, seed: int = 1234) -> DataFrame:
    """(walk, step, unit_id): uniform walks over the transition table of units (unit_id, phone, half) from starts (walk,
    unit_id), all walks a step at a time. The transitions of a unit are the units of one phone and half, so that a draw
    is a rank among them and a step an equi join; the table itself is not made. A walk ends where there is none. Ranks
    come from ranges, so that a frequent phone is no single task's, and each step is stored before the next."""
    from unitweave.operators.joins import successors
    from unitweave.operators.select import ranked_within

    # A draw meets one unit of a phone and half: (place, rank) is a key without repeats.
    named = units.select("unit_id", F.concat_ws("|", "phone", "half").alias("place"))
    ranked = kept(ranked_within(named, "place", "unit_id", "_r").withColumnRenamed("unit_id", "to_id"), "ranked")
    sizes = ranked.groupBy("place").agg(F.count(F.lit(1)).alias("_n"))
    nxt = successors(units, "unit_id", "phone").select(F.col("from_id").alias("unit_id"), "to_phone")
    phone = F.when(F.col("half") == "L", F.col("phone")).otherwise(F.col("to_phone"))
    wanted = units.join(nxt, "unit_id", "left").where(phone.isNotNull()).select("unit_id", F.concat_ws("|", phone, F.when(F.col("half") == "L", F.lit("R")).otherwise(F.lit("L"))).alias("place"))
    wanted = kept(wanted.join(sizes, "place"), "wanted")
    path = fresh_path(units.sparkSession, "walks")
    schema = starts.select("walk", F.lit(0).alias("step"), "unit_id").schema
    now = starts.select("walk", "unit_id")
    now.select("walk", F.lit(0).alias("step"), "unit_id").write.parquet(path)
    stored = None
    for k in range(1, steps + 1):
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("walk").cast("string"), F.lit(str(k))).cast("binary")), 1, 8), 16, 10).cast("long")
        here = now.join(wanted, "unit_id").select("walk", "place", (draw % F.col("_n")).alias("_r"))
        after = kept(here.join(ranked, ["place", "_r"]).select("walk", F.lit(k).alias("step"), F.col("to_id").alias("unit_id")), "step")
        after.write.mode("append").parquet(path)
        drop(*([stored] if stored is not None else []))
        now, stored = after.select("walk", "unit_id"), after
    drop(ranked, wanted, *([stored] if stored is not None else []))
    return units.sparkSession.read.schema(schema).parquet(path)


def _runs_of(codes: DataFrame, doc: str | None, size: int, least: int = 1) -> DataFrame:
    """(doc, ix, n, gram) of all runs of ``least`` to ``size`` codes of (doc, ix, code). Each code goes to the ``size``
    places whose run it can be in; a place sorts what it gets, and its runs are the prefixes of that."""
    keys = [doc] if doc else []
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")))
    sent = codes.select(*keys, F.col("ix").cast("long").alias("_at"), F.col("code").cast("string").alias("code"), place.alias("_j"))
    sent = sent.select(*keys, (F.col("_at") - F.col("_j")).alias("ix"), "_j", "code")
    got = sent.groupBy(*keys, "ix").agg(F.array_sort(F.collect_list(F.struct("_j", "code"))).alias("x"))  # at most `size` codes
    whole = F.filter("x", lambda e, i: e["_j"] == i)  # up to the first gap
    got = got.select(*keys, "ix", F.transform(whole, lambda e: e["code"]).alias("x")).where(F.size("x") >= least)
    n = F.explode(F.sequence(F.lit(least), F.size("x")))
    return got.select(*keys, "ix", "x", n.alias("n")).select(*keys, "ix", "n", F.array_join(F.slice("x", F.lit(1), F.col("n")), " ").alias("gram"))


def tile_paths(paths: DataFrame, corpus: DataFrame, longest: int) -> DataFrame:
    """(utt, ix, n, at): tiles that cover each path (utt, ix, code) from the left, each the longest run of up to
    ``longest`` codes that the corpus (ix, code) has, at its first place; -1 and one code where it has none. Runs meet
    their places by an equi join; what is left to an utterance's group is a row for each of its places."""
    index = _runs_of(corpus, None, longest).groupBy("n", "gram").agg(F.min("ix").alias("at"))
    found = _runs_of(paths, "utt", longest).join(index, ["n", "gram"]).groupBy("utt", "ix").agg(F.max(F.struct("n", "at")).alias("m"))
    rows = paths.select("utt", F.col("ix").cast("long").alias("ix")).join(found, ["utt", "ix"], "left").select("utt", "ix", F.coalesce("m.n", F.lit(1)).alias("n"), F.coalesce("m.at", F.lit(-1)).cast("long").alias("at"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ix")
        kept, free = [], -1
        for k, (ix, n) in enumerate(zip(pdf.ix, pdf.n)):
            if ix >= free:
                kept.append(k)
                free = ix + n
        return pdf.iloc[kept]

    return rows.groupBy("utt").applyInPandas(run, rows.schema)


def chunk_tiles(paths: DataFrame, corpus: DataFrame, size: int, resolutions: list) -> DataFrame:
    """(utt, chunk, level, position): whole chunks of ``size`` codes of each path by the finest of the resolutions
    (expressions of code) in which the corpus has them, at the first place. A chunk that none has is left out."""
    places, wanted = [], []
    for level, code in enumerate(resolutions):
        places.append(_runs_of(corpus.select("ix", code.alias("code")), None, size, size).groupBy("gram").agg(F.min("ix").alias("position")).withColumn("level", F.lit(level)))
        wanted.append(_runs_of(paths.select("utt", "ix", code.alias("code")), "utt", size, size).where(F.col("ix") % size == 0).select("utt", (F.col("ix") / size).cast("long").alias("chunk"), "gram", F.lit(level).alias("level")))
    from functools import reduce

    met = reduce(DataFrame.unionByName, wanted).join(reduce(DataFrame.unionByName, places), ["level", "gram"])
    return met.groupBy("utt", "chunk").agg(F.min(F.struct("level", "position")).alias("m")).select("utt", "chunk", "m.level", "m.position")
