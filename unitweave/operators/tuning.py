"""Weights and codebooks: balancing streams, searches over weights, k-means, novelty."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from unitweave.sources.scratch import drop, fresh_path, kept

#: Fixed values of the balancing: first step, factors, bounds of a step, floor of a weight, patience, epochs, stop.
FIRST_STEP, FASTER, SLOWER, STEPS, FLOOR, PATIENCE, MAX_EPOCHS, STOP = 0.1, 1.2, 0.5, (1e-6, 50.0), 0.0, 5, 1000, 0.001


def chosen_costs(weights: DataFrame, costs: DataFrame) -> DataFrame:
    """(cand, stream, cost): what a selection under weights costs, for many weightings in one pass. costs (item, unit_id,
    stream, cost) are the candidates of each item; of these every weighting (cand, stream, weight) takes the one of the
    least weighted sum (the lesser id of equal ones). A stream's cost is the mean of its weighted costs above 0."""
    w = F.broadcast(weights.select("cand", "stream", "weight"))  # a row for each weighting and stream
    each = costs.join(w, "stream").select("cand", "item", "unit_id", "stream", (F.col("cost") * F.col("weight")).alias("x"))
    sums = each.groupBy("cand", "item", "unit_id").agg(F.sum("x").alias("all"), F.map_from_entries(F.collect_list(F.struct("stream", "x"))).alias("by"))  # a unit's streams
    best = sums.groupBy("cand", "item").agg(F.min_by("by", F.struct(F.round("all", 9), "unit_id")).alias("by"))
    means = best.select("cand", F.explode("by").alias("stream", "x")).groupBy("cand", "stream").agg(F.avg(F.when(F.col("x") > 0, F.col("x"))).alias("cost"))
    return means.withColumn("cost", F.coalesce("cost", F.lit(0.0)))


def balance_step(state: DataFrame, costs: DataFrame) -> DataFrame:
    """The state (cand, stream, group, weight, step, direction, goal) after a pass that cost (cand, stream, cost); cost,
    loss and the new values as next_weight, next_step and next_direction. Goals that are not known yet are all cost,
    dealt out evenly to the groups and then to their streams. A weight moves against its stream's distance from the goal
    by its step, which grows while the direction stays and shrinks when it turns."""
    of, group = Window.partitionBy("cand"), Window.partitionBy("cand", "group")
    rows = state.join(costs, ["cand", "stream"]).withColumn("_groups", F.size(F.collect_set("group").over(of)))
    goal = F.coalesce("goal", F.sum("cost").over(of) / F.col("_groups") / F.count(F.lit(1)).over(group))
    rows = rows.withColumn("goal", goal).withColumn("loss", F.sum(F.abs(F.col("cost") - F.col("goal"))).over(of))
    to = F.signum(F.col("goal") - F.col("cost"))
    turn = to * F.col("direction")
    step = F.col("step") * F.when(turn > 0, F.lit(FASTER)).when(turn < 0, F.lit(SLOWER)).otherwise(F.lit(1.0))
    rows = rows.withColumns({"next_direction": to, "next_step": F.least(F.greatest(step, F.lit(STEPS[0])), F.lit(STEPS[1]))})
    return rows.withColumn("next_weight", F.greatest(F.col("weight") + F.col("next_direction") * F.col("next_step"), F.lit(FLOOR))).drop("_groups")


def balanced(start: DataFrame, costs_of: Callable[[DataFrame], DataFrame], epochs: int = MAX_EPOCHS) -> DataFrame:
    """(cand, epoch, stream, weight, cost, goal, loss): the course of balancing the weights start (cand, stream, group,
    weight), all candidates in one pass an epoch, so that the groups (join and target, say) contribute alike, and the
    streams within each. ``costs_of`` gives the costs (cand, stream, cost) of weights (cand, stream, weight). A candidate
    ends where its loss is nearly 0 or has not fallen below the one before for some epochs in a row."""
    spark = start.sparkSession
    path, schema = fresh_path(spark, "balance"), None
    state = kept(start.select("cand", "stream", "group", F.col("weight").cast("double").alias("weight"), F.lit(FIRST_STEP).alias("step"), F.lit(1.0).alias("direction"), F.lit(None).cast("double").alias("goal"), F.lit(0).alias("stale"), F.lit(float("inf")).alias("before")), "weights")
    for epoch in range(epochs):
        done = kept(balance_step(state, costs_of(state.select("cand", "stream", "weight"))), "balanced")
        rows = done.select("cand", F.lit(epoch).alias("epoch"), "stream", "weight", "cost", "goal", "loss")
        rows.write.mode("append").parquet(path)
        schema = rows.schema
        stale = F.when(F.col("loss") < F.col("before"), F.lit(0)).otherwise(F.col("stale") + 1)
        after = done.withColumn("stale", stale).where((F.col("loss") >= STOP) & (F.col("stale") < PATIENCE))
        new = kept(after.select("cand", "stream", "group", F.col("next_weight").alias("weight"), F.col("next_step").alias("step"), F.col("next_direction").alias("direction"), "goal", "stale", F.col("loss").alias("before")), "weights")
        drop(state, done)
        state = new
        if state.isEmpty():
            break
    drop(state)
    return spark.read.schema(schema).parquet(path)


def best_weights(course: DataFrame) -> DataFrame:
    """(cand, stream, weight, loss) of the epoch of the least loss, the first of equal ones."""
    least = course.groupBy("cand").agg(F.min(F.struct("loss", "epoch")).alias("m")).select("cand", F.col("m.epoch").alias("epoch"))
    return course.join(least, ["cand", "epoch"]).select("cand", "stream", "weight", "loss")


#: A loss of many points at once: one job for all of them.
Losses = Callable[[list[np.ndarray]], Sequence[float]]


def table_losses(spark: SparkSession, streams: Sequence[str], loss_of: Callable[[DataFrame], DataFrame]) -> Losses:
    """A loss for the searches below from one over tables: ``loss_of`` gives (cand, loss) of weights (cand, stream,
    weight) in one job."""

    def losses(points: list[np.ndarray]) -> list[float]:
        rows = [(i, s, float(x)) for i, p in enumerate(points) for s, x in zip(streams, p)]
        found = {r.cand: r.loss for r in loss_of(spark.createDataFrame(rows, "cand int, stream string, weight double")).collect()}
        return [found[i] for i in range(len(points))]

    return losses


def section_search(losses: Losses, low: float, high: float, tolerance: float, parts: int = 8) -> float:
    """The least point of a loss with one valley: ``parts`` inner points are tried at once, and the valley is on either
    side of the least of them."""
    while high - low > tolerance:
        at = np.linspace(low, high, parts + 2)
        k = int(np.argmin(losses([np.array([x]) for x in at[1:-1]]))) + 1
        low, high = at[k - 1], at[k + 1]
    return (low + high) / 2


def coordinate_search(losses: Losses, weights: Sequence[float], low: float, high: float, tolerance: float, rounds: int = 1) -> np.ndarray:
    """One weight after the other by sections."""
    w = np.array(weights, float)
    for _ in range(rounds):
        for d in range(len(w)):
            w[d] = section_search(lambda points, d=d: losses([np.r_[w[:d], x, w[d + 1 :]] for x in points]), low, high, tolerance)
    return w


def simplex_search(losses: Losses, start: Sequence[float], size: float = 0.5, tolerance: float = 1e-6, max_steps: int = 500) -> np.ndarray:
    """Nelder and Mead's downhill simplex. A step tries all points that it can move to at once, in one job."""
    n = len(start)
    points = np.array(start, float) + np.vstack([np.zeros(n), size * np.eye(n)])
    values = np.array(losses(list(points)), float)
    for _ in range(max_steps):
        order = np.argsort(values, kind="stable")
        points, values = points[order], values[order]
        if values[-1] - values[0] <= tolerance * (1 + abs(values[0])) and np.abs(points[1:] - points[0]).max() <= tolerance:
            break
        centre = points[:-1].mean(0)
        moved = {k: centre + k * (centre - points[-1]) for k in (1.0, 2.0, 0.5, -0.5)}
        shrunk = points[0] + 0.5 * (points[1:] - points[0])
        tried = np.array(losses([*moved.values(), *shrunk]), float)
        value = dict(zip(moved, tried))
        if value[1.0] < values[0]:
            k = 2.0 if value[2.0] < value[1.0] else 1.0
        elif value[1.0] < values[-2]:
            k = 1.0
        else:
            k = 0.5 if value[1.0] < values[-1] else -0.5
            if value[k] >= min(value[1.0], values[-1]):
                points, values = np.vstack([points[:1], shrunk]), np.r_[values[:1], tried[4:]]
                continue
        points[-1], values[-1] = moved[k], value[k]
    return points[int(np.argmin(values))]


def codebook(units: DataFrame, k: int, seed: int = 1234, sample: float | None = None) -> tuple[list[list[float]], DataFrame]:
    """(centres, units with ``cluster``) by k-means; learned on a seeded share of the units, applied to all."""
    rows = units.withColumn("features", array_to_vector(F.col("v").cast("array<double>")))
    learn = rows if sample is None else rows.where(F.pmod(F.xxhash64("u"), F.lit(10_000)) < int(sample * 10_000))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(learn)
    return [c.tolist() for c in model.clusterCenters()], model.transform(rows).withColumnRenamed("prediction", "cluster").drop("features")


def cascade(units: DataFrame, largest: int, seed: int = 1234) -> list[tuple[int, list[list[float]]]]:
    """Codebooks of k, k/2, ... 2 centres."""
    out, k = [], largest
    while k >= 2:
        out.append((k, codebook(units, k, seed)[0]))
        k //= 2
    return out


def novelty(rows: DataFrame, k: int) -> DataFrame:
    """``error``: mean squared error of each vector (u, v) when put together again from k principal components."""
    from pyspark.ml.feature import PCA

    data = rows.withColumn("features", array_to_vector(F.col("v").cast("array<double>")))
    model = PCA(k=k, inputCol="features", outputCol="_pca").fit(data)
    basis = model.pc.toArray()
    from pyspark.ml.functions import vector_to_array

    low = model.transform(data).withColumn("_pca", vector_to_array("_pca"))
    from unitweave.functions.vectors import literal, total, weighted

    again = F.array(*(total(weighted(F.col("_pca"), literal(row))) for row in basis))
    error = total(F.zip_with(F.col("v").cast("array<double>"), again, lambda x, y: (x - y) * (x - y))) / F.size("v")
    return low.select("u", error.alias("error"))


def join_classifier(pairs: DataFrame):
    """A logistic model of acceptable joins from (features, label)."""
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(maxIter=50, regParam=1e-3).fit(pairs.withColumn("features", array_to_vector(F.col("features").cast("array<double>"))))
