"""What a search chose: costs by stream, joins, runs, histograms, traces."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from unitweave.functions import vectors as V


def _squares(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x - y) * (x - y))


def target_costs(path: DataFrame, units: DataFrame, streams: Sequence[tuple[str, int]]) -> DataFrame:
    """(utt, step, cost_<stream>): squared error of each stream between the target of a path (utt, step, unit_id,
    target) and the unit chosen for it (unit_id, own)."""
    rows = path.join(units, "unit_id")
    sums = V.streams_summed(_squares(V.as_doubles(F.col("target")), V.as_doubles(F.col("own"))), [n for _, n in streams])
    return rows.select("utt", "step", *(c.alias(f"cost_{name}") for (name, _), c in zip(streams, sums)))


def join_costs_by_stream(path: DataFrame, contexts: DataFrame, streams: Sequence[tuple[str, int]]) -> DataFrame:
    """(utt, step, cost_<stream>) between the end of a unit and the start of the next one on the path."""
    w = Window.partitionBy("utt").orderBy("step")
    rows = path.join(contexts, "unit_id").withColumn("_next", F.lead("start").over(w)).where(F.col("_next").isNotNull())
    sums = V.streams_summed(_squares(V.as_doubles(F.col("end")), V.as_doubles(F.col("_next"))), [n for _, n in streams])
    return rows.select("utt", "step", *(c.alias(f"cost_{name}") for (name, _), c in zip(streams, sums)))


def cost_summary(costs: DataFrame, streams: Sequence[str]) -> DataFrame:
    """(utt, mean_<stream>, std_<stream>): population deviation."""
    return costs.groupBy("utt").agg(*(f(f"cost_{s}").alias(f"{n}_{s}") for s in streams for n, f in (("mean", F.avg), ("std", F.stddev_pop))))


def positive_mean(x: Column) -> Column:
    """The mean of values above 0; 0 where there is none."""
    return F.coalesce(F.avg(F.when(x > 0, x)), F.lit(0.0))


def join_rate(path: DataFrame) -> DataFrame:
    """(utt, n_joins, percent): steps whose unit is not the natural successor of the one before."""
    w = Window.partitionBy("utt").orderBy("step")
    cut = F.when(F.lead("unit_id").over(w) != F.col("unit_id") + 1, 1).otherwise(0)
    rows = path.withColumn("_cut", cut)
    return rows.groupBy("utt").agg(F.sum("_cut").cast("long").alias("n_joins"), F.coalesce(F.try_divide(F.sum("_cut") * 100.0, F.count(F.lit(1)) - 1), F.lit(0.0)).alias("percent"))


def contiguous_runs(path: DataFrame) -> DataFrame:
    """(utt, run, first_id, last_id, length): stretches of natural successors."""
    w = Window.partitionBy("utt").orderBy("step")
    new = F.when(F.lag("unit_id").over(w) == F.col("unit_id") - 1, 0).otherwise(1)
    rows = path.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("utt", "run").agg(F.min("unit_id").alias("first_id"), F.max("unit_id").alias("last_id"), F.count(F.lit(1)).alias("length"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(from_id, to_id, n)"""
    return pairs.groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n"))


def growth(rows: DataFrame, step: str, value: str) -> DataFrame:
    """(step, n_new, n_seen): how many different values there are up to each step."""
    first = rows.groupBy(value).agg(F.min(step).alias(step))
    new = first.groupBy(step).agg(F.count(F.lit(1)).alias("n_new"))
    return new.withColumn("n_seen", F.sum("n_new").over(Window.orderBy(step).rowsBetween(Window.unboundedPreceding, 0)))  # a row for each step


def histogram(df: DataFrame, value: str, bins: int, low: float, high: float, *by: str) -> DataFrame:
    """(by, bin, n): equal bins of [low, high], the last one closed."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("long")
    return df.where(F.col(value).between(low, high)).groupBy(*by, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def trace(path: DataFrame) -> DataFrame:
    """(utt, step, line): ``source start end`` of each unit on a path (utt, step, src, start, end)."""
    return path.select("utt", "step", F.concat_ws(" ", "src", F.col("start").cast("string"), F.col("end").cast("string")).alias("line"))


def rms(v: Column) -> Column:
    return F.sqrt(F.try_divide(V.total(F.transform(v, lambda x: x * x)), F.size(v)))


def reconstruction_error(pairs: DataFrame) -> DataFrame:
    """(utt, error): root of the summed squared differences of (utt, wanted, got)."""
    return pairs.groupBy("utt").agg(F.sqrt(F.sum(F.pow(F.col("wanted") - F.col("got"), 2))).alias("error"))


def voiced_duration(df: DataFrame, utt: str, ix: str, f0: str, unvoiced_ms: float = 5.0) -> DataFrame:
    """(utt, ms): 5 ms for an unvoiced frame and a period for each voiced one after the first frame."""
    first = F.min(ix).over(Window.partitionBy(utt))
    ms = F.when(F.col(f0) <= 0, F.lit(unvoiced_ms)).when(F.col(ix) > first, F.try_divide(F.lit(1000.0), F.col(f0))).otherwise(F.lit(0.0))
    return df.withColumn("_ms", ms).groupBy(utt).agg(F.sum("_ms").alias("ms"))


def wave_statistics(samples: DataFrame, utt: str, value: Column, first: int = 100) -> DataFrame:
    """(mean, std) of companded samples of the first utterances by name: the reference's own limit (0: all)."""
    from unitweave.functions.scalars import mu_law

    rows = samples
    if first:
        rows = samples.join(samples.select(utt).distinct().orderBy(utt).limit(first), utt, "left_semi")
    y = mu_law(value)
    return rows.agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("std"))


def stream_factors(sums: DataFrame, stream: str, total: str) -> DataFrame:
    """(stream, factor): root of the largest stream's sum over a stream's own. A row for each stream."""
    largest = sums.agg(F.max(total).alias("_max"))
    return sums.crossJoin(F.broadcast(largest)).select(stream, F.sqrt(F.try_divide(F.col("_max"), F.col(total))).alias("factor"))  # one row on the right
