"""Series of an utterance: gaps, smoothing, differences, runs, resampling, segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from unitweave.functions.vectors import UNVOICED
from unitweave.functions.vectors import literal as V_literal
from unitweave.functions.windows import ahead


def _track(utt: str, order: str):
    return Window.partitionBy(utt).orderBy(order)


def indexed(df: DataFrame, utt: str, order: str, *more: str, name: str = "ix") -> DataFrame:
    """A 0-based index within the utterance."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(utt).orderBy(order, *more)) - 1).cast("long"))


def gap_filled(df: DataFrame, utt: str, ix: str, value: str, ends: str = "extrapolate") -> DataFrame:
    """``filled`` and ``vuv`` (1 where the value is above 0): values that are not above 0 are interpolated linearly.

    ends: "extrapolate" continues the line through the two nearest voiced values, "hold" keeps the nearest one. An
    utterance with no voiced value keeps its values; with one, it is held.
    """
    w, voiced = _track(utt, ix), F.when(F.col(value) > 0, F.struct(F.col(ix).cast("double").alias("x"), F.col(value).cast("double").alias("y")))
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("_v", voiced).withColumn("_p", F.last("_v", True).over(back)).withColumn("_n", F.last("_v", True).over(ahead(utt, ix)))
    # The second voiced value from each end of the utterance.
    every = Window.partitionBy(utt)
    rank = F.count("_v").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("_rank", rank).withColumn("_all", F.count("_v").over(every))
    pick = lambda k: F.max(F.when(F.col("_v").isNotNull() & (F.col("_rank") == k), F.col("_v"))).over(every)
    out = out.withColumns({"_a": pick(F.lit(1)), "_b": pick(F.lit(2)), "_y": pick(F.col("_all") - 1), "_z": pick(F.col("_all"))})
    x = F.col(ix).cast("double")

    def line(p: Column, q: Column) -> Column:
        return p["y"] + F.try_divide(q["y"] - p["y"], q["x"] - p["x"]) * (x - p["x"])

    if ends == "hold":
        left, right = F.col("_a")["y"], F.col("_z")["y"]
    else:
        left = F.coalesce(line(F.col("_a"), F.col("_b")), F.col("_a")["y"])
        right = F.coalesce(line(F.col("_y"), F.col("_z")), F.col("_z")["y"])
    filled = F.when(F.col("_v").isNotNull(), F.col("_v")["y"]).when(F.col("_all") == 0, F.col(value).cast("double")).when(F.col("_p").isNull(), left).when(F.col("_n").isNull(), right).otherwise(line(F.col("_p"), F.col("_n")))
    vuv = F.when(F.col(value) > 0, 1).otherwise(0)
    return out.withColumns({"filled": filled, "vuv": vuv}).drop("_v", "_p", "_n", "_rank", "_all", "_a", "_b", "_y", "_z")


def held_in_place(f0: Sequence[float]) -> list[float]:
    """The older gap filler, quirks included: a ramp ends a step early, and a voiced value on the last frame of the
    utterance does not stop a gap. Of one utterance; for parity."""
    out = [float(x) for x in f0]
    n, at, last = len(out), 0, 0.0
    first = next((x for x in out if x > 0), 0.0)
    while at < n:
        if out[at] > 0:
            last = out[at]
            at += 1
            continue
        end = next((j for j in range(at, n) if out[j] > 0), n)
        if last == 0.0 and end < n:
            out[at:end] = [first] * (end - at)
            at = end
        elif end < n - 1:
            step = (out[end] - last) / (end - at)
            out[at:end] = [last + step * (j - at + 1) for j in range(at, end)]
            at = end
        else:
            out[at:] = [last] * (n - at)
            at = n
    return out


def smoothed(df: DataFrame, utt: str, ix: str, value: str, weights: Sequence[float], name: str = "smooth") -> DataFrame:
    """Centred weighted moving average; the edges repeat."""
    w, half, every = _track(utt, ix), len(weights) // 2, Window.partitionBy(utt)
    first, last = F.min_by(value, ix).over(every), F.max_by(value, ix).over(every)
    x = F.lit(0.0)
    for k, weight in enumerate(weights):
        at = k - half
        near = F.col(value) if at == 0 else F.coalesce(F.lag(value, -at).over(w), first) if at < 0 else F.coalesce(F.lead(value, at).over(w), last)
        x = x + near * float(weight)
    return df.withColumn(name, x / float(sum(weights)))


def median_filtered(df: DataFrame, utt: str, ix: str, value: str, size: int, name: str = "median") -> DataFrame:
    """Running median; beyond the edges stand zeros."""
    half, w = size // 2, _track(utt, ix)
    values = F.collect_list(value).over(w.rowsBetween(-half, half))
    padded = F.array_sort(F.concat(values, F.array_repeat(F.lit(0.0), F.lit(size) - F.size(values))))
    return df.withColumn(name, F.element_at(padded, half + 1))


def cumulated(df: DataFrame, utt: str, ix: str, value: str, name: str = "mark") -> DataFrame:
    """Running sum: positions from shifts."""
    return df.withColumn(name, F.sum(value).over(_track(utt, ix).rowsBetween(Window.unboundedPreceding, 0)))


def differenced(df: DataFrame, utt: str, ix: str, value: str, name: str = "shift") -> DataFrame:
    """The inverse of ``cumulated``."""
    return df.withColumn(name, F.col(value) - F.coalesce(F.lag(value).over(_track(utt, ix)), F.lit(0)))


def monotonic(df: DataFrame, utt: str, ix: str, value: str) -> DataFrame:
    """(utt, monotonic): whether an utterance's values never fall."""
    fall = F.col(value) < F.lag(value).over(_track(utt, ix))
    return df.withColumn("_fall", F.coalesce(fall, F.lit(False))).groupBy(utt).agg((~F.bool_or("_fall")).alias("monotonic"))


def variance_scaled(df: DataFrame, utt: str, value: str, scale: float, name: str = "scaled") -> DataFrame:
    """Distances from the utterance's mean, scaled."""
    mean = F.avg(value).over(Window.partitionBy(utt))
    return df.withColumn(name, (F.col(value) - mean) * scale + mean)


def runs(df: DataFrame, utt: str, ix: str, value: str) -> DataFrame:
    """(utt, run, value, start, length): stretches of equal values."""
    w = _track(utt, ix)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & F.lag(ix).over(w).isNotNull(), 0).otherwise(1)
    marked = df.withColumn("_new", new).withColumn("run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(utt, "run").agg(F.first(value).alias(value), F.min(ix).alias("start"), F.count(F.lit(1)).alias("length"))


def segmented(df: DataFrame, utt: str, ix: str, value: str, length: int, overlap: int = 0, end: str = "cut", end_value: float = 0.0) -> DataFrame:
    """(utt, segment, values): windows of ``length`` rows that overlap. What is left at the end is cut, padded with
    ``end_value`` or wrapped around from the start."""
    if not 0 <= overlap < length or end not in ("cut", "pad", "wrap"):
        raise ValueError("0 <= overlap < length, and end is cut, pad or wrap")
    step, w, every = length - overlap, _track(utt, ix), Window.partitionBy(utt)
    out = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", F.count(F.lit(1)).over(every)).withColumn("values", F.collect_list(value).over(w.rowsBetween(0, length - 1)))
    if end == "wrap":
        out = out.withColumn("_head", F.slice(F.collect_list(value).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), 1, length))
    out = out.where(F.col("_i") % step == 0)
    short = F.lit(length) - F.size("values")
    if end == "cut":
        out = out.where(F.size("values") == length)
    else:
        # A last window begins only where the one before it did not reach the end.
        out = out.where((F.col("_i") == 0) | (F.col("_i") + overlap < F.col("_n")))
        kind = df.schema[value].dataType
        tail = F.array_repeat(F.lit(end_value).cast(kind), short) if end == "pad" else F.slice("_head", 1, short)
        out = out.withColumn("values", F.when(short > 0, F.concat("values", tail)).otherwise(F.col("values")))
    return out.select(utt, (F.col("_i") / step).cast("long").alias("segment"), "values")


def frame_centres(frames: Column, shift: float, convention: str = "world", window: float = 0.025) -> Column:
    """Centre time in seconds of a 0-based frame: world frames begin at 0, straight ones a shift later; others are
    centred in their analysis window."""
    start = {"world": 0.0, "straight": shift, "snack": window / 2, "htk": window / 2}[convention]
    return frames * F.lit(shift) + F.lit(start)


def resampled(values: DataFrame, grid: DataFrame, utt: str, at: str, value: str, nearest: bool = False) -> DataFrame:
    """The grid (utt, at) with ``value`` read from a series between its neighbours, by one union and two windows: no
    join. Linear (held beyond the ends), or the nearer neighbour (the earlier of equal ones)."""
    rows = values.select(utt, F.col(at).cast("double").alias("_x"), F.col(value).cast("double").alias("_y"), F.lit(0).alias("_g")).unionAll(grid.select(utt, F.col(at).cast("double"), F.lit(None).cast("double"), F.lit(1)))
    w = Window.partitionBy(utt).orderBy("_x", "_g")
    point = F.when(F.col("_g") == 0, F.struct("_x", "_y"))
    rows = rows.withColumn("_q", point)
    rows = rows.withColumn("_p", F.last("_q", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.last("_q", True).over(ahead(utt, "_x", "_g")))
    p, n, x = F.col("_p"), F.col("_n"), F.col("_x")
    if nearest:
        between = F.when(x - p["_x"] <= n["_x"] - x, p["_y"]).otherwise(n["_y"])
    else:
        between = p["_y"] + F.coalesce(F.try_divide(n["_y"] - p["_y"], n["_x"] - p["_x"]), F.lit(0.0)) * (x - p["_x"])
    got = F.when(p.isNull(), n["_y"]).when(n.isNull(), p["_y"]).otherwise(between)
    return rows.where("_g = 1").select(utt, x.alias(at), got.alias(value))


def synthetic_marks(tracks: DataFrame, utt: str, ix: str, f0: str, rate: int, unvoiced_sec: float = 0.005) -> DataFrame:
    """(utt, mark_ix, sample): marks one period apart, each period read from the F0 (a value for each sample) at the
    mark before. Sequential, so an utterance is one group."""
    kind = tracks.schema[utt].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        track = pdf.sort_values(ix)[f0].to_numpy(float)
        marks, at = [], 0
        while at < len(track):
            marks.append(at)
            at += max(1, int(round(rate / track[at] if track[at] > 0 else rate * unvoiced_sec)))
        return pd.DataFrame({utt: pdf[utt].iloc[0], "mark_ix": np.arange(len(marks)), "sample": marks})

    return tracks.select(utt, ix, f0).groupBy(utt).applyInPandas(run, f"{utt} {kind}, mark_ix long, sample long")


def unvoiced_restored(value: Column, vuv: Column, sentinel: float = UNVOICED) -> Column:
    return F.when(vuv == 0, F.lit(sentinel)).otherwise(value)


def lagged_contexts(df: DataFrame, utt: str, ix: str, vector: str, lags: Sequence[int], width: int, name: str = "context") -> DataFrame:
    """Vectors of earlier rows, one after the other; zeros before the start."""
    zeros = F.array_repeat(F.lit(0.0), width)
    return df.withColumn(name, F.concat(*(F.coalesce(F.lag(vector, k).over(_track(utt, ix)), zeros) for k in lags)))


def edges_replaced(df: DataFrame, utt: str, ix: str, value: str, marked: Column, by: float, name: str = "value_out") -> DataFrame:
    """Marked rows that lead or end an utterance get another value; those between stay."""
    w = _track(utt, ix)
    other = (~marked).cast("int")
    before, after = F.sum(other).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum(other).over(ahead(utt, ix))
    return df.withColumn(name, F.when((before == 0) | (after == 0), F.lit(by)).otherwise(F.col(value)))


def run_text(df: DataFrame, utt: str, ix: str, value: str) -> DataFrame:
    """(utt, text): stretches of equal values as ``value*length``, in order, for display."""
    each = runs(df, utt, ix, value)
    listed = F.array_sort(F.collect_list(F.struct("run", F.concat_ws("*", F.col(value).cast("string"), F.col("length").cast("string")).alias("t"))))
    return each.groupBy(utt).agg(F.array_join(F.transform(listed, lambda x: x["t"]), " ").alias("text"))  # an utterance's runs


def voiced_interpolated(df: DataFrame, utt: str, ix: str, value: str, voiced: Column, name: str = "interpolated") -> DataFrame:
    """Values of unvoiced rows read on the line between the voiced ones beside them, held at both ends; an utterance
    without a voiced row is 0."""
    w = _track(utt, ix)
    rows = df.withColumn("_v", F.when(voiced, F.struct(F.col(ix).cast("double").alias("x"), F.col(value).cast("double").alias("y"))))
    rows = rows.withColumn("_p", F.last("_v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.last("_v", True).over(ahead(utt, ix)))
    p, n = F.col("_p"), F.col("_n")
    between = p["y"] + F.try_divide(n["y"] - p["y"], n["x"] - p["x"]) * (F.col(ix) - p["x"])
    got = F.when(F.col("_v").isNotNull(), F.col("_v")["y"]).when(p.isNull(), F.coalesce(n["y"], F.lit(0.0))).when(n.isNull(), p["y"]).otherwise(between)
    return rows.withColumn(name, got).drop("_v", "_p", "_n")


def unvoiced_zeroed(value: Column, voiced: Column) -> Column:
    return F.when(voiced, value).otherwise(F.lit(0.0))


def reflected_smoothed(df: DataFrame, utt: str, ix: str, value: str, weights: Sequence[float], name: str = "smooth") -> DataFrame:
    """(utt, at, smooth): the weighted mean of as many values as there are weights, also where it only partly overlaps the
    series, whose ends are reflected (the first value stands once, the last one twice): longer than the series by one
    less than the weights. Shorter utterances than these are left out. Sums of partial products, no window over them."""
    size = len(weights)
    rows = indexed(df.select(utt, ix, F.col(value).cast("double").alias("_x")), utt, ix, name="_i").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(utt))).where(F.col("_n") >= size)
    i, n = F.col("_i"), F.col("_n")
    copies = F.array(i, F.when((i > 0) & (i < size), -i), F.when(i >= n - size + 1, 2 * n - 1 - i))
    rows = rows.select(utt, "_n", "_x", F.explode(F.filter(copies, lambda p: p.isNotNull())).alias("_p"))
    each = rows.select(utt, "_n", F.posexplode(F.transform(V_literal(weights), lambda w: w * F.col("_x"))).alias("_j", "_y"), "_p")
    at = F.col("_p") + (size - 1) - F.col("_j")
    sums = each.select(utt, "_n", at.alias("at"), "_y").where((F.col("at") >= 0) & (F.col("at") < F.col("_n") + size - 1)).groupBy(utt, "at").agg(F.sum("_y").alias("_s"))
    return sums.select(utt, "at", (F.col("_s") / float(sum(weights))).alias(name))


#: Named predicates on a value, instead of evaluated text.
PREDICATES = {"voiced": lambda x: x > 0, "unvoiced": lambda x: x <= 0, "sentinel": lambda x: x == UNVOICED}
