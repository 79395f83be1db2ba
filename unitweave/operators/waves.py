"""Waveforms around marks: contexts of samples, pitch periods, segments, F0 octaves and imposed durations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from unitweave.functions import vectors as V
from unitweave.operators import assemble, joins

#: Bounds of transposed F0, frames that a reference is taken from, and frames between voiced parts at most.
LOWEST_F0, HIGHEST_F0, REFERENCE, APART = 48.0, 420.0, 4, 8
#: Fixed value: F0 below it is what lies between voiced and unvoiced frames.
VOICED_FROM = 100.0


def dilated_filter(factor: float, outputs: int) -> list[list[float]]:
    """A row of weights for each output over a context of samples, oldest first: Hann windows that widen and move away
    from the newest sample by ``factor`` a step, each with the sum 1. A window of one step is a single sample."""
    at, step, centres = 0, 1.0, []
    for _ in range(outputs):
        wide = math.floor(step + 0.5)
        centres.append((at, wide))
        step *= factor
        at += math.floor(step + 0.5)
    size = centres[-1][0] + centres[-1][1]
    out = []
    for centre, wide in centres:
        row = [0.0] * size
        for i, w in enumerate(V.hann(2 * wide - 1)):
            row[size - 1 - (centre - wide + 1 + i)] = w
        out.append([w / sum(row) for w in row])
    return out


def sample_contexts(samples: DataFrame, length: int, weights: list[list[float]] | None = None) -> DataFrame:
    """(utt, pos, context, next): each sample of (utt, pos, value) with the ``length`` ones before it, zeros before the
    start; with ``weights`` (rows as long as the context) their weighted sums instead."""
    w = Window.partitionBy("utt").orderBy("pos").rowsBetween(-length, -1)
    before = F.collect_list(F.col("value").cast("double")).over(w)
    context = F.concat(F.array_repeat(F.lit(0.0), F.lit(length) - F.size(before)), before)
    rows = samples.select("utt", "pos", context.alias("context"), F.col("value").alias("next"))
    if weights is None:
        return rows
    return rows.withColumn("context", F.array(*(V.total(V.weighted(F.col("context"), V.literal(r))) for r in weights)))


def pitch_fragments(marks: DataFrame, samples: DataFrame, size: int) -> DataFrame:
    """(utt, mark_ix, i, value): ``size`` samples around each inner mark of (utt, mark_ix, pos), from the mark before to
    the mark after it, cut to half the size on either side and weighted by the halves of Hann windows; zeros beyond."""
    half, w = size // 2, Window.partitionBy("utt").orderBy("mark_ix")
    rows = marks.withColumns({"_a": F.lag("pos").over(w), "_z": F.lead("pos").over(w)}).where("_a IS NOT NULL AND _z IS NOT NULL")
    rows = rows.withColumns({"_a": F.greatest("_a", F.col("pos") - half), "_z": F.least("_z", F.col("pos") + half)})
    rows = rows.select("utt", "mark_ix", F.col("pos").alias("_m"), "_a", "_z", F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("i")).withColumn("pos", F.col("_m") - half + F.col("i"))
    hann = lambda i, n: 0.5 - 0.5 * F.cos(2 * math.pi * F.try_divide(i, n - 1))
    left, right = F.col("_m") - F.col("_a"), F.col("_z") - F.col("_m")
    weight = F.when(F.col("pos") < F.col("_m"), hann(F.col("pos") - F.col("_a"), 2 * left)).otherwise(hann(F.col("pos") - F.col("_m") + right, 2 * right))
    inside = (F.col("pos") >= F.col("_a")) & (F.col("pos") < F.col("_z"))
    got = rows.join(samples.select("utt", "pos", "value"), ["utt", "pos"], "left")
    return got.select("utt", "mark_ix", "i", F.when(inside, F.coalesce(F.col("value") * weight, F.lit(0.0))).otherwise(F.lit(0.0)).alias("value"))


def segment_bounds(units: DataFrame, marks: DataFrame, margin: int) -> DataFrame:
    """Where the units (utt, step, src, start, end in seconds) of a path lie among the marks (src, pm_ix, pos, t) of their
    sources: (utt, step, src, first_pm, last_pm, from_pos, to_pos, added_before, added_after). The marks nearest to both
    ends, ``margin`` marks further out but at the ends of the utterance, and a mark more on either side for the samples."""
    near = joins.nearest(units.select("utt", "step", "src", "start", "end"), marks.select("src", F.col("t").alias("start"), "pm_ix"), "src", "start", ["pm_ix"]).withColumnRenamed("near_pm_ix", "_a")
    near = joins.nearest(near, marks.select("src", F.col("t").alias("end"), "pm_ix"), "src", "end", ["pm_ix"]).withColumnRenamed("near_pm_ix", "_z")
    last = marks.groupBy("src").agg(F.max("pm_ix").alias("_last"))
    w = Window.partitionBy("utt")
    rows = near.join(last, "src").withColumns({"_s": F.min("step").over(w), "_e": F.max("step").over(w)})
    first = F.greatest(F.when(F.col("step") == F.col("_s"), F.col("_a")).otherwise(F.col("_a") - margin), F.lit(1))
    end = F.least(F.when(F.col("step") == F.col("_e"), F.col("_z")).otherwise(F.col("_z") + margin), F.col("_last") - 1)
    rows = rows.select("utt", "step", "src", first.alias("first_pm"), end.alias("last_pm"), F.greatest(F.col("_a") - first, F.lit(0)).alias("added_before"), F.greatest(end - F.col("_z"), F.lit(0)).alias("added_after"))
    at = marks.select("src", "pm_ix", "pos")
    rows = rows.join(at.select("src", (F.col("pm_ix") + 1).alias("first_pm"), F.col("pos").alias("from_pos")), ["src", "first_pm"])
    return rows.join(at.select("src", (F.col("pm_ix") - 1).alias("last_pm"), F.col("pos").alias("to_pos")), ["src", "last_pm"])


def segment_samples(bounds: DataFrame, samples: DataFrame) -> DataFrame:
    """(utt, step, i, value): the samples (src, pos, value) of each segment, both ends included. Positions are joined by
    equality, so a long source is read once."""
    at = bounds.where("from_pos <= to_pos").select("utt", "step", "src", "from_pos", F.explode(F.sequence("from_pos", "to_pos")).alias("pos"))
    return at.join(samples.select("src", "pos", "value"), ["src", "pos"]).select("utt", "step", (F.col("pos") - F.col("from_pos")).alias("i"), "value")


def concatenated(bounds: DataFrame, samples: DataFrame, fade: int) -> DataFrame:
    """(utt, pos, value): the segments of a path one after the other, cross-faded over ``fade`` samples."""
    rows = segment_samples(bounds, samples).groupBy("utt", "step").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("x"))  # a unit's samples
    return assemble.waveform(rows.select("utt", "step", F.col("x.value").alias("samples")), fade)


def octave_factors(segments: DataFrame) -> DataFrame:
    """(utt, segment, factor) of segments (utt, segment, head, tail, first, last, n, low, high) in the order of their
    numbers. head and tail are what a segment has for reference at its ends; the scaled tail of the one before decides."""
    rows = F.array_sort(F.collect_list(F.struct("segment", "head", "tail", "first", "last", "n", "low", "high")))
    start = F.struct(F.lit(None).cast("double").alias("tail"), F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("n"), F.array().cast("array<double>").alias("factors"))

    def follow(state: Column, x: Column) -> Column:
        usable = (state["n"] > REFERENCE) & (x["n"] > REFERENCE) & (x["first"] - state["last"] < APART)
        above = x["head"] > state["tail"]
        ratio = F.bround(F.greatest(x["head"] / state["tail"], state["tail"] / x["head"]))
        inside = F.when(above, F.coalesce(x["low"] / ratio > LOWEST_F0, F.lit(True))).otherwise(F.coalesce(x["high"] * ratio < HIGHEST_F0, F.lit(True)))
        factor = F.when(usable & inside, F.when(above, 1 / ratio).otherwise(ratio)).otherwise(F.lit(1.0))
        return F.struct((x["tail"] * factor).alias("tail"), x["last"].alias("last"), x["n"].alias("n"), F.concat(state["factors"], F.array(factor)).alias("factors"))

    folded = segments.groupBy("utt").agg(rows.alias("x")).select("utt", "x", F.aggregate("x", start, follow)["factors"].alias("f"))  # a row for each segment
    return folded.select("utt", F.explode(F.arrays_zip("x", "f")).alias("y")).select("utt", F.col("y.x.segment").alias("segment"), F.col("y.x.n").alias("n"), F.col("y.f").alias("factor"))


def transposed(frames: DataFrame) -> DataFrame:
    """(utt, frame, f0, factor): F0 of (utt, frame, segment, f0; 0: unvoiced) moved by octaves, so that segments meet.

    A segment is divided or multiplied by the rounded ratio of two medians of ``REFERENCE`` voiced frames: those before
    the last one of the segment before it, and its own after its first; not where these are missing or ``APART`` frames
    from each other, nor where it would leave the range. Then all is divided by the factor of most voiced frames (the
    least of equal ones). Segments are summed up by aggregation, and only these sums are folded, in expressions."""
    over = Window.partitionBy("utt").orderBy("frame")
    f = frames.select("utt", F.col("frame").cast("long").alias("frame"), "segment", F.col("f0").cast("double").alias("f0"))
    f = f.withColumns({"i": F.row_number().over(over).cast("long"), "_new": (~F.col("segment").eqNullSafe(F.lag("segment").over(over))).cast("long"), "voiced": F.col("f0") > 0})
    f = f.withColumn("_g", F.sum("_new").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("utt", "_g")
    f = f.withColumns({"_up": F.sum(F.col("voiced").cast("long")).over(inside.orderBy("i")), "_down": F.sum(F.col("voiced").cast("long")).over(inside.orderBy(F.desc("i"))), "_first": F.min("i").over(inside)})
    only = lambda condition: F.when(condition, F.col("f0"))
    voiced, rest = F.col("voiced"), F.col("i") > F.col("_first")
    segments = f.groupBy("utt", F.col("_g").alias("segment")).agg(
        F.median(only(voiced & F.col("_up").between(2, REFERENCE + 1))).alias("head"), F.median(only(voiced & F.col("_down").between(2, REFERENCE + 1))).alias("tail"),
        F.min(F.when(voiced, F.col("i"))).alias("first"), F.max(F.when(voiced, F.col("i"))).alias("last"), F.count(F.when(voiced, 1)).alias("n"), F.min(only(rest)).alias("low"), F.max(only(rest)).alias("high"),
    )
    factors = octave_factors(segments)
    common = factors.where("n > 0").groupBy("utt", "factor").agg(F.sum("n").alias("n")).groupBy("utt").agg(F.min(F.struct((-F.col("n")).alias("n"), "factor"))["factor"].alias("common"))
    done = f.join(factors.select("utt", F.col("segment").alias("_g"), "factor"), ["utt", "_g"]).join(common, "utt", "left")
    factor = F.when(voiced, F.col("factor") / F.col("common")).otherwise(F.lit(1.0))
    return done.select("utt", "frame", F.when(voiced, F.col("f0") * F.col("factor") / F.col("common")).otherwise(F.col("f0")).alias("f0"), factor.alias("factor"))


def duration_of(f0: Column, unvoiced_ms: float = 5.0) -> Column:
    """Milliseconds of an array of F0: a period for each voiced frame after the first, else 5 ms."""
    each = F.transform(f0, lambda x, i: F.when(x <= 0, F.lit(unvoiced_ms)).when(i > 0, F.try_divide(F.lit(1000.0), x)).otherwise(F.lit(0.0)))
    return V.total(each)


def durations_imposed(units: DataFrame, first: int = 2, shortest: int = 3) -> DataFrame:
    """(utt, step, f0[, frames]): arrays of F0 of units (utt, step, f0, target_ms, confidence), read anew between their
    values so that they last as long as wanted, by the confidence; what falls below ``VOICED_FROM`` between voiced and
    unvoiced frames is unvoiced. A column ``frames`` (array of spectra, with the same number of further frames around
    F0's) is read anew likewise, each coefficient between its neighbours in time. The first two units, the last, and
    those of up to three frames stay."""
    w = Window.partitionBy("utt")
    more = ["frames"] if "frames" in units.columns else []
    rows = units.select("utt", "step", F.col("f0").cast("array<double>").alias("f0"), "target_ms", "confidence", *(F.col(c).cast("array<array<double>>").alias(c) for c in more))
    rows = rows.withColumns({"_n": F.size("f0"), "_ms": duration_of(F.col("f0")), "_s": F.min("step").over(w), "_e": F.max("step").over(w)})
    wanted = (1 - F.col("confidence")) * F.col("_ms") + F.col("confidence") * F.col("target_ms")
    rows = rows.withColumn("_k", F.floor(F.col("_n") * F.try_divide(wanted, F.col("_ms"))).cast("int"))

    def again(x: str, n: Column, k: Column, between) -> Column:
        """k values at equal distances from the first to the last of the n values of an array."""

        def read(i: Column) -> Column:
            place = F.coalesce(F.try_divide(i * (n - 1), k - 1), F.lit(0.0))
            low = F.floor(place).cast("int")
            return between(F.get(x, low), F.get(x, F.least(low + 1, n - 1)), place - low)

        return F.transform(F.sequence(F.lit(0), F.greatest(k, F.lit(1)) - 1), read)

    def voiced(a: Column, b: Column, share: Column) -> Column:
        value = a + (b - a) * share
        return F.when(value < VOICED_FROM, F.lit(0.0)).otherwise(value)

    changed = (F.col("step") >= F.col("_s") + first) & (F.col("step") != F.col("_e")) & (F.col("_n") > shortest) & (F.col("_k") > 0)
    n, k = F.col("_n"), F.col("_k")
    out = [F.when(changed, again("f0", n, k, voiced)).otherwise(F.col("f0")).alias("f0")]
    if more:
        size = F.size("frames")
        mixed = lambda a, b, share: F.zip_with(a, b, lambda x, y: x + (y - x) * share)
        out.append(F.when(changed, again("frames", size, k + size - n, mixed)).otherwise(F.col("frames")).alias("frames"))
    return rows.select("utt", "step", *out)
