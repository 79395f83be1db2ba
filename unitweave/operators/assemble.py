"""Putting a path's fragments together: gather, taper, overlap-add, cross-fade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from unitweave.functions import vectors as V


def fragments(path: DataFrame, frames: DataFrame, size: int, extra: int, width: int) -> DataFrame:
    """(utt, step, pos, v): for each unit of the path (utt, step, src, frame) its ``size`` frames and ``extra`` on
    either side from frames (src, frame, v); zeros beyond the source's ends. pos counts from 0."""
    at = path.select("utt", "step", "src", F.posexplode(F.sequence(F.col("frame") - extra, F.col("frame") + (size + extra - 1))).alias("pos", "frame"))
    zeros = F.array_repeat(F.lit(0.0), width)
    got = at.join(frames.select("src", "frame", V.as_doubles(F.col("v")).alias("v")), ["src", "frame"], "left")
    return got.select("utt", "step", "pos", F.coalesce("v", zeros).alias("v"))


def overlap_added(frags: DataFrame, hop: int, size: int, overlap: int) -> DataFrame:
    """(utt, pos, d, value): fragments of size + overlap frames, tapered at both ends over ``overlap`` frames, set down
    ``hop`` frames apart and summed; half the overlap is cut from either end. Sums are partial before the shuffle."""
    if 2 * overlap > size + overlap:
        raise ValueError("the tapers of a fragment overlap each other")
    whole = size + overlap
    weight = V.taper(F.col("pos"), F.lit(whole), overlap)
    rows = frags.withColumn("_w", weight).select("utt", (F.col("step") * hop + F.col("pos")).alias("_at"), F.posexplode(F.transform("v", lambda x: x * F.col("_w"))).alias("d", "x"))
    out = rows.groupBy("utt", F.col("_at").alias("pos"), "d").agg(F.sum("x").alias("value"))
    ends = frags.groupBy("utt").agg((F.max("step") * hop + whole).alias("_n"))
    half = overlap // 2
    return out.join(ends, "utt").where((F.col("pos") >= half) & (F.col("pos") < F.col("_n") - half)).select("utt", (F.col("pos") - half).alias("pos"), "d", "value")


def placed(frags: DataFrame, length: str, shared: int) -> DataFrame:
    """``offset`` of each fragment (utt, step, length) when every one begins ``shared`` samples before the last ends."""
    w = Window.partitionBy("utt").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    return frags.withColumn("offset", F.coalesce(F.sum(F.col(length) - shared).over(w), F.lit(0)))


def waveform(frags: DataFrame, fade: int) -> DataFrame:
    """(utt, pos, value): fragments (utt, step, samples) one after the other with cross-faded ends."""
    rows = placed(frags.withColumn("_n", F.size("samples")), "_n", fade)
    each = rows.select("utt", "offset", "_n", F.posexplode("samples").alias("i", "x"))
    weight = V.taper(F.col("i"), F.col("_n"), fade)
    return each.groupBy("utt", (F.col("offset") + F.col("i")).alias("pos")).agg(F.sum(F.col("x") * weight).alias("value"))


def voicing_imposed(frames: DataFrame, vuv: Column, value: Column) -> Column:
    """F0 of the target where voiced, else 0."""
    return F.when(vuv < 0.5, F.lit(0.0)).otherwise(value)


def crossfaded(left: DataFrame, right: DataFrame, size: int) -> DataFrame:
    """(utt, pos, value): the last ``size`` rows of one series mixed linearly into the first of the next one; both
    (utt, pos, value), positions already aligned. Outside the margin each stands alone."""
    both = left.select("utt", "pos", F.col("value").alias("a")).join(right.select("utt", "pos", F.col("value").alias("b")), ["utt", "pos"], "full")
    start = right.groupBy("utt").agg(F.min("pos").alias("_s"))
    x = (F.col("pos") - F.col("_s") + 1) / (size + 1)
    return both.join(start, "utt", "left").select("utt", "pos", F.when(F.col("a").isNull(), F.col("b")).when(F.col("b").isNull(), F.col("a")).otherwise(F.col("a") * (1 - x) + F.col("b") * x).alias("value"))


def slope_to_average(units: DataFrame, f0: str = "f0", low: float = 20.0, high: float = 450.0) -> DataFrame:
    """(utt, step, value_ix, f0): F0 of each unit tilted so that at a join both sides meet at their mean; a unit that
    would leave [low, high] stays as it was. units (utt, step, f0 array)."""
    w = Window.partitionBy("utt").orderBy("step")
    first, last = F.col(f0)[0], F.element_at(f0, -1)
    rows = units.withColumns({"_in": (F.lag(F.element_at(f0, -1)).over(w) + first) / 2 - first, "_out": (F.lead(F.col(f0)[0]).over(w) + last) / 2 - last, "_n": F.size(f0)})
    add = lambda x, i: x + F.coalesce("_in", F.lit(0.0)) + (F.coalesce("_out", F.lit(0.0)) - F.coalesce("_in", F.lit(0.0))) * F.coalesce(F.try_divide(i.cast("double"), F.col("_n") - 1), F.lit(0.0))
    rows = rows.withColumn("_new", F.transform(f0, add))
    fine = F.forall("_new", lambda x: (x >= low) & (x <= high))
    return rows.select("utt", "step", F.posexplode(F.when(fine, F.col("_new")).otherwise(F.col(f0))).alias("value_ix", "f0"))


def snr_mixed(signal: DataFrame, noise: DataFrame, snr_db: float) -> DataFrame:
    """(utt, pos, value): the signal with the noise added at the wanted ratio of energies, position by position."""
    both = signal.select("utt", "pos", F.col("value").alias("s")).join(noise.select("utt", "pos", F.col("value").alias("n")), ["utt", "pos"])
    w = both.groupBy("utt").agg(F.sqrt(F.try_divide(F.sum(F.col("s") * F.col("s")), F.sum(F.col("n") * F.col("n")) * F.lit(10 ** (snr_db / 10)))).alias("gain"))
    return both.join(w, "utt").select("utt", "pos", (F.col("s") + F.col("n") * F.coalesce("gain", F.lit(0.0))).alias("value"))


def level_normalised(signal: DataFrame, level_db: float = -26.0) -> DataFrame:
    """(utt, pos, value): signals scaled to a root mean square at ``level_db`` of full scale 1; silence stays."""
    gain = signal.groupBy("utt").agg(F.try_divide(F.lit(10 ** (level_db / 20)), F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("_g"))
    return signal.join(gain, "utt").select("utt", "pos", (F.col("value") * F.coalesce("_g", F.lit(1.0))).alias("value"))
