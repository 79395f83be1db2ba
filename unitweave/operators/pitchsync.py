"""Frames at marks of variable distance: pitch-synchronous overlap-add, fragments at cutpoints, changes of frame rate.

Everything is joins by equality, windows over a track and sums, but for ``marks_from_shifts``, in which each step is read
at the place that the last one reached: there an utterance is one group.

Rows: keys and positions that are null are left out; an utterance without marks has no output; positions before 0 are
cut; shifts that are not positive end a track of marks.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitweave.functions import vectors as V
from unitweave.functions.windows import ahead


def side_window(offset: Column, left: Column, right: Column) -> Column:
    """A window with its top, 1, at offset 0, that falls as half a Hann window to 0 over ``left`` samples before and
    ``right`` after it."""
    length = F.when(offset < 0, left).otherwise(right)
    inside = F.abs(offset) <= length
    return F.when(offset == 0, F.lit(1.0)).when(inside, 0.5 + 0.5 * F.cos(math.pi * offset / length)).otherwise(F.lit(0.0))


def shifts(marks: DataFrame) -> DataFrame:
    """(utt, frame, pos, left, right): of marks (utt, frame, pos) the distances to the marks before (the first: from 0)
    and after (the last: as before it)."""
    w = Window.partitionBy("utt").orderBy("frame")
    left = F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0))
    return marks.where("utt IS NOT NULL AND pos IS NOT NULL").select("utt", "frame", F.col("pos").cast("long").alias("pos")).withColumn("left", left).withColumn("right", F.coalesce(F.lead("left").over(w), F.col("left")))


def pitch_overlap_added(frames: DataFrame, marks: DataFrame, window: bool = True) -> DataFrame:
    """(utt, pos, value): frames (utt, frame, samples) set down with their middle (of an even number the first of the
    second half) at the marks (utt, frame, pos) and summed; with ``window`` each frame fades over the distances to the
    marks on either side. Sums are partial before the shuffle."""
    at = frames.select("utt", "frame", F.col("samples").cast("array<double>").alias("samples")).join(shifts(marks), ["utt", "frame"])
    offset = F.col("i") - F.floor(F.size("samples") / 2)
    each = at.select("utt", "pos", "left", "right", "samples", F.posexplode("samples").alias("i", "x")).withColumn("offset", offset)
    weight = side_window(F.col("offset"), F.col("left"), F.col("right")) if window else F.lit(1.0)
    each = each.select("utt", (F.col("pos") + F.col("offset")).alias("pos"), (F.col("x") * weight).alias("x"), F.abs("offset").alias("_o"), "left", "right", "offset")
    if window:
        each = each.where(F.col("_o") <= F.when(F.col("offset") < 0, F.col("left")).otherwise(F.col("right")))
    return each.where("pos >= 0").groupBy("utt", "pos").agg(F.sum("x").alias("value"))


def cut_fragments(cuts: DataFrame, samples: DataFrame, taper: int = 0) -> DataFrame:
    """(utt, step, i, value): the samples (src, pos, value) from ``start`` to ``end``, both included, of cuts (utt, step,
    src, start, end). With a column ``middle`` they fade over both sides of it by halves of symmetric Hann windows; else
    with ``taper`` they begin and end half a taper further out (zeros beyond the source) and fade over it."""
    half = taper // 2
    epoch = "middle" in cuts.columns
    more = ["middle"] if epoch else []
    wide = cuts.select("utt", "step", "src", *more, (F.col("start") - (0 if epoch else half)).cast("long").alias("a"), (F.col("end") + (0 if epoch else half)).cast("long").alias("b")).where("a <= b")
    at = wide.select("utt", "step", "src", *more, "a", "b", F.explode(F.sequence("a", "b")).alias("pos"))
    got = at.join(samples.select("src", F.col("pos").cast("long").alias("pos"), F.col("value").cast("double").alias("value")), ["src", "pos"], "left")
    i, n = F.col("pos") - F.col("a"), F.col("b") - F.col("a") + 1
    if epoch:
        left, right = F.col("middle") - F.col("a"), F.col("b") + 1 - F.col("middle")
        j = F.when(i < left, i).otherwise(i - left + right)
        m = F.when(i < left, left).otherwise(right)
        weight = F.coalesce(0.5 - 0.5 * F.cos(F.try_divide(2 * math.pi * j, 2 * m - 1)), F.lit(1.0))
    elif taper:
        rise = lambda k: 0.5 - 0.5 * F.cos(2 * math.pi * k / max(1, taper - 1))
        weight = F.when(i < half, rise(i)).otherwise(F.lit(1.0)) * F.when(n - i <= taper - half, rise(taper - (n - i))).otherwise(F.lit(1.0))
    else:
        weight = F.lit(1.0)
    return got.select("utt", "step", i.alias("i"), (F.coalesce("value", F.lit(0.0)) * weight).alias("value"))


def _read(p: Column, n: Column, x: Column, beyond: str) -> Column:
    """The vector at x from the points before (or at) and after it, each (_q, _before, _after): itself and its neighbours."""

    def line(a: Column, b: Column) -> Column:
        share = F.coalesce(F.try_divide(x - a["x"], b["x"] - a["x"]), F.lit(0.0))
        return F.zip_with(a["y"], b["y"], lambda s, t: s + (t - s) * share)

    exact = p["_q"]["x"] == x
    inside = F.when(exact, p["_q"]["y"]).when(p.isNotNull() & n.isNotNull(), line(p["_q"], n["_q"]))
    if beyond == "extend":
        early = F.when(n["_after"].isNull(), n["_q"]["y"]).otherwise(line(n["_q"], n["_after"]))
        late = F.when(p["_before"].isNull(), p["_q"]["y"]).otherwise(line(p["_before"], p["_q"]))
    else:
        early, late = n["_q"]["y"], p["_q"]["y"]
    return inside if beyond == "drop" else F.coalesce(inside, F.when(p.isNull(), early).otherwise(late))


def read_between(values: DataFrame, grid: DataFrame, at: str, v: str, beyond: str = "hold") -> DataFrame:
    """The grid (utt, at, ...) with the vectors ``v`` of values (utt, at, v), each coefficient linear between neighbours in
    ``at``. Beyond the ends: ``hold`` the last value, ``extend`` the line through the last two, or leave the row out
    (``drop``). One union and windows over a track; no join."""
    other = [c for c in grid.columns if c not in ("utt", at)]
    point = F.struct(F.col(at).cast("double").alias("x"), F.col(v).cast("array<double>").alias("y"))
    w = Window.partitionBy("utt").orderBy("_x", "_g")
    known = values.where(F.col(at).isNotNull() & F.col(v).isNotNull()).select("utt", F.col(at).cast("double").alias("_x"), F.lit(0).alias("_g"), point.alias("_q"))
    known = known.withColumns({"_before": F.lag("_q").over(w), "_after": F.lead("_q").over(w)})
    known = known.select("utt", "_x", "_g", F.struct("_q", "_before", "_after").alias("_k"), *(F.lit(None).cast(grid.schema[c].dataType).alias(c) for c in other))
    rows = known.unionByName(grid.select("utt", F.col(at).cast("double").alias("_x"), F.lit(1).alias("_g"), F.lit(None).cast(known.schema["_k"].dataType).alias("_k"), *other))
    rows = rows.withColumn("_p", F.last("_k", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.last("_k", True).over(ahead("utt", "_x", "_g")))
    x = F.col("_x")
    inside = _read(F.col("_p"), F.col("_n"), x, beyond)
    return rows.where("_g = 1").select("utt", x.alias(at), inside.alias(v), *other).where(F.col(v).isNotNull())


def constant_rate(frames: DataFrame, rate: int, hop_seconds: float) -> DataFrame:
    """(utt, k, v): frames (utt, pos, v) at marks, read every ``hop_seconds`` from the first hop on, before the last mark;
    hops before the first mark are left out."""
    hop = rate * hop_seconds
    last = frames.groupBy("utt").agg(F.max("pos").alias("_last"))
    n = F.ceil(F.col("_last") / hop).cast("long") - 1
    grid = last.where(n >= 1).select("utt", F.explode(F.sequence(F.lit(1).cast("long"), n)).alias("k")).select("utt", "k", (F.col("k") * F.lit(float(hop))).alias("pos"))
    return read_between(frames, grid, "pos", "v", "drop").select("utt", "k", "v")


def marks_from_shifts(shift: DataFrame, rate: int, hop_seconds: float) -> DataFrame:
    """(utt, mark, pos, shift): marks at variable distances from shifts (utt, k, shift) known at a constant rate, the k-th
    (from 1) at k hops: from the last one backwards, each mark one shift before the next, where the shift is read at
    the mark reached. Ends before the first hop."""
    schema = T.StructType([shift.schema["utt"], T.StructField("mark", T.LongType()), T.StructField("pos", T.DoubleType()), T.StructField("shift", T.DoubleType())])
    hop = rate * hop_seconds

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k")
        x, y = pdf.k.to_numpy() * hop, pdf["shift"].to_numpy(float)
        pos, out = x[-1], []
        while pos >= x[0]:
            step = float(np.interp(pos, x, y))
            out.append((pos, step))
            if not step > 0:
                break
            pos -= step
        out.reverse()
        return pd.DataFrame({"utt": pdf.utt.iloc[0], "mark": np.arange(len(out)), "pos": [p for p, _ in out], "shift": [s for _, s in out]})

    return shift.where("utt IS NOT NULL AND k IS NOT NULL AND shift IS NOT NULL").select("utt", "k", "shift").groupBy("utt").applyInPandas(run, schema)


def variable_rate(frames: DataFrame, marks: DataFrame, rate: int, hop_seconds: float) -> DataFrame:
    """(utt, mark, pos, v): frames (utt, k, v) of a constant rate, the k-th (from 1) at k hops, read at marks (utt, mark,
    pos); marks beyond the frames are left out."""
    at = frames.select("utt", (F.col("k") * F.lit(rate * hop_seconds)).alias("pos"), "v")
    return read_between(at, marks.select("utt", "pos", "mark"), "pos", "v", "drop").select("utt", "mark", "pos", "v")


def upsampled(frames: DataFrame, lengths: DataFrame, rate: int, hop_seconds: float, convention: str = "world", f0: int | None = None) -> DataFrame:
    """(utt, pos, v): a vector for each sample of an utterance (utt, n) from frames (utt, ix, v) at their centres, linear
    between and beyond them. The coefficient ``f0`` is linear over voiced frames alone, and ``UNVOICED`` where the nearest
    frame (the earlier of equal ones) is unvoiced."""
    from unitweave.operators.series import frame_centres

    centre = (frame_centres(F.col("ix"), hop_seconds, convention) * rate).alias("pos")
    at = frames.select("utt", centre, F.col("v").cast("array<double>").alias("v"))
    grid = lengths.where("n > 0").select("utt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias("pos")).select("utt", F.col("pos").cast("double").alias("pos"))
    if f0 is None:
        return read_between(at, grid, "pos", "v", "extend").select("utt", F.col("pos").cast("long").alias("pos"), "v")
    # The vector, the F0 of voiced frames and voicing are read in one pass over frames and samples.
    value, x = F.col("v")[f0], F.col("_x")
    to, after = Window.partitionBy("utt").orderBy("_x", "_g").rowsBetween(Window.unboundedPreceding, 0), ahead("utt", "_x", "_g")
    before = Window.partitionBy("utt").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("utt").orderBy(F.desc("_x")).rowsBetween(Window.unboundedPreceding, -1)
    known = at.where("pos IS NOT NULL").withColumnRenamed("pos", "_x").withColumn("_g", F.lit(0)).withColumn("_flag", F.struct(x.alias("x"), F.coalesce(value > 0, F.lit(False)).alias("voiced")))
    known = known.withColumns({"_v": F.when(F.col("v").isNotNull(), F.struct(x.alias("x"), F.col("v").alias("y"))), "_f": F.when(value > 0, F.struct(x.alias("x"), F.array(value).alias("y")))})
    known = known.withColumns({f"{c}{side}": F.last(c, True).over(w) for c in ("_v", "_f") for side, w in (("b", before), ("a", behind))})
    point = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("_q"), F.col(f"{c}b").alias("_before"), F.col(f"{c}a").alias("_after"))).alias(c)
    known = known.select("utt", "_x", "_g", "_flag", point("_v"), point("_f"))
    rows = known.unionByName(grid.select("utt", F.col("pos").alias("_x"), F.lit(1).alias("_g"), *(F.lit(None).cast(known.schema[c].dataType).alias(c) for c in ("_flag", "_v", "_f"))))
    rows = rows.withColumns({f"{c}p": F.last(c, True).over(to) for c in ("_flag", "_v", "_f")}).withColumns({f"{c}n": F.last(c, True).over(after) for c in ("_flag", "_v", "_f")}).where("_g = 1")
    p, n = F.col("_flagp"), F.col("_flagn")
    voiced = F.when(n.isNull() | (p.isNotNull() & (x - p["x"] <= n["x"] - x)), p["voiced"]).otherwise(n["voiced"])
    own = F.when(voiced, _read(F.col("_fp"), F.col("_fn"), x, "extend")[0]).otherwise(F.lit(V.UNVOICED))
    out = rows.select("utt", x.cast("long").alias("pos"), _read(F.col("_vp"), F.col("_vn"), x, "extend").alias("v"), own.alias("_own")).where("v IS NOT NULL")
    return out.select("utt", "pos", F.transform("v", lambda y, i: F.when(i == f0, F.col("_own")).otherwise(y)).alias("v"))
