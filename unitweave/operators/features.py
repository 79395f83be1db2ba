"""Features: composing streams, their statistics, standardising, units and their join contexts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from unitweave.functions import vectors as V
from unitweave.functions.windows import ahead


def composed(streams: DataFrame, order: Sequence[str], f0_streams: Sequence[str] = ("f0", "lf0"), skip: Sequence[str] = ("triphone",)) -> DataFrame:
    """(utt, frame, v) from stream_frames (utt, stream, frame, v): the streams of a frame one after the other. Frames
    that miss a stream are left out, so an utterance is as long as its shortest stream; F0 that is not above 0 becomes
    the unvoiced sentinel. One aggregation whatever the number of streams."""
    names = [s for s in order if s not in skip]
    marked = F.when(F.col("stream").isin(list(f0_streams)), F.transform(V.as_doubles(F.col("v")), V.unvoiced_marked)).otherwise(V.as_doubles(F.col("v")))
    rows = streams.where(F.col("stream").isin(names)).select("utt", "frame", "stream", marked.alias("v"))
    own = [F.first(F.when(F.col("stream") == s, F.col("v")), True).alias(f"_{i}") for i, s in enumerate(names)]
    wide = rows.groupBy("utt", "frame").agg(*own)
    whole = [F.col(f"_{i}") for i in range(len(names))]
    every = whole[0].isNotNull()
    for c in whole[1:]:
        every &= c.isNotNull()
    return wide.where(every).select("utt", "frame", F.concat(*whole).alias("v"))


def stream_statistics(frames: DataFrame, vector: str, streams: Sequence[tuple[str, int]], voiced_only: Sequence[str] = ()) -> DataFrame:
    """(stream, d, mean, std) over all frames: means of each coefficient, and for each stream the largest population
    standard deviation of its coefficients. Voiced-only streams leave out frames whose first coefficient is not above
    0; frames with values that are not finite are left out. Partial sums are made before the shuffle."""
    layout, at = [], 0
    for name, width in streams:
        layout.append((name, at, width))
        at += width
    parts = [F.struct(F.lit(name).alias("stream"), V.stream_slice(V.as_doubles(F.col(vector)), start, width).alias("x"), F.lit(name in voiced_only).alias("voiced")) for name, start, width in layout]
    rows = frames.select(F.explode(F.array(*parts)).alias("s")).select("s.*").where(V.finite(F.col("x")) & (~F.col("voiced") | (F.col("x")[0] > 0)))
    each = rows.select("stream", F.posexplode("x").alias("d", "x")).groupBy("stream", "d").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("own"))
    return each.select("stream", "d", "mean", F.max("own").over(Window.partitionBy("stream")).alias("std"))  # a row for each coefficient


def statistics_vectors(stats: DataFrame, order: Sequence[str]) -> tuple[list[float], list[float]]:
    """(means, stds) of the composed vector; as many numbers as it has coefficients."""
    rank = {s: i for i, s in enumerate(order)}
    rows = sorted(stats.collect(), key=lambda r: (rank[r.stream], r.d))
    return [r["mean"] for r in rows], [r["std"] for r in rows]


def bad_utterances(frames: DataFrame, utt: str, vector: str) -> DataFrame:
    """Utterances with a value that is not finite."""
    return frames.groupBy(utt).agg(F.bool_or(~V.finite(V.as_doubles(F.col(vector)))).alias("_bad")).where("_bad").select(utt)


def inner_frames(frames: DataFrame, utt: str, frame: str) -> DataFrame:
    """Without the first and the last frame of an utterance."""
    w = Window.partitionBy(utt)
    out = frames.withColumns({"_a": F.min(frame).over(w), "_b": F.max(frame).over(w)})
    return out.where((F.col(frame) > F.col("_a")) & (F.col(frame) < F.col("_b"))).drop("_a", "_b")


def length_matched(frames: DataFrame, lengths: DataFrame, utt: str, frame: str, vector: str, width: int, tolerance: int = 5) -> DataFrame:
    """Utterances padded with zeros or trimmed to the wanted ``n`` frames of lengths (utt, n); those further off than
    the tolerance are left out."""
    have = frames.groupBy(utt).agg(F.count(F.lit(1)).alias("_have"))
    fits = have.join(lengths, utt).where(F.abs(F.col("_have") - F.col("n")) <= tolerance)
    grid = fits.select(utt, F.explode(F.sequence(F.lit(0).cast("long"), F.col("n").cast("long") - 1)).alias(frame))
    zeros = F.array_repeat(F.lit(0.0), width)
    return grid.join(frames.select(utt, F.col(frame).cast("long").alias(frame), V.as_doubles(F.col(vector)).alias(vector)), [utt, frame], "left").withColumn(vector, F.coalesce(vector, zeros))


def silence_restored(frames: DataFrame, labels: DataFrame, width: int, silence: Sequence[str] = ("#",)) -> DataFrame:
    """Zero frames for the silent labels (utt, start, end, phone) that lead and end an utterance; frames (utt, frame,
    v) are those between, counted from 0."""
    w = Window.partitionBy("utt").orderBy("start")
    loud = labels.withColumn("_loud", (~F.col("phone").isin(list(silence))).cast("int"))
    loud = loud.withColumns({"_before": F.sum("_loud").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.sum("_loud").over(ahead("utt", "start"))})
    lead = loud.groupBy("utt").agg(F.coalesce(F.sum(F.when(F.col("_before") == 0, F.col("end") - F.col("start"))), F.lit(0)).alias("_lead"), F.coalesce(F.sum(F.when((F.col("_after") == 0) & (F.col("_before") > 0), F.col("end") - F.col("start"))), F.lit(0)).alias("_tail"))
    n = frames.groupBy("utt").agg(F.count(F.lit(1)).alias("_n")).join(lead, "utt")
    moved = frames.join(lead, "utt").select("utt", (F.col("frame") + F.col("_lead")).cast("long").alias("frame"), V.as_doubles(F.col("v")).alias("v"))
    zero = F.array_repeat(F.lit(0.0), width)
    spans = n.select("utt", F.concat(F.sequence(F.lit(0).cast("long"), F.col("_lead").cast("long")), F.transform(F.sequence(F.lit(0).cast("long"), F.col("_tail").cast("long")), lambda i: i + F.col("_lead") + F.col("_n"))).alias("at"), "_lead", "_n", "_tail")
    at = spans.select("utt", F.explode("at").alias("frame"), "_lead", "_n", "_tail").where((F.col("frame") < F.col("_lead")) | ((F.col("frame") >= F.col("_lead") + F.col("_n")) & (F.col("frame") < F.col("_lead") + F.col("_n") + F.col("_tail")))).distinct()
    return moved.unionByName(at.select("utt", "frame", zero.alias("v")))


def unit_windows(units: DataFrame, utt: str, ix: str, vector: str, size: int, tumbling: bool = False) -> DataFrame:
    """Units of several frames: the vectors of ``size`` rows from each one on, flattened; none crosses utterances."""
    w = Window.partitionBy(utt).orderBy(ix)
    rows = F.collect_list(vector).over(w.rowsBetween(0, size - 1))
    out = units.withColumn("_rows", rows).where(F.size("_rows") == size)
    if tumbling:
        out = out.where(F.col(ix) % size == 0)
    return out.withColumn(vector, F.flatten("_rows")).drop("_rows")


def join_contexts(units: DataFrame, ix: str, vector: str, utt: str | None = None, shift: int = 1) -> DataFrame:
    """``start`` (the vector before; the first one's own) and ``end`` (its own, or that of the last frame of a longer
    unit). utt None runs over the whole table, as the older layout with shared rows does: by equi joins on the dense ids."""
    if utt is None:
        near = lambda step, name: units.select((F.col(ix) + step).alias(ix), F.col(vector).alias(name))
        out = units.join(near(1, "start"), ix, "left").withColumn("start", F.coalesce("start", vector))
        return out.withColumn("end", F.col(vector)) if shift == 1 else out.join(near(1 - shift, "end"), ix, "left")
    w = Window.partitionBy(utt).orderBy(ix)
    end = F.col(vector) if shift == 1 else F.lead(vector, shift - 1).over(w)
    return units.withColumns({"start": F.coalesce(F.lag(vector).over(w), F.col(vector)), "end": end})


def frame_pairs(frames: DataFrame, utt: str, ix: str, vector: str) -> DataFrame:
    """Adjacent frames as one vector."""
    nxt = F.lead(vector).over(Window.partitionBy(utt).orderBy(ix))
    return frames.withColumn("_next", nxt).where(F.col("_next").isNotNull()).withColumn(vector, F.concat(vector, "_next")).drop("_next")


def cut_contexts(cuts: DataFrame, frames: DataFrame) -> DataFrame:
    """n + 1 boundary vectors of n units: cuts (utt, unit_ix, start, end) at frames (utt, frame, v)."""
    last = Window.partitionBy("utt").orderBy(F.desc("unit_ix"))
    ends = cuts.withColumn("_r", F.row_number().over(last)).where("_r = 1").select("utt", (F.col("unit_ix") + 1).alias("unit_ix"), F.col("end").alias("frame"))
    at = cuts.select("utt", "unit_ix", F.col("start").alias("frame")).unionByName(ends)
    return at.join(frames, ["utt", "frame"]).select("utt", F.col("unit_ix").alias("cut_ix"), "frame", "v")


def natural_contexts(frames: DataFrame, utt: str, ix: str, vector: str, width: int = 2) -> DataFrame:
    """``width`` frames before and after each one; the edges repeat."""
    w, every = Window.partitionBy(utt).orderBy(ix), Window.partitionBy(utt)
    first, last = F.min_by(vector, ix).over(every), F.max_by(vector, ix).over(every)
    near = [F.coalesce(F.lag(vector, k).over(w), first) for k in range(width, 0, -1)] + [F.col(vector)] + [F.coalesce(F.lead(vector, k).over(w), last) for k in range(1, width + 1)]
    return frames.withColumn("context", F.concat(*near))


def halfphones(states: DataFrame) -> DataFrame:
    """(utt, phone_ix, half, start, middle, end, duration) from states (utt, seq, start, end, state): states 2 and 3
    are the left half, 4 to 6 the right; the middle is the boundary inside a half."""
    rows = states.withColumn("phone_ix", F.floor(F.col("seq") / 5).cast("int")).withColumn("half", F.when(F.col("state").cast("int") <= 3, F.lit("L")).otherwise(F.lit("R")))
    inner = F.max(F.when(F.col("state").isin("3", "5"), F.col("start")))
    return rows.groupBy("utt", "phone_ix", "half").agg(F.min("start").alias("start"), inner.alias("middle"), F.max("end").alias("end"), F.sum(F.col("end") - F.col("start")).alias("duration"))


def halfphone_vectors(halves: DataFrame, frames: DataFrame, points: int = 3) -> DataFrame:
    """Vectors of one (middle), two (start, end) or three points of each half; the last frame is the one before end."""
    names = {1: ["middle"], 2: ["start", "end"], 3: ["start", "middle", "end"]}[points]
    at = F.array(*(F.struct(F.lit(i).alias("k"), (F.col(n) - (1 if n == "end" else 0)).alias("frame")) for i, n in enumerate(names)))
    rows = halves.select("utt", "phone_ix", "half", F.explode(at).alias("p")).select("utt", "phone_ix", "half", "p.*").join(frames, ["utt", "frame"])
    got = rows.groupBy("utt", "phone_ix", "half").agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("x"))  # three at most
    return got.where(F.size("x") == points).select("utt", "phone_ix", "half", F.flatten(F.col("x.v")).alias("target"))


def duration_statistics(rows: DataFrame, phone: str, duration: str, floor: float = 0.001) -> DataFrame:
    """(phone, mean, std): population deviation, floored."""
    return rows.groupBy(phone).agg(F.avg(duration).alias("mean"), F.greatest(F.stddev_pop(duration), F.lit(floor)).alias("std"))


def normalised_durations(rows: DataFrame, stats: DataFrame, phone: str, duration: str, unknown: tuple[float, float] = (5.0, 5.0)) -> DataFrame:
    """``norm``: durations in deviations from their phone's mean, or from ``unknown`` for a phone without one."""
    out = rows.join(stats.select(F.col(phone).alias("_p"), F.col("mean").alias("_m"), F.col("std").alias("_s")), F.col(phone) == F.col("_p"), "left")
    return out.withColumn("norm", (F.col(duration) - F.coalesce("_m", F.lit(unknown[0]))) / F.coalesce("_s", F.lit(unknown[1]))).drop("_p", "_m", "_s")


def prosody_targets(units: DataFrame, frames: DataFrame, energy: Column, lf0: Column, shift_sec: float = 0.005) -> DataFrame:
    """(utt, unit_ix, duration_ms, energy, lf0): means over the frames of units (utt, unit_ix, start, end); an unvoiced
    unit has the sentinel."""
    joined = units.join(frames.withColumnRenamed("utt", "_u"), (F.col("utt") == F.col("_u")) & (F.col("frame") >= F.col("start")) & (F.col("frame") < F.col("end")))
    out = joined.groupBy("utt", "unit_ix").agg((F.max("end") - F.max("start")).alias("_n"), F.avg(energy).alias("energy"), F.avg(F.when(lf0 > 0, lf0)).alias("_lf0"))
    return out.select("utt", "unit_ix", (F.col("_n") * shift_sec * 1000).alias("duration_ms"), "energy", F.coalesce("_lf0", F.lit(V.UNVOICED)).alias("lf0"))


def spliced(frames: DataFrame, utt: str, ix: str, vector: str, weights: Sequence[float]) -> DataFrame:
    """``spliced``: the weighted vectors of the neighbours around each frame, in order; frames that miss one are left out."""
    w, half = Window.partitionBy(utt).orderBy(ix), len(weights) // 2
    near = [F.col(vector) if k == half else F.lag(vector, half - k).over(w) for k in range(len(weights))]
    parts = [V.weighted(c, F.transform(c, lambda _: F.lit(g))) for c, g in zip(near, map(float, weights))]  # noqa: B023
    return frames.withColumn("spliced", F.concat(*parts)).where(F.col("spliced").isNotNull())


def unspliced(v: Column, parts: int, width: int) -> Column:
    """The middle one of the spliced vectors."""
    return V.stream_slice(v, parts // 2 * width, width)
