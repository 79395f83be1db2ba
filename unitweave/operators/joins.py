"""Joins in time and by name: nearest marks, intervals, backoff, transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from unitweave.functions.windows import ahead
from unitweave.sources.scratch import kept

#: Names of a level that go to every task, each with a short list of units.
NAMES = 50_000


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, values: Sequence[str]) -> DataFrame:
    """``left`` with the values of the row of ``right`` whose time is nearest in the same key (the earlier of equally
    near ones); null where the key has none. One union, one sort within the key and two windows: linear, no join."""
    marks = right.select(F.col(key).alias("_k"), F.col(at).cast("double").alias("_t"), F.struct(F.col(at).cast("double").alias("_x"), *values).alias("_m"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema.simpleString()).alias("_row"))
    rows = left.select(F.col(key).alias("_k"), F.col(at).cast("double").alias("_t"), F.lit(None).cast(marks.schema["_m"].dataType).alias("_m"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    w = Window.partitionBy("_k").orderBy("_t", "_side")
    # Of marks of one time the first in the values' order stands for it.
    first = Window.partitionBy("_k", "_t").orderBy("_m")
    marks = marks.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    both = marks.unionByName(rows)
    both = both.withColumn("_p", F.last("_m", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.last("_m", True).over(ahead("_k", "_t", "_side")))
    t = F.col("_t")
    earlier = F.col("_n").isNull() | (F.col("_p").isNotNull() & (t - F.col("_p._x") <= F.col("_n._x") - t))
    got = F.when(earlier, F.col("_p")).otherwise(F.col("_n"))
    return both.where("_side = 1").select("_row.*", *(got[v].alias(f"near_{v}") for v in values))


def interval_joined(points: DataFrame, intervals: DataFrame, key: str, at: str, start: str, values: Sequence[str]) -> DataFrame:
    """Each point with the last interval of its key that starts at or before it: an as-of join by one window."""
    i = intervals.select(F.col(key).alias("_k"), F.col(start).alias("_t"), F.struct(*values).alias("_m"), F.lit(0).alias("_side"), F.lit(None).cast(points.schema.simpleString()).alias("_row"))
    p = points.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(None).cast(i.schema["_m"].dataType).alias("_m"), F.lit(1).alias("_side"), F.struct(*points.columns).alias("_row"))
    w = Window.partitionBy("_k").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = i.unionByName(p).withColumn("_got", F.last("_m", True).over(w))
    return both.where("_side = 1").select("_row.*", *(F.col("_got")[v].alias(v) for v in values))


def _marked(ids: Column, level: int) -> Column:
    return F.transform(ids, lambda u: F.struct(F.lit(level).alias("level"), u.alias("unit")))


def backoff(targets: DataFrame, units: DataFrame, target_key: str, levels: Sequence[tuple[Column, Column]], unit_id: str, k: int, fallback: int | None = None, repeats: bool = False) -> DataFrame:
    """(target_key, rank, unit_id, level): up to k units for each target, exact names first and then by ever shorter
    ones; within a level by unit id. levels: (target's name, unit's name) from the longest on. Without ``repeats`` a
    unit counts once for a target. Targets without any match get the fallback unit at level -1.

    Only the first k units of each name can be taken, so a name is one row with a short list. Each target reads the
    lists of its own names, and no more than k units of it are shuffled: what a frequent name has comes to no single
    task. Names of a level are broadcast up to ``NAMES`` of them."""
    index = units.select(unit_id, F.explode(F.array(*(F.struct(F.lit(i).alias("level"), u.alias("form")) for i, (_, u) in enumerate(levels)))).alias("e")).select(F.col(unit_id).alias("_u"), "e.*").where("form IS NOT NULL")
    keep = k * (1 if repeats else len(levels))
    index = index.withColumn("_r", F.row_number().over(Window.partitionBy("level", "form").orderBy("_u"))).where(F.col("_r") <= keep)
    index = kept(index.groupBy("level", "form").agg(F.array_sort(F.collect_list("_u")).alias("_ids")), "names")
    names = {r.level: r["n"] for r in index.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each level
    rows, none = targets.select(target_key, *(t.alias(f"_form{i}") for i, (t, _) in enumerate(levels))), F.array().cast(index.schema["_ids"].dataType)
    for i in range(len(levels)):
        own = index.where(F.col("level") == i).select(F.col("form").alias(f"_form{i}"), F.col("_ids").alias(f"_ids{i}"))
        rows = rows.join(F.broadcast(own) if names.get(i, 0) <= NAMES else own, f"_form{i}", "left")
    lists, before = [], none
    for i in range(len(levels)):
        ids = F.coalesce(f"_ids{i}", none)
        lists.append(_marked(ids if repeats else F.array_except(ids, before), i))
        before = F.concat(before, ids)
    # A target that has several rows takes the best of all.
    found = rows.select(target_key, F.slice(F.concat(*lists), 1, k).alias("_x")).where(F.size("_x") > 0).repartition(target_key)
    found = found.select(target_key, F.explode("_x").alias("_x")).select(target_key, F.col("_x.level").alias("level"), F.col("_x.unit").alias(unit_id))
    if not repeats:
        found = found.groupBy(target_key, unit_id).agg(F.min("level").alias("level"))
    w = Window.partitionBy(target_key).orderBy("level", unit_id)
    out = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(target_key, "rank", unit_id, "level")
    if fallback is None:
        return out
    lost = targets.select(target_key).distinct().join(out.select(target_key).distinct(), target_key, "left_anti")
    return out.unionByName(lost.select(target_key, F.lit(1).alias("rank"), F.lit(fallback).cast(units.schema[unit_id].dataType).alias(unit_id), F.lit(-1).alias("level")))


def successors(units: DataFrame, unit_id: str, *carry: str, utt: str | None = None) -> DataFrame:
    """(from_id, to_id, carried values of both): natural neighbours, by an equi join on the next id."""
    a = units.select(F.col(unit_id).alias("from_id"), *(F.col(c).alias(f"from_{c}") for c in carry), *([F.col(utt).alias("_ua")] if utt else []))
    b = units.select(F.col(unit_id).alias("to_id"), *(F.col(c).alias(f"to_{c}") for c in carry), *([F.col(utt).alias("_ub")] if utt else []))
    out = a.join(b, F.col("to_id") == F.col("from_id") + 1)
    return out.where("_ua = _ub").drop("_ua", "_ub") if utt else out


def transitions(units: DataFrame) -> DataFrame:
    """Transition counts by phone of units (unit_id, phone, half): a left half goes to right halves of its phone, a
    right half to left halves of the phone that follows it. (from_id, natural, n_candidates): the pairs themselves are
    joined only for given units (``transitions_of``), as all of them grow with the square of a phone's units."""
    sizes = units.groupBy("phone", "half").agg(F.count(F.lit(1)).alias("n"))
    nxt = successors(units, "unit_id", "phone", "half").select(F.col("from_id").alias("unit_id"), "to_phone", "to_half", F.col("to_id").alias("natural"))
    rows = units.join(nxt, "unit_id", "left").withColumn("_want", F.when(F.col("half") == "L", F.col("phone")).otherwise(F.col("to_phone"))).withColumn("_half", F.when(F.col("half") == "L", F.lit("R")).otherwise(F.lit("L")))
    out = rows.join(sizes.select(F.col("phone").alias("_p"), F.col("half").alias("_h"), "n"), (F.col("_want") == F.col("_p")) & (F.col("_half") == F.col("_h")), "left")
    return out.select(F.col("unit_id").alias("from_id"), "natural", F.coalesce("n", F.lit(0)).cast("long").alias("n_candidates"))


def transitions_of(chosen: DataFrame, units: DataFrame) -> DataFrame:
    """The transition table (from_id, to_id, natural) of chosen unit ids, without loops."""
    nxt = successors(units, "unit_id", "phone").select(F.col("from_id").alias("_f"), "to_phone")
    rows = chosen.join(units, "unit_id").join(nxt, F.col("unit_id") == F.col("_f"), "left").select(F.col("unit_id").alias("from_id"), F.when(F.col("half") == "L", F.col("phone")).otherwise(F.col("to_phone")).alias("_want"), F.when(F.col("half") == "L", F.lit("R")).otherwise(F.lit("L")).alias("_half"))
    out = rows.join(units, (F.col("_want") == F.col("phone")) & (F.col("_half") == F.col("half"))).where("from_id <> unit_id")
    return out.select("from_id", F.col("unit_id").alias("to_id"), (F.col("unit_id") == F.col("from_id") + 1).alias("natural"))


def binned_clipped(points: DataFrame, bins: DataFrame, key: str, at: str, end: str, values: Sequence[str]) -> DataFrame:
    """Each point with the first bin of its key that ends at or after it; one beyond the last end gets the last bin."""
    b = bins.select(F.col(key).alias("_k"), F.col(end).alias("_t"), F.struct(*values).alias("_m"), F.lit(1).alias("_side"), F.lit(None).cast(points.schema.simpleString()).alias("_row"))
    p = points.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(None).cast(b.schema["_m"].dataType).alias("_m"), F.lit(0).alias("_side"), F.struct(*points.columns).alias("_row"))
    w = Window.partitionBy("_k").orderBy("_t", "_side")
    both = b.unionByName(p).withColumns({"_n": F.last("_m", True).over(ahead("_k", "_t", "_side")), "_p": F.last("_m", True).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return both.where("_side = 0").select("_row.*", *(F.coalesce("_n", "_p")[v].alias(v) for v in values))


def labels_at(marks: DataFrame, spans: DataFrame, shift: int) -> DataFrame:
    """``marks`` (utt, pos in samples) with the label of the frame whose centre is nearest (the earlier of equal ones);
    marks before the first and after the last centre get these frames' labels. spans (utt, start, end, label) count
    frames of ``shift`` samples."""
    last = spans.groupBy("utt").agg(F.max("end").alias("_n"))
    frame = F.ceil((F.col("pos") - shift // 2) / F.lit(float(shift)) - 0.5)
    rows = marks.join(last, "utt").withColumn("_f", F.least(F.greatest(frame, F.lit(0)), F.col("_n") - 1)).drop("_n")
    return interval_joined(rows, spans.select("utt", F.col("start").cast("long").alias("start"), "label"), "utt", "_f", "start", ["label"]).drop("_f")


def join_examples(units: DataFrame, candidates: DataFrame) -> DataFrame:
    """(from_id, to_id, ok): joins to learn from or to be judged. Good ones are neighbours in one utterance of the units
    (unit_id, utt); others are all different pairs of candidates (utt, step, unit_id) of neighbouring steps that are not."""
    good = successors(units, "unit_id", utt="utt").select("from_id", "to_id", F.lit(True).alias("ok"))
    a = candidates.select("utt", "step", F.col("unit_id").alias("from_id"))
    b = candidates.select("utt", (F.col("step") - 1).alias("step"), F.col("unit_id").alias("to_id"))
    other = a.join(b, ["utt", "step"]).where("to_id <> from_id + 1").select("from_id", "to_id").distinct()
    return good.unionByName(other.withColumn("ok", F.lit(False)))
