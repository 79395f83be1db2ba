"""Choosing utterances and rows: limits, patterns, set operations, repeatable samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window


def any_pattern(utt: Column, patterns: list[str]) -> Column:
    """Whether a name holds one of the patterns."""
    return reduce(lambda a, b: a | b, (F.contains(utt, F.lit(p)) for p in patterns), F.lit(False))


def training_set(utts: DataFrame, utt: str, n_train: int | str = 0, exclude: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """The first n names (0: all) or those that hold a pattern; then without those that hold an excluded pattern; then
    only those listed. The limit comes before the exclusion."""
    out = utts
    if isinstance(n_train, str):
        out = out.where(F.contains(F.col(utt), F.lit(n_train)))
    elif n_train:
        out = out.orderBy(utt).limit(n_train)
    if exclude:
        out = out.where(~any_pattern(F.col(utt), exclude))
    return out if only is None else out.join(only, utt, "left_semi")


def test_set(utts: DataFrame, utt: str, patterns: list[str], training: DataFrame, n: int = 0, done: DataFrame | None = None) -> DataFrame:
    """Names that hold a pattern and are in no training set; of these the first n; without those already produced."""
    out = utts.where(any_pattern(F.col(utt), patterns)).join(training.select(utt).distinct(), utt, "left_anti")
    if n:
        out = out.orderBy(utt).limit(n)
    return out if done is None else out.join(done.select(utt).distinct(), utt, "left_anti")


def common_names(frames: list[DataFrame], name: str) -> DataFrame:
    """Names that are in all frames."""
    every = reduce(DataFrame.unionAll, (f.select(name).distinct().withColumn("_in", F.lit(i)) for i, f in enumerate(frames)))
    return every.groupBy(name).agg(F.count_distinct("_in").alias("_n")).where(F.col("_n") == len(frames)).select(name)


def common_to_all(df: DataFrame, name: str, group: str) -> DataFrame:
    """Names that occur in every group of one table: one pass for the groups' number, one aggregation for the names."""
    n = df.agg(F.count_distinct(group).alias("_n"))
    own = df.groupBy(name).agg(F.count_distinct(group).alias("_own"))
    return own.crossJoin(F.broadcast(n)).where("_own = _n").select(name)  # one row on the right


def hash_order(*columns: str, seed: int = 1234) -> Column:
    """A repeatable random order, the same in any engine: the md5 digest of the seed and the columns as text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary"))


def sample_rows(df: DataFrame, n: int, *columns: str, seed: int = 1234) -> DataFrame:
    """n rows, the same ones however the data lies."""
    return df.orderBy(hash_order(*columns, seed=seed), *columns).limit(n)


def sample_classes(df: DataFrame, label: str, n: int, *columns: str, seed: int = 1234) -> DataFrame:
    """n rows of each class."""
    w = Window.partitionBy(label).orderBy(hash_order(*columns, seed=seed), *columns)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def evenly_spaced(df: DataFrame, n: int, order: str, key: str) -> DataFrame:
    """About n rows at equal distances of their rank (all rows where there are fewer), by range partitions' counts: no
    task sees all rows."""
    ranked = ranked_globally(df, [order, key])
    size = df.count()
    step = max(1, size // max(1, n))
    return ranked.where(F.col("rank") % step == 0).drop("rank")


def _number(df: DataFrame, column: str) -> Column:
    """A value in the order of the column: itself, of a text its first seven bytes."""
    own = F.col(column)
    if isinstance(df.schema[column].dataType, T.StringType):
        own = F.conv(F.rpad(F.hex(F.substring(own.cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return own


def _above(value: Column, cuts: Column, n: int) -> Column:
    """How many of the ascending ``cuts``, at most n, are below the value: a binary search; 0 for null."""
    steps = [1 << b for b in reversed(range(max(1, n).bit_length()))]
    further = lambda at, step: F.when(value > F.get(cuts, at + step - 1), at + step).otherwise(at)
    return F.aggregate(F.array(*(F.lit(x) for x in steps)), F.lit(0), further)


def ranked_globally(df: DataFrame, order: list[str], name: str = "rank") -> DataFrame:
    """A dense 0-based rank over the whole table by ``order``, whose first column is a number, date, time or text; nulls
    come first. Quantiles of that column cut the rows into ranges, and those of the second column cut the rows of a
    value that fills several ranges (of a text: of its first seven bytes); rows are ranked within a range, and add the
    rows of the ranges before it. The range follows from the row alone, so that a stage that runs again ranks alike."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shares = [(i + 1) / parts for i in range(parts - 1)] or [0.5]
    quantiles = df.select(_number(df, order[0]).alias("x")).agg(F.percentile_approx("x", shares, 10_000).alias("q")).first().q or []
    cuts = sorted(set(quantiles))
    placed = df.withColumn("_p", _above(_number(df, order[0]), F.array(*(F.lit(c) for c in cuts)), len(cuts)) if cuts else F.lit(0))
    heavy = sorted({a for a, b in zip(quantiles, quantiles[1:]) if a == b})
    if heavy and len(order) > 1:
        # A cut is the last value of its range, so its rows come after the others of the range.
        which = placed.select(_number(df, order[0]).alias("_x"), _number(df, order[1]).alias("_y"))
        own = which.where(F.col("_x").isin(heavy)).groupBy("_x").agg(F.array_sort(F.array_distinct(F.percentile_approx("_y", shares, 10_000))).alias("_cuts"))
        placed = placed.withColumn("_x", _number(df, order[0])).join(F.broadcast(own), "_x", "left")  # a row for each value of the quantiles
        placed = placed.withColumn("_q", F.when(F.col("_cuts").isNull(), F.lit(0)).otherwise(1 + _above(_number(df, order[1]), F.col("_cuts"), parts))).drop("_x", "_cuts")
    else:
        placed = placed.withColumn("_q", F.lit(0))
    sizes = placed.groupBy("_p", "_q").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", "_q", F.coalesce(F.sum("_n").over(Window.orderBy("_p", "_q").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each range
    ranked = F.row_number().over(Window.partitionBy("_p", "_q").orderBy(*order)) - 1
    return placed.withColumn("_i", ranked).join(F.broadcast(before), ["_p", "_q"]).withColumn(name, F.col("_i") + F.col("_before")).select(*df.columns, name)


def ranked_within(df: DataFrame, key: str, order: str, name: str = "rank") -> DataFrame:
    """A dense 0-based rank of the rows of each key by ``order``, without a task that gets all rows of a key; rows
    without a key are left out."""
    ranked = ranked_globally(df.where(F.col(key).isNotNull()), [key, order], "_r")
    first = ranked.groupBy(F.col(key).alias("_k")).agg(F.min("_r").alias("_first"))
    return ranked.join(first, F.col(key) == F.col("_k")).withColumn(name, F.col("_r") - F.col("_first")).select(*df.columns, name)


def group_medians(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, median): of the values that are not null, exactly, from their ranks."""
    rows = df.select(key, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked_within(rows, key, "_v").join(sizes, key)
    middle = ranked.where((F.col("rank") == F.floor((F.col("n") - 1) / 2)) | (F.col("rank") == F.ceil((F.col("n") - 1) / 2)))
    return middle.groupBy(key).agg(F.max("n").alias("n"), F.avg("_v").alias("median"))


def group_modes(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, mode): the most frequent value, of equally frequent ones the least; counts are aggregated first."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v")))["v"].alias("mode"))


def holdout(df: DataFrame, unit_id: str, percent: float) -> tuple[DataFrame, DataFrame]:
    """(rest, the last percent of units by their dense id)"""
    n = df.count()
    limit = n - int(n * percent / 100)
    return df.where(F.col(unit_id) < limit), df.where(F.col(unit_id) >= limit)


def fragment_starts(spark, size: int, length: int, n: int, seed: int = 1234) -> DataFrame:
    """(start): n starts of different fragments of ``length`` of ``size`` rows, in a repeatable random order."""
    starts = spark.range(0, max(0, size - length), length).select(F.col("id").alias("start"))
    return sample_rows(starts, n, "start", seed=seed)
