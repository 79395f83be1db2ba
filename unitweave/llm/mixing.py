"""Mixing sources to target weights by capped water-filling.

Each source asks for its share of the mix by weight. A source whose share is above ``max_epochs`` times its size is
clamped there, and the excess goes to the others by weight until none is above (``water_fill``). A source then takes
its documents whole ``floor(target / size)`` times and the rest of the target as a seeded sample: its documents are
put in the order of a seeded hash and taken once more until the budget of words is used up; the document on the edge
is taken in part (its first words). So every source takes its target to within half a word, and reruns agree.

The running sum needs no source in one place: words are summed by (source, hash bucket), the buckets before the edge
are taken, those after it not, and only the one bucket on the edge of a source is put in order.

Rows: null text has size 0; the null source is a source of its own, last in the order of sources; repeated rows are
rows of their own (in a bucket on the edge they are put in any order, which no result column shows); an empty table
gives an empty mix. At most ``MAX_SOURCES`` sources are planned on the driver, more raise an error.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from unitweave.llm.scratch import stored

MAX_SOURCES = 1_000_000
#: Sources up to which the plan is sent to every task (some 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 50_000
WORD = r"[^\x20\x09-\x0D]+"
SEED = 17
WEIGHTS = (5.0, 2.0, 1.0)
#: Hash digits that make a bucket: 16**3 of them.
DIGITS = 3


def water_fill(sizes: list[int], weights: list[float], total: float, max_epochs: float) -> list[float]:
    """Targets that share ``total`` by weight, none above max_epochs times its size; the sum is less than total only
    where all sizes together do not allow it."""
    order = sorted((i for i in range(len(sizes)) if weights[i] > 0), key=lambda i: max_epochs * sizes[i] / weights[i])
    out = [0.0] * len(sizes)
    left, weight = total, math.fsum(weights[i] for i in order)
    for n, i in enumerate(order):
        cap = max_epochs * sizes[i]
        if cap * weight > left * weights[i]:  # this one stays below its cap, and so do all after it
            for j in order[n:]:
                out[j] = left * weights[j] / weight
            break
        out[i] = float(cap)
        left, weight = left - cap, weight - weights[i]
    return out


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, *more: str) -> DataFrame:
    """Per row: doc, source, size in words and its place in the seeded order; and more columns."""
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    return docs.select(F.col(id_col).alias("doc"), F.col(source_col).alias("source"), size.alias("size"), key.alias("place"), *more)


def plan(sizes: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> list[tuple]:
    """Per source, in order: (source, source_size, target, whole, budget)."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    rows = sorted(((r.source, r.n) for r in rows), key=lambda x: (x[0] is None, x[0] or ""))
    n = [x[1] for x in rows]
    targets = water_fill(n, [weights[i % len(weights)] for i in range(len(n))], share * sum(n), max_epochs)
    out = []
    for (source, size), target in zip(rows, targets):
        whole = int(target // size) if size else 0
        out.append((source, size, target, whole, math.floor(target - whole * size + 0.5)))
    return out


def _decided(rows: DataFrame, sizes: DataFrame, source_kind: T.DataType, share: float, max_epochs: float, weights: tuple[float, ...]) -> DataFrame:
    """``rows`` (with doc, source, size and place) and source_size, target, whole and part."""
    spark = rows.sparkSession
    schema = T.StructType([T.StructField("source", source_kind), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("whole", T.LongType()), T.StructField("budget", T.LongType())])
    planned = plan(sizes, share, max_epochs, weights)
    plans = spark.createDataFrame(planned, schema)
    few = F.broadcast if len(planned) <= BROADCAST_SOURCES else lambda x: x
    bucket = F.substring("place", 1, DIGITS)
    sums = sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).withColumnRenamed("source", "s")
    sums = sums.join(few(plans), F.col("s").eqNullSafe(F.col("source"))).drop("source")
    # The one bucket of each source that the budget ends in, the words before it, and the last bucket that is in whole.
    here = (F.col("before") < F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget"))
    ends = sums.groupBy("s").agg(F.max(F.when(here, F.col("bucket"))).alias("edge"), F.max(F.when(here, F.col("before"))).alias("before"), F.max(F.when((F.col("before") + F.col("words") <= F.col("budget")) & (F.col("budget") > 0), F.col("bucket"))).alias("last"))
    every = plans.join(few(ends), F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumnRenamed("source", "s")
    joined = rows.join(few(every), rows["source"].eqNullSafe(F.col("s"))).drop("s")
    on_edge = F.coalesce(bucket == F.col("edge"), F.lit(False))
    easy = joined.where(~on_edge).withColumn("part", F.when(bucket <= F.col("last"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    # On the edge, ids and sizes alone are put in order to find the row that the budget ends in; only rows equal to it
    # (repeated rows) are counted.
    narrow = sizes.join(few(every.where("edge IS NOT NULL")), sizes["source"].eqNullSafe(F.col("s"))).where(on_edge)
    ordered = Window.partitionBy("s").orderBy("place", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    narrow = narrow.withColumn("earlier", F.coalesce(F.sum("size").over(ordered), F.lit(0)) + F.col("before"))
    ends_here = (F.col("earlier") < F.col("budget")) & (F.col("earlier") + F.col("size") >= F.col("budget"))
    same = lambda x, y: x["place"].eqNullSafe(y["place"]) & x["doc"].eqNullSafe(y["doc"]) & (x["size"] == y["size"])
    own = F.struct("place", "doc", "size")
    cut = narrow.groupBy("s").agg(F.min(F.when(ends_here, own)).alias("stop"))
    at = narrow.join(few(cut.withColumnRenamed("s", "c")), F.col("s").eqNullSafe(F.col("c"))).where(same(own, F.col("stop"))).groupBy("s").agg(F.first("stop").alias("stop"), F.min("earlier").alias("until")).withColumnRenamed("s", "a")
    hard = joined.where(on_edge).join(few(at), F.col("source").eqNullSafe(F.col("a")), "left").drop("a")
    equal, stop = same(own, F.col("stop")), F.col("stop")
    sooner = (F.col("place") < stop["place"]) | ((F.col("place") == stop["place"]) & (F.coalesce(F.col("doc") < stop["doc"], F.col("doc").isNull() & stop["doc"].isNotNull()) | (F.col("doc").eqNullSafe(stop["doc"]) & (F.col("size") < stop["size"]))))
    nth = F.row_number().over(Window.partitionBy("source", "place", "doc", "size").orderBy(F.lit(0))) - 1
    tied = hard.where(equal).withColumn("part", F.least(F.greatest(F.col("budget") - F.col("until") - nth * F.col("size"), F.lit(0)), F.col("size")).cast("long"))
    apart = hard.where(~equal).withColumn("part", F.when(sooner, F.col("size")).otherwise(F.lit(0)).cast("long"))
    return easy.unionByName(tied.drop("stop", "until")).unionByName(apart.drop("stop", "until")).drop("edge", "before", "last", "budget")


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: id, size, source_size, target, taken (words, repeats counted), whole (repetitions in full)
    and part (words of one more repetition)."""
    sizes = stored(sized(docs, id_col, text_col, source_col, seed), "sizes")
    done = _decided(sizes, sizes, docs.schema[source_col].dataType, share, max_epochs, weights)
    taken = F.col("whole") * F.col("size") + F.col("part")
    return done.select(F.col("doc").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "whole", "part")


def repetitions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5, max_epochs: float = 2.0, weights: tuple[float, ...] = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, with repetition (1, 2), size (words of the
    document), taken (words of this repetition), source_size and target; columns of ``docs`` with one of these names give
    way to them. The one repetition in part of a source is cut after its words, and n_chars, where there is such a
    column, follows."""
    docs = docs.drop(*({"repetition", "size", "taken", "source_size", "target"} - {id_col, text_col, source_col}))
    sizes = stored(sized(docs, id_col, text_col, source_col, seed), "sizes")
    extra = sized(docs.withColumn("_row", F.struct(*docs.columns)), id_col, text_col, source_col, seed, "_row")
    done = _decided(extra, sizes, docs.schema[source_col].dataType, share, max_epochs, weights)
    done = done.withColumn("repetition", F.explode(F.filter(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("whole") + 1, F.lit(1).cast("long"))), lambda i: (i <= F.col("whole")) | (F.col("part") > 0))))
    in_part = (F.col("repetition") > F.col("whole")) & (F.col("part") < F.col("size"))
    text = F.col(f"_row.{text_col}")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0)), F.lit(1), F.col("part").cast("int")), "")
    shown = F.when(in_part, cut).otherwise(text)
    columns = {c: F.col(f"_row.{c}") for c in docs.columns} | {text_col: shown}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(in_part, F.length(cut).cast("long")).otherwise(F.col("_row.n_chars"))
    taken = F.when(F.col("repetition") > F.col("whole"), F.col("part")).otherwise(F.col("size"))
    return done.select(*(c.alias(n) for n, c in columns.items()), "repetition", "size", taken.alias("taken"), "source_size", "target")


#: What ``mixed`` returns for the contract's numbers, from its definition alone: the fixed point of the clamping is
#: the prefix of sources in the order of cap / weight.
SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM sources
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST) AS r FROM weighed
), levels AS (
  SELECT *, 1.5::DOUBLE * (SELECT sum(source_size) FROM sources)::DOUBLE - coalesce(sum(2 * source_size) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS remain,
         sum(w) OVER (ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM ranked
), stop AS (
  SELECT arg_min(remain, r) AS remain, arg_min(rest, r) AS rest, min(r) AS r FROM levels WHERE 2.0 * source_size * rest > remain * w
), targets AS (
  SELECT source, source_size, CASE WHEN l.r >= (SELECT r FROM stop) THEN (SELECT remain FROM stop) * w / (SELECT rest FROM stop) ELSE 2.0::DOUBLE * source_size END AS target FROM levels l
), planned AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM targets
), budgets AS (
  SELECT *, CAST(floor(target - whole * source_size + 0.5) AS BIGINT) AS budget FROM planned
), ordered AS (
  SELECT d.*, b.source_size, b.target, b.whole, b.budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM sized d JOIN budgets b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target, CAST(whole * size + least(greatest(budget - earlier, 0), size) AS BIGINT) AS taken,
       whole, CAST(least(greatest(budget - earlier, 0), size) AS BIGINT) AS part
FROM ordered
"""
