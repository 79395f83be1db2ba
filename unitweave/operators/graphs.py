"""n-gram graphs with backoff, their composition with lattices, best paths and seeded samples of paths.

States are histories of up to order - 1 tokens, joined by a blank (the empty history is the empty text). A graph is two
tables, arcs (state, token, next, cost) and backoffs (state, via, cost: to each shorter end of the state, itself at 0
included). Composing a lattice with it is an equi join on (state, token), all utterances a step at a time; each step's
edges are stored in a folder of their own. Paths come from the stored edges backwards (the best) or by weights summed
backwards (samples).

Rows: tokens hold no blank; rows with a null are left out; repeated candidates of a step are one, at the least cost; a
lattice that the graph does not lead through has no path. Costs are negative natural logarithms.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitweave.sources.scratch import drop, fresh_path, kept

START, END = "<s>", "</s>"


class Graph(NamedTuple):
    arcs: DataFrame
    backoffs: DataFrame
    start: str


def _shorter(state: Column) -> Column:
    """A history without its first token."""
    return F.regexp_replace(state, r"^[^ ]* ?", "")


def ngram_graph(sequences: DataFrame, order: int = 3, discount: float = 0.5) -> Graph:
    """The graph of sequences (doc, ix, token): a token that followed a history c of n times costs -log((c - discount) / n),
    and the step to the history without its first token -log(discount * t / n) where t different tokens followed. Counts
    of shorter histories are sums of those of longer ones; the empty history has no discount."""
    tokens = sequences.select("doc", "ix", F.col("token").cast("string").alias("token")).where("doc IS NOT NULL AND ix IS NOT NULL AND token IS NOT NULL")
    w = Window.partitionBy("doc").orderBy("ix")
    ends = tokens.groupBy("doc").agg(F.max("ix").alias("ix")).select("doc", (F.col("ix") + 1).alias("ix"), F.lit(END).alias("token"))
    history = F.concat_ws(" ", *(F.lag("token", j, START).over(w) for j in range(order - 1, 0, -1)))
    counts = tokens.unionByName(ends).select(history.alias("state"), "token").groupBy("state", "token").agg(F.count(F.lit(1)).alias("c"))
    counts = kept(counts, "grams")
    arcs = backoffs = None
    made = [counts]
    for n in range(order - 1, -1, -1):
        total = counts.groupBy("state").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("t"))
        after = F.concat_ws(" ", F.when(F.col("state") != "", F.col("state")), "token")
        if n == order - 1 and n:
            after = _shorter(after)
        taken = F.col("c") - (discount if n else 0.0)
        own = counts.join(total, "state").select("state", "token", F.when(F.col("token") == END, F.lit(END)).otherwise(after).alias("next"), (-F.log(taken / F.col("n"))).alias("cost"))
        arcs = own if arcs is None else arcs.unionByName(own)
        if n:
            down = total.select("state", _shorter(F.col("state")).alias("via"), (-F.log(discount * F.col("t") / F.col("n"))).alias("cost"))
            backoffs = down if backoffs is None else backoffs.unionByName(down)
            counts = kept(counts.groupBy(_shorter(F.col("state")).alias("state"), "token").agg(F.sum("c").alias("c")), "grams")
            made.append(counts)
    arcs = kept(arcs, "arcs")
    chain = arcs.select("state").distinct().select("state", F.col("state").alias("via"), F.lit(0.0).alias("cost"))
    if backoffs is not None:
        one = kept(backoffs, "backoffs")
        step = chain
        for _ in range(order - 1):
            step = step.join(one.select(F.col("state").alias("via"), F.col("via").alias("_v"), F.col("cost").alias("_c")), "via").select("state", F.col("_v").alias("via"), (F.col("cost") + F.col("_c")).alias("cost"))
            chain = chain.unionByName(step)
    chain = kept(chain, "chains")
    drop(*made)
    return Graph(arcs, chain, " ".join([START] * (order - 1)))


class Composed(NamedTuple):
    """edges (utt, step, state, unit_id, next, best, weight): best is the least cost of an edge's ways through shorter
    histories, weight the logarithm of the sum of exp(-cost); the last step's edges lead to the end."""

    edges: DataFrame
    last: DataFrame
    steps: int


def composed(graph: Graph, lattice: DataFrame) -> Composed:
    """The lattice (utt, step, unit_id, token, tcost), steps from 0 on, through the graph: a table of edges. After an
    utterance's last step an edge without a unit leads to the end."""
    spark = lattice.sparkSession
    rows = lattice.where("utt IS NOT NULL AND step IS NOT NULL AND unit_id IS NOT NULL AND token IS NOT NULL AND tcost IS NOT NULL")
    rows = rows.groupBy("utt", F.col("step").cast("long").alias("step"), "unit_id", F.col("token").cast("string").alias("token")).agg(F.min("tcost").alias("tcost"))
    rows = kept(rows.select("utt", "step", "unit_id", "token", F.col("tcost").cast("double").alias("tcost")), "candidates")
    last = kept(rows.groupBy("utt").agg((F.max("step") + 1).alias("last")), "lengths")
    steps = last.agg(F.max("last")).first()[0]
    if steps is None:
        raise ValueError("an empty lattice")
    ends = last.select("utt", F.col("last").alias("step"), F.lit(None).cast(rows.schema["unit_id"].dataType).alias("unit_id"), F.lit(END).alias("token"), F.lit(0.0).alias("tcost"))
    path = fresh_path(spark, "edges")
    now = last.select("utt", F.lit(graph.start).alias("state"))
    ways = graph.backoffs.withColumnRenamed("cost", "down")
    arcs = graph.arcs.select(F.col("state").alias("via"), "token", "next", "cost")
    for k in range(steps + 1):
        here = rows.unionByName(ends).where(F.col("step") == k).drop("step")
        open_ = now.join(ways, "state").join(here, "utt").join(arcs, ["via", "token"])
        cost = F.col("down") + F.col("cost") + F.col("tcost")
        summed = open_.groupBy("utt", "state", "unit_id", "next").agg(F.min(cost).alias("best"), F.log(F.sum(F.exp(-cost))).alias("weight"))
        summed.write.parquet(f"{path}/step={k}")
        edges = spark.read.schema(summed.schema).parquet(f"{path}/step={k}")
        now = edges.where(F.col("next") != END).select("utt", F.col("next").alias("state")).distinct()
    drop(rows)
    return Composed(spark.read.schema(T.StructType([*summed.schema, T.StructField("step", T.LongType())])).parquet(path), last, steps + 1)


def best_paths(lattice: Composed) -> DataFrame:
    """(utt, step, unit_id, total): the least path of each utterance; of equal ones that of the lesser unit and history,
    from the end."""
    values, reached = {}, None
    for k in range(lattice.steps):
        edges = lattice.edges.where(F.col("step") == k)
        if reached is None:
            total = edges.withColumn("total", F.col("best"))
        else:
            total = edges.join(reached.select("utt", F.col("next").alias("state"), F.col("total").alias("_t")), ["utt", "state"]).withColumn("total", F.col("_t") + F.col("best"))
        order = F.struct("total", "unit_id", "state")
        reached = values[k] = kept(total.groupBy("utt", "next").agg(F.min(order).alias("m")).select("utt", "next", "m.total", "m.unit_id", "m.state"), "reached")
    out, at = None, None
    for k in reversed(range(lattice.steps)):
        here = values[k].where(F.col("next") == END).select("utt", "state", "unit_id", "total")
        if at is not None:
            on = values[k].select("utt", F.col("next").alias("_at"), "state", "unit_id")
            here = here.unionByName(at.select("utt", F.col("state").alias("_at"), "total").join(on, ["utt", "_at"]).select("utt", "state", "unit_id", "total"))
        at = kept(here, "path")
        own = at.where("unit_id IS NOT NULL").select("utt", F.lit(k).cast("long").alias("step"), "unit_id", "total")
        out = own if out is None else out.unionByName(own)
    drop(*values.values())
    return out


def sampled_paths(lattice: Composed, n: int = 1, seed: int = 1234) -> DataFrame:
    """(utt, sample, step, unit_id): ``n`` paths of each utterance, each drawn with a probability in proportion to the
    product of its weights: weights are summed from the end, and an edge is drawn with its share of what can follow."""
    ahead, tables = None, []
    for k in reversed(range(lattice.steps)):
        edges = lattice.edges.where(F.col("step") == k)
        rest = F.lit(0.0) if ahead is None else F.when(F.col("next") == END, F.lit(0.0)).otherwise(F.col("_rest"))
        if ahead is not None:
            edges = edges.join(ahead.select("utt", F.col("state").alias("next"), F.col("all").alias("_rest")), ["utt", "next"], "left")
        weighed = kept(edges.withColumn("w", F.col("weight") + rest).where("w IS NOT NULL").where((F.col("next") == END) | F.lit(ahead is not None)).select("utt", "state", "unit_id", "next", "w"), "weights")
        tables.append(weighed)
        # The greatest weight is taken out, so that sums of small ones keep their digits.
        top = weighed.withColumn("top", F.max("w").over(Window.partitionBy("utt", "state")))
        ahead = top.groupBy("utt", "state").agg(F.max("top").alias("top"), F.sum(F.exp(F.col("w") - F.col("top"))).alias("s")).select("utt", "state", (F.col("top") + F.log("s")).alias("all"))
    tables.reverse()
    at, out = None, None
    for k, weighed in enumerate(tables):
        if at is None:
            at = weighed.select("utt", "state").distinct().select("utt", "state", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("sample"))
        # Only the edges of the states that samples are in are shared out.
        met = at.join(weighed, ["utt", "state"])
        mine = Window.partitionBy("utt", "sample")
        share = F.exp(F.col("w") - F.max("w").over(mine))
        until = F.sum("share").over(mine.orderBy(F.col("unit_id").asc_nulls_first(), "next"))
        shares = met.withColumn("share", share).withColumn("until", until).withColumn("of", F.sum("share").over(mine))
        draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("utt").cast("string"), F.col("sample").cast("string"), F.lit(str(k))).cast("binary")), 1, 8), 16, 10).cast("long") / float(1 << 32)
        taken = shares.where(F.col("until") > draw * F.col("of"))
        chosen = kept(taken.groupBy("utt", "sample").agg(F.min(F.struct("until", "unit_id", "next")).alias("m")).select("utt", "sample", "m.unit_id", F.col("m.next").alias("state")), "drawn")
        own = chosen.where("unit_id IS NOT NULL").select("utt", "sample", F.lit(k).cast("long").alias("step"), "unit_id")
        out = own if out is None else out.unionByName(own)
        at = chosen.where(F.col("state") != END).drop("unit_id")
    drop(*tables)
    return out
