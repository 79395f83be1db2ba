"""Connected components of large graphs, by alternating large-star and small-star steps.

Nothing is collected: a step is an aggregation (with map-side minima, so that a hub is no hot key) and a join that
adaptive execution can split. Each round's edges are written to the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.scratch import release, stored

MAX_ROUNDS = 60


def _with_min(edges: DataFrame, *more) -> DataFrame:
    """Rows (u, v) with m, the least of u's neighbours."""
    least = edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
    return edges.join(least, F.col("u") == F.col("w")).drop("w")


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: two columns of ids, in any direction, repeats and loops allowed; nulls are left out. Returns a stored
    table (id, component) with the least id of each component; ids without an edge to another one are not in it."""
    a, b = edges.columns
    kind = edges.schema[a].dataType
    pairs = edges.select(F.greatest(a, b).cast(kind).alias("u"), F.least(a, b).cast(kind).alias("v")).where("u <> v").distinct()
    now, seen = stored(pairs, "edges"), None
    for _ in range(MAX_ROUNDS):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: the larger neighbours of u move to the least of u and its neighbours.
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        # Small star: u and its smaller neighbours move to the least of these.
        small = _with_min(large)
        small = small.select("u", F.col("m").alias("v")).unionAll(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        new = stored(small, "edges")
        release(now)
        now = new
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        seen = mark
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stored(stars.unionAll(stars.select(F.col("component").alias("id"), "component")).distinct(), "components")
