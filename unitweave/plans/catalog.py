"""Registered queries of the engine over the driver's tables, and what they return in DuckDB's SQL.

The tables stand for speech data: embeddings for units (label: phone), events for F0 tracks (user: utterance, value:
F0, at most 5: unvoiced), lineitem for frames of four streams, orders and customer for utterance lists, part for unit
names of three levels, documents and conversations for token and state sequences. Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from unitweave.functions import scalars, vectors
from unitweave.operators import assemble, diagnostics, features, joins, knn, search, select, series

STREAMS = (("mag", 24), ("real", 20), ("imag", 19), ("lf0", 1))
DIM = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "embeddings").select("vec_id", vectors.as_doubles(F.col("embedding")).alias("v"), "label")


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt, ix, f0): F0 tracks; values up to 5 are unvoiced, written as 0."""
    e = _t(spark, sf_dir, "events").select(F.col("user_id").alias("utt"), "ts", "event_id", F.when(F.col("value") > 5, F.col("value")).otherwise(0.0).alias("f0"))
    return series.indexed(e, "utt", "ts", "event_id").select("utt", "ix", "f0")


def _r(c: Column, digits: int = 6) -> Column:
    return F.round(c, digits)


_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_TR = "t AS (SELECT user_id AS utt, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ix, CASE WHEN value > 5 THEN value ELSE 0.0 END AS f0 FROM events)"
_LAYOUT = "layout(stream, a, n) AS (VALUES ('mag', 0, 24), ('real', 24, 20), ('imag', 44, 19), ('lf0', 63, 1))"


# --- statistics and standardising -------------------------------------------------------------------------------


@_query(f"WITH {_E}, {_LAYOUT}, x AS (SELECT stream, d, v[a + d + 1] AS x FROM e, layout, unnest(range(n)) AS u(d)), s AS (SELECT stream, CAST(d AS INTEGER) AS d, avg(x) AS mean, stddev_pop(x) AS own FROM x GROUP BY ALL) SELECT stream, d, round(mean, 6) AS mean, round(max(own) OVER (PARTITION BY stream), 6) AS std FROM s")
def stream_mean_std(spark, d):
    s = features.stream_statistics(_vectors(spark, d), "v", STREAMS)
    return s.select("stream", "d", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"))


@_query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events WHERE value > 5 GROUP BY event_type")
def voiced_mean_std(spark, d):
    e = _t(spark, d, "events").where("value > 5")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("value")).alias("mean"), _r(F.stddev_pop("value")).alias("std"))


@_query(f"WITH {_E}, {_LAYOUT}, x AS (SELECT vec_id, stream, a + d AS d, v[a + d + 1] AS x FROM e, layout, unnest(range(n)) AS u(d)), s AS (SELECT stream, d, avg(x) AS mean, stddev_pop(x) AS own FROM x GROUP BY ALL), m AS (SELECT d, mean, max(own) OVER (PARTITION BY stream) AS std FROM s) SELECT vec_id, CAST(x.d AS INTEGER) AS d, round((x - mean) / std, 6) AS z FROM x JOIN m ON x.d = m.d")
def standardise_vectors(spark, d):
    e = _vectors(spark, d)
    mean, std = features.statistics_vectors(features.stream_statistics(e, "v", STREAMS), [s for s, _ in STREAMS])
    z = vectors.standardised(F.col("v"), vectors.literal(mean), vectors.literal(std))
    return e.select("vec_id", F.posexplode(z).alias("d", "z")).select("vec_id", "d", _r(F.col("z")).alias("z"))


@_query(f"WITH {_TR}, s AS (SELECT avg(f0) AS m, stddev_pop(f0) AS s FROM t WHERE f0 > 0) SELECT utt, ix, round(CASE WHEN f0 <= 0 THEN -20 * s ELSE (f0 - m) / s END, 6) AS z FROM t, s")
def uv_sentinel(spark, d):
    t = _tracks(spark, d)
    m = t.where("f0 > 0").agg(F.avg("f0").alias("m"), F.stddev_pop("f0").alias("s")).first()
    z = vectors.standardised(F.array(vectors.unvoiced_marked(F.col("f0"))), vectors.literal([m.m]), vectors.literal([m.s]))
    return t.select("utt", "ix", _r(z[0]).alias("z"))


@_query(f"WITH {_E}, w AS (SELECT list_transform(range(64), lambda i: CASE WHEN i < 24 THEN 0.5 WHEN i < 44 THEN 1.0 WHEN i < 63 THEN 2.0 ELSE 4.0 END::DOUBLE) AS w), x AS (SELECT vec_id, label, list_transform(range(1, 65), lambda i: v[i] * w[i]) AS v FROM e, w) SELECT a.vec_id, round(list_distance(a.v, b.v), 6) AS cost FROM x a JOIN x b ON b.vec_id = a.vec_id + 1")
def weighted_distance(spark, d):
    w = vectors.literal(vectors.expanded_weights((0.5, 1.0, 2.0, 4.0), [n for _, n in STREAMS]))
    e = _vectors(spark, d).select("vec_id", vectors.weighted(F.col("v"), w).alias("v"))
    return joins.successors(e, "vec_id", "v").select(F.col("from_id").alias("vec_id"), _r(vectors.distance(F.col("from_v"), F.col("to_v"))).alias("cost"))


@_query(f"WITH {_E}, x AS (SELECT vec_id, list_concat(list_concat(v[1:10], v[45:46]), v[64:64]) AS y FROM e) SELECT vec_id, CAST(i - 1 AS INTEGER) AS d, round(y[i], 6) AS x FROM x, unnest(range(1, 14)) AS u(i)")
def truncate_streams(spark, d):
    y = vectors.truncated(F.col("v"), [n for _, n in STREAMS], (10, 0, 2, -1))
    return _vectors(spark, d).select("vec_id", F.posexplode(y).alias("d", "x")).select("vec_id", "d", _r(F.col("x")).alias("x"))


@_query("SELECT l_orderkey, round(avg(CASE WHEN l_discount > 0 THEN l_discount END), 6) AS mean FROM lineitem GROUP BY l_orderkey HAVING avg(CASE WHEN l_discount > 0 THEN l_discount END) IS NOT NULL UNION ALL SELECT l_orderkey, 0.0 FROM lineitem GROUP BY l_orderkey HAVING avg(CASE WHEN l_discount > 0 THEN l_discount END) IS NULL")
def nonzero_mean(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_orderkey").agg(_r(diagnostics.positive_mean(F.col("l_discount"))).alias("mean"))


@_query(f"WITH {_E} SELECT label, round(avg(sqrt(list_sum(list_transform(v, lambda x: x * x)) / 64)), 9) AS rms FROM e GROUP BY label")
def frame_rms(spark, d):
    return _vectors(spark, d).groupBy("label").agg(_r(F.avg(diagnostics.rms(F.col("v"))), 9).alias("rms"))


# --- choosing rows ----------------------------------------------------------------------------------------------


@_query("WITH l AS (SELECT c_name FROM customer ORDER BY c_name LIMIT 100) SELECT c_name FROM l WHERE NOT contains(c_name, '7') AND NOT contains(c_name, '05') AND c_name IN (SELECT c_name FROM customer WHERE c_acctbal > 0)")
def utt_select_limit_then_exclude(spark, d):
    c = _t(spark, d, "customer")
    return select.training_set(c.select("c_name"), "c_name", 100, ["7", "05"], c.where("c_acctbal > 0").select("c_name"))


@_query("SELECT c_custkey FROM customer WHERE (contains(c_mktsegment, 'BUILD') OR contains(c_mktsegment, 'AUTO')) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NOT NULL)")
def test_set(spark, d):
    c = _t(spark, d, "customer")
    trained = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    marked = c.select("c_custkey", F.concat_ws("/", "c_mktsegment", F.col("c_custkey").cast("string")).alias("name"))
    named = marked.join(trained.distinct(), "c_custkey", "left_semi").select("name")
    return select.test_set(marked, "name", ["BUILD", "AUTO"], named).select("c_custkey")


@_query("SELECT user_id FROM events GROUP BY user_id HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def common_utts(spark, d):
    return select.common_to_all(_t(spark, d, "events"), "user_id", "event_type")


@_query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS rank FROM orders), n AS (SELECT greatest(1, count(*) // 100) AS step FROM orders) SELECT o_orderkey FROM r, n WHERE rank % step = 0")
def evenly_spaced(spark, d):
    return select.evenly_spaced(_t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 100, "o_totalprice", "o_orderkey").select("o_orderkey")


@_query("SELECT vec_id FROM embeddings WHERE vec_id >= (SELECT count(*) - CAST(floor(count(*) * 10 / 100) AS BIGINT) FROM embeddings)")
def holdout_units(spark, d):
    return select.holdout(_t(spark, d, "embeddings").select("vec_id"), "vec_id", 10)[1]


@_query("SELECT c_mktsegment AS name FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY 1 UNION SELECT o_orderpriority FROM orders GROUP BY 1")
def distinct_union(spark, d):
    return _t(spark, d, "customer").select(F.col("c_mktsegment").alias("name")).union(_t(spark, d, "orders").select("o_orderpriority")).where("name IS NOT NULL").distinct()


# --- composing and joining --------------------------------------------------------------------------------------

_FRAMES = "f AS (SELECT l_orderkey AS utt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS frame, l_quantity AS q, l_extendedprice AS p, l_discount AS dc, l_tax AS x FROM lineitem)"


#: Rows of frames that one task sorts and composes.
TASK_ROWS = 250_000


def _frames(spark, d) -> DataFrame:
    """(utt, frame, q, p, dc, x), dealt by utterance to partitions that grow in number with the rows and not in size."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity", "l_discount", "l_tax"]
    lines = _t(spark, d, "lineitem")
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // TASK_ROWS))
    rows = series.indexed(lines.repartition(parts, "l_orderkey"), "l_orderkey", order[0], *order[1:], name="frame")
    return rows.select(F.col("l_orderkey").alias("utt"), "frame", F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("dc"), F.col("l_tax").alias("x"))


@_query(f"WITH {_FRAMES} SELECT utt, frame, q, p, CASE WHEN dc <= 0 THEN -1000.0 ELSE dc END AS f0, x FROM f")
def compose_streams(spark, d):
    f = _frames(spark, d)
    parts = F.array(*(F.struct(F.lit(s).alias("stream"), F.array(c).alias("v")) for s, c in (("mag", "q"), ("real", "p"), ("f0", "dc"), ("imag", "x"))))
    streams = f.select("utt", "frame", F.explode(parts).alias("s")).select("utt", "frame", "s.stream", "s.v")
    v = features.composed(streams, ["mag", "real", "f0", "imag"])
    return v.select("utt", "frame", *(F.col("v")[i].alias(n) for i, n in enumerate(("q", "p", "f0", "x"))))


@_query(f"WITH {_FRAMES} SELECT utt, frame, q FROM (SELECT *, max(frame) OVER (PARTITION BY utt) AS last FROM f) WHERE frame > 0 AND frame < last")
def inner_frames(spark, d):
    return features.inner_frames(_frames(spark, d), "utt", "frame").select("utt", "frame", "q")


@_query(
    "WITH m AS (SELECT user_id, epoch_us(ts) AS t, min(event_id) AS id FROM events WHERE value <= 5 GROUP BY ALL), p AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events WHERE value > 5),"
    " j AS (SELECT event_id, id, row_number() OVER (PARTITION BY event_id ORDER BY abs(p.t - m.t), m.t) AS r FROM p LEFT JOIN m ON p.user_id = m.user_id) SELECT event_id, id AS near_id FROM j WHERE r = 1"
)
def asof_nearest_pitchmark(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    marks = e.where("value <= 5").select("user_id", "t", F.col("event_id").alias("id"))
    return joins.nearest(e.where("value > 5").select("event_id", "user_id", "t"), marks, "user_id", "t", ["id"]).select("event_id", "near_id")


@_query(
    "WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) SELECT event_id, o.o_orderkey FROM events e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate"
)
def interval_state_join(spark, d):
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("at")).agg(F.max("o_orderkey").alias("o_orderkey"))
    e = _t(spark, d, "events").select("event_id", "user_id", "ts")
    return joins.interval_joined(e, o, "user_id", "ts", "at", ["o_orderkey"]).select("event_id", "o_orderkey")


@_query(f"WITH {_E}, p AS (SELECT a.vec_id AS q, b.vec_id AS u, list_distance(a.v, b.v) AS x, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id) SELECT q, CAST(r AS INTEGER) AS rank, u, round(x * x, 6) AS dist2 FROM p WHERE r <= 5")
def knn_exact(spark, d):
    e = _vectors(spark, d)
    units = e.select(F.col("vec_id").alias("u"), "v")
    out = knn.k_nearest(e.select(F.col("vec_id").alias("q"), "v"), units, 5, exclude_self=True, index=knn.build(units, copies=6))
    return out.select("q", "rank", "u", _r(F.col("dist2")).alias("dist2"))


@_query(f"WITH {_E}, p AS (SELECT a.vec_id AS q, b.vec_id AS u, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT q, CAST(r AS INTEGER) AS rank, u FROM p WHERE r <= 3")
def knn_by_class(spark, d):
    e = _vectors(spark, d)
    units = e.select(F.col("vec_id").alias("u"), "v", "label")
    return knn.k_nearest(e.select(F.col("vec_id").alias("q"), "v", "label"), units, 3, by="label", exclude_self=True, index=knn.build(units, "label", 4)).select("q", "rank", "u")


@_query(f"WITH {_E} SELECT a.vec_id AS q, count(*) FILTER (WHERE a.vec_id <> b.vec_id AND list_distance(a.v, b.v) <= 1.2) AS n FROM e a, e b GROUP BY a.vec_id")
def radius_counts(spark, d):
    e = _vectors(spark, d)
    return knn.radius_counts(e.select(F.col("vec_id").alias("q"), "v"), e.select(F.col("vec_id").alias("u"), "v"), 1.2, exclude_self=True)


@_query(
    "WITH m AS (SELECT t.p_partkey AS target, u.p_partkey AS unit_id, CASE WHEN t.p_name = u.p_name THEN 0 WHEN t.p_brand = u.p_brand THEN 1 ELSE 2 END AS level FROM part t JOIN part u ON t.p_name = u.p_name OR t.p_brand = u.p_brand OR t.p_type = u.p_type),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY level, unit_id) AS rank FROM m) SELECT target, CAST(rank AS INTEGER) AS rank, unit_id, level FROM r WHERE rank <= 5"
)
def backoff_lookup(spark, d):
    p = _t(spark, d, "part")
    targets = p.select(F.col("p_partkey").alias("target"), "p_name", "p_brand", "p_type")
    units = p.select(F.col("p_partkey").alias("unit_id"), "p_name", "p_brand", "p_type")
    return joins.backoff(targets, units, "target", [(F.col(c), F.col(c)) for c in ("p_name", "p_brand", "p_type")], "unit_id", 5)


@_query(f"WITH {_E} SELECT a.vec_id AS from_id, b.vec_id AS to_id, a.label = b.label AS same FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def natural_successor(spark, d):
    return joins.successors(_vectors(spark, d), "vec_id", "label").select("from_id", "to_id", (F.col("from_label") == F.col("to_label")).alias("same"))


_HALVES = "u AS (SELECT vec_id AS unit_id, label AS phone, CASE WHEN vec_id % 2 = 0 THEN 'L' ELSE 'R' END AS half FROM embeddings)"


def _halves(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("label").alias("phone"), F.when(F.col("vec_id") % 2 == 0, F.lit("L")).otherwise(F.lit("R")).alias("half"))


@_query(f"WITH {_HALVES}, w AS (SELECT a.unit_id, b.unit_id AS natural, CASE WHEN a.half = 'L' THEN a.phone ELSE b.phone END AS phone, CASE WHEN a.half = 'L' THEN 'R' ELSE 'L' END AS half FROM u a LEFT JOIN u b ON b.unit_id = a.unit_id + 1) SELECT w.unit_id AS from_id, w.natural, count(c.unit_id) AS n_candidates FROM w LEFT JOIN u c ON c.phone = w.phone AND c.half = w.half GROUP BY ALL")
def transition_table(spark, d):
    return joins.transitions(_halves(spark, d))


@_query("SELECT s_suppkey, coalesce(n_name, 'none') AS nation FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <= 2")
def lookup_with_default(spark, d):
    n = _t(spark, d, "nation").where("n_regionkey <= 2").select("n_nationkey", "n_name")
    return _t(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", F.coalesce("n_name", F.lit("none")).alias("nation"))


# --- series -----------------------------------------------------------------------------------------------------


@_query(f"WITH {_TR}, w AS (SELECT utt, ix, list(f0) OVER (PARTITION BY utt ORDER BY ix ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS x FROM t) SELECT utt, ix // 4 AS segment, CAST(i - 1 AS INTEGER) AS i, round(x[i], 6) AS x FROM w, unnest(range(1, 9)) AS u(i) WHERE ix % 4 = 0 AND len(x) = 8")
def segment_windows(spark, d):
    s = series.segmented(_tracks(spark, d), "utt", "ix", "f0", 8, 4)
    return s.select("utt", "segment", F.posexplode("values").alias("i", "x")).select("utt", "segment", "i", _r(F.col("x")).alias("x"))


@_query(f"WITH {_TR}, w AS (SELECT utt, ix, count(*) OVER (PARTITION BY utt) AS n, list(f0) OVER (PARTITION BY utt ORDER BY ix ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS x FROM t) SELECT utt, ix // 5 AS segment, round(list_sum(x), 6) AS total, 8 - len(x) AS padded FROM w WHERE ix % 5 = 0 AND (ix = 0 OR ix + 3 < n)")
def segment_windows_padded(spark, d):
    s = series.segmented(_tracks(spark, d), "utt", "ix", "f0", 8, 3, end="pad", end_value=-1.0)
    missing = F.size(F.filter("values", lambda x: x < 0)).cast("long")
    return s.select("utt", "segment", _r(vectors.total(F.col("values")) + missing).alias("total"), missing.alias("padded"))


@_query(f"WITH {_E}, x AS (SELECT vec_id, v, lead(v, 1) OVER w AS b, lead(v, 2) OVER w AS c, lag(v) OVER w AS p FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT vec_id, round(list_distance(v, c), 6) AS across, round(list_distance(coalesce(p, v), v), 6) AS before FROM x WHERE c IS NOT NULL")
def multiepoch_units(spark, d):
    e = features.join_contexts(_vectors(spark, d), "vec_id", "v", "label")
    u = features.unit_windows(e.select("vec_id", "label", "v", "start", F.col("v").alias("own")), "label", "vec_id", "v", 3)
    return u.select("vec_id", _r(vectors.distance(F.col("own"), vectors.stream_slice(F.col("v"), 2 * DIM, DIM))).alias("across"), _r(vectors.distance(F.col("start"), F.col("own"))).alias("before"))


_GAPS = _TR + (
    ", a AS (SELECT *, f0 > 0 AS voiced, max(CASE WHEN f0 > 0 THEN ix END) OVER (PARTITION BY utt ORDER BY ix) AS p, min(CASE WHEN f0 > 0 THEN ix END) OVER (PARTITION BY utt ORDER BY ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM t),"
    " k AS (SELECT utt, list(ix ORDER BY ix) AS xs FROM t WHERE f0 > 0 GROUP BY utt),"
    " b AS (SELECT a.utt, a.ix, a.f0, a.voiced, CASE WHEN p IS NULL THEN xs[1] WHEN n IS NULL THEN xs[len(xs) - 1] ELSE p END AS x1, CASE WHEN p IS NULL THEN xs[2] WHEN n IS NULL THEN xs[len(xs)] ELSE n END AS x2, p, n, xs FROM a LEFT JOIN k USING (utt)),"
    " c AS (SELECT b.*, t1.f0 AS y1, t2.f0 AS y2 FROM b LEFT JOIN t t1 ON t1.utt = b.utt AND t1.ix = b.x1 LEFT JOIN t t2 ON t2.utt = b.utt AND t2.ix = b.x2)"
)


@_query(f"WITH {_GAPS} SELECT utt, ix, round(CASE WHEN voiced OR xs IS NULL THEN f0 WHEN y2 IS NULL THEN coalesce(y1, f0) ELSE y1 + (y2 - y1) / (x2 - x1) * (ix - x1) END, 6) AS f0, CAST(voiced AS INTEGER) AS vuv FROM c")
def gap_fill_linear(spark, d):
    return series.gap_filled(_tracks(spark, d), "utt", "ix", "f0").select("utt", "ix", _r(F.col("filled")).alias("f0"), "vuv")


@_query(f"WITH {_GAPS} SELECT utt, ix, round(CASE WHEN voiced OR xs IS NULL THEN f0 WHEN p IS NULL THEN y1 WHEN n IS NULL THEN y2 ELSE y1 + (y2 - y1) / (x2 - x1) * (ix - x1) END, 6) AS f0, CAST(voiced AS INTEGER) AS vuv FROM c")
def gap_fill_hold(spark, d):
    return series.gap_filled(_tracks(spark, d), "utt", "ix", "f0", ends="hold").select("utt", "ix", _r(F.col("filled")).alias("f0"), "vuv")


@_query(f"WITH {_TR}, s AS (SELECT *, first_value(f0) OVER (PARTITION BY utt ORDER BY ix) AS a, last_value(f0) OVER (PARTITION BY utt ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM t) SELECT utt, ix, round((0.5 * coalesce(lag(f0) OVER w, a) + f0 + 0.5 * coalesce(lead(f0) OVER w, z)) / 2, 6) AS smooth FROM s WINDOW w AS (PARTITION BY utt ORDER BY ix)")
def hann_smooth(spark, d):
    return series.smoothed(_tracks(spark, d), "utt", "ix", "f0", vectors.hann(5)).select("utt", "ix", _r(F.col("smooth")).alias("smooth"))


@_query(f"WITH {_TR}, m AS (SELECT utt, ix, f0, sum(f0) OVER (PARTITION BY utt ORDER BY ix) AS mark FROM t) SELECT utt, ix, round(mark, 4) AS mark, round(mark - coalesce(lag(mark) OVER (PARTITION BY utt ORDER BY ix), 0), 4) AS shift FROM m")
def cumsum_and_diff(spark, d):
    m = series.differenced(series.cumulated(_tracks(spark, d), "utt", "ix", "f0"), "utt", "ix", "mark")
    return m.select("utt", "ix", _r(F.col("mark"), 4).alias("mark"), _r(F.col("shift"), 4).alias("shift"))


@_query("SELECT user_id, NOT bool_or(coalesce(fall, false)) AS monotonic FROM (SELECT user_id, value < lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS fall FROM events) GROUP BY user_id")
def monotonic_tracks(spark, d):
    e = series.indexed(_t(spark, d, "events"), "user_id", "ts", "event_id")
    return series.monotonic(e, "user_id", "ix", "value")


@_query(f"WITH {_TR} SELECT utt, ix, round((f0 - avg(f0) OVER (PARTITION BY utt)) * 1.5 + avg(f0) OVER (PARTITION BY utt), 9) AS scaled FROM t")
def variance_scale(spark, d):
    return series.variance_scaled(_tracks(spark, d), "utt", "f0", 1.5).select("utt", "ix", _r(F.col("scaled"), 9).alias("scaled"))


@_query(f"WITH {_TR}, w AS (SELECT utt, ix, list(f0) OVER (PARTITION BY utt ORDER BY ix ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS x FROM t) SELECT utt, ix, round(list_sort(list_concat(x, list_transform(range(5 - len(x)), lambda i: 0.0::DOUBLE)))[3], 6) AS median FROM w")
def median_filter(spark, d):
    return series.median_filtered(_tracks(spark, d), "utt", "ix", "f0", 5).select("utt", "ix", _r(F.col("median")).alias("median"))


@_query(f"WITH {_TR}, g AS (SELECT utt, ix, f0 > 0 AS voiced, ix - row_number() OVER (PARTITION BY utt, f0 > 0 ORDER BY ix) AS g FROM t), r AS (SELECT utt, voiced, min(ix) AS start, count(*) AS length FROM g GROUP BY utt, voiced, g) SELECT utt, row_number() OVER (PARTITION BY utt ORDER BY start) AS run, voiced, start, length FROM r")
def voicing_runs(spark, d):
    t = _tracks(spark, d).withColumn("voiced", F.col("f0") > 0)
    r = series.runs(t, "utt", "ix", "voiced")
    return r.select("utt", F.col("run").cast("long").alias("run"), "voiced", "start", "length")


@_query(f"WITH {_TR}, g AS (SELECT utt, unnest(range(2 * count(*) - 1)) AS k FROM t GROUP BY utt) SELECT g.utt, k, round(CASE WHEN k % 2 = 0 THEN a.f0 ELSE (a.f0 + b.f0) / 2 END, 6) AS f0 FROM g JOIN t a ON a.utt = g.utt AND a.ix = k // 2 LEFT JOIN t b ON b.utt = g.utt AND b.ix = k // 2 + 1")
def resample_linear(spark, d):
    t = _tracks(spark, d).withColumn("x", F.col("ix").cast("double"))
    grid = t.groupBy("utt").agg(F.count(F.lit(1)).alias("n")).select("utt", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("n") - 2)).alias("k"))
    out = series.resampled(t, grid.select("utt", (F.col("k") / 2).alias("x")), "utt", "x", "f0")
    return out.select("utt", (F.col("x") * 2).cast("long").alias("k"), _r(F.col("f0")).alias("f0"))


@_query(f"WITH {_TR} SELECT utt, round(sum(CASE WHEN f0 <= 0 THEN 5.0 WHEN ix > 0 THEN 1000 / f0 ELSE 0 END), 6) AS ms FROM t GROUP BY utt")
def voiced_duration(spark, d):
    return diagnostics.voiced_duration(_tracks(spark, d), "utt", "ix", "f0").select("utt", _r(F.col("ms")).alias("ms"))


@_query("SELECT user_id, CAST(least(floor(value / 10), 9) AS BIGINT) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 100 GROUP BY ALL")
def histogram(spark, d):
    return diagnostics.histogram(_t(spark, d, "events"), "value", 10, 0.0, 100.0, "user_id")


@_query("WITH s AS (SELECT event_type, avg(value) AS mean, greatest(stddev_pop(value), 0.001) AS std FROM events WHERE event_type <> 'click' GROUP BY event_type) SELECT event_id, round((value - coalesce(mean, 5.0)) / coalesce(std, 5.0), 6) AS norm FROM events LEFT JOIN s USING (event_type)")
def duration_stats(spark, d):
    e = _t(spark, d, "events")
    s = features.duration_statistics(e.where("event_type <> 'click'"), "event_type", "value")
    return features.normalised_durations(e, s, "event_type", "value").select("event_id", _r(F.col("norm")).alias("norm"))


@_query("SELECT event_id, round(sign(value / 1000) * ln(1 + 255 * abs(value / 1000)) / ln(256), 9) AS mu, round(20 * log10(value + 1), 9) AS db, CASE WHEN value <= 5 THEN -1e10 ELSE round(ln(value), 9) END AS lf0, CAST(pow(2, ceil(log2(value + 1))) AS BIGINT) AS fft FROM events")
def scalar_functions(spark, d):
    v = F.col("value")
    return _t(spark, d, "events").select("event_id", _r(scalars.mu_law(v / 1000), 9).alias("mu"), _r(scalars.decibels(v + 1), 9).alias("db"), F.when(v <= 5, F.lit(vectors.LOG_FLOOR)).otherwise(_r(scalars.protected_log(v), 9)).alias("lf0"), scalars.next_power_of_two(v + 1).alias("fft"))


@_query("SELECT conv_id AS utt, CAST(turn // 5 AS INTEGER) AS phone_ix, min(turn) AS start, max(turn) + 1 AS end, arg_min(role, turn) AS label FROM conversations GROUP BY ALL")
def label_merge(spark, d):
    from unitweave.functions.labels import phone_labels

    c = _t(spark, d, "conversations").select(F.col("conv_id").alias("utt"), F.col("turn").alias("seq"), F.col("turn").alias("start"), (F.col("turn") + 1).alias("end"), F.col("role").alias("label"))
    return phone_labels(c)


@_query(
    f"WITH {_E}, p AS (SELECT a.vec_id AS start_id, b.vec_id AS end_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v[1:24], b.v[41:64]), b.vec_id) AS r, list_distance(a.v[1:24], b.v[41:64]) AS x FROM e a, e b),"
    " n AS (SELECT a.vec_id AS end_id, count(*) FILTER (WHERE list_distance(a.v[41:64], b.v[1:24]) <= 0.9) AS n_starts FROM e a, e b GROUP BY a.vec_id)"
    " SELECT start_id, CAST(r AS INTEGER) AS rank, end_id, round(x * x, 6) AS dist2, n_starts FROM p JOIN n USING (end_id) WHERE r <= 4"
)
def starts_to_ends(spark, d):
    """The unit ends that are nearest to each unit's start, with the starts that are near each of these ends: two
    searches, of which the second reads an index that was stored before."""
    from unitweave.sources.scratch import fresh_path

    e = _vectors(spark, d)
    starts = e.select("vec_id", vectors.stream_slice(F.col("v"), 0, 24).alias("v"))
    ends = e.select("vec_id", vectors.stream_slice(F.col("v"), 40, 24).alias("v"))
    units, at = ends.withColumnRenamed("vec_id", "u"), fresh_path(spark, "starts")
    near = knn.k_nearest(starts.withColumnRenamed("vec_id", "q"), units, 4, index=knn.build(units, copies=4))
    knn.build(starts.withColumnRenamed("vec_id", "u"), copies=1, path=at)
    counts = knn.radius_counts(ends.withColumnRenamed("vec_id", "q"), starts.withColumnRenamed("vec_id", "u"), 0.9, index=knn.read(spark, at))
    out = near.join(counts.select(F.col("q").alias("u"), F.col("n").alias("n_starts")), "u")
    return out.select(F.col("q").alias("start_id"), "rank", F.col("u").alias("end_id"), _r(F.col("dist2")).alias("dist2"), "n_starts")


# --- search, assembly and diagnostics ---------------------------------------------------------------------------

#: Join weight of the search queries, and steps of an utterance.
JOIN_WEIGHT, STEPS = 0.3, 25
_TARGETS = f"{_E}, tg AS (SELECT vec_id // {STEPS} AS utt, vec_id % {STEPS} AS step, list_concat(v[33:64], v[1:32]) AS t FROM e)"


def _targets(spark, d) -> DataFrame:
    """Every vector, its halves exchanged, is a target; utterances are runs of consecutive ids."""
    t = F.concat(vectors.stream_slice(F.col("v"), 32, 32), vectors.stream_slice(F.col("v"), 0, 32))
    return _vectors(spark, d).select(F.floor(F.col("vec_id") / STEPS).alias("utt"), (F.col("vec_id") % STEPS).alias("step"), t.alias("target"))


def _greedy_sql(steps: int) -> str:
    targets = _TARGETS.replace(f"// {STEPS} ", f"// {steps} ").replace(f"% {STEPS} ", f"% {steps} ")
    return (
        f"WITH RECURSIVE {targets}, u AS (SELECT e.vec_id AS id, list_transform(coalesce(p.v, e.v), lambda x: x * {JOIN_WEIGHT}) AS prev, e.v AS t, list_transform(e.v, lambda x: x * {JOIN_WEIGHT}) AS cur FROM e LEFT JOIN e p ON p.vec_id = e.vec_id - 1),"
        " path(utt, step, id, cost) AS (SELECT * FROM (SELECT utt, step, arg_min(u.id, list_sum(list_transform(u.prev, lambda x: x * x)) + pow(list_distance(u.t, tg.t), 2)) AS id, min(list_sum(list_transform(u.prev, lambda x: x * x)) + pow(list_distance(u.t, tg.t), 2)) AS cost FROM tg, u WHERE step = 0 GROUP BY utt, step)"
        " UNION ALL SELECT * FROM (SELECT p.utt, p.step + 1 AS step, arg_min(u.id, pow(list_distance(u.prev, c.cur), 2) + pow(list_distance(u.t, tg.t), 2)) AS id, min(pow(list_distance(u.prev, c.cur), 2) + pow(list_distance(u.t, tg.t), 2)) AS cost FROM path p JOIN tg ON tg.utt = p.utt AND tg.step = p.step + 1 JOIN u c ON c.id = p.id, u GROUP BY p.utt, p.step))"
        " SELECT utt, step, id AS unit_id, round(cost, 6) AS cost FROM path"
    )


def _joint_units(spark, d) -> DataFrame:
    e = _vectors(spark, d)
    scaled = lambda c: F.transform(c, lambda x: x * JOIN_WEIGHT)
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("v").alias("p"))
    return e.join(before, "vec_id", "left").select(F.col("vec_id").alias("unit_id"), scaled(F.coalesce("p", "v")).alias("prev"), F.col("v").alias("target"), scaled(F.col("v")).alias("cur"))


@_query(_greedy_sql(STEPS))
def greedy_search(spark, d):
    """The flagship: greedy joint search of every utterance over all units."""
    return search.greedy_search(_joint_units(spark, d), _targets(spark, d)).select("utt", "step", "unit_id", _r(F.col("cost")).alias("cost"))


def _chunks(spark, d) -> tuple[DataFrame, DataFrame]:
    """Units, and chunks of consecutive ones as targets that begin as their first unit does."""
    units = _joint_units(spark, d)
    first = units.where(F.col("unit_id") % STEPS == 0).select(F.floor(F.col("unit_id") / STEPS).alias("utt"), F.col("prev").alias("begin"))
    targets = units.select(F.floor(F.col("unit_id") / STEPS).alias("utt"), (F.col("unit_id") % STEPS).alias("step"), "target").join(first, "utt")
    return units, targets


@_query(f"SELECT vec_id // {STEPS} AS utt, vec_id % {STEPS} AS step, vec_id AS unit_id, CAST(0 AS DOUBLE) AS cost FROM embeddings")
def natural_resynthesis(spark, d):
    """Chunks of consecutive units, searched for from their own start: the units come back."""
    units, targets = _chunks(spark, d)
    return search.greedy_search(units, targets).select("utt", "step", "unit_id", _r(F.col("cost")).alias("cost"))


_HELD_OUT = (
    _greedy_sql(STEPS).replace("list_concat(v[33:64], v[1:32]) AS t", "v AS t").replace("list_sum(list_transform(u.prev, lambda x: x * x))", "pow(list_distance(u.prev, z.prev), 2)")
    .replace("FROM tg, u WHERE step = 0", f"FROM tg JOIN u z ON z.id = tg.utt * {STEPS}, u WHERE step = 0 AND u.id // {STEPS} <> utt").replace("JOIN u c ON c.id = p.id, u GROUP BY", f"JOIN u c ON c.id = p.id, u WHERE u.id // {STEPS} <> p.utt GROUP BY")
)


@_query(_HELD_OUT)
def held_out_resynthesis(spark, d):
    """The same chunks without their own units."""
    units, targets = _chunks(spark, d)
    own = F.sequence(F.col("utt") * STEPS, F.col("utt") * STEPS + (STEPS - 1))
    return search.greedy_search(units, targets.withColumn("held", own)).select("utt", "step", "unit_id", _r(F.col("cost")).alias("cost"))


@_query("SELECT k AS step, k * 7 AS unit_id FROM (SELECT unnest(range((SELECT count(*) + 6 FROM embeddings) // 7)) AS k)")
def adjacent_units(spark, d):
    """A path of every seventh unit, to check assembly with."""
    return search.every_nth_unit(spark, _vectors(spark, d).count(), 7)


@_query(_greedy_sql(2))
def greedy_in_place(spark, d):
    """The same search of utterances of two steps, over an index of units that stay in place."""
    units = _joint_units(spark, d)
    targets = _targets(spark, d).select((F.col("utt") * STEPS + F.col("step")).alias("i"), "target").select(F.floor(F.col("i") / 2).alias("utt"), (F.col("i") % 2).alias("step"), "target")
    return search.greedy_search(units, targets, index=search.joint_index(units)).select("utt", "step", "unit_id", _r(F.col("cost")).alias("cost"))


_CANDIDATES = f"{_TARGETS}, c AS (SELECT utt, step, e.vec_id AS id, list_distance(tg.t, e.v) AS tc, row_number() OVER (PARTITION BY utt, step ORDER BY list_distance(tg.t, e.v), e.vec_id) AS r FROM tg, e QUALIFY r <= 5)"


def _candidates(spark, d) -> DataFrame:
    t = _targets(spark, d)
    q = t.select((F.col("utt") * STEPS + F.col("step")).alias("q"), F.col("target").alias("v"))
    near = knn.k_nearest(q, _vectors(spark, d).select(F.col("vec_id").alias("u"), "v"), 5)
    return near.select(F.floor(F.col("q") / STEPS).alias("utt"), (F.col("q") % STEPS).alias("step"), "rank", F.col("u").alias("unit_id"), F.sqrt("dist2").alias("tcost"))


@_query(f"WITH {_CANDIDATES} SELECT DISTINCT a.id AS from_id, b.id AS to_id FROM c a JOIN c b ON b.utt = a.utt AND b.step = a.step + 1")
def candidate_pairs(spark, d):
    return search.candidate_pairs(_candidates(spark, d))


@_query(f"WITH {_CANDIDATES}, p AS (SELECT a.id AS from_id, b.id AS to_id FROM c a JOIN c b ON b.utt = a.utt AND b.step = a.step + 1) SELECT from_id, to_id, count(*) AS n FROM p GROUP BY ALL")
def pair_counts(spark, d):
    c = _candidates(spark, d)
    a = c.select("utt", "step", F.col("unit_id").alias("from_id"))
    b = c.select("utt", (F.col("step") - 1).alias("step"), F.col("unit_id").alias("to_id"))
    return diagnostics.pair_counts(a.join(b, ["utt", "step"]))


_VITERBI = (
    f"{_CANDIDATES}, arc AS (SELECT b.utt, b.step, a.id AS f, b.id AS t, CASE WHEN b.id = a.id + 1 THEN 0.0 ELSE list_distance(x.v, y.v) END + b.tc AS cost FROM c a JOIN c b ON b.utt = a.utt AND b.step = a.step + 1 JOIN e x ON x.vec_id = a.id JOIN e y ON y.vec_id = b.id),"
    " best(utt, step, id, total, path) AS (SELECT utt, step, id, tc, [id] FROM c WHERE step = 0 UNION ALL SELECT * FROM (SELECT arc.utt, arc.step, arc.t AS id, min(best.total + arc.cost) AS total, list_append(arg_min(best.path, best.total + arc.cost), arc.t) AS path FROM best JOIN arc ON arc.utt = best.utt AND arc.step = best.step + 1 AND arc.f = best.id GROUP BY arc.utt, arc.step, arc.t)),"
    " last AS (SELECT utt, max(step) AS step FROM tg GROUP BY utt), won AS (SELECT b.utt, min(total) AS total, arg_min(path, total) AS path FROM best b JOIN last USING (utt, step) GROUP BY b.utt),"
    " vp AS (SELECT utt, i - 1 AS step, path[i] AS unit_id, total FROM won, unnest(range(1, len(path) + 1)) AS u(i))"
)


def _viterbi(spark, d) -> DataFrame:
    c, e = _candidates(spark, d), _vectors(spark, d)
    contexts = e.select(F.col("vec_id").alias("unit_id"), F.col("v").alias("start"), F.col("v").alias("end"))
    return search.viterbi(c, search.join_costs(search.candidate_pairs(c), contexts))


@_query(f"WITH RECURSIVE {_VITERBI} SELECT utt, step, unit_id, round(total, 6) AS total FROM vp")
def viterbi_search(spark, d):
    return _viterbi(spark, d).select("utt", "step", "unit_id", _r(F.col("total")).alias("total"))


_RESORT = _VITERBI.replace(
    "e y ON y.vec_id = b.id),",
    "e y ON y.vec_id = b.id WHERE (a.id + b.id) % 4 = 0 AND b.step % 3 <> 0), own AS (SELECT * FROM arc), resort AS (SELECT b.utt, b.step, a.id AS f, b.id AS t, 5e8 + b.tc AS cost FROM c b JOIN c a ON b.utt = a.utt AND b.step = a.step + 1 ANTI JOIN own ON own.utt = b.utt AND own.step = b.step AND own.t = b.id), every AS (SELECT * FROM own UNION ALL SELECT * FROM resort),",
).replace("FROM best JOIN arc ON arc.utt = best.utt AND arc.step = best.step + 1 AND arc.f = best.id GROUP BY arc.utt, arc.step, arc.t", "FROM best JOIN every AS arc ON arc.utt = best.utt AND arc.step = best.step + 1 AND arc.f = best.id GROUP BY arc.utt, arc.step, arc.t")


@_query(f"WITH RECURSIVE {_RESORT} SELECT utt, step, unit_id, round(total / 1e6, 3) AS total FROM vp")
def viterbi_last_resort(spark, d):
    """Shortest paths where three of four joins are missing, and all into every third step: the candidates that nothing
    leads to are joined at the emergency cost. Lattices are cut into segments of eight steps."""
    c, e = _candidates(spark, d), _vectors(spark, d)
    contexts = e.select(F.col("vec_id").alias("unit_id"), F.col("v").alias("start"), F.col("v").alias("end"))
    at = c.select("utt", "step", "unit_id")
    before = at.select("utt", (F.col("step") + 1).alias("step"), F.col("unit_id").alias("from_id"))
    pairs = at.where("step % 3 <> 0").withColumnRenamed("unit_id", "to_id").join(before, ["utt", "step"]).where("(from_id + to_id) % 4 = 0").select("from_id", "to_id").distinct()
    # The graph knows pairs of units, not steps: units of every third step get names of their own.
    named = c.select("utt", "step", (F.col("unit_id") * 2 + (F.col("step") % 3 == 0).cast("int")).alias("unit_id"), "tcost")
    costs = search.join_costs(pairs, contexts).select((F.col("from_id") * 2).alias("from_id"), (F.col("to_id") * 2).alias("to_id"), "cost")
    costs = costs.unionByName(costs.withColumn("from_id", F.col("from_id") + 1))
    found = search.viterbi(named, costs, last_resort=True, segment=8)
    return found.select("utt", "step", F.floor(F.col("unit_id") / 2).alias("unit_id"), _r(F.col("total") / 1e6, 3).alias("total"))


@_query(f"WITH RECURSIVE {_VITERBI}, j AS (SELECT utt, lead(unit_id) OVER (PARTITION BY utt ORDER BY step) <> unit_id + 1 AS cut FROM vp) SELECT utt, count(*) FILTER (WHERE cut) AS n_joins, round(CASE WHEN count(*) > 1 THEN count(*) FILTER (WHERE cut) * 100.0 / (count(*) - 1) ELSE 0 END, 6) AS percent FROM j GROUP BY utt")
def join_rate(spark, d):
    return diagnostics.join_rate(_viterbi(spark, d)).select("utt", "n_joins", _r(F.col("percent").cast("double")).alias("percent"))


@_query(f"WITH RECURSIVE {_VITERBI}, x AS (SELECT vp.utt, list_transform(range(1, 65), lambda i: pow(tg.t[i] - e.v[i], 2)) AS s FROM vp JOIN tg USING (utt, step) JOIN e ON e.vec_id = vp.unit_id), y AS (SELECT utt, list_sum(s[1:24]) AS a, list_sum(s[25:44]) AS b, list_sum(s[45:63]) AS c, s[64] AS z FROM x) SELECT utt, round(avg(a), 6) AS mean_mag, round(stddev_pop(a), 6) AS std_mag, round(avg(b), 6) AS mean_real, round(stddev_pop(b), 6) AS std_real, round(avg(c), 6) AS mean_imag, round(stddev_pop(c), 6) AS std_imag, round(avg(z), 6) AS mean_lf0, round(stddev_pop(z), 6) AS std_lf0 FROM y GROUP BY utt")
def path_costs_by_stream(spark, d):
    path = _viterbi(spark, d).join(_targets(spark, d), ["utt", "step"])
    costs = diagnostics.target_costs(path, _vectors(spark, d).select(F.col("vec_id").alias("unit_id"), F.col("v").alias("own")), STREAMS)
    out = diagnostics.cost_summary(costs, [s for s, _ in STREAMS])
    return out.select("utt", *(_r(F.col(c)).alias(c) for c in out.columns[1:]))


@_query(f"WITH {_CANDIDATES}, f AS (SELECT id, min(step) AS step FROM c GROUP BY id), n AS (SELECT step, count(*) AS n_new FROM f GROUP BY step) SELECT step, n_new, CAST(sum(n_new) OVER (ORDER BY step) AS BIGINT) AS n_seen FROM n")
def candidate_growth(spark, d):
    return diagnostics.growth(_candidates(spark, d), "step", "unit_id")


@_query(
    f"WITH {_E}, fr AS (SELECT label AS utt, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS step, v FROM e), p AS (SELECT utt, step, v, i FROM fr, unnest(range(64)) AS u(i)),"
    " w AS (SELECT utt, step * 48 + i AS pos, v[i + 1] * CASE WHEN i + 1 <= 16 THEN pow(sin((i + 1) * pi() / 34), 2) WHEN 64 - i <= 16 THEN pow(sin((64 - i) * pi() / 34), 2) ELSE 1 END AS x FROM p) SELECT utt, pos, round(sum(x), 6) AS value FROM w GROUP BY ALL"
)
def overlap_add(spark, d):
    e = _vectors(spark, d).withColumn("step", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).cast("long"))
    out = assemble.waveform(e.select(F.col("label").alias("utt"), "step", F.col("v").alias("samples")), 16)
    return out.select("utt", "pos", _r(F.col("value")).alias("value"))


@_query(f"WITH {_E}, a AS (SELECT label, vec_id AS pos, v[1] AS s, v[2] AS n FROM e), g AS (SELECT label, sqrt(sum(s * s) / (sum(n * n) * pow(10, 0.6))) AS gain FROM a GROUP BY label) SELECT label AS utt, pos, round(s + n * gain, 6) AS value FROM a JOIN g USING (label)")
def snr_mix(spark, d):
    e = _vectors(spark, d)
    s = e.select(F.col("label").alias("utt"), F.col("vec_id").alias("pos"), F.col("v")[0].alias("value"))
    n = e.select(F.col("label").alias("utt"), F.col("vec_id").alias("pos"), F.col("v")[1].alias("value"))
    return assemble.snr_mixed(s, n, 6.0).select("utt", "pos", _r(F.col("value")).alias("value"))


@_query(f"WITH {_E}, k AS (SELECT label AS centre, list_transform(range(1, 65), lambda i: CASE WHEN (i * 7 + label * 13) % 5 = 0 THEN 0.2 ELSE -0.05 END::DOUBLE) AS c FROM (SELECT unnest(range(8)) AS label)), p AS (SELECT vec_id, centre, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(v, c), centre) AS r FROM e, k) SELECT vec_id, CAST(centre AS INTEGER) AS centre FROM p WHERE r = 1")
def kmeans_assign(spark, d):
    centres = [[0.2 if (i * 7 + k * 13) % 5 == 0 else -0.05 for i in range(1, DIM + 1)] for k in range(8)]
    return knn.nearest_given(_vectors(spark, d).select(F.col("vec_id").alias("u"), "v"), centres).select(F.col("u").alias("vec_id"), "centre")


@_query()
def kmeans_codebook(spark, d):
    """Sizes of the clusters of a learned codebook; its centres are the library's own, so no SQL."""
    from unitweave.operators.tuning import codebook

    _, rows = codebook(_vectors(spark, d).select(F.col("vec_id").alias("u"), "v"), 8)
    return rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_TOKENS = "k AS (SELECT conv_id, turn, list_filter(string_split(lower(text), ' '), lambda x: x <> '') AS w FROM conversations)"


def _tokens(spark, d) -> DataFrame:
    words = F.filter(F.split(F.lower("text"), " "), lambda x: x != "")
    return _t(spark, d, "conversations").select("conv_id", "turn", F.posexplode(words).alias("ix", "token"))


@_query(f"WITH {_TOKENS}, g AS (SELECT w[i] || ' ' || w[i + 1] AS gram FROM k, unnest(range(1, len(w))) AS u(i)) SELECT gram, count(*) AS n FROM g GROUP BY gram")
def ngram_counts(spark, d):
    t = _tokens(spark, d).withColumn("doc", F.struct("conv_id", "turn"))
    return search.ngrams(t, "doc", "ix", "token", 2).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_TOKENS}, g AS (SELECT conv_id, turn, i - 1 AS ix, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram FROM k, unnest(range(1, len(w) - 1)) AS u(i)), p AS (SELECT gram, count(*) AS n, min({{'c': conv_id, 't': turn, 'i': ix}}) AS m FROM g GROUP BY gram) SELECT gram, n, m.c AS conv_id, m.t AS turn, CAST(m.i AS INTEGER) AS ix FROM p WHERE n > 1")
def patch_index(spark, d):
    t = _tokens(spark, d).withColumn("doc", F.struct("conv_id", "turn"))
    g = search.ngrams(t, "doc", "ix", "token", 3)
    at = g.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc.conv_id", "doc.turn", "ix")).alias("at")).where("n > 1")
    return at.select("gram", "n", "at.conv_id", "at.turn", "at.ix")


# --- further windows, joins and sums ----------------------------------------------------------------------------


@_query(f"WITH {_TR}, m AS (SELECT *, sum(CAST(f0 > 0 AS INTEGER)) OVER (PARTITION BY utt ORDER BY ix) AS a, sum(CAST(f0 > 0 AS INTEGER)) OVER (PARTITION BY utt ORDER BY ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM t) SELECT utt, ix, CASE WHEN a = 0 OR z = 0 THEN -10.0 ELSE f0 END AS f0 FROM m")
def silent_edges(spark, d):
    out = series.edges_replaced(_tracks(spark, d), "utt", "ix", "f0", F.col("f0") <= 0, -10.0)
    return out.select("utt", "ix", F.col("value_out").alias("f0"))


@_query("SELECT round(avg(ln(1 + 255 * abs(value) / 1000) / ln(256)), 9) AS mean, round(stddev_pop(ln(1 + 255 * abs(value) / 1000) / ln(256)), 9) AS std FROM events")
def wave_mean_std(spark, d):
    out = diagnostics.wave_statistics(_t(spark, d, "events"), "user_id", F.col("value") / 1000, 0)
    return out.select(*(_r(F.col(c), 9).alias(c) for c in ("mean", "std")))


@_query("WITH s AS (SELECT l_returnflag AS stream, sum(l_quantity) AS total FROM lineitem GROUP BY 1) SELECT stream, round(sqrt((SELECT max(total) FROM s) / total), 9) AS factor FROM s")
def stream_factors(spark, d):
    s = _t(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("stream")).agg(F.sum("l_quantity").alias("total"))
    return diagnostics.stream_factors(s, "stream", "total").select("stream", _r(F.col("factor"), 9).alias("factor"))


@_query(f"WITH {_E}, a AS (SELECT label AS utt, vec_id AS pos, v[1] AS x FROM e), g AS (SELECT utt, pow(10, -1.3) / sqrt(avg(x * x)) AS g FROM a GROUP BY utt) SELECT utt, pos, round(x * g, 9) AS value FROM a JOIN g USING (utt)")
def level_normalise(spark, d):
    s = _vectors(spark, d).select(F.col("label").alias("utt"), F.col("vec_id").alias("pos"), F.col("v")[0].alias("value"))
    return assemble.level_normalised(s).select("utt", "pos", _r(F.col("value"), 9).alias("value"))


@_query(f"WITH {_TR}, g AS (SELECT utt, ix, CAST(f0 > 0 AS INTEGER) AS v, ix - row_number() OVER (PARTITION BY utt, f0 > 0 ORDER BY ix) AS g FROM t), r AS (SELECT utt, v, min(ix) AS s, count(*) AS n FROM g GROUP BY utt, v, g) SELECT utt, string_agg(v || '*' || n, ' ' ORDER BY s) AS text FROM r GROUP BY utt")
def run_text(spark, d):
    return series.run_text(_tracks(spark, d).withColumn("v", (F.col("f0") > 0).cast("int")), "utt", "ix", "v")


@_query(f"WITH RECURSIVE {_VITERBI}, g AS (SELECT utt, step, unit_id, unit_id - step AS g FROM vp), n AS (SELECT *, CASE WHEN lag(unit_id) OVER (PARTITION BY utt ORDER BY step) = unit_id - 1 THEN 0 ELSE 1 END AS new FROM g), r AS (SELECT *, sum(new) OVER (PARTITION BY utt ORDER BY step) AS run FROM n) SELECT utt, CAST(run AS BIGINT) AS run, min(unit_id) AS first_id, max(unit_id) AS last_id, count(*) AS length FROM r GROUP BY utt, run")
def contiguous_runs(spark, d):
    return diagnostics.contiguous_runs(_viterbi(spark, d)).withColumn("run", F.col("run").cast("long"))


@_query(f"WITH RECURSIVE {_VITERBI} SELECT vp.utt, step, e.label || ' ' || unit_id || ' ' || (unit_id + 1) AS line FROM vp JOIN e ON e.vec_id = unit_id")
def selection_trace(spark, d):
    e = _vectors(spark, d).select(F.col("vec_id").alias("unit_id"), F.col("label").cast("string").alias("src"), F.col("vec_id").alias("start"), (F.col("vec_id") + 1).alias("end"))
    return diagnostics.trace(_viterbi(spark, d).join(e, "unit_id"))


@_query(f"WITH {_CANDIDATES}, p AS (SELECT DISTINCT a.id AS f, b.id AS t FROM c a JOIN c b ON b.utt = a.utt AND b.step = a.step + 1) SELECT f AS from_id, t AS to_id, round(CASE WHEN t = f + 1 THEN 0.0 ELSE list_distance(x.v, y.v) END, 6) AS cost FROM p JOIN e x ON x.vec_id = f JOIN e y ON y.vec_id = t")
def join_cost_table(spark, d):
    e = _vectors(spark, d).select(F.col("vec_id").alias("unit_id"), F.col("v").alias("start"), F.col("v").alias("end"))
    return search.join_costs(search.candidate_pairs(_candidates(spark, d)), e).withColumn("cost", _r(F.col("cost")))


@_query(f"WITH {_E}, x AS (SELECT vec_id, v, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM e) SELECT vec_id, CAST(128 AS INTEGER) AS width, round(v[1] + b[64], 6) AS edge FROM x WHERE b IS NOT NULL")
def frame_pairs(spark, d):
    out = features.frame_pairs(_vectors(spark, d), "label", "vec_id", "v")
    return out.select("vec_id", F.size("v").alias("width"), _r(F.col("v")[0] + F.element_at("v", -1)).alias("edge"))


@_query(f"WITH {_E}, x AS (SELECT vec_id, v, coalesce(lag(v, 2) OVER w, first_value(v) OVER w) AS a, lead(v, 2) OVER w AS b, last_value(v) OVER (PARTITION BY label ORDER BY vec_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS z FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT vec_id, round(a[1], 6) AS first, round(coalesce(b, z)[64], 6) AS last FROM x")
def natural_contexts(spark, d):
    out = features.natural_contexts(_vectors(spark, d), "label", "vec_id", "v")
    return out.select("vec_id", _r(F.col("context")[0]).alias("first"), _r(F.element_at("context", -1)).alias("last"))


@_query(f"WITH {_E} SELECT vec_id, round(coalesce(lag(v[1], 10) OVER w, 0.0), 6) AS lag10, round(coalesce(lag(v[64], 20) OVER w, 0.0), 6) AS lag20 FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)")
def lagged_contexts(spark, d):
    out = series.lagged_contexts(_vectors(spark, d), "label", "vec_id", "v", (10, 20), DIM)
    return out.select("vec_id", _r(F.col("context")[0]).alias("lag10"), _r(F.element_at("context", -1)).alias("lag20"))


@_query("WITH h AS (SELECT a.conv_id AS from_id, b.conv_id AS to_id FROM (SELECT DISTINCT conv_id FROM conversations) a JOIN (SELECT DISTINCT conv_id FROM conversations) b ON b.conv_id = a.conv_id + 1) SELECT * FROM h")
def adjacent_conversations(spark, d):
    return joins.successors(_t(spark, d, "conversations").select("conv_id").distinct(), "conv_id").select("from_id", "to_id")


@_query(f"WITH {_HALVES}, n AS (SELECT a.unit_id, b.phone FROM u a LEFT JOIN u b ON b.unit_id = a.unit_id + 1) SELECT a.unit_id AS from_id, c.unit_id AS to_id, c.unit_id = a.unit_id + 1 AS natural FROM u a JOIN n USING (unit_id) JOIN u c ON c.phone = CASE WHEN a.half = 'L' THEN a.phone ELSE n.phone END AND c.half <> a.half AND c.unit_id <> a.unit_id WHERE a.unit_id % 100 = 0")
def transitions_of(spark, d):
    """Transitions of the stated query set, every unit whose id is divisible by 100, against all units."""
    u = _halves(spark, d)
    return joins.transitions_of(u.where("unit_id % 100 = 0").select("unit_id"), u)
