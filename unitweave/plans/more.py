"""Further registered queries: assembly, halfphones, labels, scalars, waveforms and walks. They join those of the catalogue.

States, halves and frames are made from embeddings: fifty consecutive vectors are an utterance, five its phones' states of
two frames each; a label's vectors in order are a signal of one sample each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from unitweave.functions import labels, scalars, vectors
from unitweave.operators import assemble, diagnostics, features, graphs, joins, pitchsync, search, select, series, waves
from unitweave.plans.catalog import _E, _TR, STREAMS, _candidates, _CANDIDATES, _query, _r, _t, _tracks, _vectors

_IX = "row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1"
_SIG = f"{_E}, s AS (SELECT label AS utt, {_IX} AS pos, v[1] AS value, v, vec_id FROM e)"
_STATES = f"{_E}, st AS (SELECT vec_id // 50 AS utt, vec_id % 50 AS seq, CAST(vec_id % 5 + 2 AS VARCHAR) AS state, (vec_id % 50) * 2 AS start, (vec_id % 50) * 2 + 2 AS end_, label, v FROM e), fr AS (SELECT utt, seq * 2 + k AS frame, [v[1] + k, v[2]] AS v FROM st, unnest(range(2)) AS u(k))"
_HALF = "h AS (SELECT utt, seq // 5 AS phone_ix, CASE WHEN state <= '3' THEN 'L' ELSE 'R' END AS half, min(start) AS start, max(CASE WHEN state IN ('3', '5') THEN start END) AS middle, max(end_) AS end_, CAST(sum(end_ - start) AS BIGINT) AS duration FROM st GROUP BY ALL)"


def _indexed(spark, d) -> DataFrame:
    """(utt, pos, value, v, vec_id): a label's vectors in order."""
    return series.indexed(_vectors(spark, d), "label", "vec_id", name="pos").select(F.col("label").alias("utt"), "pos", F.col("v")[0].alias("value"), "v", "vec_id")


def _states(spark, d) -> DataFrame:
    e = _vectors(spark, d)
    seq = F.col("vec_id") % 50
    return e.select(F.floor(F.col("vec_id") / 50).alias("utt"), seq.alias("seq"), (F.col("vec_id") % 5 + 2).cast("string").alias("state"), (seq * 2).alias("start"), (seq * 2 + 2).alias("end"), "label", "v")


def _state_frames(spark, d) -> DataFrame:
    rows = _states(spark, d).select("utt", "start", "v", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    return rows.select("utt", (F.col("start") + F.col("k")).alias("frame"), F.array(F.col("v")[0] + F.col("k"), F.col("v")[1]).alias("v"))


# --- assembly ---------------------------------------------------------------------------------------------------


@_query(
    f"WITH {_SIG}, p AS (SELECT vec_id // 25 AS utt, vec_id % 25 AS step, utt AS src, pos AS frame FROM s), g AS (SELECT p.utt, step, k AS pos, coalesce(s.v[1:3], [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]) AS v FROM p CROSS JOIN unnest(range(4)) AS u(k) LEFT JOIN s ON s.utt = p.src AND s.pos = p.frame + k - 1),"
    " x AS (SELECT utt, step * 2 + pos AS pos, i - 1 AS d, v[i] * CASE WHEN pos + 1 <= 2 THEN pow(sin((pos + 1) * pi() / 6), 2) WHEN 4 - pos <= 2 THEN pow(sin((4 - pos) * pi() / 6), 2) ELSE 1 END AS x FROM g, unnest(range(1, 4)) AS u(i)),"
    " n AS (SELECT utt, max(step) * 2 + 4 AS n FROM g GROUP BY utt) SELECT utt, pos - 1 AS pos, CAST(d AS INTEGER) AS d, round(sum(x), 6) AS value FROM x JOIN n USING (utt) WHERE pos >= 1 AND pos < n - 1 GROUP BY ALL"
)
def overlapped_frames(spark, d):
    """The flagship's own output: frames of the chosen units with a frame more on either side, tapered and summed."""
    s = _indexed(spark, d)
    path = s.select(F.floor(F.col("vec_id") / 25).alias("utt"), (F.col("vec_id") % 25).alias("step"), F.col("utt").alias("src"), F.col("pos").alias("frame"))
    frames = s.select(F.col("utt").alias("src"), F.col("pos").alias("frame"), vectors.stream_slice(F.col("v"), 0, 3).alias("v"))
    out = assemble.overlap_added(assemble.fragments(path, frames, 2, 1, 3), 2, 2, 2)
    return out.select("utt", "pos", "d", _r(F.col("value")).alias("value"))


@_query(f"WITH {_SIG}, l AS (SELECT utt, pos, value AS a FROM s WHERE pos < 20), r AS (SELECT utt, pos, v[2] AS b FROM s WHERE pos >= 16 AND pos < 40), o AS (SELECT utt, min(pos) AS f FROM r GROUP BY utt) SELECT utt, pos, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a * (1 - (pos - f + 1) / 5) + b * (pos - f + 1) / 5 END, 6) AS value FROM l FULL JOIN r USING (utt, pos) LEFT JOIN o USING (utt)")
def crossfade_join(spark, d):
    s = _indexed(spark, d)
    out = assemble.crossfaded(s.where("pos < 20").select("utt", "pos", "value"), s.where("pos >= 16 AND pos < 40").select("utt", "pos", F.col("v")[1].alias("value")), 4)
    return out.select("utt", "pos", _r(F.col("value")).alias("value"))


@_query(
    f"WITH {_E}, u AS (SELECT vec_id // 25 AS utt, vec_id % 25 AS step, list_transform(v[1:6], lambda x: 150 + 300 * x) AS f FROM e), a AS (SELECT *, coalesce((lag(f[6]) OVER w + f[1]) / 2 - f[1], 0.0) AS i, coalesce((lead(f[1]) OVER w + f[6]) / 2 - f[6], 0.0) AS o FROM u WINDOW w AS (PARTITION BY utt ORDER BY step)),"
    " n AS (SELECT utt, step, f, list_transform(range(6), lambda k: f[k + 1] + i + (o - i) * k / 5) AS g FROM a), c AS (SELECT utt, step, CASE WHEN list_min(g) >= 20 AND list_max(g) <= 450 THEN g ELSE f END AS f FROM n) SELECT utt, step, CAST(k AS INTEGER) AS value_ix, round(f[k + 1], 6) AS f0 FROM c, unnest(range(6)) AS t(k)"
)
def slopes_to_average(spark, d):
    u = _vectors(spark, d).select(F.floor(F.col("vec_id") / 25).alias("utt"), (F.col("vec_id") % 25).alias("step"), F.transform(vectors.stream_slice(F.col("v"), 0, 6), lambda x: x * 300 + 150).alias("f0"))
    return assemble.slope_to_average(u).select("utt", "step", "value_ix", _r(F.col("f0")).alias("f0"))


# --- states, halves and their features --------------------------------------------------------------------------


@_query(f"WITH {_STATES}, {_HALF} SELECT utt, phone_ix, half, start, middle, end_ AS \"end\", duration FROM h")
def halfphone_spans(spark, d):
    out = features.halfphones(_states(spark, d))
    return out.select("utt", F.col("phone_ix").cast("long").alias("phone_ix"), "half", "start", "middle", "end", "duration")


@_query(f"WITH {_STATES}, {_HALF} SELECT h.utt, phone_ix, half, round(a.v[1], 6) AS first, round(b.v[1], 6) AS middle, round(c.v[2], 6) AS last FROM h JOIN fr a ON a.utt = h.utt AND a.frame = h.start JOIN fr b ON b.utt = h.utt AND b.frame = h.middle JOIN fr c ON c.utt = h.utt AND c.frame = h.end_ - 1")
def halfphone_targets(spark, d):
    out = features.halfphone_vectors(features.halfphones(_states(spark, d)), _state_frames(spark, d), 3)
    v = F.col("target")
    return out.select("utt", F.col("phone_ix").cast("long").alias("phone_ix"), "half", _r(v[0]).alias("first"), _r(v[2]).alias("middle"), _r(v[5]).alias("last"))


@_query(f"WITH {_STATES}, {_HALF} SELECT h.utt, phone_ix * 2 + CASE WHEN half = 'L' THEN 0 ELSE 1 END AS unit_ix, round((max(end_) - max(start)) * 5.0::DOUBLE, 6) AS duration_ms, round(avg(v[1]), 6) AS energy, round(coalesce(avg(v[2]) FILTER (WHERE v[2] > 0), -1000), 6) AS lf0 FROM h JOIN fr ON fr.utt = h.utt AND fr.frame >= h.start AND fr.frame < h.end_ GROUP BY h.utt, phone_ix, half")
def prosody_of_units(spark, d):
    h = features.halfphones(_states(spark, d))
    units = h.select("utt", (F.col("phone_ix").cast("long") * 2 + F.when(F.col("half") == "L", 0).otherwise(1)).alias("unit_ix"), "start", "end")
    out = features.prosody_targets(units, _state_frames(spark, d), F.col("v")[0], F.col("v")[1])
    return out.select("utt", "unit_ix", *(_r(F.col(c)).alias(c) for c in ("duration_ms", "energy", "lf0")))


@_query(f"WITH {_STATES}, c AS (SELECT utt, seq AS ix, start AS frame FROM st UNION ALL SELECT utt, max(seq) + 1, arg_max(start, seq) + 1 FROM st GROUP BY utt) SELECT c.utt, ix AS cut_ix, frame, round(v[1], 6) AS x FROM c JOIN fr USING (utt, frame)")
def contexts_at_cuts(spark, d):
    cuts = _states(spark, d).select("utt", F.col("seq").alias("unit_ix"), "start", (F.col("start") + 1).alias("end"))
    return features.cut_contexts(cuts, _state_frames(spark, d)).select("utt", "cut_ix", "frame", _r(F.col("v")[0]).alias("x"))


@_query(f"WITH {_E} SELECT label FROM e GROUP BY label HAVING bool_or(v[1] > 0.3)")
def broken_utterances(spark, d):
    e = _vectors(spark, d).select("label", F.transform("v", lambda x: F.when(x > 0.3, F.lit(float("nan"))).otherwise(x)).alias("v"))
    return features.bad_utterances(e.select("label", vectors.stream_slice(F.col("v"), 0, 1).alias("v")), "label", "v")


@_query("WITH f AS (SELECT l_orderkey AS utt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) - 1 AS frame, l_quantity AS q FROM lineitem), h AS (SELECT utt, count(*) AS have, utt % 7 + 1 AS n FROM f GROUP BY utt), g AS (SELECT utt, unnest(range(n)) AS frame FROM h WHERE abs(have - n) <= 2) SELECT utt, frame, round(coalesce(q, 0), 6) AS q FROM g LEFT JOIN f USING (utt, frame)")
def lengths_matched(spark, d):
    from unitweave.plans.catalog import _frames

    f = _frames(spark, d).select("utt", "frame", F.array("q").alias("v"))
    lengths = f.select("utt").distinct().select("utt", (F.col("utt") % 7 + 1).alias("n"))
    return features.length_matched(f, lengths, "utt", "frame", "v", 1, 2).select("utt", "frame", _r(F.col("v")[0]).alias("q"))


@_query(
    f"WITH {_STATES}, l AS (SELECT *, sum(CAST(label > 1 AS INTEGER)) OVER (PARTITION BY utt ORDER BY seq) AS a, sum(CAST(label > 1 AS INTEGER)) OVER (PARTITION BY utt ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS z FROM st),"
    " n AS (SELECT utt, CAST(coalesce(sum(2) FILTER (WHERE a = 0), 0) AS BIGINT) AS lead, CAST(coalesce(sum(2) FILTER (WHERE z = 0 AND a > 0), 0) AS BIGINT) AS tail, count(*) AS n FROM l GROUP BY utt) SELECT st.utt, seq + lead AS frame, round(v[1], 6) AS x FROM st JOIN n USING (utt) UNION ALL SELECT utt, unnest(range(lead)), 0.0 FROM n UNION ALL SELECT utt, unnest(range(lead + n, lead + n + tail)), 0.0 FROM n"
)
def silence_put_back(spark, d):
    s = _states(spark, d)
    marks = s.select("utt", "start", "end", F.when(F.col("label") > 1, F.lit("a")).otherwise(F.lit("#")).alias("phone"))
    out = features.silence_restored(s.select("utt", F.col("seq").alias("frame"), F.array(F.col("v")[0]).alias("v")), marks, 1)
    return out.select("utt", "frame", _r(F.col("v")[0]).alias("x"))


@_query(f"WITH {_E}, n AS (SELECT vec_id, lag(v) OVER w AS p, v, lead(v) OVER w AS q FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)) SELECT vec_id, round(0.5 * p[1], 6) AS before, round(v[64], 6) AS own, round(0.25 * q[2], 6) AS after FROM n WHERE p IS NOT NULL AND q IS NOT NULL")
def spliced_frames(spark, d):
    out = features.spliced(_vectors(spark, d), "label", "vec_id", "v", (0.5, 1.0, 0.25))
    v = F.col("spliced")
    return out.select("vec_id", _r(v[0]).alias("before"), _r(features.unspliced(v, 3, 64)[63]).alias("own"), _r(v[129]).alias("after"))


# --- labels and scalars -----------------------------------------------------------------------------------------

_LABEL = "l AS (SELECT p_partkey, p_size || '~' || lower(substr(p_type, 1, 2)) || '-' || replace(p_brand, 'Brand#', 'b') || '+' || lower(substr(p_type, 3, 2)) || '=' || p_size || ':x' AS label, p_partkey % 2 = 0 AS even FROM part)"
_PATTERN = r"^([^~]+)~([^-]+)-([^+]+)\+([^=]+)=([^:]+):"


@_query(f"WITH {_LABEL}, g AS (SELECT p_partkey, regexp_extract(label, '{_PATTERN}', ['ll', 'l', 'c', 'r', 'rr']) AS g, CASE WHEN even THEN '_L' ELSE '_R' END AS h, even FROM l) SELECT p_partkey, g.ll || '/' || g.l || '/' || g.c || h || '/' || g.r || '/' || g.rr AS quin, g.l || '/' || g.c || h || '/' || g.r AS tri, CASE WHEN even THEN g.l || '/' || g.c || h ELSE g.c || h || '/' || g.r END AS di, g.c || h AS mono, CASE WHEN g.c IN ('b11', 'b12') THEN 'pau' ELSE g.c END AS phone FROM g")
def label_names(spark, d):
    """Quinphones read from labels, the names a unit backs off to, and phones with pauses made one."""
    p = _t(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("~"), F.lower(F.substring("p_type", 1, 2)), F.lit("-"), F.regexp_replace("p_brand", "Brand#", "b"), F.lit("+"), F.lower(F.substring("p_type", 3, 2)), F.lit("="), F.col("p_size").cast("string"), F.lit(":x")).alias("label"))
    ll, l, c, r, rr = labels.quinphone(F.col("label"), _PATTERN)  # noqa: E741
    half = F.when(F.col("p_partkey") % 2 == 0, F.lit("_L")).otherwise(F.lit("_R"))
    named = p.select("p_partkey", labels.unit_name(ll, l, F.concat(c, half), r, rr).alias("name"))
    names = labels.backoff_names(F.col("name"))
    return named.select("p_partkey", *(n.alias(a) for n, a in zip(names, ("quin", "tri", "di", "mono"))), labels.pauses_unified(labels.monophone(F.col("name")), ["b11", "b12"]).alias("phone"))


@_query("SELECT event_id, CASE WHEN value > 5 THEN round(16000.0 / value, 6) ELSE 0.0 END AS f0, CASE WHEN value - 5 > 0 THEN round(16000.0 / (value - 5), 6) ELSE 80.0 END AS shift, CAST(round_even(value * 512 / 16000, 0) AS INTEGER) AS bin, round((event_id % 100) * 31.25::DOUBLE, 6) AS hz, round(sign(value / 1000) * (pow(256, abs(value / 1000)) - 1) / 255, 9) AS linear, round(pow(10, value / 20 / 10), 6) AS amplitude, CAST(least(greatest(trunc(value * 1000 - 20000), -32768), 32767) AS SMALLINT) AS sample FROM events")
def speech_scalars(spark, d):
    v = F.col("value")
    return _t(spark, d, "events").select(
        "event_id", _r(scalars.shift_to_f0(v, 16000, v > 5)).alias("f0"), _r(scalars.f0_to_shift(v - 5, 16000)).alias("shift"), scalars.hz_to_bin(v, 16000, 512).alias("bin"), _r(scalars.bin_to_hz(F.col("event_id") % 100, 16000, 512)).alias("hz"),
        _r(scalars.mu_law_inverse(v / 1000), 9).alias("linear"), _r(scalars.from_decibels(v / 10)).alias("amplitude"), scalars.clipped_sample(v * 1000 - 20000).alias("sample"),
    )


@_query(f"WITH {_E} SELECT vec_id, round(sqrt(v[1] * v[1] + v[2] * v[2]), 9) AS mag, round(v[1] / sqrt(v[1] * v[1] + v[2] * v[2]), 9) AS re, round(v[2] / sqrt(v[1] * v[1] + v[2] * v[2]), 9) AS im, round(atan2(v[2], v[1]), 9) AS ph, round(cos(atan2(v[2], v[1])), 9) AS c, round(sin(atan2(v[2], v[1])), 9) AS s, round(CASE WHEN v[3] > 0.1 THEN 0 ELSE v[3] END, 9) AS trimmed, round(v[4] / 2, 9) AS halved FROM e")
def spectra_parts(spark, d):
    v = F.col("v")
    mag, re, im = scalars.unit_spectrum(v[0], v[1])
    ph = scalars.phase(v[0], v[1])
    c, s = scalars.phase_parts(ph)
    trimmed = vectors.outliers_zeroed(F.array(F.when(v[2] > 0.1, F.lit(1000.0)).otherwise(v[2])))[0]
    halved = vectors.deweighted(F.array(v[3]), vectors.literal([2.0]))[0]
    return _vectors(spark, d).select("vec_id", *(_r(x, 9).alias(n) for x, n in ((mag, "mag"), (re, "re"), (im, "im"), (ph, "ph"), (c, "c"), (s, "s"), (trimmed, "trimmed"), (halved, "halved"))))


@_query(f"WITH {_E} SELECT vec_id, round(v[1], 6) AS a, round(v[64], 6) AS z FROM e")
def back_to_raw(spark, d):
    """Standardised and back again."""
    e = _vectors(spark, d)
    mean, std = features.statistics_vectors(features.stream_statistics(e, "v", STREAMS), [s for s, _ in STREAMS])
    m, s = vectors.literal(mean), vectors.literal(std)
    v = vectors.destandardised(vectors.standardised(F.col("v"), m, s), m, s)
    return e.select("vec_id", v.alias("v")).select("vec_id", _r(F.col("v")[0]).alias("a"), _r(F.col("v")[63]).alias("z"))


@_query("SELECT page_id, regexp_replace(regexp_replace(url, '^.*/', ''), '\\.[^.]*$', '') AS stem FROM pages")
def url_stems(spark, d):
    return _t(spark, d, "pages").select("page_id", scalars.stem(F.col("url")).alias("stem"))


@_query(f"WITH {_TR} SELECT utt, ix, round(ix * 0.005::DOUBLE, 9) AS world, round(ix * 0.005::DOUBLE + 0.005::DOUBLE, 9) AS straight, round(ix * 0.005::DOUBLE + 0.0125::DOUBLE, 9) AS htk FROM t")
def frame_times(spark, d):
    return _tracks(spark, d).select("utt", "ix", *(_r(series.frame_centres(F.col("ix"), 0.005, c), 9).alias(c) for c in ("world", "straight", "htk")))


# --- series -----------------------------------------------------------------------------------------------------


@_query(f"WITH RECURSIVE {_TR}, m(utt, mark_ix, sample) AS (SELECT utt, 0::BIGINT, 0::BIGINT FROM t WHERE ix = 0 UNION ALL SELECT m.utt, mark_ix + 1, n.sample FROM m JOIN t ON t.utt = m.utt AND t.ix = m.sample, LATERAL (SELECT m.sample + greatest(1, CAST(round_even(CASE WHEN f0 > 0 THEN 100 / f0 ELSE 2 END, 0) AS BIGINT)) AS sample) n JOIN t x ON x.utt = m.utt AND x.ix = n.sample) SELECT utt, mark_ix, sample FROM m")
def pitch_marks(spark, d):
    return series.synthetic_marks(_tracks(spark, d), "utt", "ix", "f0", 100, 0.02)


@_query(f"WITH {_TR}, w AS (SELECT utt, ix, list(f0) OVER (PARTITION BY utt ORDER BY ix ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS x FROM t) SELECT utt, ix AS segment, round(x[1], 6) AS first, round(x[4], 6) AS last FROM w WHERE len(x) = 4")
def rolling_windows(spark, d):
    s = series.segmented(_tracks(spark, d), "utt", "ix", "f0", 4, 3)
    return s.select("utt", "segment", _r(F.col("values")[0]).alias("first"), _r(F.col("values")[3]).alias("last"))


@_query(f"WITH {_TR}, p AS (SELECT *, last_value(CASE WHEN f0 > 0 THEN ix END IGNORE NULLS) OVER (PARTITION BY utt ORDER BY ix) AS a, first_value(CASE WHEN f0 > 0 THEN ix END IGNORE NULLS) OVER (PARTITION BY utt ORDER BY ix ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM t), q AS (SELECT p.*, x.ix * 2.0 AS ya, y.ix * 2.0 AS yb FROM p LEFT JOIN t x ON x.utt = p.utt AND x.ix = p.a LEFT JOIN t y ON y.utt = p.utt AND y.ix = p.b) SELECT utt, ix, round(CASE WHEN f0 > 0 THEN ix * 2.0 WHEN ya IS NULL AND yb IS NULL THEN 0.0 WHEN ya IS NULL THEN yb WHEN yb IS NULL THEN ya ELSE ya + (yb - ya) * (ix - a) / (b - a) END, 6) AS held, CASE WHEN f0 > 0 THEN ix * 2.0::DOUBLE ELSE 0.0::DOUBLE END AS zeroed FROM q")
def unvoiced_regions(spark, d):
    """Values read between voiced frames and held at the ends, or zeroed where unvoiced."""
    t = _tracks(spark, d).withColumn("y", F.col("ix") * 2.0)
    out = series.voiced_interpolated(t, "utt", "ix", "y", series.PREDICATES["voiced"](F.col("f0")))
    return out.select("utt", "ix", _r(F.col("interpolated")).alias("held"), series.unvoiced_zeroed(F.col("y"), series.PREDICATES["voiced"](F.col("f0"))).alias("zeroed"))


@_query(f"WITH {_TR}, n AS (SELECT utt, count(*) AS n FROM t GROUP BY utt HAVING count(*) >= 5), g AS (SELECT utt, n, unnest(range(n + 4)) AS k FROM n), x AS (SELECT utt, n, k, j, k + j - 4 AS i FROM g, unnest(range(5)) AS u(j)), y AS (SELECT utt, k, j, CASE WHEN i < 0 THEN -i WHEN i >= n THEN 2 * n - 1 - i ELSE i END AS i FROM x) SELECT y.utt, k, round(sum(f0 * [0.08::DOUBLE, 0.54::DOUBLE, 1.0::DOUBLE, 0.54::DOUBLE, 0.08::DOUBLE][j + 1]) / 2.24, 6) AS smooth FROM y JOIN t ON t.utt = y.utt AND t.ix = y.i GROUP BY y.utt, k")
def reflected_smoothing(spark, d):
    out = series.reflected_smoothed(_tracks(spark, d), "utt", "ix", "f0", vectors.window_weights("hamming", 5))
    return out.select("utt", F.col("at").alias("k"), _r(F.col("smooth")).alias("smooth"))


@_query("WITH m AS (SELECT user_id, event_id, epoch_us(ts) AS t FROM events), o AS (SELECT o_custkey AS user_id, epoch_us(o_orderdate::TIMESTAMP) AS t, max(o_orderkey) AS k FROM orders GROUP BY ALL), c AS (SELECT m.event_id, o.k, row_number() OVER (PARTITION BY m.event_id ORDER BY CASE WHEN o.t >= m.t THEN 0 ELSE 1 END, CASE WHEN o.t >= m.t THEN o.t ELSE -o.t END) AS r FROM m JOIN o USING (user_id)) SELECT event_id, k AS o_orderkey FROM c WHERE r = 1")
def clipped_bins(spark, d):
    """Each event with the first interval that ends at or after it, or with the last one of its user."""
    o = _t(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("end")).agg(F.max("o_orderkey").alias("o_orderkey"))
    e = _t(spark, d, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return joins.binned_clipped(e, o, "user_id", "t", "end", ["o_orderkey"]).where("o_orderkey IS NOT NULL").select("event_id", "o_orderkey")


@_query(f"WITH {_STATES}, n AS (SELECT utt, count(*) * 2 AS n FROM st GROUP BY utt), p AS (SELECT utt, unnest(range(30)) AS k FROM n) SELECT p.utt, k AS pm_ix, st.label FROM p JOIN n USING (utt) JOIN st ON st.utt = p.utt AND st.seq = least(greatest(CAST(ceil((k * 37 - 40) / 80.0 - 0.5) AS BIGINT), 0), n - 1) // 2")
def labels_at_marks(spark, d):
    """Labels of frames of 80 samples, whose centres are 40, 120, ..., read at marks; both ends are clamped."""
    s = _states(spark, d)
    marks = s.select("utt").distinct().select("utt", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("pm_ix")).withColumn("pos", F.col("pm_ix") * 37)
    out = joins.labels_at(marks, s.select("utt", "start", "end", "label"), 80)
    return out.select("utt", F.col("pm_ix").cast("long").alias("pm_ix"), "label")


# --- waveforms --------------------------------------------------------------------------------------------------


@_query(f"WITH {_SIG} SELECT utt, pos, round(coalesce(lag(value, 1) OVER w, 0.0), 6) AS c1, round(coalesce(lag(value, 3) OVER w, 0.0), 6) AS c3, round(coalesce(lag(value, 5) OVER w, 0.0), 6) AS c5, round(value, 6) AS next FROM s WINDOW w AS (PARTITION BY utt ORDER BY pos)")
def dilated_contexts(spark, d):
    weights = waves.dilated_filter(1.5, 3)
    out = waves.sample_contexts(_indexed(spark, d), len(weights[0]), weights)
    return out.select("utt", "pos", *(_r(F.col("context")[i]).alias(n) for i, n in enumerate(("c1", "c3", "c5"))), _r(F.col("next")).alias("next"))


_MARKS = "mk AS (SELECT utt, m AS mark_ix, 7 * m + m % 3 AS pos FROM (SELECT utt, max(pos) AS z FROM s GROUP BY utt), unnest(range(z // 7)) AS u(m))"


def _marks(spark, d) -> DataFrame:
    """(utt, mark_ix, pos): a mark about every seventh sample."""
    n = _indexed(spark, d).groupBy("utt").agg(F.floor(F.max("pos") / 7).alias("n")).where("n > 0")
    return n.select("utt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("mark_ix")).withColumn("pos", F.col("mark_ix") * 7 + F.col("mark_ix") % 3)


@_query(
    f"WITH {_SIG}, {_MARKS}, b AS (SELECT utt, mark_ix, pos AS m, greatest(lag(pos) OVER w, pos - 5) AS a, least(lead(pos) OVER w, pos + 5) AS z, lag(pos) OVER w IS NOT NULL AND lead(pos) OVER w IS NOT NULL AS inner_ FROM mk WINDOW w AS (PARTITION BY utt ORDER BY mark_ix)),"
    " k AS (SELECT *, m - 5 + i AS pos FROM b, unnest(range(10)) AS u(i) WHERE inner_) SELECT k.utt, mark_ix, CAST(i AS INTEGER) AS i, round(CASE WHEN k.pos >= a AND k.pos < z THEN coalesce(value, 0) * CASE WHEN k.pos < m THEN 0.5 - 0.5 * cos(2 * pi() * (k.pos - a) / (2 * (m - a) - 1)) ELSE 0.5 - 0.5 * cos(2 * pi() * (k.pos - m + z - m) / (2 * (z - m) - 1)) END ELSE 0.0 END, 6) AS value FROM k LEFT JOIN s ON s.utt = k.utt AND s.pos = k.pos"
)
def pitch_periods(spark, d):
    out = waves.pitch_fragments(_marks(spark, d), _indexed(spark, d), 10)
    return out.select("utt", "mark_ix", "i", _r(F.col("value")).alias("value"))


_BOUNDS = (
    f"{_SIG}, {_MARKS}, un AS (SELECT vec_id // 25 AS utt, vec_id % 25 AS step, utt AS src, pos / 100.0 AS a, (pos + 9) / 100.0 AS z FROM s),"
    " na AS (SELECT un.utt, step, arg_min(mark_ix, (abs(pos / 100.0 - a), mark_ix)) AS x FROM un JOIN mk ON mk.utt = un.src GROUP BY ALL), nz AS (SELECT un.utt, step, arg_min(mark_ix, (abs(pos / 100.0 - z), mark_ix)) AS y FROM un JOIN mk ON mk.utt = un.src GROUP BY ALL),"
    " la AS (SELECT utt AS src, max(mark_ix) AS last FROM mk GROUP BY utt), ends AS (SELECT utt, min(step) AS s0, max(step) AS s1 FROM un GROUP BY utt),"
    " bo AS (SELECT un.utt, step, src, greatest(CASE WHEN step = s0 THEN x ELSE x - 2 END, 1) AS first_pm, least(CASE WHEN step = s1 THEN y ELSE y + 2 END, last - 1) AS last_pm, x, y FROM un JOIN na USING (utt, step) JOIN nz USING (utt, step) JOIN la USING (src) JOIN ends USING (utt)),"
    " bd AS (SELECT bo.utt, step, src, first_pm, last_pm, f.pos AS from_pos, l.pos AS to_pos, greatest(x - first_pm, 0) AS added_before, greatest(last_pm - y, 0) AS added_after FROM bo JOIN mk f ON f.utt = src AND f.mark_ix = first_pm - 1 JOIN mk l ON l.utt = src AND l.mark_ix = last_pm + 1)"
)


def _bounds(spark, d) -> DataFrame:
    s = _indexed(spark, d)
    units = s.select(F.floor(F.col("vec_id") / 25).alias("utt"), (F.col("vec_id") % 25).alias("step"), F.col("utt").alias("src"), (F.col("pos") / 100).alias("start"), ((F.col("pos") + 9) / 100).alias("end"))
    marks = _marks(spark, d).select(F.col("utt").alias("src"), F.col("mark_ix").alias("pm_ix"), "pos", (F.col("pos") / 100).alias("t"))
    return waves.segment_bounds(units, marks, 2)


@_query(f"WITH {_BOUNDS} SELECT * FROM bd")
def segments_at_marks(spark, d):
    return _bounds(spark, d).select("utt", "step", "src", "first_pm", "last_pm", "from_pos", "to_pos", "added_before", "added_after")


@_query(
    f"WITH {_BOUNDS}, ns AS (SELECT utt, step, src, from_pos, to_pos, to_pos - from_pos + 1 AS n FROM bd WHERE from_pos <= to_pos), o AS (SELECT *, coalesce(sum(n - 4) OVER (PARTITION BY utt ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM ns),"
    " x AS (SELECT o.utt, off + i AS pos, value * CASE WHEN i + 1 <= 4 THEN pow(sin((i + 1) * pi() / 10), 2) WHEN n - i <= 4 THEN pow(sin((n - i) * pi() / 10), 2) ELSE 1 END AS x FROM o CROSS JOIN unnest(range(n)) AS u(i) JOIN s ON s.utt = o.src AND s.pos = o.from_pos + i) SELECT utt, CAST(pos AS BIGINT) AS pos, round(sum(x), 6) AS value FROM x GROUP BY ALL"
)
def segments_concatenated(spark, d):
    """A waveform driver: segments at marks, one after the other with cross-faded ends."""
    samples = _indexed(spark, d).select(F.col("utt").alias("src"), "pos", "value")
    return waves.concatenated(_bounds(spark, d), samples, 4).select("utt", "pos", _r(F.col("value")).alias("value"))


@_query(
    f"WITH RECURSIVE {_TR}, f AS (SELECT utt, ix AS frame, ix // 12 AS seg, f0 * 5 AS f0 FROM t), r AS (SELECT *, sum(CASE WHEN f0 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY utt, seg ORDER BY frame) AS up, sum(CASE WHEN f0 > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY utt, seg ORDER BY frame DESC) AS down FROM f),"
    " s AS (SELECT utt, seg, median(f0) FILTER (WHERE f0 > 0 AND up BETWEEN 2 AND 5) AS head, median(f0) FILTER (WHERE f0 > 0 AND down BETWEEN 2 AND 5) AS tail, min(frame) FILTER (WHERE f0 > 0) AS a, max(frame) FILTER (WHERE f0 > 0) AS b, count(*) FILTER (WHERE f0 > 0) AS n, min(f0) FILTER (WHERE frame > seg * 12) AS low, max(f0) FILTER (WHERE frame > seg * 12) AS high FROM r GROUP BY utt, seg),"
    " g(utt, seg, tail, b, n, factor) AS (SELECT utt, seg, tail, b, n, CAST(1 AS DOUBLE) FROM s WHERE seg = 0 UNION ALL SELECT utt, seg, tail * factor, b, n, factor FROM (SELECT s.utt, s.seg, s.tail, s.b, s.n, CAST(CASE WHEN NOT coalesce(g.n >= 5 AND s.n >= 5 AND s.a - g.b < 8, FALSE) THEN 1 WHEN s.head > g.tail THEN CASE WHEN coalesce(s.low / round_even(s.head / g.tail, 0) > 48, TRUE) THEN 1 / round_even(s.head / g.tail, 0) ELSE 1 END WHEN coalesce(s.high * round_even(g.tail / s.head, 0) < 420, TRUE) THEN round_even(g.tail / s.head, 0) ELSE 1 END AS DOUBLE) AS factor FROM g JOIN s ON s.utt = g.utt AND s.seg = g.seg + 1)),"
    " m AS (SELECT utt, arg_min(factor, (-n, factor)) AS common FROM (SELECT utt, factor, sum(n) AS n FROM g WHERE n > 0 GROUP BY utt, factor) GROUP BY utt)"
    " SELECT f.utt, f.frame, round(CASE WHEN f0 > 0 THEN f0 * factor / common ELSE f0 END, 6) AS f0, round(CASE WHEN f0 > 0 THEN factor / common ELSE 1 END, 6) AS factor FROM f JOIN g USING (utt, seg) LEFT JOIN m USING (utt)"
)
def octaves_joined(spark, d):
    """F0 moved by octaves between segments of twelve frames; each factor depends on the one before."""
    t = _tracks(spark, d).select("utt", F.col("ix").alias("frame"), F.floor(F.col("ix") / 12).alias("segment"), (F.col("f0") * 5).alias("f0"))
    return waves.transposed(t).select("utt", "frame", _r(F.col("f0")).alias("f0"), _r(F.col("factor")).alias("factor"))


@_query(
    f"WITH {_E}, u AS (SELECT vec_id // 25 AS utt, vec_id % 25 AS step, list_transform(v[1:8], lambda x: CASE WHEN x > 0 THEN 100 + 300 * x ELSE 0.0 END) AS f, 30.0 + label AS ms, 0.5 AS c FROM e), a AS (SELECT *, list_sum(list_transform(range(8), lambda i: CASE WHEN f[i + 1] <= 0 THEN 5.0 WHEN i > 0 THEN 1000.0 / f[i + 1] ELSE 0 END)) AS dur, min(step) OVER (PARTITION BY utt) AS s0, max(step) OVER (PARTITION BY utt) AS s1 FROM u),"
    " b AS (SELECT *, CAST(floor(8 * ((1 - c) * dur + c * ms) / dur) AS BIGINT) AS k FROM a), g AS (SELECT utt, step, CASE WHEN step >= s0 + 2 AND step <> s1 AND k > 0 THEN list_transform(range(k), lambda i: f[CAST(floor(coalesce(i * 7.0 / nullif(k - 1, 0), 0)) AS BIGINT) + 1] + (f[least(CAST(floor(coalesce(i * 7.0 / nullif(k - 1, 0), 0)) AS BIGINT) + 1, 7) + 1] - f[CAST(floor(coalesce(i * 7.0 / nullif(k - 1, 0), 0)) AS BIGINT) + 1]) * (coalesce(i * 7.0 / nullif(k - 1, 0), 0) - floor(coalesce(i * 7.0 / nullif(k - 1, 0), 0)))) ELSE f END AS f, step >= s0 + 2 AND step <> s1 AND k > 0 AS changed FROM b), h AS (SELECT utt, step, CASE WHEN changed THEN list_transform(f, lambda x: CASE WHEN x < 100 THEN 0.0 ELSE x END) ELSE f END AS f FROM g)"
    " SELECT utt, step, CAST(len(f) AS INTEGER) AS n, round(list_sum(f), 4) AS total, CAST(len(f) + 4 AS INTEGER) AS n_frames FROM h"
)
def imposed_durations(spark, d):
    u = _vectors(spark, d).select(F.floor(F.col("vec_id") / 25).alias("utt"), (F.col("vec_id") % 25).alias("step"), F.transform(vectors.stream_slice(F.col("v"), 0, 8), lambda x: F.when(x > 0, 100 + 300 * x).otherwise(F.lit(0.0))).alias("f0"), (F.col("label") + 30.0).alias("target_ms"), F.lit(0.5).alias("confidence"), F.array_repeat(vectors.stream_slice(F.col("v"), 8, 4), 12).alias("frames"))
    return waves.durations_imposed(u).select("utt", "step", F.size("f0").alias("n"), _r(vectors.total(F.col("f0")), 4).alias("total"), F.size("frames").alias("n_frames"))


# --- frames at marks --------------------------------------------------------------------------------------------


def _line(x: str, y: str, t: str) -> str:
    """SQL for the line through the points of two lists at t, beyond its ends as well."""
    k = f"greatest(1, least(len({x}) - 1, len(list_filter({x}, lambda q: q <= {t}))))"
    return f"(CASE WHEN len({x}) = 1 THEN {y}[1] ELSE {y}[{k}] + ({y}[{k} + 1] - {y}[{k}]) * ({t} - {x}[{k}]) / ({x}[{k} + 1] - {x}[{k}]) END)"


_UNEVEN = f"{_SIG}, mk AS (SELECT utt, pos AS frame, pos * 5 + vec_id % 3 + 7 AS mpos, v, vec_id FROM s)"


def _uneven_marks(spark, d) -> DataFrame:
    """A mark about every five samples for each vector of a label."""
    return _indexed(spark, d).select("utt", F.col("pos").alias("frame"), (F.col("pos") * 5 + F.col("vec_id") % 3 + 7).alias("pos"), "v")


@_query(
    f"WITH {_UNEVEN}, sh AS (SELECT *, mpos - coalesce(lag(mpos) OVER (PARTITION BY utt ORDER BY frame), 0) AS l FROM mk), sr AS (SELECT *, coalesce(lead(l) OVER (PARTITION BY utt ORDER BY frame), l) AS r FROM sh), x AS (SELECT utt, mpos + i - 6 AS pos, v[i + 1] * CASE WHEN i = 6 THEN 1 ELSE 0.5 + 0.5 * cos(pi() * (i - 6) / CASE WHEN i < 6 THEN l ELSE r END) END AS x, abs(i - 6) <= CASE WHEN i < 6 THEN l ELSE r END AS inside FROM sr, unnest(range(12)) AS u(i))"
    " SELECT utt, pos, round(sum(x), 6) AS value FROM x WHERE inside AND pos >= 0 GROUP BY ALL"
)
def pitch_synchronous(spark, d):
    """Frames of twelve samples overlapped and added at marks of variable distance."""
    m = _uneven_marks(spark, d)
    out = pitchsync.pitch_overlap_added(m.select("utt", "frame", vectors.stream_slice(F.col("v"), 0, 12).alias("samples")), m)
    return out.select("utt", "pos", _r(F.col("value")).alias("value"))


@_query(
    f"WITH {_SIG}, cu AS (SELECT utt, pos AS step, pos AS a, pos + 3 AS m, pos + 7 + vec_id % 2 AS b FROM s WHERE pos % 4 = 0), fr AS (SELECT cu.*, i, coalesce(s.value, 0) AS x FROM cu, unnest(range(0, 9)) AS u(i) LEFT JOIN s ON s.utt = cu.utt AND s.pos = cu.a + i WHERE a + i <= b)"
    " SELECT utt, step, i, round(x * CASE WHEN i < 3 THEN 0.5 - 0.5 * cos(2 * pi() * i / 5) ELSE 0.5 - 0.5 * cos(2 * pi() * (i - 3 + b + 1 - m) / (2 * (b + 1 - m) - 1)) END, 6) AS value FROM fr"
)
def epoch_fragments(spark, d):
    """Fragments from a mark before to a mark after a middle, fading over both sides of it."""
    s = _indexed(spark, d)
    cuts = s.where("pos % 4 = 0").select("utt", F.col("pos").alias("step"), F.col("utt").alias("src"), F.col("pos").alias("start"), (F.col("pos") + 3).alias("middle"), (F.col("pos") + 7 + F.col("vec_id") % 2).alias("end"))
    out = pitchsync.cut_fragments(cuts, s.select(F.col("utt").alias("src"), "pos", "value"))
    return out.select("utt", "step", "i", _r(F.col("value")).alias("value"))


@_query(
    f"WITH {_UNEVEN}, li AS (SELECT utt, list(CAST(mpos AS DOUBLE) ORDER BY mpos) AS x, list(v[1] ORDER BY mpos) AS y, list(v[2] ORDER BY mpos) AS z FROM mk GROUP BY utt), g AS (SELECT *, k, k * 4.0::DOUBLE AS t FROM li, unnest(range(1, 100000)) AS u(k) WHERE k * 4 < x[-1] AND k * 4 >= x[1])"
    f" SELECT utt, k, round({_line('x', 'y', 't')}, 6) AS first, round({_line('x', 'z', 't')}, 6) AS second FROM g"
)
def constant_rate(spark, d):
    """Vectors at marks, read every four samples."""
    out = pitchsync.constant_rate(_uneven_marks(spark, d).select("utt", "pos", vectors.stream_slice(F.col("v"), 0, 2).alias("v")), 1000, 0.004)
    return out.select("utt", "k", _r(F.col("v")[0]).alias("first"), _r(F.col("v")[1]).alias("second"))


@_query(
    f"WITH RECURSIVE {_SIG}, li AS (SELECT utt, list((pos + 1) * 4.0::DOUBLE ORDER BY pos) AS x, list(3 + abs(v[1]) * 4 ORDER BY pos) AS y, list(v[2] ORDER BY pos) AS z FROM s GROUP BY utt), mk(utt, x, y, z, n, pos) AS (SELECT utt, x, y, z, 0, x[-1] FROM li UNION ALL SELECT utt, x, y, z, n + 1, p FROM (SELECT *, pos - {_line('x', 'y', 'pos')} AS p FROM mk) WHERE p >= x[1])"
    f" SELECT utt, max(n) OVER (PARTITION BY utt) - n AS mark, round(pos, 6) AS pos, round({_line('x', 'z', 'pos')}, 6) AS value FROM mk"
)
def variable_rate(spark, d):
    """Shifts known every four samples become marks, each read at the place reached, and frames are read at these."""
    s = _indexed(spark, d)
    k = (F.col("pos") + 1).alias("k")
    marks = pitchsync.marks_from_shifts(s.select("utt", k, (3 + F.abs(F.col("value")) * 4).alias("shift")), 1000, 0.004)
    out = pitchsync.variable_rate(s.select("utt", k, vectors.stream_slice(F.col("v"), 1, 1).alias("v")), marks, 1000, 0.004)
    return out.select("utt", "mark", _r(F.col("pos")).alias("pos"), _r(F.col("v")[0]).alias("value"))


@_query(
    f"WITH {_TR}, li AS (SELECT utt, count(*) AS n, list(ix * 3.0::DOUBLE ORDER BY ix) AS x, list(CAST(ix % 7 AS DOUBLE) ORDER BY ix) AS a, list(f0 ORDER BY ix) AS f, coalesce(list(ix * 3.0::DOUBLE ORDER BY ix) FILTER (WHERE f0 > 0), []) AS vx, coalesce(list(f0 ORDER BY ix) FILTER (WHERE f0 > 0), []) AS vy FROM t GROUP BY utt), g AS (SELECT *, CAST(k AS BIGINT) AS pos, k * 1.0::DOUBLE AS t FROM li, unnest(range(0, 100000)) AS u(k) WHERE k < 3 * n)"
    f" SELECT utt, pos, round({_line('x', 'a', 't')}, 6) AS ramp, round(CASE WHEN f[least(n, CAST(ceil(pos / 3.0 - 0.5) AS BIGINT) + 1)] > 0 THEN {_line('vx', 'vy', 't')} ELSE -1000 END, 6) AS f0 FROM g"
)
def upsampled_frames(spark, d):
    """A ramp and F0 for each of three samples a frame; F0 is held apart from voicing."""
    t = _tracks(spark, d)
    lengths = t.groupBy("utt").agg((F.count(F.lit(1)) * 3).alias("n"))
    out = pitchsync.upsampled(t.select("utt", "ix", F.array((F.col("ix") % 7).cast("double"), "f0").alias("v")), lengths, 300, 0.01, f0=1)
    return out.select("utt", "pos", _r(F.col("v")[0]).alias("ramp"), _r(F.col("v")[1]).alias("f0"))


# --- searches, walks and joins to judge -------------------------------------------------------------------------


_GRAPH = (
    f"{_CANDIDATES}, tok AS (SELECT vec_id // 25 AS doc, vec_id AS ix, 'p' || label AS w FROM e WHERE label IS NOT NULL UNION ALL SELECT vec_id // 25, max(vec_id) + 1, '</s>' FROM e WHERE label IS NOT NULL GROUP BY 1),"
    " g3 AS (SELECT a || ' ' || b AS h, w, count(*) AS c FROM (SELECT lag(w, 2, '<s>') OVER (PARTITION BY doc ORDER BY ix) AS a, lag(w, 1, '<s>') OVER (PARTITION BY doc ORDER BY ix) AS b, w FROM tok) GROUP BY ALL),"
    " g2 AS (SELECT split_part(h, ' ', 2) AS h, w, sum(c) AS c FROM g3 GROUP BY ALL), g1 AS (SELECT '' AS h, w, sum(c) AS c FROM g2 GROUP BY w),"
    " arcs AS (SELECT h, w, CASE WHEN w = '</s>' THEN w ELSE split_part(h, ' ', 2) || ' ' || w END AS n, -ln((c - 0.5) / sum(c) OVER (PARTITION BY h)) AS cost FROM g3 UNION ALL SELECT h, w, CASE WHEN w = '</s>' THEN w ELSE h || ' ' || w END, -ln((c - 0.5) / sum(c) OVER (PARTITION BY h)) FROM g2 UNION ALL SELECT h, w, w, -ln(c / sum(c) OVER ()) FROM g1),"
    " down3 AS (SELECT h, split_part(h, ' ', 2) AS v, -ln(0.5 * count(*) / sum(c)) AS cost FROM g3 GROUP BY h), down2 AS (SELECT h, '' AS v, -ln(0.5 * count(*) / sum(c)) AS cost FROM g2 GROUP BY h),"
    " ways AS (SELECT DISTINCT h, h AS v, CAST(0 AS DOUBLE) AS cost FROM arcs UNION ALL SELECT * FROM down3 UNION ALL SELECT * FROM down2 UNION ALL SELECT a.h, b.v, a.cost + b.cost FROM down3 a JOIN down2 b ON b.h = a.v),"
    " lat AS (SELECT c.utt, c.step, c.id, 'p' || label AS w, tc FROM c JOIN e ON e.vec_id = c.id WHERE step < 3 AND label IS NOT NULL), lat2 AS (SELECT * FROM lat UNION ALL SELECT utt, max(step) + 1, NULL, '</s>', 0 FROM lat GROUP BY utt)"
)


def _composed(spark, d, steps: int | None = None):
    """Candidates composed with the graph over their labels; with ``steps`` only the first ones of each utterance."""
    e = _vectors(spark, d).where("label IS NOT NULL")
    token = F.concat(F.lit("p"), F.col("label").cast("string"))
    graph = graphs.ngram_graph(e.select(F.floor(F.col("vec_id") / 25).alias("doc"), F.col("vec_id").alias("ix"), token.alias("token")))
    candidates = _candidates(spark, d)
    if steps is not None:
        candidates = candidates.where(F.col("step") < steps)
    lattice = candidates.join(e.select(F.col("vec_id").alias("unit_id"), token.alias("token")), "unit_id")
    return graphs.composed(graph, lattice)


@_query(
    f"WITH RECURSIVE {_GRAPH}, best(utt, step, state, total, path) AS (SELECT DISTINCT utt, CAST(-1 AS BIGINT), '<s> <s>', CAST(0 AS DOUBLE), CAST([] AS BIGINT[]) FROM lat UNION ALL SELECT * FROM (SELECT b.utt, b.step + 1 AS step, a.n AS state, min(total + y.cost + a.cost + l.tc) AS total, arg_min(list_append(path, l.id), total + y.cost + a.cost + l.tc) AS path FROM best b JOIN ways y ON y.h = b.state JOIN lat2 l ON l.utt = b.utt AND l.step = b.step + 1 JOIN arcs a ON a.h = y.v AND a.w = l.w GROUP BY b.utt, b.step, a.n))"
    " SELECT utt, i - 1 AS step, path[i] AS unit_id, round(total, 6) AS total FROM best, unnest(range(1, len(path))) AS u(i) WHERE state = '</s>'"
)
def graph_paths(spark, d):
    """Best paths of candidates through an n-gram graph with backoff over their labels (the first three steps)."""
    return graphs.best_paths(_composed(spark, d, 3)).select("utt", "step", "unit_id", _r(F.col("total")).alias("total"))


# The same over whole utterances; what recursions read again and again is made once.
_WHOLE_GRAPH = _GRAPH.replace("WHERE step < 3 AND label", "WHERE label").replace(" arcs AS (", " arcs AS MATERIALIZED (").replace(" ways AS (", " ways AS MATERIALIZED (").replace(" lat AS (", " lat AS MATERIALIZED (").replace(" lat2 AS (", " lat2 AS MATERIALIZED (")


@_query(
    f"WITH RECURSIVE {_WHOLE_GRAPH}, reach(utt, step, state) AS (SELECT DISTINCT utt, CAST(0 AS BIGINT), '<s> <s>' FROM lat UNION SELECT r.utt, r.step + 1, a.n FROM reach r JOIN ways y ON y.h = r.state JOIN lat2 l ON l.utt = r.utt AND l.step = r.step JOIN arcs a ON a.h = y.v AND a.w = l.w),"
    " edge AS MATERIALIZED (SELECT utt, step, state, id, n, ln(w) AS lw FROM (SELECT r.utt, r.step, r.state, l.id, a.n, sum(exp(-(y.cost + a.cost + l.tc))) AS w FROM reach r JOIN ways y ON y.h = r.state JOIN lat2 l ON l.utt = r.utt AND l.step = r.step JOIN arcs a ON a.h = y.v AND a.w = l.w GROUP BY ALL) WHERE w > 0),"
    " ahead(utt, step, state, t) AS (SELECT utt, step, state, max(m) + ln(sum(exp(lw - m))) FROM (SELECT *, max(lw) OVER (PARTITION BY utt, step, state) AS m FROM edge WHERE n = '</s>') GROUP BY utt, step, state UNION ALL SELECT * FROM (SELECT utt, step, state, max(m) + ln(sum(exp(w - m))) AS t FROM (SELECT x.utt, x.step, x.state, x.lw + b.t AS w, max(x.lw + b.t) OVER (PARTITION BY x.utt, x.step, x.state) AS m FROM ahead b JOIN edge x ON x.utt = b.utt AND x.step = b.step - 1 AND x.n = b.state) GROUP BY utt, step, state)),"
    " every AS (SELECT x.utt, x.step, x.state, x.id, x.n, x.lw + CASE WHEN x.n = '</s>' THEN 0 ELSE b.t END AS lw FROM edge x LEFT JOIN ahead b ON b.utt = x.utt AND b.step = x.step + 1 AND b.state = x.n WHERE x.n = '</s>' OR b.t IS NOT NULL), shares AS (SELECT *, exp(lw - max(lw) OVER (PARTITION BY utt, step, state)) AS w FROM every),"
    " cum AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY utt, step, state ORDER BY id NULLS FIRST, n) AS until, sum(w) OVER (PARTITION BY utt, step, state) AS total FROM shares),"
    " walk(utt, sample, step, state, id) AS (SELECT DISTINCT utt, s, CAST(0 AS BIGINT), '<s> <s>', CAST(NULL AS BIGINT) FROM cum, range(2) AS r(s) WHERE step = 0 UNION ALL SELECT utt, sample, step + 1, m.n, m.id FROM (SELECT k.utt, k.sample, k.step, arg_min({'id': c.id, 'n': c.n}, c.until) AS m FROM walk k JOIN cum c ON c.utt = k.utt AND c.step = k.step AND c.state = k.state WHERE c.until > CAST('0x' || substr(md5('1234:' || k.utt || ':' || k.sample || ':' || k.step), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE * c.total GROUP BY k.utt, k.sample, k.step))"
    " SELECT utt, CAST(sample AS INTEGER) AS sample, step - 1 AS step, id AS unit_id FROM walk WHERE id IS NOT NULL"
)
def graph_samples(spark, d):
    """Two seeded paths of each whole utterance through the same graph, drawn by their weights."""
    return graphs.sampled_paths(_composed(spark, d), 2)


@_query(
    f"WITH RECURSIVE {_E}, u AS (SELECT vec_id, v[1:16] AS v FROM e WHERE vec_id + 1 IN (SELECT vec_id FROM e)), w(walk, step, id) AS (SELECT vec_id, CAST(0 AS BIGINT), vec_id FROM e WHERE vec_id % 100 = 0"
    " UNION ALL SELECT walk, step + 1, near[1 + CAST('0x' || substr(md5('1234:' || walk || ':' || (step + 1)), 1, 8) AS BIGINT) % len(near)] + 1 FROM (SELECT w.walk, w.step, list(u.vec_id ORDER BY list_distance(u.v, c.v[1:16]), u.vec_id)[1:4] AS near FROM w JOIN e c ON c.vec_id = w.id JOIN u ON u.vec_id < w.id - 2 OR u.vec_id > w.id WHERE w.step < 3 GROUP BY w.walk, w.step))"
    " SELECT walk, step, id AS unit_id FROM w"
)
def random_walks(spark, d):
    """Walks from every hundredth unit: to the unit after one of the four nearest ones, by a seeded draw."""
    u = _vectors(spark, d).select(F.col("vec_id").alias("unit_id"), vectors.stream_slice(F.col("v"), 0, 16).alias("v"))
    starts = u.where("unit_id % 100 = 0").select(F.col("unit_id").alias("walk"), "unit_id")
    return search.random_walks(u, starts, 3, k=4, span=2)


@_query(
    f"WITH RECURSIVE {_E}, u AS (SELECT vec_id AS id, v[1] AS c1, v[2] AS c2, v[3:10] AS t, v[11] AS sample FROM e), tg AS (SELECT vec_id // 3 AS utt, vec_id % 3 AS step, v[20:27] AS t FROM e),"
    " path(utt, step, x, a, b) AS (SELECT DISTINCT utt, CAST(-1 AS BIGINT), NULL::STRUCT(id BIGINT, sample DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM tg"
    " UNION ALL SELECT utt, step, x, b, x.sample FROM (SELECT utt, step, b, near[1 + CAST('0x' || substr(md5('1234:' || utt || ':' || step), 1, 8) AS BIGINT) % len(near)] AS x FROM (SELECT p.utt, tg.step, p.b, list({'id': u.id, 'sample': u.sample} ORDER BY pow(list_distance(u.t, tg.t), 2) + pow(u.c1 - p.a, 2) + pow(u.c2 - p.b, 2), u.id)[1:3] AS near FROM path p JOIN tg ON tg.utt = p.utt AND tg.step = p.step + 1, u GROUP BY p.utt, tg.step, p.b)))"
    " SELECT utt, step, x.id AS unit_id, round(x.sample, 6) AS sample FROM path WHERE step >= 0"
)
def sampled_frames(spark, d):
    """Autoregressive selection of samples: one of the three nearest to the last two samples and the frame."""
    e = _vectors(spark, d)
    part = lambda a, n: vectors.stream_slice(F.col("v"), a, n)
    units = e.select(F.col("vec_id").alias("unit_id"), part(0, 2).alias("context"), part(2, 8).alias("target"), F.col("v")[10].alias("sample"))
    frames = e.select(F.floor(F.col("vec_id") / 3).alias("utt"), (F.col("vec_id") % 3).alias("step"), part(19, 8).alias("target"))
    return search.next_samples(units, frames, 2, k=3).select("utt", "step", "unit_id", _r(F.col("sample")).alias("sample"))


@_query(f"WITH {_E}, p AS (SELECT vec_id // 25 AS utt, vec_id % 25 AS step, (vec_id * 7) % (SELECT count(*) FROM e) AS unit_id FROM e), x AS (SELECT p.utt, p.step, a.v AS v, lead(a.v) OVER (PARTITION BY p.utt ORDER BY p.step) AS w FROM p JOIN e a ON a.vec_id = p.unit_id), y AS (SELECT utt, step, list_transform(range(1, 65), lambda i: pow(v[i] - w[i], 2)) AS s FROM x WHERE w IS NOT NULL) SELECT utt, step, round(list_sum(s[1:24]), 6) AS cost_mag, round(list_sum(s[25:44]), 6) AS cost_real, round(list_sum(s[45:63]), 6) AS cost_imag, round(s[64], 6) AS cost_lf0 FROM y")
def join_costs_of_path(spark, d):
    e = _vectors(spark, d)
    n = e.count()
    path = e.select(F.floor(F.col("vec_id") / 25).alias("utt"), (F.col("vec_id") % 25).alias("step"), (F.col("vec_id") * 7 % n).alias("unit_id"))
    out = diagnostics.join_costs_by_stream(path, e.select(F.col("vec_id").alias("unit_id"), F.col("v").alias("start"), F.col("v").alias("end")), STREAMS)
    return out.select("utt", "step", *(_r(F.col(c)).alias(c) for c in out.columns[2:]))


@_query(f"WITH {_CANDIDATES}, pos AS (SELECT a.vec_id AS f, b.vec_id AS t FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 AND b.label = a.label), neg AS (SELECT DISTINCT a.id AS f, b.id AS t FROM c a JOIN c b ON b.utt = a.utt AND b.step = a.step + 1 WHERE b.id <> a.id + 1) SELECT f AS from_id, t AS to_id, true AS ok FROM pos UNION ALL SELECT f, t, false FROM neg")
def joins_to_judge(spark, d):
    e = _vectors(spark, d).select(F.col("vec_id").alias("unit_id"), F.col("label").alias("utt"))
    return joins.join_examples(e, _candidates(spark, d))


_WALK = "CAST('0x' || substr(md5('1234:' || w.walk || ':' || {step}), 1, 8) AS BIGINT)"


@_query(
    "WITH RECURSIVE u AS (SELECT vec_id AS id, label AS phone, CASE WHEN (vec_id // 3) % 2 = 0 THEN 'L' ELSE 'R' END AS half FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY phone, half ORDER BY id) - 1 AS rk, count(*) OVER (PARTITION BY phone, half) AS n FROM u),"
    " nx AS (SELECT a.id, CASE WHEN a.half = 'L' THEN a.phone ELSE b.phone END AS phone, CASE WHEN a.half = 'L' THEN 'R' ELSE 'L' END AS half FROM u a LEFT JOIN u b ON b.id = a.id + 1), cnt AS (SELECT phone, half, count(*) AS n FROM u GROUP BY ALL),"
    f" w(walk, step, id) AS (SELECT id, 0, id FROM u WHERE id % 100 = 0 UNION ALL SELECT w.walk, w.step + 1, r.id FROM w JOIN nx ON nx.id = w.id JOIN cnt ON cnt.phone = nx.phone AND cnt.half = nx.half JOIN r ON r.phone = nx.phone AND r.half = nx.half AND r.rk = {_WALK.format(step='(w.step + 1)')} % cnt.n WHERE w.step < 6) SELECT walk, CAST(step AS INTEGER) AS step, id AS unit_id FROM w"
)
def transition_walks(spark, d):
    """Walks of six steps over the transition table, from every unit whose id is divisible by 100."""
    u = _t(spark, d, "embeddings").select(F.col("vec_id").alias("unit_id"), F.col("label").alias("phone"), F.when(F.floor(F.col("vec_id") / 3) % 2 == 0, F.lit("L")).otherwise(F.lit("R")).alias("half"))
    return search.transition_walks(u, u.where("unit_id % 100 = 0").select(F.col("unit_id").alias("walk"), "unit_id"), 6)


_CODES = f"{_E}, k AS (SELECT vec_id AS ix, label AS code FROM e), q AS (SELECT vec_id // 40 AS utt, vec_id % 40 AS ix, label + CASE WHEN vec_id % 9 = 0 THEN 1 ELSE 0 END AS code FROM e)"


def _codes(spark, d) -> tuple[DataFrame, DataFrame]:
    e = _t(spark, d, "embeddings")
    corpus = e.select(F.col("vec_id").alias("ix"), F.col("label").alias("code"))
    return corpus, e.select(F.floor(F.col("vec_id") / 40).alias("utt"), (F.col("vec_id") % 40).alias("ix"), (F.col("label") + F.when(F.col("vec_id") % 9 == 0, 1).otherwise(0)).alias("code"))


@_query(
    f"WITH RECURSIVE {_CODES}, g AS (SELECT n, string_agg(b.code, ' ' ORDER BY b.ix) AS gram, a.ix FROM k a CROSS JOIN unnest(range(1, 5)) AS u(n) JOIN k b ON b.ix >= a.ix AND b.ix < a.ix + n GROUP BY n, a.ix HAVING count(*) = n), i AS (SELECT gram, n, min(ix) AS place FROM g GROUP BY gram, n),"
    " p AS (SELECT n, string_agg(b.code, ' ' ORDER BY b.ix) AS gram, a.utt, a.ix FROM q a CROSS JOIN unnest(range(1, 5)) AS u(n) JOIN q b ON b.utt = a.utt AND b.ix >= a.ix AND b.ix < a.ix + n GROUP BY n, a.utt, a.ix HAVING count(*) = n), m AS (SELECT p.utt, p.ix, max(p.n) AS n, arg_max(i.place, p.n) AS place FROM p JOIN i USING (gram, n) GROUP BY p.utt, p.ix),"
    " f AS (SELECT q.utt, q.ix, coalesce(m.n, 1) AS n, coalesce(m.place, -1) AS place FROM q LEFT JOIN m USING (utt, ix)), w AS (SELECT * FROM f WHERE ix = 0 UNION ALL SELECT f.* FROM w JOIN f ON f.utt = w.utt AND f.ix = w.ix + w.n) SELECT utt, ix, CAST(n AS INTEGER) AS n, place AS position FROM w"
)
def longest_tiles(spark, d):
    """Paths of codes covered by the longest runs that the corpus has."""
    corpus, paths = _codes(spark, d)
    return search.tile_paths(paths, corpus, 4).withColumnRenamed("at", "position")


@_query(
    f"WITH {_CODES}, g AS (SELECT a.ix, list(b.code ORDER BY b.ix) AS x FROM k a JOIN k b ON b.ix >= a.ix AND b.ix < a.ix + 3 GROUP BY a.ix HAVING count(*) = 3), i AS (SELECT 0 AS lv, CAST(x AS VARCHAR) AS gram, min(ix) AS place FROM g GROUP BY ALL UNION ALL SELECT 1, CAST(list_transform(x, lambda c: c // 4) AS VARCHAR), min(ix) FROM g GROUP BY ALL),"
    " c AS (SELECT utt, ix // 3 AS chunk, list(code ORDER BY ix) AS x FROM q GROUP BY ALL HAVING count(*) = 3), p AS (SELECT utt, chunk, 0 AS lv, CAST(x AS VARCHAR) AS gram FROM c UNION ALL SELECT utt, chunk, 1, CAST(list_transform(x, lambda c: c // 4) AS VARCHAR) FROM c) SELECT utt, chunk, CAST(min(p.lv) AS INTEGER) AS level, arg_min(place, p.lv) AS position FROM p JOIN i USING (lv, gram) GROUP BY utt, chunk"
)
def tiles_by_resolution(spark, d):
    """Chunks of three codes by the finest of two codebooks whose corpus has them."""
    corpus, paths = _codes(spark, d)
    return search.chunk_tiles(paths, corpus, 3, [F.col("code"), F.floor(F.col("code") / 4)])


@_query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY md5('1234:' || event_id), event_id) AS r FROM events) WHERE r <= 50")
def hash_sample(spark, d):
    """A repeatable sample of 50 rows: the sampling operator's own limit."""
    return select.sample_rows(_t(spark, d, "events").select("event_id", "event_type"), 50, "event_id")


@_query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('1234:' || event_id), event_id) AS r FROM events) WHERE r <= 20")
def class_sample(spark, d):
    """A repeatable sample of 20 rows of each class: the sampling operator's own limit."""
    return select.sample_classes(_t(spark, d, "events").select("event_id", "event_type"), "event_type", 20, "event_id")


@_query("WITH f AS (SELECT unnest(range(0, (SELECT count(*) FROM events) - 20, 20)) AS start) SELECT start FROM (SELECT start, row_number() OVER (ORDER BY md5('1234:' || start), start) AS r FROM f) WHERE r <= 15")
def held_out_starts(spark, d):
    """Starts of fragments of 20 rows, chosen without replacement: the operator's own limit of 15."""
    return select.fragment_starts(spark, _t(spark, d, "events").count(), 20, 15)


@_query("SELECT user_id, n FROM (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) ORDER BY n DESC, user_id LIMIT 10")
def largest_users(spark, d):
    """The ten users of most events: a report's own limit."""
    return _t(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(10)


@_query("WITH s AS (SELECT user_id, count(*) AS n, median(value) AS mid, (array_agg(event_type ORDER BY c DESC, event_type))[1] AS often FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS c FROM events) GROUP BY user_id) SELECT user_id, n, round(mid, 6) AS mid, often FROM s")
def median_and_mode(spark, d):
    """From ranks and counts: a user of many events is no single task's."""
    e = _t(spark, d, "events")
    mid = select.group_medians(e, "user_id", "value").select("user_id", "n", _r(F.col("median")).alias("mid"))
    return mid.join(select.group_modes(e, "user_id", "event_type").withColumnRenamed("mode", "often"), "user_id")


@_query(f"WITH {_E} SELECT label AS utt, round(sqrt(sum(pow(v[1] - v[2], 2))), 6) AS error FROM e GROUP BY label")
def reconstruction_errors(spark, d):
    pairs = _vectors(spark, d).select(F.col("label").alias("utt"), F.col("v")[0].alias("wanted"), F.col("v")[1].alias("got"))
    return diagnostics.reconstruction_error(pairs).select("utt", _r(F.col("error")).alias("error"))
