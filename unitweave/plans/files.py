"""Queries over files and stored tables that are written from the driver's tables and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitweave.functions import vectors
from unitweave.operators import joins, knn, tuning
from unitweave.plans import config
from unitweave.plans.catalog import _CANDIDATES, _E, STREAMS, _candidates, _query, _r, _t, _targets, _vectors
from unitweave.sources import files, formats, tables
from unitweave.sources.scratch import fresh_path, kept


def _numbered(df: DataFrame, key: str, *order: str) -> DataFrame:
    return df.where(F.col(key).isNotNull()).withColumn("frame", (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


@_query(f"WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM e WHERE label IS NOT NULL) SELECT 'u' || label AS utt, frame, CAST(len(v) AS INTEGER) AS dim, round(v[1], 5) AS first, round(list_sum(v), 4) AS total FROM n WHERE frame >= 3 AND label <> 1")
def matrix_round_trip(spark, d):
    """Float matrices: written, read in byte ranges, without one file and without the first rows of the others."""
    formats.register(spark)
    at = fresh_path(spark, "matrices")
    rows = _numbered(_vectors(spark, d), "label", "vec_id").select(F.concat(F.lit("u"), F.col("label").cast("string")).alias("utt"), "frame", F.col("v").cast("array<float>").alias("v"))
    formats.by_utterance(rows, "frame").write.format("speech-matrix").option("dim", 64).option("suffix", ".f32").mode("append").save(at)
    back = spark.read.format("speech-matrix").option("dim", 64).option("suffix", ".f32").option("range_bytes", 1 << 16).load(at).where("frame >= 3 AND utt <> 'u1'")
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("utt", "frame", F.size("v").alias("dim"), _r(F.col("v")[0].cast("double"), 5).alias("first"), _r(total, 4).alias("total"))


_EV = "n AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame FROM events WHERE user_id IS NOT NULL)"


def _events(spark, d) -> DataFrame:
    e = _numbered(_t(spark, d, "events"), "user_id", "ts", "event_id")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("utt"), "frame", F.coalesce("value", F.lit(0.0)).alias("value"), "user_id")


@_query(f"WITH {_EV} SELECT 'u' || user_id AS utt, frame, CAST(greatest(-32768, least(32767, round_even(coalesce(value, 0) * 700, 0))) AS INTEGER) AS a, CAST(frame % 100 AS INTEGER) AS b FROM n WHERE frame < 40")
def shorts_round_trip(spark, d):
    """Matrices of 16-bit numbers, clipped, of which the first forty rows are read."""
    formats.register(spark)
    at = fresh_path(spark, "shorts")
    rows = _events(spark, d).select("utt", "frame", F.array(F.col("value") * 700, (F.col("frame") % 100).cast("double")).alias("v"))
    formats.by_utterance(rows, "frame").write.format("speech-matrix").option("dim", 2).option("dtype", "int16").mode("append").save(at)
    back = spark.read.format("speech-matrix").option("dim", 2).option("dtype", "int16").load(at).where("frame < 40")
    return back.select("utt", "frame", F.col("v")[0].cast("int").alias("a"), F.col("v")[1].cast("int").alias("b"))


@_query(f"WITH {_EV} SELECT 'u' || user_id AS utt, frame AS pos, 16000 AS rate, CAST(greatest(-32768, least(32767, round_even(coalesce(value, 0) * 900, 0))) AS INTEGER) AS value FROM n")
def wave_round_trip(spark, d):
    """Waves of 16-bit samples, clipped, read in ranges."""
    formats.register(spark)
    at = fresh_path(spark, "waves")
    e = _events(spark, d)
    e = e.withColumns({"n": F.count(F.lit(1)).over(Window.partitionBy("utt")), "part": F.floor(F.col("frame") / 512)})
    rows = e.groupBy("utt", "n", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "value"))), lambda x: x["value"] * 900).alias("samples"))  # up to 512
    formats.by_utterance(rows.withColumn("rate", F.lit(16000)), "part").select("utt", "rate", "n", "samples").write.format("speech-wave").option("suffix", ".wav").mode("append").save(at)
    back = spark.read.format("speech-wave").option("mono", "true").option("range_bytes", 4096).load(at)
    return back.select("utt", "rate", "pos", F.posexplode("samples").alias("i", "value")).select("utt", (F.col("pos") + F.col("i")).alias("pos"), "rate", F.col("value").cast("int").alias("value"))


@_query(f"WITH {_EV}, m AS (SELECT 'u' || user_id AS utt, frame, CASE WHEN user_id % 7 = 3 AND frame = 2 THEN 0.001::DOUBLE ELSE 0.01::DOUBLE + round(frame * 0.005::DOUBLE, 3) END AS t, CASE WHEN value > 5 THEN 1 ELSE 0 END AS voiced, max(frame) OVER (PARTITION BY user_id) AS last, user_id % 7 = 3 AND max(frame) OVER (PARTITION BY user_id) >= 2 AS falls FROM n) SELECT utt, CAST(frame AS INTEGER) AS pm_ix, round(t, 6) AS t_sec, voiced FROM m WHERE NOT falls AND frame < last")
def marks_round_trip(spark, d):
    """Pitch marks as text with a header: files whose marks fall are left out, and the last mark of each."""
    at = fresh_path(spark, "marks")
    t = F.when((F.col("user_id") % 7 == 3) & (F.col("frame") == 2), F.lit(0.001)).otherwise(0.01 + F.round(F.col("frame") * 0.005, 3))
    line = F.format_string("%.6f %d 1", t, F.when(F.col("value") > 5, F.lit(1)).otherwise(F.lit(0)))
    text = _events(spark, d).groupBy("utt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))  # one file's lines
    files.write_files(text.select("utt", F.concat(F.lit("EST_File Track\nDataType ascii\nEST_Header_End\n"), "text", F.lit("\n")).cast("binary").alias("content")), at, ".pm")
    return files.read_marks(spark, at, drop_last=True).select("utt", "pm_ix", _r(F.col("t_sec")).alias("t_sec"), "voiced")


_PHONES = "p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS seq, coalesce(role, 'x') AS c FROM conversations WHERE conv_id IS NOT NULL)"


def _turns(spark, d) -> DataFrame:
    c = _t(spark, d, "conversations")
    return c.where("conv_id IS NOT NULL").select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("utt"), (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).alias("seq"), F.coalesce("role", F.lit("x")).alias("c"))


@_query(f"WITH {_PHONES} SELECT 'c' || conv_id AS utt, CAST(seq AS INTEGER) AS seq, CAST(seq * 3 AS INTEGER) AS start, CAST(seq * 3 + 3 AS INTEGER) AS \"end\", 'a' AS ll, 'b' AS l, c, 'd' AS r, 'e' AS rr, CAST(2 + seq % 5 AS VARCHAR) AS state FROM p")
def labels_round_trip(spark, d):
    """State labels: lines of times and a quinphone with its state."""
    at = fresh_path(spark, "labels")
    line = F.format_string("%d %d a^b-%s+d=e@x[%d]", F.col("seq") * 150_000, F.col("seq") * 150_000 + 150_000, F.col("c"), 2 + F.col("seq") % 5)
    text = _turns(spark, d).groupBy("utt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))  # one file's lines
    files.write_files(text.select("utt", F.col("text").cast("binary").alias("content")), at, ".lab")
    return files.read_labels(spark, at, r"([^~]+)\^([^~]+)-([^~]+)\+([^~]+)=([^~]+)@")


@_query(f"WITH {_PHONES} SELECT 'c' || conv_id AS utt, CAST(seq + 1 AS INTEGER) AS seq, c AS third FROM p WHERE seq % 3 <> 0")
def utterances_round_trip(spark, d):
    """Utterance files, of which the lines of phones are kept."""
    at = fresh_path(spark, "utterances")
    line = F.format_string("%d id %s ; a b c %s x", F.col("seq"), F.col("c"), F.when(F.col("seq") % 3 != 0, F.lit("ph1")).otherwise(F.lit("syl")))
    text = _turns(spark, d).groupBy("utt").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))  # one file's lines
    files.write_files(text.select("utt", F.concat(F.lit("Stream_Items\n"), "text").cast("binary").alias("content")), at, ".utt")
    return files.read_utterances(spark, at).select("utt", "seq", F.col("tokens")[2].alias("third"))


@_query("WITH n AS (SELECT DISTINCT p_brand AS line FROM part WHERE trim(coalesce(p_brand, '')) <> '') SELECT trim(line) AS line, CAST(count(*) AS BIGINT) AS n FROM n GROUP BY ALL")
def lines_round_trip(spark, d):
    """A list of names as a text file."""
    at = fresh_path(spark, "lists")
    names = _t(spark, d, "part").select(F.concat(F.lit(" "), "p_brand").alias("line")).distinct()
    files.write_lines(names.unionAll(names.select(F.lit("").alias("line")).distinct()), "line", at)
    return files.read_lines(spark, at).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM e WHERE label IS NOT NULL) SELECT 'u' || label AS utt, 'mag' AS stream, frame, round(list_sum(v[1:24]), 4) AS total FROM n UNION ALL SELECT 'u' || label, 'lf0', frame, round(v[64], 4) FROM n")
def stream_folders_read(spark, d):
    """Two streams, each found in the one folder that has it."""
    formats.register(spark)
    places, dims = [fresh_path(spark, f"folder{k}") for k in range(2)], {"mag": 24, "lf0": 1}
    rows = _numbered(_vectors(spark, d), "label", "vec_id").withColumn("utt", F.concat(F.lit("u"), F.col("label").cast("string")))
    for place, (name, a, n) in zip(places, (("mag", 1, 24), ("lf0", 64, 1))):
        own = rows.select("utt", "frame", F.slice("v", a, n).cast("array<float>").alias("v"))
        formats.by_utterance(own, "frame").write.format("speech-matrix").option("dim", n).option("suffix", f".{name}").mode("append").save(f"{place}/{name}")
    back = files.read_streams(spark, places, dims)
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return back.select("utt", "stream", F.col("frame").cast("long").alias("frame"), _r(total, 4).alias("total"))


@_query(f"WITH {_E}, n AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM e WHERE label IS NOT NULL) SELECT label, count(*) AS units, count(*) FILTER (WHERE frame % 4 <> 0) AS complete, round(sum(CASE WHEN frame % 4 <> 0 THEN v[1] + v[30] END), 4) AS total FROM n GROUP BY label")
def database_round_trip(spark, d):
    """A unit database that is not written over unasked, its columns read alone, and frames that all streams have."""
    root = fresh_path(spark, "database")
    base = tables.UnitDatabase(spark, root, {"join_weight": 0.3, "streams": ["mag", "real"]})
    rows = _numbered(_vectors(spark, d), "label", "vec_id")
    base.write("units", rows.select("vec_id", "label", "frame", "v"), by="label")
    try:
        base.write("units", rows)
        raise AssertionError("written over")
    except Exception as e:
        if "written over" in str(e):
            raise
    base.write("units", rows.select("vec_id", "label", "frame", "v"), overwrite=True, by="label")
    units = base.read("units", "label", "frame", "v")
    stream = lambda k: units.select(F.col("label").alias("utt"), "frame", F.slice("v", k, 1).alias("v"))
    whole = tables.spectra({"mag": stream(1), "real": stream(30).where("frame % 4 <> 0")})
    joined = whole.groupBy(F.col("utt").alias("label")).agg(F.count(F.lit(1)).alias("complete"), _r(F.sum(F.col("mag")[0] + F.col("real")[0]), 4).alias("total"))
    counts = base.read("units", "label").groupBy("label").agg(F.count(F.lit(1)).alias("units"))
    return counts.join(joined, "label", "left").select(F.col("label").cast("int").alias("label"), "units", F.coalesce("complete", F.lit(0)).alias("complete"), "total")


@_query(
    f"WITH {_E}, near AS (SELECT a.vec_id AS f, b.vec_id AS t, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_distance(a.v, b.v), b.vec_id) AS r FROM e a, e b), every AS (SELECT f, t FROM near WHERE r <= 3 UNION ALL SELECT a.vec_id, a.vec_id + 1 FROM e a SEMI JOIN e b ON b.vec_id = a.vec_id + 1)"
    " SELECT f AS from_index, count(*) AS n, count(DISTINCT t) AS n_different, count(*) FILTER (WHERE t = f + 1) AS n_natural, count(*) FILTER (WHERE f % 100 = 0) AS n_looked_up FROM every GROUP BY f"
)
def transition_lists(spark, d):
    """Two lists of transitions appended to one stored table, scanned, and looked up for every hundredth unit."""
    e = _vectors(spark, d)
    table = tables.TransitionTable(spark, fresh_path(spark, "transitions"))
    near = knn.k_nearest(e.select(F.col("vec_id").alias("q"), "v"), e.select(F.col("vec_id").alias("u"), "v"), 3)
    table.append(near.select(F.col("q").alias("from_index"), F.col("u").alias("to_index")))
    table.append(joins.successors(e, "vec_id").select(F.col("from_id").alias("from_index"), F.col("to_id").alias("to_index")))
    counts = table.scan().groupBy("from_index").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("to_index").alias("n_different"), F.count_if("natural").alias("n_natural"))
    looked = table.of_all(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("unit_id"))).groupBy(F.col("from_index").alias("f")).agg(F.count(F.lit(1)).alias("n_looked_up"))
    out = counts.join(looked, F.col("from_index") == F.col("f"), "left")
    return out.select(F.col("from_index").cast("long").alias("from_index"), "n", "n_different", "n_natural", F.coalesce("n_looked_up", F.lit(0)).alias("n_looked_up"))


_ORDERED = "n AS (SELECT label AS utt, vec_id AS frame, v, substr(md5('1234:' || label || ':' || vec_id), 1, 14) AS o, CAST('0x' || substr(md5('1234:' || label), 1, 8) AS BIGINT) < CAST(0.2 * 4294967296 AS BIGINT) AS held FROM e WHERE label IS NOT NULL)"


@_query(
    f"WITH {_E}, {_ORDERED}, p AS (SELECT x.epoch, utt, frame, v, row_number() OVER (PARTITION BY x.epoch ORDER BY substr(md5(x.epoch || ':' || o), 1, 14), utt, frame) - 1 AS r FROM n, (SELECT unnest([0, 1]) AS epoch) x WHERE NOT held AND frame % 9 <> 0)"
    " SELECT CAST(epoch AS INTEGER) AS epoch, r // 16 AS batch, r % 16 AS row, frame, round(v[1] + v[64], 6) AS total FROM p WHERE epoch = 0 OR r // 16 >= 2"
)
def mini_batches(spark, d):
    """Batches of two epochs of the training part, each in an order of its own; the second resumes at its third batch."""
    e = _vectors(spark, d).where("label IS NOT NULL").select(F.col("label").alias("utt"), F.col("vec_id").alias("frame"), "v")
    train, _ = tables.split(e, "utt", 0.2)
    streams = {"mag": train, "lf0": train.where("frame % 9 <> 0").withColumn("v", F.slice("v", 64, 1))}
    parts = [tables.mini_batches(streams, 16, epoch, first=first).withColumn("epoch", F.lit(epoch)) for epoch, first in ((0, 0), (1, 2))]
    return parts[0].unionByName(parts[1]).select("epoch", "batch", "row", "frame", _r(F.col("mag")[0] + F.col("lf0")[0]).alias("total"))


def _epoch_sql(k: int) -> str:
    """One pass of balancing: costs under the weights w{k}, then the state of the next pass."""
    return (
        f"x{k} AS (SELECT w.cand, c.item, c.id, c.stream, c.cost * w.weight AS x FROM sc c JOIN w{k} w ON w.stream = c.stream), a{k} AS (SELECT cand, item, id, sum(x) AS s FROM x{k} GROUP BY ALL), b{k} AS (SELECT cand, item, arg_min(id, (round(s, 9), id)) AS id FROM a{k} GROUP BY ALL),"
        f" m{k} AS (SELECT x.cand, x.stream, coalesce(avg(x) FILTER (WHERE x > 0), 0) AS cost FROM x{k} x JOIN b{k} b ON b.cand = x.cand AND b.item = x.item AND b.id = x.id GROUP BY ALL),"
        f" g{k} AS (SELECT w.*, m.cost, coalesce(w.goal, sum(m.cost) OVER (PARTITION BY w.cand) / 2 / count(*) OVER (PARTITION BY w.cand, w.grp)) AS target FROM w{k} w JOIN m{k} m USING (cand, stream)),"
        f" l{k} AS (SELECT *, sum(abs(cost - target)) OVER (PARTITION BY cand) AS loss, CAST(sign(target - cost) AS DOUBLE) AS dir FROM g{k}), n{k} AS (SELECT *, least(greatest(step * CASE WHEN dir * direction > 0 THEN 1.2 WHEN dir * direction < 0 THEN 0.5 ELSE 1 END, 1e-6), 50) AS nstep FROM l{k}),"
        f" w{k + 1} AS (SELECT cand, stream, grp, greatest(weight + dir * nstep, 0) AS weight, nstep AS step, dir AS direction, target AS goal FROM n{k})"
    )


@_query(
    f"WITH {_CANDIDATES}, sc AS (SELECT utt * 25 + step AS item, c.id, s.stream, list_sum(list_transform(range(s.a, s.b), lambda i: pow(tg.t[i + 1] - e.v[i + 1], 2))) AS cost FROM c JOIN tg USING (utt, step) JOIN e ON e.vec_id = c.id, (VALUES ('mag', 0, 24), ('real', 24, 44), ('imag', 44, 63), ('lf0', 63, 64)) AS s(stream, a, b)),"
    " w0 AS (SELECT cand, stream, CASE WHEN stream IN ('mag', 'lf0') THEN 'join' ELSE 'target' END AS grp, CAST(1 + cand * 0.5 AS DOUBLE) AS weight, CAST(0.1 AS DOUBLE) AS step, CAST(1 AS DOUBLE) AS direction, CAST(NULL AS DOUBLE) AS goal FROM (VALUES (0), (1), (2)) AS k(cand), (VALUES ('mag'), ('real'), ('imag'), ('lf0')) AS s(stream)),"
    f" {', '.join(map(_epoch_sql, range(3)))}"
    " SELECT cand, CAST(epoch AS INTEGER) AS epoch, stream, round(weight, 6) AS weight, round(cost, 6) AS cost, round(target, 6) AS goal, round(loss, 6) AS loss FROM (SELECT 0 AS epoch, * FROM l0 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 2, * FROM l2)"
)
def balanced_weights(spark, d):
    """Three epochs of balancing three sets of weights at once, each epoch one pass over the candidates."""
    targets = _targets(spark, d)
    units = _vectors(spark, d).select(F.col("vec_id").alias("unit_id"), "v")
    rows = _candidates(spark, d).select("utt", "step", "unit_id").join(targets, ["utt", "step"]).join(units, "unit_id")
    each, at = [], 0
    for name, width in STREAMS:
        part = lambda c, a=at, n=width: vectors.stream_slice(F.col(c), a, n)
        each.append(F.struct(F.lit(name).alias("stream"), vectors.dist2(part("target"), part("v")).alias("cost")))
        at += width
    costs = kept(rows.select((F.col("utt") * 25 + F.col("step")).alias("item"), "unit_id", F.explode(F.array(*each)).alias("x")).select("item", "unit_id", "x.*"), "costs")
    streams = [(c, s, "join" if s in ("mag", "lf0") else "target", 1 + c * 0.5) for c in range(3) for s, _ in STREAMS]
    start = spark.createDataFrame(streams, "cand int, stream string, group string, weight double")
    out = tuning.balanced(start, lambda w: tuning.chosen_costs(w, costs), 3)
    return out.select("cand", "epoch", "stream", *(_r(F.col(c)).alias(c) for c in ("weight", "cost", "goal", "loss")))


@_query(
    f"WITH {_E}, r(run, weight, keep, units_built, weighted_built, near_built) AS (VALUES (0, 0.5, 3, TRUE, TRUE, TRUE), (1, 0.25, 3, FALSE, TRUE, TRUE), (2, 0.25, 2, FALSE, FALSE, TRUE), (3, 0.5, 3, FALSE, FALSE, FALSE)), d AS (SELECT r.*, e.vec_id, row_number() OVER (PARTITION BY run, label ORDER BY v[1] * weight + v[64] * (1 - weight) DESC, vec_id) AS k, v[1] * weight + v[64] * (1 - weight) AS score FROM r, e WHERE label IS NOT NULL)"
    " SELECT run, units_built, weighted_built, near_built, count(*) AS n, round(sum(score), 6) AS total FROM d WHERE k <= keep GROUP BY ALL"
)
def rebuilt_tables(spark, d):
    """Units, their weighted scores, and the best of each label, under four settings in turn: what is stored is read."""
    root, runs = fresh_path(spark, "project"), [(0.5, 3), (0.25, 3), (0.25, 2), (0.5, 3)]
    out = None
    for run, (weight, keep) in enumerate(runs):
        project = config.Project(spark, root, config.Settings(join_cost_weight=weight, candidates=keep))
        project.table("units", ["streams"], [], lambda: _vectors(spark, d).where("label IS NOT NULL"))
        project.table("weighted", ["join_cost_weight"], ["units"], lambda u, w=weight: u.select("vec_id", "label", (F.col("v")[0] * w + F.col("v")[63] * (1 - w)).alias("score")))
        order = Window.partitionBy("label").orderBy(F.desc("score"), "vec_id")
        near = project.table("near", ["candidates"], ["weighted"], lambda u, k=keep, order=order: u.withColumn("k", F.row_number().over(order)).where(F.col("k") <= k))
        row = near.agg(F.count(F.lit(1)).alias("n"), _r(F.sum("score")).alias("total")).select(F.lit(run).alias("run"), *(F.lit(x in project.built).alias(f"{x}_built") for x in ("units", "weighted", "near")), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out
