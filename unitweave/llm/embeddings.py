"""Near-duplicate embeddings by iterative quantisation and multi-index Hamming tables.

Equal vectors are taken together first. A bounded sample learns the principal directions and, several times, a
rotation of them under which the signs of the coordinates are balanced bits close to the data (iterative
quantisation). Every vector gets a 64-bit code under each rotation, and each code is cut into substrings that key
hash tables. Vectors that share a table's bucket and differ in few bits of that code are candidates; they only need to
be joined in chains, so a bucket gives at most one edge per vector. The vectors of a chain of candidates are then
compared by cosine in double precision, in blocks of bounded size: exact links, counted for each vector.

How long substrings are follows from the number of vectors, and how many rotations there are from the chance that a
pair at the threshold shares a bucket (``TARGET``; chains find more). A bucket with more than ``BUCKET`` vectors is
cut into blocks, and every two blocks of it meet.

Rows: vectors that are null, empty, zero, of another length than most, or hold null or non-finite components link with
nothing, as do rows without an id. Rows of the same id are one node of the graph; each counts its own links. An empty
table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm.graph import connected_components
from unitweave.llm.scratch import stored

#: Vectors that the rotation is learned from at most (about; chosen by a hash).
SAMPLE = 10_000
ITERATIONS, MAX_BITS, TARGET = 40, 64, 0.985
#: Vectors whose mean squared distance from their centre is below this are not centred: it would part near ones.
LEAST_SPREAD = 0.3
#: Vectors of a bucket, and of a side of a block, that are compared at once.
BUCKET, BLOCK = 4096, 1024
#: Codes of a group whose matrix is made whole, and codes that meet all others of a larger group at once.
SMALL, FRONTIER = 1024, 256
#: Buckets over the limit up to which their list goes to every task; a longer one is joined by a shuffle.
BROADCAST_HOT = 100_000


def itq(x: np.ndarray, bits: int, seed: int, iterations: int = ITERATIONS) -> np.ndarray:
    """A (dim, bits) projection: principal directions, rotated so that signs lose least. x: centred rows."""
    _, vectors = np.linalg.eigh(x.T @ x / max(1, len(x)))
    basis = vectors[:, ::-1][:, :bits]
    v = x @ basis
    r = np.linalg.qr(np.random.default_rng(seed).normal(size=(bits, bits)))[0]
    for _ in range(iterations):
        u, _, wt = np.linalg.svd(np.where(v @ r >= 0, 1.0, -1.0).T @ v)
        r = (u @ wt).T
    return basis @ r


def flip_chance(cosine: float) -> float:
    """How often a random hyperplane parts two unit vectors."""
    return math.acos(max(-1.0, min(1.0, cosine))) / math.pi


def plan_tables(n: int, bits: int, cosine: float, spread: float = 1.0) -> tuple[int, int, int, int]:
    """(substring bits, substrings of a code, rotations, most differing bits of a candidate pair). spread: the mean
    squared distance of unit vectors from the centre, by which centring widens the angle of a pair."""
    cosine = 1 - (1 - cosine) / spread
    width = min(bits, max(12, min(20, math.ceil(math.log2(max(2, n))))))
    parts, q = max(1, bits // width), flip_chance(cosine)
    hit = (1 - q) ** width
    rotations = max(1, math.ceil(math.log(1 - TARGET) / math.log(1 - hit) / parts))
    rest = bits - width
    return width, parts, rotations, math.ceil(rest * q + 3.4 * math.sqrt(rest * q * (1 - q))) if rest else 0


def _unit(values: pa.Array, dim: int) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    # Scaled by the largest component first: squares of huge or tiny ones would leave the range.
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """A stored table (rep, n, v) of the different usable vectors, and their length."""
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return None, 0
    # -0.0 and 0.0 are the same component
    v = F.transform("v", lambda x: x + F.lit(0.0))
    same = rows.where(F.size("v") == sizes.d).select("id", v.alias("v")).groupBy("v").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    return stored(same.select("rep", "n", "v"), "classes"), sizes.d


def _codes(table: DataFrame, dim: int, cosine: float, n: int):
    """(key, rep, code): a row for each vector and table, and the most differing bits."""
    spark = table.sparkSession
    every = max(1, n // SAMPLE)
    sample = np.array([r.v for r in table.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("v").limit(4 * SAMPLE).collect()], np.float64)
    if not len(sample):
        sample = np.array([r.v for r in table.limit(1).collect()], np.float64)
    sample /= np.sqrt((sample * sample).sum(1, keepdims=True))
    mean, bits = sample.mean(0), min(MAX_BITS, dim)
    spread = float(1 - mean @ mean)
    if spread < LEAST_SPREAD:
        mean, spread = np.zeros(dim), 1.0
    width, parts, rotations, most = plan_tables(n, bits, cosine, spread)
    held = spark.sparkContext.broadcast((mean, [itq(sample - mean, bits, 100 + r) for r in range(rotations)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, maps = held.value
        weight = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(batch.column(1), dim) - mean
            keys, codes = [], []
            for r, m in enumerate(maps):
                code = ((x @ m >= 0) * weight).sum(1, dtype=np.uint64)
                for p in range(parts):
                    keys.append(((code >> np.uint64(p * width)) & np.uint64((1 << width) - 1)).astype(np.int64) | (r * parts + p) << 40)
                    codes.append(code.view(np.int64))
            rep = np.tile(batch.column(0).to_numpy(), len(keys))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(rep), pa.array(np.concatenate(codes))], ["key", "rep", "code"])

    return table.select("rep", "v").mapInArrow(run, "key long, rep long, code long"), most


def grouped(batches: Iterator[pa.RecordBatch], keys: int, group) -> Iterator:
    """Calls ``group`` with the columns (numpy, but lists for nested ones) of each run of equal values of the first
    ``keys`` columns; batches come sorted by them. Only one run is held beside a batch."""
    held: list[pa.RecordBatch] = []

    def cut(table: pa.Table, last: bool):
        if not table.num_rows:
            return table
        marks = np.zeros(table.num_rows, bool)
        marks[0] = True
        for k in range(keys):
            c = table.column(k).to_numpy()
            marks[1:] |= c[1:] != c[:-1]
        at = np.r_[np.flatnonzero(marks), table.num_rows]
        if not last:
            at = at[:-1]
        for a, b in zip(at[:-1], at[1:]):
            if (out := group(table.slice(a, b - a))) is not None:
                yield out
        return table.slice(at[-1])

    rest = None
    for batch in batches:
        one = pa.Table.from_batches([batch])
        rest = one if rest is None else pa.concat_tables([rest, one])
        rest = yield from cut(rest, False)
    if rest is not None and rest.num_rows:
        yield from cut(rest, True)


def _stars(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row of its component."""
    label = np.arange(len(linked))
    while True:
        new = np.where(linked, label, len(label)).min(1)
        new = np.minimum(label, new)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _chained(code: np.ndarray, most: int) -> np.ndarray:
    """For each code the first of those that it is joined with by chains of codes that differ in ``most`` bits at most.
    A code that was reached meets those that were not, so a group costs half its square at most, in small blocks."""
    label, left = np.arange(len(code)), np.arange(len(code))
    while len(left):
        first, reached, left = left[0], left[:1], left[1:]
        while len(reached) and len(left):
            now, reached = reached[:FRONTIER], reached[FRONTIER:]
            near = (np.bitwise_count(code[now][:, None] ^ code[left]) <= most).any(0)
            label[left[near]] = first
            reached, left = np.concatenate([reached, left[near]]), left[~near]
    return label


def candidate_edges(codes: DataFrame, most: int) -> DataFrame:
    """Edges (a, b) that chain the candidates of each bucket. A bucket over the limit is cut into blocks, of which every
    two meet; its equal codes are one before."""
    spark = codes.sparkSession
    hot = stored(codes.groupBy("key").count().where(F.col("count") > BUCKET).select(F.col("key").alias("k")), "hot")
    n_hot = hot.count()
    rows, same = codes.withColumn("salt", F.lit(0).cast("long")), None
    if n_hot:
        near = F.broadcast if n_hot <= BROADCAST_HOT else lambda x: x
        rows = codes.join(near(hot), F.col("key") == F.col("k"), "left_anti").withColumn("salt", F.lit(0).cast("long"))
        many = codes.join(near(hot), F.col("key") == F.col("k"), "left_semi")
        ones = stored(many.groupBy("key", "code").agg(F.min("rep").alias("first")), "different codes")
        same = many.join(ones, ["key", "code"]).where("rep <> first").select(F.col("first").alias("a"), F.col("rep").alias("b"))
        blocks = ones.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BUCKET).alias("n")).where("n > 1")
        own = F.coalesce(F.pmod(F.xxhash64("first", F.lit(1)), F.col("n")), F.lit(0))
        other = F.when(F.col("n").isNull(), F.array("own")).otherwise(F.array_except(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.array("own")))
        placed = ones.join(blocks, "key", "left").withColumn("own", own).withColumn("other", F.explode(other))
        pair = F.shiftleft(F.least("own", "other"), 32) + F.greatest("own", "other")
        rows = rows.select("key", "salt", "rep", "code").unionByName(placed.select("key", pair.alias("salt"), F.col("first").alias("rep"), "code"))
    sorted_ = rows.repartition(_partitions(spark), "key", "salt").sortWithinPartitions("key", "salt").select("key", "salt", "rep", "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(t: pa.Table):
            if t.num_rows < 2:
                return None
            rep, at = np.unique(t.column(2).to_numpy(), return_index=True)
            code = t.column(3).to_numpy()[at].view(np.uint64)
            if len(rep) < 2:
                return None
            label = _stars(np.bitwise_count(code[:, None] ^ code) <= most) if len(rep) <= SMALL else _chained(code, most)
            far = label != np.arange(len(rep))
            return (rep[label[far]], rep[far]) if far.any() else None

        for out in _batched(grouped(batches, 2, group)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[0] for x in out]), pa.int64()), pa.array(np.concatenate([x[1] for x in out]), pa.int64())], ["a", "b"])

    edges = sorted_.mapInArrow(run, "a long, b long")
    return (edges if same is None else edges.unionByName(same)).distinct()


def _batched(items: Iterator, size: int = 2000) -> Iterator[list]:
    held = []
    for x in items:
        held.append(x)
        if len(held) >= size:
            yield held
            held = []
    if held:
        yield held


def _partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _rerank(table: DataFrame, chains: DataFrame, dim: int, cosine: float) -> DataFrame:
    """(rep, links, first): for each vector and block, the rows it links with (copies counted) and the least vector of
    its links' component there."""
    spark = table.sparkSession
    sizes = chains.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    big = sizes.where("blocks > 1").select(F.col("component").alias("c"), "blocks")
    rows = table.join(chains, F.col("rep") == F.col("id")).drop("id").join(big, F.col("component") == F.col("c"), "left").drop("c")
    own = F.coalesce(F.pmod(F.xxhash64("rep"), F.col("blocks")), F.lit(0)).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks") - 1, F.lit(0)))))
    rows = rows.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "n", "v")
    placed = rows.repartition(_partitions(spark), "component", "i", "j").sortWithinPartitions("component", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def group(t: pa.Table):
            i, j = t.column(1)[0].as_py(), t.column(2)[0].as_py()
            own, rep, n = (t.column(c).to_numpy() for c in (3, 4, 5))
            order = np.lexsort((rep, own))
            x = _unit(t.column(6).combine_chunks(), dim)[order]
            own, rep, n = own[order], rep[order], n[order]
            linked = x @ x.T >= cosine
            np.fill_diagonal(linked, False)
            counted = linked if i == j else linked & (own[:, None] != own)
            links = counted @ n
            by_id = np.argsort(rep, kind="stable")
            label = np.empty(len(rep), np.int64)
            label[by_id] = rep[by_id][_stars(linked[np.ix_(by_id, by_id)])]
            return rep, links, label

        for out in _batched(grouped(batches, 3, group), 500):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in out]), pa.int64()) for k in range(3)], ["rep", "links", "first"])

    return placed.mapInArrow(run, "rep long, links long, first long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = 0.95) -> DataFrame:
    """Per row: id, n_links, component_id, kept."""
    table, dim = classes(vectors, id_col, vec_col)
    ids = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    if table is None:
        return ids.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    codes, most = _codes(table, dim, cosine, table.count())
    codes = stored(codes, "codes")
    chains = connected_components(candidate_edges(codes, most))
    links = stored(_rerank(table, chains, dim, cosine), "links")
    members = ids.join(table.select(F.col("v").alias("w"), "rep", "n"), F.col("v") == F.col("w"), "left").select("id", "rep", "n")
    members = stored(members, "members")
    edges = links.select(F.col("rep").alias("a"), F.col("first").alias("b")).unionAll(members.where("rep IS NOT NULL").select("id", "rep"))
    parts = connected_components(edges)
    counts = links.groupBy(F.col("rep").alias("r")).agg(F.sum("links").alias("links"))
    out = members.join(counts, F.col("rep") == F.col("r"), "left").drop("r").join(parts.withColumnRenamed("id", "p"), F.col("id") == F.col("p"), "left")
    lone = F.coalesce(F.col("n") - 1, F.lit(0)) + F.coalesce(F.col("links"), F.lit(0))
    component = F.coalesce(F.col("component"), F.col("id")).cast("long")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNull(), F.lit(0)).otherwise(lone).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_sum(list_transform(x, lambda y: abs(y))) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.95
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links, min(r.b) AS component_id, v.vec_id = min(r.b) AS kept
FROM v JOIN reach r ON r.a = v.vec_id GROUP BY v.vec_id
"""
