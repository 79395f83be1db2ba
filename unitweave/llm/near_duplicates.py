"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles.

A text is the weighted set of its five-word shingles, tf times idf. Document frequencies come from all documents, in a
table of 2**20 hash buckets (4 MB whatever the corpus; the buckets of rare shingles hold some of the same number, so
the table acts as an upper limit of the idf, alike at every size). Consistent weighted sampling draws 36 samples of
each set such that two sets agree in a sample with the chance of their weighted Jaccard similarity; three samples make
a band. Texts that share a band's value are candidates, and every link is verified by the exact weighted Jaccard
similarity of the whole texts (at least 0.8).

Equal texts are one class from the start. A bucket is compared as a star around its least member, not pair by pair.
Where members of a bucket stay apart from its star, a second round compares them anew: small buckets pair by pair,
larger ones as stars of those that agree in one more band. What is still apart in a larger bucket is compared pair by
pair in blocks, so that every two texts that share a band and end in different classes have been compared. Pairs of 0.8
share a band with a chance of 0.9998. Stars are verified in salted groups of bounded size. Classes are the connected
components of the links.

Rows: null texts are alone; equal texts (empty ones too) are copies; texts without words have no other links; a text
of fewer than five words is one shingle. Rows of one id are one node, a row without an id is alone (class null, kept).
Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitweave.llm import textarrays as ta
from unitweave.llm.embeddings import _partitions, grouped
from unitweave.llm.graph import connected_components
from unitweave.llm.scratch import release, stored

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 12, 3
DF_BITS = 20
_FEATURE_BITS = 44
#: Blocks that the frequency table is summed in.
_PIECES = 64
#: Members of a star that one group verifies; members up to which a bucket is compared pair by pair.
STAR, SMALL = 256, 16
#: Members of a larger bucket, about, that meet as many others in one group where all pairs are compared.
BLOCK = 512
#: Parts that the members of one band's value are dealt into, at most 64.
SALTS = 64
#: Ids of candidates up to which their list (8 bytes each) goes to every task; a longer one is joined by a shuffle.
BROADCAST_IDS = 500_000


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, tf) of the different shingles of each text, sorted by row and feature."""
    starts, ends, first = ta.words(buf, offsets)
    hashes, row = ta.shingles(ta.word_hashes(buf, starts, ends), first, SHINGLE)
    key = np.sort(row.astype(np.uint64) << np.uint64(_FEATURE_BITS) | hashes >> np.uint64(64 - _FEATURE_BITS))
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.r_[at, len(key)])
    return (key[at] >> np.uint64(_FEATURE_BITS)).astype(np.int64), key[at] & np.uint64((1 << _FEATURE_BITS) - 1), tf


def _bucket(feature: np.ndarray) -> np.ndarray:
    return (feature >> np.uint64(_FEATURE_BITS - DF_BITS)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """ln(1 + documents / frequency) of each bucket, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(1 << DF_BITS, np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for _, buf, offsets in ta.blocks(batch.column(0)):
                total += np.bincount(_bucket(features(buf, offsets)[1]), minlength=1 << DF_BITS)
        parts = total.reshape(_PIECES, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(_PIECES), pa.int32()), pa.array([n] * _PIECES, pa.int64()), pa.array([p.tobytes() for p in parts], pa.binary())], ["piece", "n", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for piece, n, counts in zip(*(c.to_pylist() for c in batch.columns)):
                own = sums.setdefault(piece, [0, np.zeros((1 << DF_BITS) // _PIECES, np.int64)])
                own[0] += n
                own[1] += np.frombuffer(counts, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int32()), pa.array([s[0] for s in sums.values()], pa.int64()), pa.array([s[1].tobytes() for s in sums.values()], pa.binary())], ["piece", "n", "counts"])

    schema = "piece int, n long, counts binary"
    counted = docs.select(text_col).mapInArrow(count, schema)
    rows = counted.repartition(_PIECES, "piece").mapInArrow(add, schema).collect()  # the table of 8 bytes a bucket
    total, n = np.zeros(1 << DF_BITS, np.int64), 0
    for r in rows:
        n = r.n
        total.reshape(_PIECES, -1)[r.piece] = np.frombuffer(r.counts, np.int64)
    return np.log1p(n / np.maximum(total, 1)).astype(np.float32)


class Sampler:
    """Consistent weighted samples. The draws of a feature are looked up in tables of 2**16 draws by bits of its hash."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.r, self.ln_c, self.b = rng.gamma(2, 1, 1 << 16).astype(np.float32), np.log(rng.gamma(2, 1, 1 << 16)).astype(np.float32), rng.random(1 << 16, np.float32)
        self.seeds = rng.integers(1, 1 << 63, (samples, 2), dtype=np.uint64) | np.uint64(1)

    def signatures(self, row: np.ndarray, feature: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
        """A (rows, samples) matrix of samples; 0 for a row without features. Rows come sorted."""
        out = np.zeros((rows, len(self.seeds)), np.uint64)
        if not len(row):
            return out
        heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        sizes = np.diff(np.r_[heads, len(row)])
        mixed, ln_w, low = ta.mix(feature), np.log(weight).astype(np.float32), np.uint64(0xFFFF)
        for k, (a, b) in enumerate(self.seeds):
            with np.errstate(over="ignore"):
                g = (mixed ^ a) * b
                g ^= g >> np.uint64(32)
            r = self.r[g & low]
            t = np.floor(ln_w / r + self.b[(g >> np.uint64(16)) & low])
            ln_a = self.ln_c[(g >> np.uint64(32)) & low] - r * (t - self.b[(g >> np.uint64(16)) & low] + 1)
            least = np.minimum.reduceat(ln_a, heads)
            at = np.flatnonzero(ln_a == np.repeat(least, sizes))
            own = row[at]
            at = at[np.r_[True, own[1:] != own[:-1]]]
            with np.errstate(over="ignore"):
                out[row[at], k] = ta.mix(mixed[at] + t[at].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A (rows, bands) matrix of band values."""
    s = signatures.reshape(len(signatures), BANDS, ROWS)
    with np.errstate(over="ignore"):
        h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0xD1B54A32D192ED03)
        for j in range(ROWS):
            h = ta.mix(h ^ s[:, :, j]) + np.uint64(j)
    return h.view(np.int64)


def signed(docs: DataFrame, id_col: str, text_col: str, idf) -> DataFrame:
    """(id, same, keys): same is a digest of the text, keys are the band values (null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, weights = Sampler(), idf.value
        for batch in batches:
            texts = batch.column(1)
            for row, buf, offsets in ta.blocks(texts):
                n = len(offsets) - 1
                of, feature, tf = features(buf, offsets)
                keys = band_keys(sampler.signatures(of, feature, tf * weights[_bucket(feature)], n))
                worded = np.zeros(n, bool)
                worded[of] = True
                data = buf.tobytes()
                same = [hashlib.blake2b(data[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                nulls = texts.slice(row, n).is_null().to_pylist()
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(worded, BANDS, 0))].astype(np.int32)), pa.array(keys[worded].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), pa.array([None if x else s for x, s in zip(nulls, same)], pa.binary()), lists], ["id", "same", "keys"])

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, "id long, same binary, keys array<long>")


def _stars(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows (keys, rep) to pairs (c, m): each member with the least of its group."""
    least = rows.groupBy(*keys).agg(F.min("rep").alias("c"), F.max("rep").alias("last")).where("c <> last").drop("last")
    return rows.join(least, keys).where("rep <> c").select("c", F.col("rep").alias("m"))


def buckets(bands: DataFrame) -> DataFrame:
    """bands: (rep, key). Its rows of the keys that several reps have, with the least of them (c) and their number (size).
    Members meet their least in parts by a salt, so that a key of many members is no one task's; a key is sent to those
    parts alone that it has members in."""
    salt = F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")
    held = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), salt))
    least = bands.groupBy("key").agg(F.min("rep").alias("c"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("size"), held.alias("held")).where("c <> last")
    parts = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda i: F.getbit("held", i) == 1)
    return bands.withColumn("salt", salt).join(least.select("key", "c", "size", F.explode(parts).alias("salt")), ["key", "salt"]).select("key", "rep", "c", "size")


def _bodies(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, body) of the ids in the one column of ``ids``."""
    ids = stored(ids.toDF("i").distinct(), "ids")
    near = F.broadcast if ids.count() <= BROADCAST_IDS else lambda x: x
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("body"))
    return texts.join(near(ids), F.col("id") == F.col("i"), "left_semi")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, idf, similarity: float) -> DataFrame:
    """The pairs (c, m) whose texts' weighted Jaccard similarity is at least ``similarity``."""
    spark = docs.sparkSession
    texts = _bodies(pairs.select("c").unionAll(pairs.select("m")), docs, id_col, text_col)
    salts = pairs.groupBy(F.col("c").alias("k")).agg(F.ceil(F.count(F.lit(1)) / STAR).alias("salts"))
    salted = pairs.join(salts, F.col("c") == F.col("k")).select("c", F.pmod(F.xxhash64("m"), F.col("salts")).alias("salt"), "m")
    members = salted.join(texts, F.col("m") == F.col("id")).select("c", "salt", F.lit(1).alias("role"), "m", "body")
    centres = salts.join(texts, F.col("k") == F.col("id")).select(F.col("k").alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("k").alias("m"), "body")
    placed = centres.unionByName(members).repartition(_partitions(spark), "c", "salt").sortWithinPartitions("c", "salt", "role", "m")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, centre, of = idf.value, None, None
        for batch in batches:
            c, salt, role, m = (batch.column(k).to_numpy() for k in range(4))
            a, b = [], []
            for row, buf, offsets in ta.blocks(batch.column(4)):
                own, feature, tf = features(buf, offsets)
                weight = (tf * weights[_bucket(feature)]).astype(np.float64)
                cut = np.searchsorted(own, np.arange(len(offsets)))
                for i in range(len(offsets) - 1):
                    f, w = feature[cut[i] : cut[i + 1]], weight[cut[i] : cut[i + 1]]
                    k = row + i
                    if not role[k]:
                        if of != (c[k], salt[k]):  # rows of one id: the first stands for it
                            of, centre = (c[k], salt[k]), (f.copy(), w.copy(), w.sum())
                    elif len(f) and len(centre[0]):
                        at = np.minimum(np.searchsorted(centre[0], f), len(centre[0]) - 1)
                        both = centre[0][at] == f
                        shared = np.minimum(w[both], centre[1][at[both]]).sum()
                        if shared >= similarity * (w.sum() + centre[2] - shared):
                            a.append(c[k])
                            b.append(m[k])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["c", "m"])

    return placed.mapInArrow(run, "c long, m long")


def still_apart(members: DataFrame) -> DataFrame:
    """The members (key, rep, part) of the buckets that hold several parts, with a block: those of the largest part
    have blocks of their own, after the ``apart`` blocks of the others; of ``blocks`` in all."""
    parts = members.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("n")).where("most < n")
    count = lambda n: F.ceil(n / BLOCK).cast("long")
    main = main.select("key", "main", count(F.col("n") - F.col("most")).alias("apart"), count(F.col("most")).alias("own"))
    salt = F.xxhash64("rep")
    block = F.when(F.col("part") == F.col("main"), F.col("apart") + F.pmod(salt, F.col("own"))).otherwise(F.pmod(salt, F.col("apart")))
    return members.join(main, "key").select("key", "rep", "part", block.alias("block"), "apart", (F.col("apart") + F.col("own")).alias("blocks"))


def compared(members: DataFrame, keys: DataFrame, docs: DataFrame, id_col: str, text_col: str, idf, similarity: float) -> DataFrame:
    """Links (c, m) between the parts of the buckets of ``still_apart``, by comparing all pairs of different parts, each
    pair in the first band it shares. keys: (rep, keys). A pair that earlier links of its group join is left out."""
    texts = _bodies(members.select("rep"), docs, id_col, text_col)
    whole = members.join(keys, "rep").join(texts, F.col("rep") == F.col("id")).drop("id")
    block, last = F.col("block"), F.col("blocks") - 1
    none = F.array().cast("array<struct<i:bigint,j:bigint,role:int>>")
    held = F.when(block < F.col("apart"), F.transform(F.sequence(block, last), lambda j: F.struct(block.alias("i"), j.alias("j"), F.lit(0).alias("role")))).otherwise(none)
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.least(block, F.col("apart") - 1)), lambda i: F.struct(i.alias("i"), block.alias("j"), F.lit(1).alias("role")))
    placed = whole.select("key", F.explode(F.concat(held, met)).alias("g"), "rep", "part", "keys", "body")
    placed = placed.select("key", "g.*", "rep", "part", "keys", "body").repartition(_partitions(docs.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "role", "rep")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, group, rows, block = idf.value, None, [], None
        for batch in batches:
            key, i, j, role, rep, part = (batch.column(k).to_numpy() for k in range(6))
            keys = batch.column(6).flatten().to_numpy().reshape(-1, BANDS)
            a, b = [], []
            for row, buf, offsets in ta.blocks(batch.column(7)):
                own, feature, tf = features(buf, offsets)
                weight = (tf * weights[_bucket(feature)]).astype(np.float64)
                cut = np.searchsorted(own, np.arange(len(offsets)))
                for n in range(len(offsets) - 1):
                    f, w = feature[cut[n] : cut[n + 1]], weight[cut[n] : cut[n + 1]]
                    k = row + n
                    if group != (now := (key[k], i[k], j[k])):
                        group, rows, block = now, [], None
                    if not len(f):
                        continue
                    if not role[k]:
                        rows.append((rep[k], part[k], keys[k].copy(), f.copy(), w.copy()))
                    elif rows:
                        block = block or _Block(rows)
                        for c in block.links(key[k], rep[k], part[k], keys[k], f, w, i[k] == j[k], similarity):
                            a.append(c)
                            b.append(rep[k])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["c", "m"])

    return placed.mapInArrow(run, "c long, m long")


class _Block:
    """Texts that others are compared with: (rep, part, keys, features, weights) each."""

    def __init__(self, rows: list[tuple]):
        self.reps, self.parts, self.keys = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.label = self.parts.copy()
        self.known, self.at = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
        self.weight = np.concatenate([r[4] for r in rows])
        self.heads = np.r_[0, np.cumsum([len(r[3]) for r in rows])[:-1]]
        self.sums = np.add.reduceat(self.weight, self.heads)

    def links(self, key, rep, part, keys, f, w, same_block: bool, similarity: float) -> list[int]:
        """One text of each label that the given one is near to; these labels become one."""
        total = w.sum()
        wanted = (self.parts != part) & (keys[(self.keys == keys).argmax(1)] == key)
        wanted &= np.minimum(self.sums, total) >= similarity * np.maximum(self.sums, total) * (1 - 1e-9)
        if same_block:
            wanted &= self.reps < rep
        if not wanted.any():
            return []
        dense = np.zeros(len(self.known))
        at = np.minimum(np.searchsorted(self.known, f), len(self.known) - 1)
        both = self.known[at] == f
        dense[at[both]] = w[both]
        shared = np.add.reduceat(np.minimum(self.weight, dense[self.at]), self.heads)
        near = np.flatnonzero(wanted & (shared >= similarity * (self.sums + total - shared)))
        labels, one = np.unique(self.label[near], return_index=True)
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]
        return self.reps[near[one]].tolist()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: id, class_id (the least id of the class), kept (the row of that id)."""
    spark = docs.sparkSession
    docs = docs.select(id_col, text_col)
    idf = spark.sparkContext.broadcast(document_frequencies(docs, text_col))
    table = stored(signed(docs, id_col, text_col, idf), "signatures")
    reps = table.where("same IS NOT NULL AND id IS NOT NULL").groupBy("same").agg(F.min("id").alias("rep"), F.first("keys").alias("keys"))
    reps = stored(reps, "representatives")
    bands = reps.where("keys IS NOT NULL").select("rep", F.explode("keys").alias("key"))
    shared = stored(buckets(bands), "buckets")
    first = stored(shared.where("rep <> c").select("c", F.col("rep").alias("m")).distinct(), "pairs")
    links = stored(verified(first, docs, id_col, text_col, idf, similarity), "links")
    parts = connected_components(links)

    # Buckets with members apart from their star; the members' parts.
    part = lambda x: F.coalesce(F.col(f"{x}_part"), F.col(x))
    known = shared.join(parts.select(F.col("id").alias("rep"), F.col("component").alias("rep_part")), "rep", "left").join(parts.select(F.col("id").alias("c"), F.col("component").alias("c_part")), "c", "left")
    known = known.select("key", "size", "rep", part("rep").alias("part"), (part("rep") != part("c")).alias("apart"))
    open_ = known.where("apart").select("key").distinct()
    rest = stored(known.join(open_, "key").drop("apart"), "apart")
    lists = rest.where(F.col("size") <= SMALL).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rep", "part"))).alias("x"))  # SMALL at most
    one = lists.select(F.posexplode("x").alias("i", "a"), "x").select("a", F.explode(F.slice(F.col("x"), F.col("i") + 2, F.lit(SMALL))).alias("b"))
    one = one.where("a.part <> b.part").select(F.col("a.rep").alias("c"), F.col("b.rep").alias("m"))
    large = rest.where(F.col("size") > SMALL).join(reps.where("keys IS NOT NULL"), "rep").select("key", "rep", "part", F.explode("keys").alias("second")).where("key <> second")
    groups = large.groupBy("key", "second").agg(F.min("rep").alias("c"), F.min_by("part", "rep").alias("c_part"), F.max("rep").alias("last")).where("c <> last")
    two = large.join(groups, ["key", "second"]).where("part <> c_part").select("c", F.col("rep").alias("m"))
    second = stored(one.unionAll(two).distinct().join(first, ["c", "m"], "left_anti"), "pairs")
    if not second.isEmpty():
        links = links.unionAll(stored(verified(second, docs, id_col, text_col, idf, similarity), "links"))

    # Larger buckets that still hold several parts.
    large = rest.where(F.col("size") > SMALL).select("key", "rep")
    if not large.isEmpty():
        parts = connected_components(links).select(F.col("id").alias("rep"), "component")
        members = large.join(parts, "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("part"))
        members = stored(still_apart(members), "apart")
        if not members.isEmpty():
            keys = reps.where("keys IS NOT NULL").select("rep", "keys")
            links = links.unionAll(stored(compared(members, keys, docs, id_col, text_col, idf, similarity), "links"))
    copies = table.where("same IS NOT NULL AND id IS NOT NULL").join(reps.select(F.col("same").alias("s"), "rep"), F.col("same") == F.col("s")).where("id <> rep").select(F.col("rep").alias("c"), F.col("id").alias("m"))
    classes = connected_components(links.select("c", "m").unionAll(copies))
    out = table.select("id").join(classes.withColumnRenamed("id", "i"), F.col("id") == F.col("i"), "left")
    class_id = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), class_id.alias("class_id"), F.coalesce(F.col("id") == class_id, F.lit(True)).alias("kept"))


def brute(docs: list[tuple], similarity: float = SIMILARITY) -> dict:
    """{id: class} by comparing all pairs plainly, with exact weights of the same frequency table; for tests."""
    texts = [(i, t) for i, t in docs if t is not None]
    sets = []
    for _, t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        _, f, tf = features(raw, np.array([0, len(raw)]))
        sets.append((f, tf))
    df = np.zeros(1 << DF_BITS)
    for f, _ in sets:
        np.add.at(df, _bucket(f), 1)
    idf = np.log1p(len(docs) / np.maximum(df, 1)).astype(np.float32)
    maps = [dict(zip(f.tolist(), (tf * idf[_bucket(f)]).tolist())) for f, tf in sets]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            x, y = maps[a], maps[b]
            shared = sum(min(x[k], y[k]) for k in x.keys() & y.keys())
            if texts[a][1] == texts[b][1] or shared and shared >= similarity * (sum(x.values()) + sum(y.values()) - shared):
                p, q = find(texts[a][0]), find(texts[b][0])
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in docs}
