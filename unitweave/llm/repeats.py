"""Repeated byte strings, by a distributed merge sort of sampled suffixes.

A byte goes if a string of 400 bytes that covers it also starts anywhere else. Suffixes are sampled so that every such
string holds one at a place that depends on its bytes alone: the leftmost least 16-gram hash (an anchor) of each run
of 385 16-grams. Some 2 suffixes in 386 are left.

1. Each text's anchors, with hashes of 208 bytes to the right and of 209 bytes around to the left. Two equal strings
   agree in one of them at their anchor, so anchors with neither repeated are dropped (counts over all texts).
2. The context of each anchor that is left (400 bytes to the right, 384 to the left) is sorted in runs. Contexts that
   are equal in a run are settled and go on once. Runs are cut at common splitters, front-coded (a suffix keeps its
   common prefix with the one before it as a number) and exchanged.
3. Each range merges its runs with a loser tree that knows the common prefixes: two suffixes are compared only from
   where both are known to agree with the last one put out, which also gives the common prefixes of the merged order.
4. For every offset of the anchor in the string, suffixes that agree in so many bytes to the right and to the left are
   the same string; the least and the largest offset that repeats give the span around the anchor that goes.

Equal texts are one class from the start: a text that occurs twice goes whole (if it has 400 bytes). Left contexts are
compared by a 64-bit hash, right contexts by their bytes.

The same anchors, of words instead of bytes, find the runs of 51 words that another document has, too. Such a passage
has some 300 bytes, so the rule above mostly leaves it; ``passages`` counts its words.

Rows: null is the empty text; repeated rows repeat each other's strings; texts under 400 bytes lose nothing and repeat
nothing; an empty table gives an empty result. Strings never cross texts. A run of one byte makes every place in it an
anchor. The anchors of one 16-gram are merged in one task (784 bytes each).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitweave.llm import textarrays as ta
from unitweave.llm.embeddings import _partitions
from unitweave.llm.scratch import release, stored

LENGTH, GRAM = 400, 16
WINDOW = LENGTH - GRAM + 1
RIGHT, LEFT = 208, 193  # an offset is at most LENGTH - RIGHT, or at least LEFT
#: Words of a passage that is reported where another text has it, too; its anchors are grams of words.
WORDS, WORD_GRAM, WORD_RIGHT, WORD_LEFT = 51, 4, 26, 26
#: Suffixes of a run, and of a range on average.
RUN, RANGE, MAX_RANGES = 20_000, 20_000, 2000
#: Texts up to which the list of their places or spans goes to every task; a longer one is joined by a shuffle.
BROADCAST_TEXTS = 200_000
_GAP_BYTE = np.random.default_rng(31).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def _prefix_sums(buf: np.ndarray) -> np.ndarray:
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    up, _ = ta.powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        np.cumsum(_GAP_BYTE[buf] * up[: len(buf)], out=out[1:])
    return out


def _hash(sums: np.ndarray, begin: np.ndarray, size: int) -> np.ndarray:
    _, down = ta.powers(len(sums))
    with np.errstate(over="ignore"):
        return ta.mix((sums[begin + size] - sums[begin]) * down[begin])


def anchors(offsets: np.ndarray, sums: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(begin, anchor) of all strings of ``length`` symbols within the texts of a block, in order. offsets: where texts
    begin, and the end; sums: the sums of the symbols' hashes."""
    size, window = int(offsets[-1]), length - gram + 1
    n = size - gram + 1
    if size < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = max(1, int(n).bit_length())
    at = np.arange(n)
    key = _hash(sums, at, gram) >> np.uint64(bits) << np.uint64(bits) | at.astype(np.uint64)
    # Minima of windows: of a window's part in one stretch of as many keys, and of its part in the next.
    padded = np.full(-(-n // window) * window, np.uint64(2**64 - 1))
    padded[:n] = key
    grid = padded.reshape(-1, window)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    begin = np.arange(size - length + 1)
    inside = np.ones(len(begin), bool)
    for edge in offsets[1:-1]:  # strings over the edge of two texts
        inside[max(0, edge - length + 1) : edge] = False
    begin = begin[inside]
    least = np.minimum(behind[begin], ahead[begin + window - 1])
    return begin, (least & np.uint64((1 << bits) - 1)).astype(np.int64)


def _word_sums(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each text's words begin in the list of all words, and its end; sums of their hashes)."""
    starts, ends, first = ta.words(buf, offsets)
    up, _ = ta.powers(len(starts) + 1)
    with np.errstate(over="ignore"):
        return first, np.r_[np.uint64(0), np.cumsum(ta.word_hashes(buf, starts, ends) * up[: len(starts)], dtype=np.uint64)]


def _sides(at: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray, right: int, left: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``right`` symbols from each anchor on, and of ``left`` before it and its gram; 0 where these leave the
    text (low to high)."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    last = len(sums) - 1
    after = np.where(at + right <= high, _hash(sums, np.clip(at, 0, max(0, last - right)), min(right, last)), np.uint64(0))
    return after, np.where(at - left >= low, _hash(sums, np.maximum(at - left, 0), left + gram), np.uint64(0))


def _anchored(docs: DataFrame) -> DataFrame:
    """(key, n_bytes, at, right, left, head, n_words, w_at, w_right, w_left) of each row; key is the text's digest, w_ is
    of the anchors among its words."""

    def listed(cut: np.ndarray, x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(cut), pa.array(x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, buf, offsets in ta.blocks(batch.column(0)):
                rows = np.arange(len(offsets))
                sums = _prefix_sums(buf)
                at = np.unique(anchors(offsets, sums)[1])
                text = np.searchsorted(offsets, at, "right") - 1
                right, left = _sides(at, offsets[text], offsets[text + 1], sums, RIGHT, LEFT, GRAM)
                head = np.zeros(len(at), np.uint64)
                for j in range(8):
                    head = head << np.uint64(8) | buf[at + j].astype(np.uint64)
                cut = np.searchsorted(text, rows).astype(np.int32)
                data = buf.tobytes()
                key = [hashlib.md5(data[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                lists = [listed(cut, x) for x in ((at - offsets[text]).astype(np.int32), right.view(np.int64), left.view(np.int64), (head ^ np.uint64(1 << 63)).view(np.int64))]
                first, sums = _word_sums(buf, offsets)
                at = np.unique(anchors(first, sums, WORDS, WORD_GRAM)[1])
                text = np.searchsorted(first, at, "right") - 1
                right, left = _sides(at, first[text], first[text + 1], sums, WORD_RIGHT, WORD_LEFT, WORD_GRAM)
                cut = np.searchsorted(text, rows).astype(np.int32)
                lists += [pa.array(np.diff(first)), *(listed(cut, x) for x in ((at - first[text]).astype(np.int32), right.view(np.int64), left.view(np.int64)))]
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(np.diff(offsets)), *lists], ["key", "n_bytes", "at", "right", "left", "head", "n_words", "w_at", "w_right", "w_left"])

    return docs.select("text").mapInArrow(run, "key binary, n_bytes long, at array<int>, right array<long>, left array<long>, head array<long>, n_words long, w_at array<int>, w_right array<long>, w_left array<long>")


def front_code(suffixes: list[bytes]) -> tuple[list[int], bytes, list[int]]:
    """(common prefixes with the one before, what follows them, its lengths) of sorted suffixes."""
    shared, rest, sizes, last = [], [], [], b""
    for s in suffixes:
        h = common(last, s, 0)
        shared.append(h)
        rest.append(s[h:])
        sizes.append(len(s) - h)
        last = s
    return shared, b"".join(rest), sizes


def front_decode(shared: list[int], rest: bytes, sizes: list[int]) -> list[bytes]:
    out, at, last = [], 0, b""
    for h, n in zip(shared, sizes):
        last = last[:h] + rest[at : at + n]
        at += n
        out.append(last)
    return out


def common(a: bytes, b: bytes, known: int) -> int:
    """The length of the common prefix, of which ``known`` bytes are known."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    low, step = known, 8
    while a[low : low + step] == b[low : low + step]:
        low += step
        step *= 2
    while step > 1:
        step //= 2
        if a[low : low + step] == b[low : low + step]:
            low += step
    return low


def merge(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, common prefix with the one before) in sorted order. Runs are sorted suffixes with their
    common prefixes. Each node of the loser tree keeps a run and how many bytes its head shares with the last winner
    that passed there; heads are compared from the smaller known prefix on only where these are equal."""
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    heads = [0] * k
    known = [0] * k  # with the last suffix put out
    loser = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        if a < 0 or heads[a] >= len(runs[a][0]):
            return b, a
        if b < 0 or heads[b] >= len(runs[b][0]):
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        x, y = runs[a][0][heads[a]], runs[b][0][heads[b]]
        h = common(x, y, known[a])
        if h == len(x) or h < len(y) and x[h] < y[h]:
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    def build(node: int) -> int:
        if node >= size:
            return node - size if node - size < k else -1
        winner, loser[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if size > 1 else 0
    while winner >= 0 and heads[winner] < len(runs[winner][0]):
        yield winner, heads[winner], known[winner]
        heads[winner] += 1
        if heads[winner] < len(runs[winner][0]):
            known[winner] = runs[winner][1][heads[winner]]
        node = (winner + size) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


def offsets_of(shared: np.ndarray, rights: np.ndarray, lefts: np.ndarray, left_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) offset at which each anchor's string repeats; (-1, -1) where none does. shared: common prefix
    of each sorted right context with the one before; lefts: left contexts as rows, from the anchor outwards."""
    n = len(shared)
    low, high = np.full(n, -1), np.full(n, -1)
    near = np.r_[shared[1:], 0]
    best = np.maximum(shared, near)  # no other suffix agrees further
    hashed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for o in range(WINDOW):
            if o:
                hashed = (hashed ^ (lefts[:, o - 1].astype(np.uint64) + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
            size = LENGTH - o
            ok = np.flatnonzero((best >= size) & (rights >= size) & (left_sizes >= o))
            if len(ok) < 2:
                continue
            part = np.cumsum(shared < size)
            key = ta.mix(hashed[ok] + part[ok].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
            order = np.sort(key)
            twice = order[1:][order[1:] == order[:-1]]
            if not len(twice):
                continue
            at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
            hit = ok[twice[at] == key]
            high[hit] = o
            low[hit[low[hit] < 0]] = o
    return low, high


def _spans_of(key: list[bytes], at: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    keep = np.flatnonzero(high >= 0)
    return pa.RecordBatch.from_arrays([pa.array([key[i] for i in keep.tolist()], pa.binary()), pa.array((at[keep] - high[keep]).astype(np.int64)), pa.array((at[keep] - low[keep] + LENGTH).astype(np.int64))], ["key", "start", "end"])


_RUN = "range int, keys binary, places binary, shared binary, sizes binary, rest binary, left_sizes binary, lefts binary, start long, end long, key binary"


def _runs(texts: DataFrame, splitters: list[int], parts: int = 1) -> DataFrame:
    """Sorted, front-coded runs, a row for each range (range >= 0), and spans that are settled in a run (range -1). A
    range can be dealt into parts by its first eight bytes, where there are more suffixes than splitters can part."""
    cuts = np.array(splitters, np.int64).view(np.uint64) ^ np.uint64(1 << 63)
    bounds = [int(c).to_bytes(8, "big") for c in cuts]
    schema = pa.schema([("range", pa.int32()), *((c, pa.binary()) for c in ("keys", "places", "shared", "sizes", "rest", "left_sizes", "lefts")), ("start", pa.int64()), ("end", pa.int64()), ("key", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes, bytes, int]] = []  # right, left (outwards), key, place

        def flush():
            held.sort()
            rows, kept, i = [], [], 0
            while i < len(held):
                j = i + 1
                while j < len(held) and held[j][:2] == held[i][:2]:
                    j += 1
                right, left = held[i][:2]
                if j - i > 1 and len(right) + len(left) >= LENGTH:
                    first, last = max(0, LENGTH - len(right)), min(WINDOW - 1, len(left))
                    if first <= last:
                        rows += [{"range": -1, "start": p - last, "end": p - first + LENGTH, "key": k} for _, _, k, p in held[i:j]]
                kept.append(held[i])
                i = j
            at = 0
            for r in range(len(bounds) + 1):
                end = at
                while end < len(kept) and (r == len(bounds) or kept[end][0][:8] < bounds[r]):
                    end += 1
                groups: dict[int, list] = {}
                for x in kept[at:end]:
                    groups.setdefault(zlib.crc32(x[0][:8]) % parts if parts > 1 else 0, []).append(x)
                for g, part in groups.items():
                    shared, rest, sizes = front_code([x[0] for x in part])
                    two = lambda x: np.array(x, np.uint16).tobytes()
                    rows.append({"range": r * parts + g, "keys": b"".join(x[2] for x in part), "places": np.array([x[3] for x in part], np.int64).tobytes(), "shared": two(shared), "sizes": two(sizes), "rest": rest, "left_sizes": two([len(x[1]) for x in part]), "lefts": b"".join(x[1] for x in part)})
                at = end
            held.clear()
            for k in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist(rows[k : k + 1000], schema)

        for batch in batches:
            for key, text, at in zip(batch.column(0), batch.column(1), batch.column(2)):
                raw, key = text.as_py().encode("utf-8", "surrogatepass"), key.as_py()
                for p in at.as_py():
                    held.append((raw[p : p + LENGTH], raw[max(0, p - WINDOW + 1) : p][::-1], key, p))
                    if len(held) >= RUN:
                        yield from flush()
        if held:
            yield from flush()

    return texts.select("key", "text", "at").mapInArrow(run, _RUN)


def _merged(runs: DataFrame) -> DataFrame:
    """Spans (key, start, end) from the runs of each range."""
    spark = runs.sparkSession
    columns = ["range", "keys", "places", "shared", "sizes", "rest", "left_sizes", "lefts"]
    placed = runs.where("range >= 0").select(*columns).repartition(max(_partitions(spark), 1), "range").sortWithinPartitions("range")

    def one(parts: list[dict]) -> pa.RecordBatch:
        shorts = lambda b: np.frombuffer(b, np.uint16)
        runs, keys, places, left_sizes, lefts = [], [], [], [], []
        for p in parts:
            shared = shorts(p["shared"]).tolist()
            runs.append((front_decode(shared, p["rest"], shorts(p["sizes"]).tolist()), shared))
            keys.append(p["keys"])
            places.append(np.frombuffer(p["places"], np.int64))
            left_sizes.append(shorts(p["left_sizes"]).astype(np.int64))
            flat, size = np.frombuffer(p["lefts"], np.uint8), left_sizes[-1]
            grid = np.zeros((len(size), WINDOW - 1), np.uint8)
            grid[np.arange(WINDOW - 1) < size[:, None]] = flat
            lefts.append(grid)
        order = np.array(list(merge(runs)), np.int64).reshape(-1, 3)
        base = np.r_[0, np.cumsum([len(r[0]) for r in runs])]
        pick = base[order[:, 0]] + order[:, 1]
        rights = np.concatenate([np.fromiter(map(len, r[0]), np.int64, len(r[0])) for r in runs])[pick]
        low, high = offsets_of(order[:, 2], rights, np.concatenate(lefts)[pick], np.concatenate(left_sizes)[pick])
        every = b"".join(keys)
        return _spans_of([every[16 * i : 16 * i + 16] for i in pick.tolist()], np.concatenate(places)[pick], low, high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if held and row["range"] != now:
                    yield one(held)
                    held = []
                now = row["range"]
                held.append(row)
        if held:
            yield one(held)

    return placed.mapInArrow(run, "key binary, start long, end long")


def _texts(docs: DataFrame) -> DataFrame:
    """A stored table of the different texts, with their anchors and copies."""
    found = stored(_anchored(docs), "anchors")
    firsts = [c for c in found.columns if c != "key"]
    out = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in firsts)), "texts")
    release(found)
    return out


def _bodies(docs: DataFrame, places: DataFrame) -> DataFrame:
    """(key, text, at) of the texts of ``places`` (key, at, copies), each once."""
    near = F.broadcast if places.count() <= BROADCAST_TEXTS else lambda x: x
    bodies = docs.select(F.unhex(F.md5(F.col("text").cast("binary"))).alias("k"), "text")
    rows = bodies.join(near(places), F.col("k") == F.col("key")).select("key", "text", "at", "copies")
    again = rows.where("copies > 1").groupBy("key").agg(F.first("text").alias("text"), F.first("at").alias("at"))
    return rows.where("copies = 1").select("key", "text", "at").unionAll(again)


def _two_sided(texts: DataFrame, at: str, right: str, left: str, *more: str) -> DataFrame:
    """(key, copies, at, more, side, h): two rows for each anchor of the three lists."""
    each = texts.where(F.size(at) > 0).select("key", "copies", F.explode(F.arrays_zip(at, right, left, *more)).alias("a"))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col(f"a.{right}").alias("h")), F.struct(F.lit(1).alias("side"), F.col(f"a.{left}").alias("h")))
    return each.select("key", "copies", F.col(f"a.{at}").alias("at"), *(F.col(f"a.{c}").alias(c) for c in more), F.explode(sides).alias("s")).select("key", "copies", "at", *more, "s.*").where("h <> 0")


def _places(kept: DataFrame) -> DataFrame:
    """A stored table (key, at, copies): each text's own anchors of (key, at, copies)."""
    return stored(kept.groupBy("key").agg(F.sort_array(F.collect_set("at")).alias("at"), F.first("copies").alias("copies")), "places")


def passages(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """A stored table (p_key, n_passage_words): for each text the words that stand in a run of ``WORDS`` words that
    another document has, too. Sides of anchors that two texts share lead to the runs' 64-bit hashes, and these are
    counted by text (a 64-bit digest)."""
    two = lambda x, *by: x.groupBy(*by).agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").drop("a", "b")
    sides = _two_sided(texts, "w_at", "w_right", "w_left").withColumn("t", F.xxhash64("key"))
    shared = stored(two(sides, F.col("side").alias("s2"), F.col("h").alias("h2")), "sides")
    places = _places(sides.join(shared, (F.col("side") == F.col("s2")) & (F.col("h") == F.col("h2")), "left_semi").select("key", "at", "copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, buf, offsets in ta.blocks(batch.column(1)):
                first, sums = _word_sums(buf, offsets)
                begin, at = anchors(first, sums, WORDS, WORD_GRAM)
                own = batch.column(2).slice(row, len(offsets) - 1)
                wanted = own.flatten().to_numpy() + np.repeat(first[:-1], pa.compute.list_value_length(own).to_numpy())
                begin = begin[np.isin(at, wanted)]
                of = np.searchsorted(first, begin, "right") - 1
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(offsets) - 1).take(pa.array(of)), pa.array((begin - first[of]).astype(np.int32)), pa.array(_hash(sums, begin, WORDS).view(np.int64))], ["t", "i", "h"])

    bodies = _bodies(docs, places).select(F.xxhash64("key").alias("t"), "text", "at")
    runs = stored(bodies.mapInArrow(run, "t long, i int, h long"), "word-runs")
    again = stored(two(runs, F.col("h").alias("h2")), "shared-runs")
    hits = runs.join(again, F.col("h") == F.col("h2"), "left_semi")
    after = F.lead("i").over(Window.partitionBy("t").orderBy("i")) - F.col("i")  # a text's own runs
    counts = hits.select("t", F.least(F.coalesce(after, F.lit(WORDS)), F.lit(WORDS)).alias("n")).groupBy("t").agg(F.sum("n").alias("n"))
    whole = (F.col("copies") > 1) & (F.col("n_words") >= WORDS)
    found = texts.select("key", "copies", "n_words").join(counts, F.xxhash64("key") == F.col("t"), "left")
    out = stored(found.select(F.col("key").alias("p_key"), F.when(whole, F.col("n_words")).otherwise(F.col("n")).alias("n_passage_words")).where("n_passage_words > 0"), "passages")
    for x in (shared, places, runs, again):
        release(x)
    return out


def spans(texts: DataFrame, docs: DataFrame) -> DataFrame:
    """A stored table (key, spans): for each text with repeats (by the md5 digest of its bytes) the spans that go,
    sorted and apart. docs: a column text, null-free; texts: its ``_texts``."""
    sides = _two_sided(texts, "at", "right", "left", "head")
    twice = sides.groupBy(F.col("side").alias("s2"), F.col("h").alias("h2")).count().where(F.col("count") > 1).drop("count")
    twice = stored(twice, "twice")  # a table of its own, so that the join can split a frequent hash
    kept = sides.join(twice, (F.col("side") == F.col("s2")) & (F.col("h") == F.col("h2")), "left_semi").select("key", "at", "copies", "head").distinct()
    kept = stored(kept, "kept")
    n = kept.count()
    ranges = min(MAX_RANGES, max(1, n // RANGE))
    splitters = sorted(set(kept.agg(F.percentile_approx("head", F.array(*(F.lit((i + 1) / ranges) for i in range(ranges - 1))), 10_000).alias("q")).first().q or [])) if ranges > 1 else []
    places = _places(kept)
    runs = stored(_runs(_bodies(docs, places), splitters, -(-n // (ranges * RANGE)) or 1), "runs", **{"parquet.block.size": 1 << 25, "parquet.block.size.row.check.min": 10, "parquet.page.size.row.check.min": 10})
    settled = runs.where("range = -1").select("key", "start", "end")
    whole = texts.where((F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)).select("key", F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end"))
    every = settled.unionAll(_merged(runs)).unionAll(whole).distinct()
    listed = every.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))  # a text's own spans
    join = F.aggregate(
        "spans", F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda a, s: F.when((F.size(a) > 0) & (F.try_element_at(a, F.lit(-1))["end"] >= s["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.try_element_at(a, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(a, F.lit(-1))["end"], s["end"]).alias("end"))))).otherwise(F.concat(a, F.array(s))),
    )
    out = stored(listed.select("key", join.alias("spans")), "spans")
    for x in (twice, kept, places, runs):
        release(x)
    return out


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_words (words in runs of ``WORDS`` words that
    another document has; most such runs are under LENGTH bytes and stay) and kept (the text that is left, bytes)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = _texts(rows.select("text"))
    words = passages(texts, rows.select("text"))
    cut = spans(texts, rows.select("text"))
    found = stored(cut.join(words, F.col("key") == F.col("p_key"), "full").select(F.coalesce("key", "p_key").alias("key"), "spans", "n_passage_words"), "found")
    for x in (texts, words, cut):
        release(x)
    near = F.broadcast if found.count() <= BROADCAST_TEXTS else lambda x: x
    joined = rows.withColumn("k", F.unhex(F.md5(F.col("text").cast("binary")))).join(near(found), F.col("k") == F.col("key"), "left").select("id", "text", "spans", F.coalesce("n_passage_words", F.lit(0).cast("long")).alias("n_passage_words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column(1), batch.column(2)):
                raw, cuts = text.as_py().encode("utf-8", "surrogatepass"), cuts.as_py() or []
                kept, at = [], 0
                for s in cuts:
                    kept.append(raw[at : s["start"]])
                    at = s["end"]
                kept = b"".join([*kept, raw[at:]])
                out.append((len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), kept))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = list(zip(*out)) or [[]] * 5
            made = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made[:4], batch.column(3), made[4]], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words", "kept"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), T.StructField("n_passage_words", T.LongType()), T.StructField("kept", T.BinaryType())])
    return joined.mapInArrow(run, schema)


def brute(texts: list[str | None], length: int = LENGTH) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, from a table of all strings; for tests."""
    raws, seen = [(t or "").encode() for t in texts], {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            h = hashlib.blake2b(raw[i : i + length], digest_size=12).digest()
            seen[h] = h in seen
    out = []
    for raw in raws:
        mark = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[hashlib.blake2b(raw[i : i + length], digest_size=12).digest()]:
                mark[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(raw, mark) if not m)
        out.append((len(raw), sum(mark), sum(1 for i, m in enumerate(mark) if m and not (i and mark[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def brute_passages(texts: list[str | None]) -> list[int]:
    """n_passage_words of each text, from a table of all runs of words; for tests."""
    words, seen = [ta.text_words(t) for t in texts], {}
    for k, w in enumerate(words):
        for i in range(len(w) - WORDS + 1):
            seen.setdefault(tuple(w[i : i + WORDS]), set()).add(k)
    out = []
    for w in words:
        mark = bytearray(len(w))
        for i in range(len(w) - WORDS + 1):
            if len(seen[tuple(w[i : i + WORDS])]) > 1:
                mark[i : i + WORDS] = b"\1" * WORDS
        out.append(sum(mark))
    return out
