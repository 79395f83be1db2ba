"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` cuts the documents into segments of some 100,000 words. Each row of the index is a segment: the words
that occur in it (as hashes, sorted), for each of them its postings (word positions in the segment, sorted), and the
documents with their first positions. Postings of every word of every document are stored. Segments hold whole
documents, with a gap between two of them that no phrase and no proximity window can cross.

``search`` reads the segments where they lie, without a shuffle. Test windows are sent to every task in blocks of
bounded size. In a segment a window is skipped unless all its words occur; then the lists of its words are intersected
from the rarest on, each moved by the word's place in the window (``phrases``), or within a span of words in any
order (``near``).

Words are compared by hash: 64 bits less those of a position in the segment, some 47 in all. A false match needs as
many collisions as the window has other words.

Rows: null and empty texts have no words and are never hit; repeated documents are rows of their own; benchmark items
without words have no window; items of the same id count once; an item whose id is null marks words, but is not
listed. Empty tables give no hits, or no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitweave.llm import textarrays as ta
from unitweave.llm.scratch import stored

SEGMENT_WORDS = 100_000
#: Positions left out between two documents, more than a window or a proximity span.
GAP = 64
#: Characters of benchmark text whose windows are searched in one pass over the index.
BLOCK_CHARS = 8_000_000
WINDOW = 10

_INDEX = T.StructType(
    [
        T.StructField("segment", T.StringType()),
        T.StructField("docs", T.ArrayType(T.LongType())),
        T.StructField("firsts", T.BinaryType()),  # uint32: first position of each document
        T.StructField("counts", T.BinaryType()),  # uint32: its words
        T.StructField("shift", T.IntegerType()),  # bits of a word's hash that are left out
        T.StructField("terms", T.BinaryType()),  # uint64, sorted
        T.StructField("starts", T.BinaryType()),  # uint32: where each term's postings begin; one more at the end
        T.StructField("postings", T.BinaryType()),  # uint32
    ]
)


def _segment(ids: list, hashes: list[np.ndarray]) -> dict:
    counts = np.array([len(h) for h in hashes], np.int64)
    firsts = np.cumsum(counts + GAP) - counts - GAP
    total = int(counts.sum())
    at = np.repeat(firsts - (np.cumsum(counts) - counts), counts) + np.arange(total)
    shift = max(1, int(at[-1]).bit_length()) if total else 1
    # One sort of the hash with the position below it gives terms and postings in order.
    key = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    key = np.sort((key >> np.uint64(shift)) << np.uint64(shift) | at.astype(np.uint64))
    term = key >> np.uint64(shift)
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if total else np.zeros(0, np.int64)
    return {
        "docs": ids, "firsts": firsts.astype(np.uint32).tobytes(), "counts": counts.astype(np.uint32).tobytes(), "shift": shift, "terms": term[starts].tobytes(),
        "starts": np.r_[starts, total].astype(np.uint32).tobytes(), "postings": (key & np.uint64((1 << shift) - 1)).astype(np.uint32).tobytes(),
    }


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index, one row per segment."""
    schema = pa.schema([("segment", pa.string()), ("docs", pa.list_(pa.int64())), ("firsts", pa.binary()), ("counts", pa.binary()), ("shift", pa.int32()), ("terms", pa.binary()), ("starts", pa.binary()), ("postings", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            names = batch.column(0).to_pylist()
            for row, buf, offsets in ta.blocks(batch.column(1)):
                starts, ends, first = ta.words(buf, offsets)
                hashes = ta.word_hashes(buf, starts, ends)
                for i in range(len(offsets) - 1):
                    ids.append(names[row + i])
                    held.append(hashes[first[i] : first[i + 1]])
                    size += int(first[i + 1] - first[i]) + GAP
                    if size >= SEGMENT_WORDS:
                        yield pa.RecordBatch.from_pylist([{"segment": f"{task}-{n}"} | _segment(ids, held)], schema)
                        ids, held, size, n = [], [], 0, n + 1
        if ids:
            yield pa.RecordBatch.from_pylist([{"segment": f"{task}-{n}"} | _segment(ids, held)], schema)

    index = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, _INDEX)
    small = {"parquet.block.size": 1 << 25, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4}
    return stored(index, "index", **small)


class Segment:
    """One row of the index, opened."""

    def __init__(self, row: dict):
        self.docs = row["docs"]
        self.firsts, self.counts = np.frombuffer(row["firsts"], np.uint32).astype(np.int64), np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.shift, self.terms = row["shift"], np.frombuffer(row["terms"], np.uint64)
        self.starts, self.postings = np.frombuffer(row["starts"], np.uint32).astype(np.int64), np.frombuffer(row["postings"], np.uint32)

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where each word (a full hash) stands among the terms; -1 where it does not occur."""
        short = terms >> np.uint64(self.shift)
        at = np.searchsorted(self.terms, short)
        there = at < len(self.terms)
        there[there] = self.terms[at[there]] == short[there]
        return np.where(there, at, -1)

    def list(self, place: int) -> np.ndarray:
        return self.postings[self.starts[place] : self.starts[place + 1]].astype(np.int64)


def phrases(segment: Segment, places: list[int]) -> np.ndarray:
    """The positions at which the words stand one after the other."""
    order = sorted(range(len(places)), key=lambda j: segment.starts[places[j] + 1] - segment.starts[places[j]])
    out = segment.list(places[order[0]]) - order[0]
    for j in order[1:]:
        other = segment.list(places[j]) - j
        at = np.searchsorted(other, out)
        at[at == len(other)] = 0
        out = out[other[at] == out]
        if not len(out):
            break
    return out


def near(segment: Segment, places: list[int], span: int) -> np.ndarray:
    """(first, last) of the groups in which all the words stand, in any order, within ``span`` positions: starts of
    spans around the occurrences of the rarest word, narrowed to those that hold every other word as well."""
    places = sorted(set(places), key=lambda p: segment.starts[p + 1] - segment.starts[p])
    lists = [segment.list(p) for p in places]
    begin = np.unique(lists[0][:, None] - np.arange(span))
    for other in lists[1:]:
        at = np.searchsorted(other, begin)
        begin = begin[(at < len(other)) & (other[np.minimum(at, len(other) - 1)] < begin + span)]
        if not len(begin):
            return np.zeros((0, 2), np.int64)
    every = np.sort(np.concatenate(lists))
    return np.unique(np.stack([every[np.searchsorted(every, begin)], every[np.searchsorted(every, begin + span) - 1]], 1), axis=0)


class Windows:
    """Test windows as rows of a matrix of word numbers: ``terms[number]`` is a word's hash."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.ids, self.window = [x[0] for x in items], window
        texts = pa.array([x[1] or "" for x in items], pa.large_string())
        hashes, item, size = [], [], []
        for row, buf, offsets in ta.blocks(texts):
            starts, ends, first = ta.words(buf, offsets)
            h = ta.word_hashes(buf, starts, ends)
            for i in range(len(offsets) - 1):
                own = h[first[i] : first[i + 1]]
                width = min(window, len(own))
                for k in range(len(own) - width + 1 if width else 0):
                    hashes.append(np.r_[own[k : k + width], np.zeros(window - width, np.uint64)])
                    item.append(row + i)
                    size.append(width)
        self.item, self.size = np.array(item, np.int64), np.array(size, np.int64)
        grid = np.array(hashes, np.uint64).reshape(-1, window)
        used = np.arange(window) < self.size[:, None]
        self.terms, number = np.unique(grid[used], return_inverse=True)
        self.number = np.full(grid.shape, -1)
        self.number[used] = number

    def search(self, segment: Segment, span: int | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(window, occurrences): their first positions, or (first, last) of each if a span is given."""
        places = np.r_[segment.places(self.terms), 0]  # -1 finds the last
        grid = places[self.number]
        for w in np.flatnonzero((grid >= 0).all(1)):
            found = grid[w, : self.size[w]].tolist()
            at = phrases(segment, found) if span is None else near(segment, found, span)
            if len(at):
                yield int(w), at


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, span: int | None = None) -> DataFrame:
    """Per document of the index: segment, place (in the segment), doc, n_words, hits (the hit words' numbers in the
    document, sorted) and items (ids of the items with occurring windows, distinct).

    span: matches all words of a window in any order within so many words (at most the gap), instead of phrases; the
    words from the first to the last of them are hit.
    """
    if span is not None and span > GAP or window > GAP:
        raise ValueError(f"windows and spans are at most {GAP} words")
    spark = index.sparkSession
    items = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("body"))
    size = items.agg(F.sum(F.length("body"))).first()[0] or 0
    passes = 1 + size // BLOCK_CHARS
    block = F.pmod(F.xxhash64("item", "body"), F.lit(passes))
    out = None
    for k in range(passes):
        held = spark.sparkContext.broadcast(Windows([(r.item, r.body) for r in items.where(block == k).collect()], window))
        one = index.mapInArrow(_searcher(held, span), "segment string, place int, doc long, n_words long, hits array<int>, items array<string>")
        out = one if out is None else out.unionAll(one)
    if passes > 1:
        out = out.groupBy("segment", "place", "doc", "n_words").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return out


def _searcher(held, span: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment(batch.slice(k, 1).to_pylist()[0])
                n = len(segment.docs)
                begun, ended = [], []
                items: list[set] = [set() for _ in range(n)]
                for w, at in windows.search(segment, span):
                    low, high = (at, at + int(windows.size[w])) if span is None else (at[:, 0], at[:, 1] + 1)
                    begun.append(low)
                    ended.append(high)
                    name = windows.ids[windows.item[w]]
                    for d in np.unique(np.searchsorted(segment.firsts, low, "right") - 1).tolist():
                        items[d].add(name)
                hits = np.zeros(0, np.int64)
                if begun:
                    depth = np.zeros(int(segment.firsts[-1] + segment.counts[-1]) + GAP + 1, np.int32)
                    np.add.at(depth, np.concatenate(begun), 1)
                    np.add.at(depth, np.concatenate(ended), -1)
                    hits = np.flatnonzero(np.cumsum(depth) > 0)
                of = np.searchsorted(segment.firsts, hits, "right") - 1
                cut = np.searchsorted(of, np.arange(n + 1)).astype(np.int32)
                inside = (hits - segment.firsts[of]).astype(np.int32) if len(hits) else hits.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column(0)[k].as_py()] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(segment.docs, pa.int64()), pa.array(segment.counts), pa.ListArray.from_arrays(pa.array(cut), pa.array(inside)), pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string()))],
                    ["segment", "place", "doc", "n_words", "hits", "items"],
                )

    return run


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of ``search``: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = F.size("hits").cast("long")
    return found.select(F.col("doc").alias(id_col), "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> dict:
    """What ``digest`` of phrases returns, by comparing words one by one; for tests."""
    out = {}
    tests = [(i, w) for i, t in items if (w := ta.text_words(t))]
    for doc, text in docs:
        w = ta.text_words(text)
        hit, found = set(), set()
        for item, words in tests:
            width = min(window, len(words))
            grams = {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}
            for k in range(len(w) - width + 1):
                if tuple(w[k : k + width]) in grams:
                    hit.update(range(k, k + width))
                    found.update(() if item is None else (str(item),))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
  FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(k) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM windows
), grams AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g FROM d, sizes, unnest(generate_series(1, len(w) - n + 1)) AS t(k) WHERE len(w) >= n
), hits AS (
  SELECT doc_id, k, g.n, item_id FROM grams g JOIN windows USING (n, g)
), marked AS (
  SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM hits, unnest(generate_series(0, n - 1)) AS t(j) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)
"""
