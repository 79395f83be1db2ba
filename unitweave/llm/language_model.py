"""Language-model scoring by prediction by partial matching over bytes.

A text is its UTF-8 bytes and an end; before it stand ``ORDER`` start symbols, so that every symbol has a context of
``ORDER`` bytes. The context trie holds for each context of 0 to ``ORDER`` bytes how often each symbol followed. A symbol
is looked for in its longest context; where it did not follow there, the model escapes to the context one byte shorter
and leaves out the symbols of the longer one (symbol exclusion). Escapes are estimated by method D: of a context with n
occurrences and d different symbols an escape takes d / 2n, a symbol seen c times (2c - 1) / 2n. Below the empty context
the symbols that never occurred share what is left. The probabilities of all texts therefore sum to at most 1.

``Trie`` is the adaptive form, which learns from a document while it codes it. The pretrained form is learned from all
training documents; its grams (a context and a symbol in one integer) grow with the corpus, and no task holds them all:

* texts are dealt to blocks of ``BLOCK`` bytes; a block lists its different grams and words, with their counts in
  training, in one sorted and compressed row for each shard of a hash (``gathered``);
* a shard adds up the lists of all blocks as they stream by, and deals its grams by the last three bytes of their
  context (``added``); so all contexts of three bytes and more that a gram can escape to meet in one place, whose size
  has a bound (a context of three bytes has at most 65,536 longer ones) whatever the corpus (``valued``);
* shorter contexts are few: three successive bytes of UTF-8 have at most 6.5 million values, 12 bytes each, and go to all;
* a shard answers the lists of the blocks as they stream by, and a block's texts are read again with the answers.

Exclusion depends on the next longer context alone, as symbols that follow a longer context also follow its end.

Rows: null and empty texts have one symbol, the end; a null id counts as not held out; each input row gives one output
row, repeated ids and texts included; texts are scored whole, whatever their length, in windows; without training
documents symbols are equally likely; an empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitweave.llm.scratch import release, stored

#: Bytes of the longest context; a gram of one more has to fit a long.
ORDER = 5
#: Bytes of a context whose longer ones meet in one place; shorter ones go to all tasks.
SHARED = 3
#: Two bytes that UTF-8 does not have stand for the start and the end of a text.
START, END = 0xFF, 0xFE
#: All but the start can follow.
SYMBOLS = 255
#: Bytes of the texts of a block, but for one longer text; and symbols that are worked on at once.
BLOCK, WINDOW = 20 << 20, 1 << 21
#: Bytes of text for which there is one shard more, and the most shards.
SHARD, SHARDS = 16 << 20, 4096
#: Grams that a shard holds before it adds them up.
HELD = 1 << 22
#: The end of a text among the words; no other is empty.
END_WORD = b""


class Trie:
    """Contexts of up to ``order`` bytes with the counts of the symbols that followed; the adaptive model of one text,
    and the plain statement of what the tables hold."""

    def __init__(self, order: int = ORDER):
        self.order, self.follow = order, {}

    @staticmethod
    def symbols(text: bytes) -> list[int]:
        return [*text, END]

    def log10(self, context: bytes, symbol: int) -> float:
        """log10 of the probability of ``symbol`` after ``context``."""
        done, out = 0.0, set()
        for k in range(min(self.order, len(context)), -1, -1):
            seen = self.follow.get(context[len(context) - k :], {})
            left = {s: c for s, c in seen.items() if s not in out}
            if n := sum(left.values()):
                if symbol in left:
                    return done + math.log10((2 * left[symbol] - 1) / (2 * n))
                done += math.log10(len(left) / (2 * n))
                out |= left.keys()
        return done - math.log10(SYMBOLS - len(out))

    def add(self, context: bytes, symbol: int) -> None:
        for k in range(min(self.order, len(context)) + 1):
            self.follow.setdefault(context[len(context) - k :], Counter())[symbol] += 1

    def coded(self, text: bytes, learn: bool = True, score: bool = True) -> float:
        """log10 of the probability of the text and its end; with ``learn`` the trie takes in each coded symbol."""
        total, context = 0.0, bytes([START]) * self.order
        for s in self.symbols(text):
            if score:
                total += self.log10(context, s)
            if learn:
                self.add(context, s)
            context = (context + bytes([s]))[-self.order :] if self.order else b""
        return total


def adaptive(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """Per row: the id and the log10 probability of the text under a model that learns from this text alone."""
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Trie(order).coded(t or b"") for t in texts], pa.float64())], schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def held_out(id_col: str, modulus: int = 7, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus, F.lit(rest + 1)) == rest


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the lower-cased words of all texts, how many each text has)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_binary()).view(pa.large_string())))
    flat, edges = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0)  # what stands before the first blank or after the last can be empty
    before = np.r_[0, np.cumsum(real.to_numpy(zero_copy_only=False))]
    return flat.filter(real).view(pa.large_binary()), np.diff(before[edges])


def slices(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of up to ``WINDOW`` bytes and 60,000 rows, but for one longer text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
    a = 0
    while a < len(texts):
        b = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + WINDOW, "right"))
        b = min(max(b, a + 1), a + 60_000, len(texts))
        yield a, texts.take(pa.array(np.arange(a, b)))  # a copy: Arrow's views of slices lose their offsets
        a = b


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, ascending, and how often each occurs; sorting is faster here than hashing."""
    return _runs(np.sort(values))


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.r_[first, len(values)])


def grams(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(symbols before, grams) of windows of all texts' symbols, the ends included."""
    row = np.frombuffer(b"".join(x for t in texts for x in (bytes([START]) * ORDER, t, bytes([END]))), np.uint8)
    done = 0
    for a in range(ORDER, len(row), WINDOW):
        part = row[a - ORDER : a + WINDOW]
        code, size, n = part.astype(np.int64), 1, len(part) - ORDER
        while size <= ORDER:  # of `size` bytes each; the last step overlaps
            more = min(size, ORDER + 1 - size)
            code = code[:-more] << 8 * more | code[more:] & _mask(more)
            size += more
        code = code[:n][part[ORDER:] != START]
        yield done, code
        done += len(code)


def _added(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The different values of some (values, counts), ascending, with the sums of their counts."""
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = np.concatenate([v for v, _ in found])
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.r_[True, values[1:] != values[:-1]]) if len(values) else np.zeros(0, np.int64)
    counts = np.concatenate([c for _, c in found])[order]
    return values[first], np.add.reduceat(counts, first) if len(first) else counts


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Numbers of 8 bytes, compressed; ascending ones by their differences."""
    if ascending and len(values):
        values = np.r_[values[:1], np.diff(values)]
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data: bytes, kind: type = np.int64, ascending: bool = False) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    out = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(out) if ascending else out


def _names(words: list[bytes]) -> bytes | None:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words)) if words else None


def _named(data: bytes | None) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(data).split(b"\n") if data is not None else []


def _shard(gram: np.ndarray, shards: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % shards


def _groups(key: np.ndarray, shards: int) -> list[np.ndarray]:
    order = np.argsort(key, kind="stable")
    return np.split(order, np.searchsorted(key[order], np.arange(1, shards)))


def in_blocks(docs: DataFrame, id_col: str, text_col: str, held: Column) -> DataFrame:
    """A stored table (block, id, held, size, text) of consecutive rows; a block is what one task read, up to ``BLOCK``
    bytes. It is stored before its numbers are used, so that a task that runs again cannot deal the rows anew."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("id", docs.schema[id_col].dataType), T.StructField("held", T.BooleanType()), T.StructField("size", T.LongType()), T.StructField("text", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, full = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            sizes = pc.add(pc.fill_null(pc.binary_length(batch.column(2)), 0).cast(pa.int64()), ORDER + 1)
            numbers = []
            for n in sizes.to_pylist():
                if full and full + n > BLOCK:
                    block, full = block + 1, 0
                full += n
                numbers.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), batch.column(0), batch.column(1), sizes, batch.column(2)], schema.names)

    return stored(docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema), "blocks")


def listed(train: pa.Array, rest: pa.Array, shards: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes], np.ndarray]]:
    """(shard, grams, counts, words, counts): the different grams and words of some texts, and how often the training
    texts hold them."""
    found, tokens = [], [pc.value_counts(pa.array([END_WORD] * len(train) or [], pa.large_binary()))]
    times = [1]
    for texts, seen in ((train, 1), (rest, 0)):
        for _, part in slices(texts):
            for _, code in grams(part.to_pylist()):
                values, n = _counted(code)
                found.append((values, n * seen))
            tokens.append(pc.value_counts(words(part)[0]))
            times.append(seen)
    gram, seen = _added(found)
    table = pa.table({"w": pa.concat_arrays([t.field(0) for t in tokens]), "n": np.concatenate([t.field(1).to_numpy() * k for t, k in zip(tokens, times)])})
    if len(rest) and not len(train):
        table = pa.concat_tables([table, pa.table({"w": pa.array([END_WORD], pa.large_binary()), "n": [0]})])
    table = table.group_by("w").aggregate([("n", "sum")]).sort_by("w")
    names, n = table["w"].to_pylist(), table["n_sum"].to_numpy()
    by_shard = _groups(np.fromiter((zlib.crc32(w) % shards for w in names), np.int64, len(names)), shards)
    for i, (own, these) in enumerate(zip(_groups(_shard(gram, shards), shards), by_shard)):
        yield i, gram[own], seen[own], [names[k] for k in these.tolist()], n[these]


_LISTS = "block long, shard long, kind int, grams binary, seen binary, words binary, n binary"


def gathered(blocks: DataFrame, shards: int) -> DataFrame:
    """A stored table of the lists of each block. A block that two tasks read has lists from both."""

    def rows(block: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        text, held = (t.column(k).chunk(0) if t.num_rows else t.column(k).combine_chunks() for k in (2, 1))
        text = pc.fill_null(text, b"")
        out = [(block, i, 1, packed(g, True), packed(c), _names(w), packed(n)) for i, g, c, w, n in listed(text.filter(pc.invert(held)), text.filter(held), shards)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 4])], ["block", "shard", "kind", "grams", "seen", "words", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            block = batch.column(0).to_numpy()
            edges = np.r_[0, np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a < b and block[a] != now:
                    if parts:
                        yield rows(now, parts)
                    now, parts = int(block[a]), []
                if a < b:
                    parts.append(batch.slice(a, b - a))
        if parts:
            yield rows(now, parts)

    return stored(blocks.select("block", "held", "text").mapInArrow(run, _LISTS), "lists")


def _streamed(rows: DataFrame, shards: int) -> DataFrame:
    """Rows of a shard one after the other, by kind."""
    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind")


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


def added(lists: DataFrame, shards: int) -> DataFrame:
    """A stored table of two kinds of rows: the words of a shard with their counts (words, n, tokens, kinds), and the
    grams of a shard that go to one ``place`` by the last ``SHARED`` bytes of their context (grams, seen)."""
    schema = "shard long, place long, grams binary, seen binary, words binary, n binary, tokens long, kinds long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(shard: int) -> pa.RecordBatch:
            gram, seen = _added(found)
            place = _groups(_shard(gram >> 8 & _mask(SHARED), shards), shards)
            out = [(shard, p, packed(gram[own], True), packed(seen[own]), None, None, None, None) for p, own in enumerate(place) if len(own)]
            names = sorted(count)
            n = np.array([count[w] for w in names], np.int64)
            out.append((shard, None, None, None, _names(names), packed(n), int(n.sum()), int(np.count_nonzero(n))))
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4, pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["shard", "place", "grams", "seen", "words", "n", "tokens", "kinds"])

        now, found, held, count = None, [], 0, Counter()
        for row in _dicts(batches):
            if row["shard"] != now:
                if now is not None:
                    yield rows(now)
                now, found, held, count = row["shard"], [], 0, Counter()
            found.append((unpacked(row["grams"], ascending=True), unpacked(row["seen"])))
            held += len(found[-1][0])
            if held > HELD:
                found, held = [_added(found)], 0
            for w, n in zip(_named(row["words"]), unpacked(row["n"]).tolist()):
                count[w] += n
        if now is not None:
            yield rows(now)

    return stored(_streamed(lists.select("shard", "kind", "grams", "seen", "words", "n"), shards).mapInArrow(run, schema), "sums")


def _mask(size: int) -> int:
    return (1 << 8 * size) - 1


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of each wanted value among the ascending keys, whether it is there)."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Level:
    """The contexts of k bytes: grams with counts, how often each context occurs (n) and with how many symbols (d)."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.gram, self.count = gram, count
        self.context, first = np.unique(gram >> 8, return_index=True)
        self.n = np.add.reduceat(count, first) if len(first) else count
        self.d = np.diff(np.r_[first, len(gram)])

    def shorter(self, k: int) -> Level:
        """The contexts of k bytes that these, of k + 1 bytes, end with."""
        return Level(*_added([(self.gram & _mask(k + 1), self.count)]))

    def excluded(self, below: Level, k: int) -> np.ndarray:
        """For each context: what its symbols take of the context of k bytes that it ends with, in ``below``."""
        at, _ = _find(below.gram, self.gram & _mask(k + 1))
        first = np.searchsorted(self.gram >> 8, self.context)
        return np.add.reduceat(below.count[at], first) if len(first) else self.count


class Model:
    """All levels, of which those below ``SHARED`` come from elsewhere: ``low`` (gram, count) are the grams of
    ``SHARED`` bytes of the whole corpus."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, low: Model | None):
        seen = count > 0
        self.levels: dict[int, Level] = {}
        self.out: dict[int, np.ndarray] = {}
        top = ORDER if low is not None else SHARED - 1
        last = SHARED if low is not None else 0
        self.levels[top] = Level(gram[seen], count[seen])
        for k in range(top - 1, last - 1, -1):
            self.levels[k] = self.levels[k + 1].shorter(k)
        if low is not None:
            self.levels |= low.levels
            self.out |= low.out
        for k in range(top - 1, max(last - 1, 0) - 1, -1):
            self.out[k + 1] = self.levels[k + 1].excluded(self.levels[k], k)

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's symbol after its context."""
        out, open_ = np.zeros(len(gram)), np.arange(len(gram))
        for k in range(ORDER, -1, -1):
            own = gram[open_]
            level = self.levels[k]
            at, known = _find(level.context, own >> 8 & _mask(k))
            n, d = (np.where(known, x[at] if len(x) else 0, 0) for x in (level.n, level.d))
            if k < ORDER:
                longer = self.levels[k + 1]
                at, known = _find(longer.context, own >> 8 & _mask(k + 1))
                n, d = (x - np.where(known, y[at] if len(y) else 0, 0) for x, y in ((n, self.out[k + 1]), (d, longer.d)))
            at, seen = _find(level.gram, own & _mask(k + 1))
            c = level.count[at] if len(level.count) else np.ones(len(own))
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(seen, np.log10((2 * c - 1) / (2 * n)), np.where(n > 0, np.log10(d / (2 * n)), 0.0))
            out[open_] += step
            open_ = open_[~seen]
        out[open_] -= math.log10(max(1, SYMBOLS - len(self.levels[0].gram)))
        return out


def low_model(sums: DataFrame) -> Model:
    """The model of contexts shorter than ``SHARED`` bytes, at most 6.5 million grams for UTF-8."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list = []
        for row in _dicts(batches):
            found = [_added([*found, (unpacked(row["grams"], ascending=True) & _mask(SHARED), unpacked(row["seen"]))])]
        gram, count = _added(found)
        yield pa.RecordBatch.from_arrays([pa.array(gram[count > 0]), pa.array(count[count > 0])], ["gram", "c"])

    parts = sums.where("grams IS NOT NULL").select("grams", "seen").mapInArrow(run, "gram long, c long")
    table = parts.groupBy("gram").agg(F.sum("c").alias("c")).toArrow().sort_by("gram")
    return Model(table["gram"].to_numpy(), table["c"].to_numpy(), None)


def valued(sums: DataFrame, low: Model, shards: int) -> DataFrame:
    """(shard, kind 0, grams, value): the log10 probabilities of all grams, a row for each place and shard."""
    held = sums.sparkSession.sparkContext.broadcast(low)

    def run(rows: pa.Table) -> pa.Table:
        gram, count = _added([(unpacked(g, ascending=True), unpacked(c)) for g, c in zip(rows["grams"].to_pylist(), rows["seen"].to_pylist())])
        value = Model(gram, count, held.value).log10(gram)
        out = [(i, 0, packed(gram[own], True), packed(value[own])) for i, own in enumerate(_groups(_shard(gram, shards), shards)) if len(own)]
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64(), pa.int32(), pa.binary(), pa.binary()])], ["shard", "kind", "grams", "seen"])

    return sums.where("grams IS NOT NULL").select("place", "grams", "seen").groupBy("place").applyInArrow(run, "shard long, kind int, grams binary, seen binary")


def answered(lists: DataFrame, values: DataFrame, sums: DataFrame, shards: int) -> DataFrame:
    """(block, grams, values, words, counts): for each list of a block the values of its grams and its words' counts."""
    none = lambda kind: F.lit(None).cast(kind)
    known = values.select(none("long").alias("block"), "shard", "kind", "grams", "seen", none("binary").alias("words"), none("binary").alias("n"))
    names = sums.where("words IS NOT NULL").select(none("long").alias("block"), "shard", F.lit(0).alias("kind"), none("binary").alias("grams"), none("binary").alias("seen"), "words", "n")
    asked = lists.select("block", "shard", "kind", "grams", none("binary").alias("seen"), "words", none("binary").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, gram, value, count = None, [], None, None, {}
        for row in _dicts(batches):
            if row["shard"] != now:
                now, found, gram, count = row["shard"], [], None, {}
            if row["kind"] == 0:
                if row["grams"] is not None:
                    found.append((unpacked(row["grams"], ascending=True), unpacked(row["seen"], np.float64)))
                else:
                    count.update(zip(_named(row["words"]), unpacked(row["n"]).tolist()))
                continue
            if gram is None:
                gram = np.concatenate([g for g, _ in found]) if found else np.zeros(0, np.int64)
                order = np.argsort(gram)
                gram, value = gram[order], (np.concatenate([v for _, v in found]) if found else np.zeros(0))[order]
            own = unpacked(row["grams"], ascending=True)
            n = np.array([count[w] for w in _named(row["words"])], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), *(pa.array([x], pa.binary()) for x in (row["grams"], packed(value[np.searchsorted(gram, own)]), row["words"], packed(n)))], ["block", "grams", "values", "words", "counts"])

    rows = known.unionByName(names).unionByName(asked)
    return _streamed(rows, shards).mapInArrow(run, "block long, grams binary, values binary, words binary, counts binary")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """Per row: the id, held_out, n_tokens, n_known, train_tokens, base_score (words by their add-one frequency) and
    score (log10 of the text's probability); rows that ``held`` (``held_out`` unless given) says are not learned from."""
    blocks = in_blocks(docs, id_col, text_col, held_out(id_col) if held is None else held)
    shards = min(SHARDS, max(8, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // SHARD)))
    lists = gathered(blocks, shards)
    sums = added(lists, shards)
    tokens, kinds = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    answers = answered(lists, valued(sums, low_model(sums), shards), sums, shards)
    names = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(a, b) for a, b in names)])

    def run(texts: pa.Table, known: pa.Table) -> pa.Table:
        text = pc.fill_null(texts["text"].combine_chunks(), b"")
        rows = len(text)
        gram, value, names, count = [], [], [], []
        for row in _dicts(known.to_batches()):
            gram.append(unpacked(row["grams"], ascending=True))
            value.append(unpacked(row["values"], np.float64))
            names += _named(row["words"])
            count.append(unpacked(row["counts"]))
        gram, value, count = np.concatenate(gram), np.concatenate(value), np.concatenate(count)
        gram, first = np.unique(gram, return_index=True)  # a block that two tasks read has two lists
        value = value[first]
        base = np.log10((count + 1) / (tokens + kinds + 1))
        known_words, end = pa.array(names, pa.large_binary()), names.index(END_WORD)
        n_tokens, n_known, base_score, score = np.ones(rows, np.int64), np.full(rows, int(count[end] > 0)), np.full(rows, base[end]), np.zeros(rows)
        for row, part in slices(text):
            own = slice(row, row + len(part))
            flat, n_words = words(part)
            at = pc.index_in(flat, value_set=known_words).to_numpy()
            doc = np.repeat(np.arange(len(part)), n_words)
            n_tokens[own] += n_words
            n_known[own] += np.bincount(doc, count[at] > 0, len(part)).astype(np.int64)
            base_score[own] += np.bincount(doc, base[at], len(part))
            edges = np.cumsum(pc.binary_length(part).to_numpy().astype(np.int64) + 1)
            for done, code in grams(part.to_pylist()):
                # Grams and texts in one number each, so that sorting brings equal grams together.
                doc = np.searchsorted(edges, done + np.arange(len(code)), "right").astype(np.uint64)
                code = np.sort(code.astype(np.uint64) << np.uint64(16) | doc)
                key, n = _runs(code >> np.uint64(16))
                got = np.repeat(value[np.searchsorted(gram, key.astype(np.int64))], n)
                score[own] += np.bincount((code & np.uint64(0xFFFF)).astype(np.int64), got, len(part))
        columns = [texts["id"], texts["held"], n_tokens, n_known, np.full(rows, tokens), base_score, score]
        return pa.table([x if isinstance(x, pa.ChunkedArray) else pa.array(x) for x in columns], schema.names)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
