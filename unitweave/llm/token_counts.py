"""Token counts by rank-synchronous array merging.

Pre-tokens of many texts are held as one ragged numpy array of symbols. In every round each pre-token looks up its
adjacent pairs, and all its pairs of the lowest rank merge at once, in all pre-tokens together; what survives is
counted. A merge can only make pairs of a higher rank than its own, so this gives what merging one pair at a time
gives. Counts of pre-tokens are kept in a direct-mapped table of fixed size, so that frequent ones merge once.

Rows: null and empty texts have 0 bytes and 0 tokens; every input row gives one output row (repeated rows repeat);
texts are counted whole, whatever their length; other columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

_NONE = np.int32(2**31 - 1)
_MULT = np.uint64(0x9E3779B97F4A7C15)
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
CACHE_BITS = 21
#: Characters that are counted at once, but for a longer single text.
BLOCK_CHARS = 400_000


class MergeTable:
    """Merges of a byte-level BPE file with word ends, as arrays: pair -> (rank, symbol)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"] and not t["normalized"]]
        shown = byte_characters()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[c + suffix] for c in shown], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.bits = int(len(keys) * 8).bit_length()
        size = 1 << self.bits
        self.key, self.rank, self.made = np.full(size, 2**64 - 1, np.uint64), np.full(size, _NONE), np.zeros(size, np.int32)
        for rank in range(len(keys)):
            slot = int(keys[rank]) * int(_MULT) % 2**64 >> 64 - self.bits
            while self.rank[slot] != _NONE and self.key[slot] != keys[rank]:
                slot = (slot + 1) % size
            if self.rank[slot] == _NONE:
                self.key[slot], self.rank[slot], self.made[slot] = keys[rank], rank, made[rank]

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, symbol) of each pair; the rank is the largest int where the pair does not merge."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        with np.errstate(over="ignore"):
            slot = (keys * _MULT >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.key[slot]
        rank, made = np.where(there == keys, self.rank[slot], _NONE), self.made[slot]
        open_ = np.flatnonzero((there != keys) & (self.rank[slot] != _NONE))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(self.key) - 1)
            at = slot[open_]
            hit = self.key[at] == keys[open_]
            rank[open_[hit]], made[open_[hit]] = self.rank[at[hit]], self.made[at[hit]]
            open_ = open_[~hit & (self.rank[at] != _NONE)]
        return rank, made


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: a byte that is printable stands
    for itself, the others follow from U+0100 on."""
    shown, spare = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            shown.append(chr(b))
        else:
            shown.append(chr(spare))
            spare += 1
    return shown


def count_symbols(table: MergeTable, tokens: list[bytes]) -> np.ndarray:
    """The number of symbols that each non-empty pre-token ends with."""
    n = len(tokens)
    out = np.zeros(n, np.int32)
    if not n:
        return out
    sizes = np.fromiter(map(len, tokens), np.int64, n)
    raw = np.frombuffer(b"".join(tokens), np.uint8)
    symbols = table.inner[raw]
    last = np.cumsum(sizes) - 1
    symbols[last] = table.last[raw[last]]
    of = np.repeat(np.arange(n), sizes)  # the pre-token of each symbol
    rank, made = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int32)

    def look(at: np.ndarray) -> None:
        at = at[at + 1 < len(symbols)]
        at = at[of[at] == of[at + 1]]
        rank[at], made[at] = table.find(symbols[at], symbols[at + 1])

    look(np.arange(len(symbols)))
    while len(symbols):
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        lowest = np.minimum.reduceat(rank, heads)
        count = np.diff(np.r_[heads, len(symbols)])
        if (done := lowest == _NONE).any():
            out[of[heads[done]]] = count[done]
            keep = np.repeat(~done, count)
            symbols, of, rank, made = symbols[keep], of[keep], rank[keep], made[keep]
            if not len(symbols):
                break
            lowest, count = lowest[~done], count[~done]
        pick = rank == np.repeat(lowest, count)
        # In a run of overlapping picks (a symbol repeated) every other one merges, from the left.
        at = np.flatnonzero(pick)
        run = np.cumsum(np.r_[True, np.diff(at) != 1]) - 1
        first = np.flatnonzero(np.r_[True, np.diff(at) != 1])
        at = at[(np.arange(len(at)) - first[run]) % 2 == 0]
        symbols[at] = made[at]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        place = np.cumsum(keep) - 1
        symbols, of, rank, made = symbols[keep], of[keep], rank[keep], made[keep]
        at = place[at]
        near = np.unique(np.r_[at, at[at > 0] - 1])
        rank[near] = _NONE
        look(near)
    return out


@cache
def _classes() -> np.ndarray:
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = OTHER
    return out


def _split(codes: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pre-tokens: letters in a row, single numbers, other signs in a row, and the English
    contractions after an apostrophe; edges: where each text begins."""
    kind = _classes()[codes]
    begin = np.ones(len(codes) + 1, bool)
    begin[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    begin[edges] = True
    quote = np.flatnonzero((codes == 39) & begin[:-1])
    quote = quote[quote + 1 < len(codes)]
    quote = quote[(kind[quote + 1] == LETTER) & ~np.isin(quote + 1, edges)]
    one = np.isin(codes[quote + 1], [ord(c) for c in "stmd"])
    two = np.zeros(len(quote), bool)
    more = np.flatnonzero(quote + 2 < len(codes))
    second = quote[more] + 2
    pair = codes[second - 1].astype(np.int64) << 32 | codes[second]
    two[more] = np.isin(pair, [ord(a) << 32 | ord(b) for a, b in ("re", "ve", "ll")]) & ~begin[second]
    for q, size in ((quote[one], 2), (quote[two & ~one], 3)):
        begin[q + 1] = False
        begin[q + size] = True
    starts = np.flatnonzero(begin[:-1])
    ends = np.r_[starts[1:], len(codes)]
    keep = kind[starts] != SPACE
    return starts[keep], ends[keep]


class Counter:
    """Counts tokens of texts; keeps the counts of pre-tokens in a table of 2**CACHE_BITS places."""

    def __init__(self, table: MergeTable):
        self.table = table
        self.key, self.size = np.zeros(1 << CACHE_BITS, np.uint64), np.zeros(1 << CACHE_BITS, np.int32)
        self.special = regex.compile("|".join(map(regex.escape, table.special))) if table.special else None
        self.letter = np.random.default_rng(7).integers(1, 1 << 63, 1 << 16, dtype=np.uint64)

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the library lowers each character alone, without the final sigma
                return "".join(map(str.lower, text))
        return text.lower()

    def counts(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        piece, rows, size = [], [], 0
        for i, text in enumerate(texts):
            if not text:
                continue
            parts = [text]
            if self.special is not None and "<|" in text:
                parts = self.special.split(text)
                out[i] += len(parts) - 1
            for part in parts:
                if part and (part := self.normal(part)):
                    piece.append(part)
                    rows.append(i)
                    size += len(part)
            if size > BLOCK_CHARS:
                self._add(piece, rows, out)
                piece, rows, size = [], [], 0
        if piece:
            self._add(piece, rows, out)
        return out

    def _add(self, pieces: list[str], rows: list[int], out: np.ndarray) -> None:
        from unitweave.llm.textarrays import mix, powers

        joined = "".join(pieces)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.cumsum([0, *map(len, pieces)])
        starts, ends = _split(codes, edges[:-1])
        up, down = powers(len(codes) + 1)
        total = np.empty(len(codes) + 1, np.uint64)
        total[0] = 0
        with np.errstate(over="ignore"):
            value = self.letter[codes & 0xFFFF] + (codes.astype(np.uint64) << np.uint64(8))
            np.cumsum(value * up[: len(codes)], out=total[1:])
            key = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64)) | np.uint64(1)
        slot = (key >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        found = self.size[slot]
        miss = np.flatnonzero(self.key[slot] != key)
        if len(miss):
            new, first, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
            at = miss[first]
            made = count_symbols(self.table, [joined[a:b].encode("utf-8", "surrogatepass") for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            found[miss] = made[inverse]
            place = (new >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
            self.key[place], self.size[place] = new, made
            # Of several that meet in a place the last assignment stays, in both arrays alike.
        sums = np.r_[0, np.cumsum(found, dtype=np.int64)]
        cut = np.searchsorted(starts, edges)
        np.add.at(out, np.array(rows), sums[cut[1:]] - sums[cut[:-1]])


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str, limit: int = 2048) -> DataFrame:
    """Per row: the id, n_bytes, n_tokens and over_limit (n_tokens > limit), without special tokens around the text.

    path: a vocabulary file of the driver; its tables (a few MB, as long as the vocabulary) travel with the tasks.
    """
    spark = df.sparkSession
    table = spark.sparkContext.broadcast(MergeTable(path))
    kind = df.schema[id_col].dataType
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(table.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = part.column(1)
                n = counter.counts(texts.to_pylist())
                import pyarrow.compute as pc

                size = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n), pa.array(n > limit)], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
