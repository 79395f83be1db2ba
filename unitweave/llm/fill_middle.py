"""Fill-in-the-middle rearrangement by bit-parallel boundaries.

A text is a row of units: a run of white space with the word after it, or the white space at the end. ``bytes.translate``
turns the UTF-8 bytes into a string of binary digits, one for each byte, which ``int`` reads as one big integer; bit i
is byte i. Shifted boolean operations on it mark the last byte of every unit, ``bit_count`` counts the units, and the
k-th mark is found by halving the integer again and again: each half is half as long, so a rank costs as much as one
pass. White space is ASCII, so that boundaries of bytes are boundaries of characters.

Rows: null and empty texts are plain, with 0 units and an empty output; a null id is hashed as an empty one; repeated
rows repeat; texts are worked on whole, one at a time, whatever their length; of the input only the two named columns
are read, so that other columns cannot clash; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Digits that a byte becomes: 1 for white space; 1 for the first byte of a character.
_IS_SPACE = bytes(49 if x in SPACES else 48 for x in range(256))
_IS_FIRST = bytes(48 if 0x80 <= x < 0xC0 else 49 for x in range(256))


class Cut(NamedTuple):
    """One text rearranged; the characters are None where the form is plain."""

    units: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def mask(text: bytes, digits: bytes) -> int:
    """The integer whose bit i is the digit of byte i."""
    return int(text.translate(digits)[::-1], 2) if text else 0


def unit_ends(text: bytes) -> int:
    """Bits at the last bytes of the units."""
    if not text:
        return 0
    spaces = mask(text, _IS_SPACE)
    top = 1 << len(text) - 1
    words = (top << 1) - 1 ^ spaces
    return words & ~(words >> 1) | spaces & top  # a word byte that no word byte follows; the text's last byte


def select(bits: int, rank: int) -> int:
    """The place of the rank-th set bit, counted from 1."""
    at = 0
    while (n := bits.bit_length()) > 64:
        half = n // 2
        low = bits & (1 << half) - 1
        if (inside := low.bit_count()) >= rank:
            bits = low
        else:
            bits, rank, at = bits >> half, rank - inside, at + half
    for _ in range(rank - 1):
        bits &= bits - 1
    return at + (bits & -bits).bit_length() - 1


def draws(seed: int, doc_id) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that follow from the seed and the id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))


def cut(text: bytes, numbers: tuple[int, int, int, int], rate: int = 50, spm_rate: int = 80) -> Cut:
    """Rearranges ``text``: in ``rate`` of 100 draws, and of these in ``spm_rate`` of 100 with the suffix first."""
    ends = unit_ends(text)
    n = ends.bit_count()
    h1, h2, h3, h4 = numbers
    if not text or h3 % 100 >= rate or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)):
        return Cut(n, "plain", None, None, text)
    a, b = (select(ends, k) + 1 if k else 0 for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    first = mask(text, _IS_FIRST)
    until_a, until_b = ((first & (1 << x) - 1).bit_count() for x in (a, b))
    parts = (PREFIX + text[:a], SUFFIX + text[b:], MIDDLE + text[a:b])
    form = "spm" if h4 % 100 < spm_rate else "psm"
    if form == "spm":
        parts = (parts[1], parts[0], parts[2])
    return Cut(n, form, until_a, until_b - until_a, b"".join(parts))


def restored(output: bytes, form: str) -> bytes:
    """The text again. No text that is not plain holds a marker, so the first of each kind is the one that was put in."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    if not output.startswith(first):
        raise ValueError("no marker at the start")
    one, _, rest = output[len(first) :].partition(second)
    two, mark, middle = rest.partition(MIDDLE)
    if not mark:
        raise ValueError("no middle")
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _binary(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def rearranged(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80) -> DataFrame:
    """Per row: the id, n, form, prefix_chars, middle_chars and output (the rearranged text)."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                done = [cut(t, draws(seed, i), rate, spm_rate) for i, t in zip(part.column(0).to_pylist(), _binary(part.column(1)))]
                n, form, prefix, middle, output = zip(*done)
                out = pa.array(output, pa.large_binary()).cast(pa.binary()).view(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), out], schema.names)

    return df.select(id_col, text_col).mapInArrow(run, schema)


def digest(done: DataFrame) -> DataFrame:
    """The rows of ``rearranged`` with digests in place of the output: of it, and of the text rebuilt from it."""
    kept = [f for f in done.schema.fields if f.name != "output"]
    schema = T.StructType([*kept, T.StructField("output_sha256", T.StringType()), T.StructField("restored_sha256", T.StringType())])
    form, output = done.columns.index("form"), done.columns.index("output")
    others = [i for i in range(len(done.columns)) if i != output]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                outputs = _binary(part.column(output))
                back = [restored(x, f) for x, f in zip(outputs, part.column(form).to_pylist())]
                digests = [pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string()) for xs in (outputs, back)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in others), *digests], schema.names)

    return done.mapInArrow(run, schema)


SQL = r"""
WITH a AS (
    SELECT doc_id, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
           sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents),
b AS (
    SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) % (len(u) + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (len(u) + 1) AS y,
           CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 50 THEN 'plain'
                WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM a),
c AS (
    SELECT *, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
           array_to_string(u[greatest(x, y) + 1:n], '') AS s
    FROM b)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
