"""Compression of vectors to one byte for each of four parts, with a vantage-point tree over each part's codebook.

Components become integers, floor(1024 * x); vectors are cut into equal parts, and every part position has a codebook of
up to 256 entries, trained by rounds of assigning and averaging in integers. Assignment searches a vantage-point tree:
a node knows the least and the greatest distance from its vantage entry to the entries of either child, rounded outwards
to integers; a child is left out only if the bound on its distances is strictly greater than the best so far, so that
equal distances are always seen and ties go to the lower index. All distances are compared as exact integers. Rows are
searched together: a node gets all rows of a batch that may have their nearest entry below it.

On Spark a round is one pass: tasks send sums and counts for each entry (never rows), and the driver gets the sums of
one codebook, whose size the parameters bound. Sums travel in limbs of 40 bits, so that no number of rows or size of
component overflows.

Rows: rows whose vector is null or holds null or non-finite components are left out. The length that counts is that of
the kept row of the least id (then least vector; null ids come last); a row of another length stays with a null code and
error. Vectors are padded with zeros to a multiple of four. Repeated ids and equal vectors are rows of their own; equal
ids rank by their vectors. An error beyond 64 bits, and a sum of errors beyond that, is null; label errors sum the known
errors. An empty table gives no rows. Only the three named columns are read, so that others cannot clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitweave.llm.scratch import stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf, which are compared one by one.
LEAF = 16
#: Rows that are searched together.
ROWS = 4096
#: Components up to this size are held in doubles, in which all sums below are exact integers; larger ones in Python's.
SMALL = 1 << 20
LIMB = 40
#: Labels up to which their sums go to every task; more of them are joined by a salted shuffle.
BROADCAST_LABELS, SALTS = 100_000, 64
_MOST = (1 << 63) - 1


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(1024 * x): as doubles, or as Python integers where one is large."""
    if not x.size or np.abs(x).max() <= SMALL / SCALE:
        return np.floor(x * float(SCALE))
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) * SCALE if abs(v) >= 2.0**53 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return out


def _exact(entries: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both as doubles where their squared distances are exact in doubles, else both as Python integers."""
    if entries.dtype != object and x.dtype != object and entries.shape[1] <= 1024:
        return entries, x
    whole = np.frompyfunc(int, 1, 1)
    return whole(entries).astype(object), whole(x).astype(object)


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to all entries."""
    if x.dtype == object:
        return np.array([[sum((a - b) ** 2 for a, b in zip(r, e)) for e in entries.tolist()] for r in x.tolist()], object).reshape(len(x), len(entries))
    return (x * x).sum(1)[:, None] + (entries * entries).sum(1) - 2 * (x @ entries.T)


def _root(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Square roots rounded down and up to integers."""
    if squares.dtype == object:
        low = np.frompyfunc(math.isqrt, 1, 1)(squares)
    else:
        low = np.floor(np.sqrt(squares))
        low -= low * low > squares
        low += (low + 1) * (low + 1) <= squares
    return low, low + (low * low < squares)


class Tree:
    """A vantage-point tree over the rows of ``entries``."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.root = self._node(np.arange(len(entries)))

    def _node(self, ids: np.ndarray):
        if len(ids) <= LEAF:
            return ids
        spread = _squares(self.entries[ids[:1]], self.entries[ids])[0]
        vantage = ids[int(np.argmax(spread))]
        rest = ids[ids != vantage]
        squares = _squares(self.entries[[vantage]], self.entries[rest])[0]
        order = np.argsort(squares, kind="stable")
        half = len(rest) // 2
        children = []
        for part in (order[:half], order[half:]):
            low, high = _root(squares[part])
            children.append((low.min(), high.max(), self._node(np.sort(rest[part]))))
        return vantage, children

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the index of its nearest entry, the lower one of equals, and the squared distance."""
        self.x, n = x, len(x)
        self.best = np.full(n, -1 if x.dtype == object else np.inf, x.dtype)
        if x.dtype == object:
            self.best[:] = _squares(x, self.entries[:1])[:, 0] if n else []
        self.index = np.zeros(n, np.int64) if x.dtype == object else np.full(n, len(self.entries))
        if n:
            self._visit(self.root, np.arange(n))
        return self.index, self.best

    def _take(self, rows: np.ndarray, squares: np.ndarray, ids) -> None:
        better = (squares < self.best[rows]) | (squares == self.best[rows]) & (ids < self.index[rows])
        better = better.astype(bool)
        self.best[rows[better]] = squares[better]
        self.index[rows[better]] = ids[better] if isinstance(ids, np.ndarray) else ids

    def _visit(self, node, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, np.ndarray):
            squares = _squares(self.x[rows], self.entries[node])
            at = squares.argmin(1)  # the first of equals, and the indexes ascend
            self._take(rows, squares[np.arange(len(rows)), at], node[at])
            return
        vantage, children = node
        squares = _squares(self.x[rows], self.entries[[vantage]])[:, 0]
        self._take(rows, squares, int(vantage))
        low, high = _root(squares)
        bounds = [np.maximum(np.maximum(low - far, near - high), 0) for near, far, _ in children]
        inner = (bounds[0] <= bounds[1]).astype(bool)
        for group, order in ((inner, (0, 1)), (~inner, (1, 0))):
            for child in order:
                here, bound = rows[group], bounds[child][group]
                open_ = (bound * bound <= self.best[here]).astype(bool)
                self._visit(children[child][2], here[open_])


def _matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column whose lists have one length."""
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def _parts(x: np.ndarray) -> list[np.ndarray]:
    """The integer parts of each row, padded with zeros."""
    width = -(-x.shape[1] // PARTS)
    if x.shape[1] < PARTS * width:
        x = np.hstack([x, np.zeros((len(x), PARTS * width - x.shape[1]))])
    v = quantised(x)
    return [v[:, p * width : (p + 1) * width] for p in range(PARTS)]


class Assigner:
    """Finds the nearest entries of batches; trees over doubles and over Python's integers are built when needed."""

    def __init__(self, books: list[np.ndarray]):
        self.books, self.trees = books, {}

    def __call__(self, part: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        entries, x = _exact(self.books[part], x)
        key = part, x.dtype == object
        if key not in self.trees:
            self.trees[key] = Tree(entries)
        return self.trees[key].nearest(x)


def _limbs(value: int) -> Iterator[tuple[int, int]]:
    """(place, limb) with value = sum of limb << 40 * place; all limbs but the last are not negative."""
    place = 0
    while abs(value) >> LIMB:
        yield place, value & (1 << LIMB) - 1
        value >>= LIMB
        place += 1
    yield place, value


_SUMS = "part int, entry int, pos int, place int, value long"


def _sums(books: list[np.ndarray]):
    """A mapInArrow function: a task's sums (and at pos -1 counts) of the parts that are nearest to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, size, width = Assigner(books), len(books[0]), books[0].shape[1]
        small, count = np.zeros((PARTS, size, width), np.int64), np.zeros((PARTS, size), np.int64)
        large: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                for p, x in enumerate(_parts(_matrix(batch.column(0).slice(at, ROWS)))):
                    index, _ = find(p, x)
                    count[p] += np.bincount(index, minlength=size)
                    for c in range(width):
                        if x.dtype != object:
                            small[p, :, c] += np.bincount(index, x[:, c], size).astype(np.int64)
                        else:
                            for e, v in zip(index.tolist(), x[:, c].tolist()):
                                large[p, e, c] = large.get((p, e, c), 0) + int(v)
        out = [(p, e, -1, 0, int(count[p, e])) for p, e in zip(*np.nonzero(count))]
        for p, e in zip(*np.nonzero(count)):
            for c in range(width):
                out += [(p, e, c, place, limb) for place, limb in _limbs(int(small[p, e, c]) + large.get((p, e, c), 0)) if limb]
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(np.array(c, np.int32)) for c in columns[:4]), pa.array(np.array(columns[4], np.int64))], ["part", "entry", "pos", "place", "value"])

    return run


def kept_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(_id, _v, _label) of the rows whose vector is whole and finite."""
    rows = df.select(F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_v"), F.col(label_col).alias("_label"))
    return rows.where(F.col("_v").isNotNull() & F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def first_rows(rows: DataFrame, n: int = ENTRIES) -> list[list[float]]:
    """The vectors of the n least ids among those as long as the first; at most n rows reach the driver. Ids are taken
    first, so that tasks send vectors only for the ids that can be among them."""

    def least(of: DataFrame, k: int) -> list:
        ids = of.select("_id").orderBy(F.col("_id").asc_nulls_last()).limit(k).collect()
        if len(ids) == k and ids[-1][0] is not None:
            of = of.where(F.col("_id") <= F.lit(ids[-1][0]))
        return [list(r[0]) for r in of.orderBy(F.col("_id").asc_nulls_last(), "_v").select("_v").limit(k).collect()]

    one = least(rows, 1)
    return least(rows.where(F.size("_v") == len(one[0])), n) if one else []


class Codebooks(NamedTuple):
    """For each part position the integer entries; and the length of the vectors that have codes."""

    entries: list[np.ndarray]
    length: int


def learn(rows: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES) -> Codebooks | None:
    """The codebooks of ``kept_rows``, with fewer entries where there are fewer rows; None without rows."""
    seeds = first_rows(rows, entries)
    if not seeds:
        return None
    books = _parts(np.array(seeds, np.float64).reshape(len(seeds), -1))
    same = rows.where(F.size("_v") == len(seeds[0])).select("_v")
    for _ in range(rounds):
        sums = same.mapInArrow(_sums(books), _SUMS).groupBy("part", "entry", "pos", "place").agg(F.sum("value").alias("value"))
        found: dict[tuple[int, int, int], int] = {}
        for batch in sums.toArrow().to_batches():
            for p, e, c, place, value in zip(*(x.to_pylist() for x in batch.columns)):
                found[p, e, c] = found.get((p, e, c), 0) + (value << LIMB * place)
        new = []
        for p, book in enumerate(books):
            made = np.array([[found.get((p, e, c), 0) // found[p, e, -1] if (p, e, -1) in found else int(v) for c, v in enumerate(row)] for e, row in enumerate(book.tolist())], object)
            made = made.reshape(book.shape)
            new.append(made.astype(np.float64) if not made.size or max(abs(v) for v in made.ravel()) <= SMALL else made)
        books = new
    return Codebooks(books, len(seeds[0]))


def books_digest(books: Codebooks) -> str:
    """sha256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for book in books.entries for v in book.ravel().tolist()).encode()).hexdigest()


def coded(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(_id, _label, code, error) of ``kept_rows``."""
    schema = T.StructType([rows.schema["_id"], rows.schema["_label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = Assigner(books.entries)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                codes, errors = np.zeros((own.num_rows, PARTS), np.uint8), [0] * own.num_rows
                for p, x in enumerate(_parts(_matrix(own.column(2)))):
                    index, squares = find(p, x)
                    codes[:, p] = index
                    errors = [a + int(b) for a, b in zip(errors, squares.tolist())]
                hexes = codes.tobytes().hex()
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array([hexes[i : i + 2 * PARTS] for i in range(0, len(hexes), 2 * PARTS)], pa.string()), pa.array([e if e <= _MOST else None for e in errors], pa.int64())], schema.names)

    others = rows.where(F.size("_v") != books.length).select("_id", "_label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return rows.where(F.size("_v") == books.length).select("_id", "_label", "_v").mapInArrow(run, schema).unionAll(others)


def compressed(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """Per kept row: the id, code, error, label_error and codebooks_sha256. Codebooks are learned from the same rows."""
    rows = kept_rows(df, id_col, vector_col, label_col)
    books = learn(rows, rounds)
    if books is None:
        return df.select(id_col, F.lit("").alias("code"), *(F.lit(0).cast("long").alias(x) for x in ("error", "label_error")), F.lit("").alias("codebooks_sha256")).limit(0)
    done = stored(coded(rows, books), "codes")
    sums = stored(done.groupBy(F.col("_label").alias("_l")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    return joined_by_label(done, sums).select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def joined_by_label(done: DataFrame, sums: DataFrame, most: int = BROADCAST_LABELS) -> DataFrame:
    """``done`` with the sums of its labels; a label that holds a large part of all rows is spread over ``SALTS`` tasks."""
    if sums.count() <= most:
        return done.join(F.broadcast(sums), F.col("_label").eqNullSafe(F.col("_l")))
    salted = sums.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    done = done.withColumn("_t", F.pmod(F.xxhash64("_id", "code", "error"), F.lit(SALTS)).cast("int"))
    return done.join(salted, F.col("_label").eqNullSafe(F.col("_l")) & (F.col("_s") == F.col("_t")))


def _sql() -> str:
    """One common table for each assignment and each codebook."""
    steps = [
        """kept AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len([1 for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0)""",
        """parts AS MATERIALIZED (
    SELECT r, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM kept, range(4) AS t(p))""",
        "book0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS y FROM parts WHERE r <= 256)",
    ]
    for i in range(ROUNDS + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
    SELECT r, p, any_value(x) AS x, min((list_inner_product(x, x) + list_inner_product(y, y) - 2 * list_inner_product(x, y)) * 256 + e) AS m
    FROM parts JOIN book{i} USING (p) GROUP BY r, p)""")
        if i < ROUNDS:
            steps.append(f"""mean{i} AS (
    SELECT p, e, list(s ORDER BY c) AS y FROM (
        SELECT p, CAST(m % 256 AS BIGINT) AS e, c, floor(sum(x[c]) / count(*)) AS s FROM near{i}, range(1, (SELECT max(len(x)) FROM parts) + 1) AS t(c) GROUP BY ALL)
    GROUP BY p, e),
book{i + 1} AS MATERIALIZED (
    SELECT b.p, b.e, coalesce(mean{i}.y, b.y) AS y FROM book{i} AS b LEFT JOIN mean{i} ON b.p = mean{i}.p AND b.e = mean{i}.e)""")
    return (
        "WITH " + ",\n".join(steps) + f""",
codes AS (
    SELECT r, lower(string_agg(printf('%02x', CAST(m % 256 AS BIGINT)), '' ORDER BY p)) AS code, CAST(sum(floor(m / 256)) AS BIGINT) AS error
    FROM near{ROUNDS} GROUP BY r),
digest AS (
    SELECT sha256(string_agg(array_to_string([CAST(CAST(z AS BIGINT) AS VARCHAR) for z in y], ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN codes USING (r), digest
"""
    )


SQL = _sql()
