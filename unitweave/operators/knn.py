"""Exact neighbours through a stored index of cells, pruned by the triangle inequality.

``build`` puts equal vectors together (with their number and their least ids), and deals them to the nearest of some
drawn pivots, level by level, until a cell has at most ``size`` vectors. A cell knows its centre and radius. A query
first meets its home cell, which gives it a bound, and then only those cells that can hold something nearer:
distance to the centre - radius <= bound. Whole cells inside a radius are counted without meeting anyone.

Rows meet in cogroups of one key whose left side is cut into chunks and whose right side (the pivots or nodes below a key,
the vectors of a cell or shelf) is bounded, so that neither a hot cell nor a hot class comes to one task. Cells that lie
together are a shelf of ``SHELF`` bytes at most; a query travels once to each shelf that holds a cell it has to meet, and
its task meets the shelf's cells one after the other in blocks of ``BLOCK`` rows. So what travels grows with the number
of shelves and not of cells, also where nothing can be pruned and all queries meet all cells. The nodes of an index go to
all tasks while they have at most ``NODES`` bytes; beyond, queries descend by two joins.

Rows: vectors have one length; rows with a null vector or (with ``by``) class are left out; q names a query: identical
repeated rows count once; repeated ids of units are one unit where their vectors are equal. No units: no neighbours,
counts of 0. Only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from unitweave.functions import vectors as V
from unitweave.sources.scratch import drop, fresh_path, kept

#: Rows of the left side of a meeting.
CHUNK = 4096
#: Meetings for each core that a smaller left side is cut into, while they have ``BLOCK`` rows.
SHARES = 3
#: Vectors of a cell: about twice the root of all, between these.
LEAST, MOST = 256, 4096
#: Bytes of the vectors of a shelf of cells, a twelfth of all between these, and as many queries are a chunk.
LEAST_SHELF, SHELF = 4 << 20, 24 << 20
#: Rows of the left side that meet a cell at once.
BLOCK = 1024
#: Pivots at which a cell is split at once, and how often cells are split by pivots before chance splits the rest.
PIVOTS, LEVELS = 256, 12
#: Bytes of the nodes that go to all tasks, and of small tables that are joined to large ones.
NODES = 32 << 20
#: Rounding that a bound on distances allows for, as a part of them.
SLACK = 1e-9


class Index(NamedTuple):
    """points (c, shelf, cell, ids, n, v) and cells (c, shelf, top, cell, v, radius, n); copies: the ids kept of equal
    vectors; rows: the vectors of a shelf."""

    points: DataFrame
    cells: DataFrame
    copies: int
    rows: int = MOST


_INDEX = "c string, shelf long, top long, cell long, ids array<long>, n long, v array<double>, radius double, copies int, shelf_rows int, is_cell boolean"


def read(spark: SparkSession, path: str) -> Index:
    """An index that ``build`` stored at ``path``."""
    both = spark.read.schema(_INDEX).parquet(path)
    cells = both.where("is_cell")
    about = cells.select("copies", "shelf_rows").first()
    points = both.where("NOT is_cell").select("c", "shelf", "cell", "ids", "n", "v")
    return Index(points, cells.select("c", "shelf", "top", "cell", "v", "radius", "n"), about.copies if about else 1 << 30, about.shelf_rows if about else MOST)


def matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the product form: good for bounds and short lists, exact ones follow."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def meet(left: DataFrame, right: DataFrame, keys: list[str], spread: str, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str, sizes: DataFrame | None = None, chunk: int = CHUNK) -> DataFrame:
    """``work`` on the rows of ``left`` (a stored table) and ``right`` that share ``keys``, as a stored table; the rows of
    a key in ``left`` are dealt by a hash of ``spread`` to chunks of some ``chunk`` rows, fewer where cores would have no work, each of which gets
    all of the key's rows of ``right``, which may be none. sizes (keys, m): the rows of each key in ``left``, if they are known. Small tables among these
    are broadcast by Spark itself, which knows the sizes of stored tables."""
    chunks = sizes or kept(left.groupBy(*keys).agg(F.count(F.lit(1)).alias("m")), "chunks")
    n_keys, n_rows = chunks.agg(F.count(F.lit(1)), F.coalesce(F.sum("m"), F.lit(0))).first()
    cores = left.sparkSession.sparkContext.defaultParallelism
    chunk = min(chunk, max(BLOCK, n_rows // (SHARES * cores)))
    meetings = n_keys + n_rows // chunk
    parts = max(1, min(2 * meetings, max(8 * cores, meetings // 2)))

    def dealt(rows: DataFrame) -> DataFrame:
        """A large meeting costs the product of its sides, not their bytes, by which Spark would put many into one task."""
        return rows.repartition(parts, *keys, "_k") if n_rows >= meetings * BLOCK // 2 else rows

    count = F.ceil(F.col("m") / chunk).cast("long")
    many = chunks.where(F.col("m") > chunk).select(*keys, count.alias("_n"))
    a = left.join(many, keys, "left").withColumn("_k", F.pmod(F.xxhash64(spread), F.coalesce("_n", F.lit(1)))).select(*left.columns, "_k")
    b = right.join(chunks.select(*keys, count.alias("_n")), keys).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).select(*right.columns, "_k")
    want = _arrow(schema)

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        return work(x.drop_columns(["_k"]), y.drop_columns(["_k"])).cast(want) if x.num_rows else want.empty_table()

    out = kept(dealt(a).groupBy(*keys, "_k").cogroup(dealt(b).groupBy(*keys, "_k")).applyInArrow(run, schema), "met")
    if sizes is None:
        drop(chunks)
    return out


def _arrow(schema: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(schema))


def _ddl(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


# --- building -------------------------------------------------------------------------------------------------------


def _distinct(units: DataFrame, copies: int) -> DataFrame:
    """(c, v, n, ids): each different vector of a class once, with the ``copies`` least ids of its n units. Lists are
    joined in steps of some 4,096 ids, so that no number of copies makes a long one."""
    units = units.distinct()
    parts = -(-units.count() // 4096)
    ids = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, copies).alias("ids")
    out = units.select("c", "v", F.lit(1).cast("long").alias("n"), F.array("u").alias("ids"), F.xxhash64("u").alias("_h"))
    while parts > 1:
        out = out.groupBy("c", "v", F.pmod("_h", F.lit(parts)).alias("_h")).agg(F.sum("n").alias("n"), ids)
        parts = -(-parts * copies // 4096)
    return out.groupBy("c", "v").agg(F.sum("n").alias("n"), ids)


def _split(open_: DataFrame, large: DataFrame, size: int, level: int) -> DataFrame:
    """The rows of the cells of m > size vectors in ``large``, each in the cell of the nearest of some drawn pivots."""
    draw = F.xxhash64(F.lit(level), "v")
    wide = open_.join(large, ["c", "cell"]).withColumns({"draw": draw, "w": F.least(F.lit(PIVOTS), F.ceil(F.col("m") * 4 / size)).cast("int")})
    drawn = wide.where(F.pmod(F.shiftright("draw", 8), F.lit(1 << 30)) < (F.col("w") * 2 + 30.0) * (1 << 30) / F.col("m"))
    pivots = drawn.groupBy("c", "cell", "w").agg(F.array_sort(F.collect_list(F.struct("draw", "v"))).alias("x"))
    pivots = kept(pivots.select("c", "cell", F.explode(F.expr("slice(x, 1, w)")).alias("x")).select("c", "cell", F.col("x.v").alias("v")), "pivots")

    def work(x: pa.Table, y: pa.Table) -> pa.Table:
        p = np.unique(matrix(y["v"]), axis=0)
        # A pivot is nearest to itself, so two of them part a cell; where too few were drawn, chance does.
        child = squares(matrix(x["v"]), p).argmin(1) if len(p) > 1 else x["draw"].to_numpy() % 2
        return x.append_column("child", pa.array(child, pa.int64()))

    wide = wide.drop("m", "w")
    met = meet(wide, pivots, ["c", "cell"], "v", work, _ddl(wide, *wide.columns) + ", child long", large)
    drop(pivots)
    return met.withColumn("cell", F.xxhash64("cell", "child", F.lit(level))).drop("child", "draw")


def build(units: DataFrame, by: str | None = None, copies: int = 64, size: int | None = None, path: str | None = None) -> Index:
    """The index of units (u, v[, by]), stored at ``path`` (a scratch folder unless given) for ``read``. A search for k
    neighbours needs ``copies`` of k at least, one more where it leaves out the query itself."""
    spark = units.sparkSession
    path = path or fresh_path(spark, "neighbours")
    cls = F.col(by).cast("string") if by else F.lit("")
    rows = units.select(cls.alias("c"), F.col("u").cast("long").alias("u"), F.col("v").cast("array<double>").alias("v")).where("c IS NOT NULL AND v IS NOT NULL")
    open_ = kept(_distinct(rows, copies).withColumns({"top": F.lit(0).cast("long"), "cell": F.lit(0).cast("long")}), "vectors")
    n, width = open_.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    size = size or min(MOST, max(LEAST, 2 * math.isqrt(n)))
    width = 8 * max(width or 1, 1)
    shelf_rows = max(1, min(SHELF, max(LEAST_SHELF, n * width // 12)) // width)
    done, made = None, [open_]
    for level in range(LEVELS + 1):
        large = kept(open_.groupBy("c", "cell").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > size), "large")
        made.append(large)
        ready = open_.join(large, ["c", "cell"], "left_anti")
        done = ready if done is None else done.unionByName(ready)
        if large.isEmpty():
            break
        if level < LEVELS:
            open_ = _split(open_, large, size, level)
            made.append(open_)
            if level == 0:
                open_ = open_.withColumn("top", F.col("cell"))
        else:  # what pivots do not part, such as a few far apart beside many close together
            child = F.pmod(F.xxhash64("v"), F.ceil(F.col("m") / size).cast("long"))
            done = done.unionByName(open_.join(large, ["c", "cell"]).withColumn("cell", F.xxhash64("cell", child, F.lit(level))).drop("m"))
    # Cells in the order of their pivots fill shelves.
    cells = done.groupBy("c", "top", "cell").agg(F.count(F.lit(1)).alias("m"))
    before = F.sum("m").over(Window.partitionBy("c").orderBy("top", "cell")) - F.col("m")
    shelves = kept(cells.select("c", "cell", F.floor(before / shelf_rows).cast("long").alias("shelf")), "shelves")
    made.append(shelves)
    want = _arrow(_INDEX)

    def centred(t: pa.Table) -> pa.Table:
        v = matrix(t["v"])
        centre = v.mean(0)
        n = t.num_rows
        own = [*(t[x][:1] for x in want.names[:4]), pa.nulls(1, pa.list_(pa.int64())), pa.array([pc.sum(t["n"]).as_py()]), pa.array([centre.tolist()]), pa.array([float(np.sqrt(((v - centre) ** 2).sum(1)).max())]), pa.array([copies]), pa.array([shelf_rows]), pa.array([True])]
        rest = [*(t[x] for x in want.names[:7]), pa.nulls(n, pa.float64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.array(np.zeros(n, bool))]
        return pa.concat_tables(pa.table(x, want.names).cast(want) for x in (own, rest))

    done.join(shelves, ["c", "cell"]).select(want.names[:7]).groupBy("c", "cell").applyInArrow(centred, _INDEX).write.partitionBy("is_cell").parquet(path)
    drop(*made)
    return read(spark, path)


def _tops(cells: DataFrame) -> DataFrame:
    """(c, cell, v, radius, n): a node above the cells of each first pivot."""
    first = cells.groupBy("c", "top").agg(F.min_by("v", "cell").alias("centre"))
    reach = (V.distance(F.col("v"), F.col("centre")) + F.col("radius")) * (1 + SLACK)
    return cells.join(first, ["c", "top"]).groupBy("c", F.col("top").alias("cell")).agg(F.first("centre").alias("v"), F.max(reach).alias("radius"), F.sum("n").alias("n"))


# --- choosing cells -------------------------------------------------------------------------------------------------


class Nodes:
    """Centres, radii and counts of nodes of one class, as arrays."""

    def __init__(self, t: pa.Table):
        t = t.sort_by("cell")
        self.cell, self.v = t["cell"].to_numpy(), matrix(t["v"])
        self.shelf = t["shelf"].to_numpy() if "shelf" in t.column_names else np.zeros(len(self.cell), int)
        self.radius, self.n = t["radius"].to_numpy(), t["n"].to_numpy()

    def homes(self, v: np.ndarray, need: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, node): for each row the nodes nearest to it that have ``need`` vectors' units together, or all."""
        if not len(self.cell):
            return np.zeros(0, int), np.zeros(0, int)
        d = squares(v, self.v)
        first = d.argmin(1)
        short = self.n[first] < need
        rows, nodes = [np.flatnonzero(~short)], [first[~short]]
        for i in np.flatnonzero(short):
            order = np.argsort(d[i], kind="stable")
            last = int(np.searchsorted(np.cumsum(self.n[order]), need[i])) + 1
            rows.append(np.full(min(last, len(order)), i))
            nodes.append(order[:last])
        return np.concatenate(rows), np.concatenate(nodes)

    def within(self, v: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, node, whole): nodes that can hold something within the bound; whole: all they hold surely is."""
        if not len(self.cell):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        d = np.sqrt(squares(v, self.v))
        # The product form errs by some 1e-16 of the squared sizes.
        slack = SLACK * (1 + d + self.radius) + 1e-7 * np.sqrt((v * v).sum(1)[:, None] + (self.v * self.v).sum(1))
        rows, nodes = np.nonzero(d - self.radius - slack <= bound[:, None])
        return rows, nodes, d[rows, nodes] + self.radius[nodes] + slack[rows, nodes] <= bound[rows]


def _chosen(queries: DataFrame, index: Index, choose: Callable[[pa.Table, Nodes], pa.Table], limit: int | None, above: Callable[[pa.Table, Nodes], pa.Table] | None = None) -> DataFrame:
    """A stored table of the rows that ``choose`` makes of queries (q, c, v, ...) and nodes: the left rows that it takes,
    with the ``cell`` or ``shelf`` that they have to meet, each once. It gets ``BLOCK`` queries at a time. Where queries
    descend, ``above`` takes the nodes above cells (``choose`` does unless given)."""
    plain = _ddl(queries, *queries.columns)
    schema = f"{plain}, cell long, shelf long"
    want = _arrow(schema)

    def each(t: pa.Table, nodes: Nodes, choose=choose):
        yield want.empty_table()
        for at in range(0, t.num_rows, BLOCK):
            yield choose(t.slice(at, BLOCK), nodes).cast(want)

    size = index.cells.agg(F.sum(F.size("v") * 8 + 64)).first()[0] or 0
    if size <= (NODES if limit is None else limit):
        table = index.cells.select("c", "shelf", "cell", "v", "radius", "n").toArrow()
        found = {c: table.filter(pc.equal(table["c"], c)) for c in table["c"].unique().to_pylist()}
        held = queries.sparkSession.sparkContext.broadcast(found)

        def run(batches):
            nodes = {}
            for batch in batches:
                t = pa.Table.from_batches([batch])
                for c in t["c"].unique().to_pylist():
                    if c in held.value:
                        if c not in nodes:
                            nodes[c] = Nodes(held.value[c])
                        for out in each(t.filter(pc.equal(t["c"], c)), nodes[c]):
                            yield from out.to_batches()

        return kept(queries.mapInArrow(run, schema), "pairs")
    queries = kept(queries, "queries")
    tops = meet(queries, _tops(index.cells), ["c"], "q", lambda x, y: pa.concat_tables(each(x, Nodes(y), above or choose)), schema)
    below = kept(tops.drop("shelf").withColumnRenamed("cell", "top"), "below")
    met = meet(below, index.cells, ["c", "top"], "q", lambda x, y: pa.concat_tables(each(x.drop_columns(["top"]), Nodes(y))), schema)
    out = kept(met.distinct(), "pairs")  # nodes above may share a shelf
    drop(queries, tops, below, met)
    return out


def _took(x: pa.Table, rows: np.ndarray, cell: np.ndarray | None = None, shelf: np.ndarray | None = None) -> pa.Table:
    long = lambda a: pa.nulls(len(rows), pa.int64()) if a is None else pa.array(a, pa.int64())
    return x.take(pa.array(rows, pa.int64())).append_column("cell", long(cell)).append_column("shelf", long(shelf))


def _cells_within(x: pa.Table, nodes: Nodes, bound: np.ndarray | None = None) -> pa.Table:
    rows, at, _ = nodes.within(matrix(x["v"]), x["bound"].to_numpy() if bound is None else bound)
    return _took(x, rows, nodes.cell[at])


def _shelves_within(x: pa.Table, nodes: Nodes, bound: np.ndarray | None = None) -> pa.Table:
    rows, at, _ = nodes.within(matrix(x["v"]), x["bound"].to_numpy() if bound is None else bound)
    shelves, place = np.unique(nodes.shelf, return_inverse=True)
    meets = np.zeros((x.num_rows, len(shelves)), bool)
    meets[rows, place[at]] = True
    rows, at = np.nonzero(meets)
    return _took(x, rows, shelf=shelves[at])


# --- searching ------------------------------------------------------------------------------------------------------


class _Cells:
    """The vectors of a task's cells in the order of their cells, with centres, radii and the ids of equal vectors."""

    def __init__(self, y: pa.Table):
        y = y.take(pc.sort_indices(y["cell"]))
        self.v, cell = matrix(y["v"]), y["cell"].to_numpy()
        self.n = y["n"].to_numpy()
        if "ids" in y.column_names:
            ids = y["ids"].combine_chunks()
            self.ids = ids.flatten().to_numpy()
            self.many = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(int)
            self.at = np.cumsum(self.many) - self.many
        start = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, int)
        self.spans = list(zip(start.tolist(), [*start[1:].tolist(), len(cell)]))
        parts = [self.v[a:b] for a, b in self.spans]
        self.nodes = Nodes.__new__(Nodes)
        self.nodes.v = np.array([p.mean(0) for p in parts])
        self.nodes.radius = np.array([np.sqrt(((p - m) ** 2).sum(1)).max() for p, m in zip(parts, self.nodes.v)])
        self.nodes.cell = np.arange(len(parts))

    def units(self, rows: np.ndarray, hits: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, dist, u) of the kept ids of each vector hit."""
        many = self.many[hits]
        place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(self.at[hits], many)
        return np.repeat(rows, many), np.repeat(dist, many), self.ids[place]


def _exact(qv: np.ndarray, uv: np.ndarray, rows: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Squared distances of pairs, some at a time."""
    step = max(1, (4 << 20) // max(1, 8 * qv.shape[1]))
    return np.concatenate([np.zeros(0), *(((uv[hits[a : a + step]] - qv[rows[a : a + step]]) ** 2).sum(1) for a in range(0, len(rows), step))])


def _best(x: pa.Table, y: pa.Table, k: int, schema: pa.Schema) -> pa.Table:
    """(q, x): of the queries x and the cells y the ``k`` least (dist2, u) within the bound, without the held ones. A block
    of queries meets cell after cell, and what it has found bounds what it looks for."""
    if not y.num_rows or not x.num_rows:
        return schema.empty_table()
    cells, all_q, out = _Cells(y), matrix(x["v"]), []
    sizes = (cells.v * cells.v).sum(1)
    for at in range(0, x.num_rows, BLOCK):
        qv, part = all_q[at : at + BLOCK], x.slice(at, BLOCK)
        n, own = len(qv), (qv * qv).sum(1)
        bound = part["bound"].to_numpy()
        held = [(i, set(h)) for i, h in enumerate(part["held"].to_pylist()) if h]
        keep_out, need = dict(held), k + max((len(h) for _, h in held), default=0)
        dist, unit = np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)
        rows, at_cell, _ = cells.nodes.within(qv, bound)
        order = np.argsort(at_cell, kind="stable")
        cut = np.searchsorted(at_cell[order], np.arange(len(cells.spans) + 1))
        for c, (a, b) in enumerate(cells.spans):
            some = rows[order[cut[c] : cut[c + 1]]]
            if not len(some):
                continue
            edge = np.minimum(bound[some] * (1 + SLACK), np.sqrt(dist[some, k - 1]) * (1 + SLACK)) ** 2
            q, u = qv[some], cells.v[a:b]
            # The product form errs by less than 1e-9 of the sizes; pairs within that of the edge are looked at exactly.
            wide = sizes[a:b].max() + own[some]
            rough = q @ (-2.0 * u.T)
            rough += sizes[a:b]
            least = own[some] - 2e-9 * (1 + wide)
            free = ~np.isfinite(edge)
            if b - a > need and free.any():  # nothing found yet: the cell's own bound
                edge[free] = np.partition(rough[free], need - 1, axis=1)[:, need - 1] + (2 * own[some] - least)[free]
            i, j = np.nonzero(rough <= (edge - least)[:, None])
            if not len(i):
                continue
            exact = _exact(q, u, i, j)
            near = exact <= edge[i]
            i, d, ids = cells.units(some[i[near]], j[near] + a, exact[near])
            if held:
                free = np.array([z not in keep_out.get(r, ()) for r, z in zip(i.tolist(), ids.tolist())], bool)
                i, d, ids = i[free], d[free], ids[free]
            touched = np.unique(i)
            i = np.concatenate([i, np.repeat(touched, k)])
            d = np.concatenate([d, dist[touched].ravel()])
            ids = np.concatenate([ids, unit[touched].ravel()])
            best = np.lexsort((ids, d, i))
            i, d, ids = i[best], d[best], ids[best]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            first = rank < k
            dist[i[first], rank[first]], unit[i[first], rank[first]] = d[first], ids[first]
        got = np.isfinite(dist)
        many = got.sum(1)
        with_any = np.flatnonzero(many)
        pairs = pa.StructArray.from_arrays([pa.array(dist[got]), pa.array(unit[got])], ["dist2", "u"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many[with_any])], pa.int32()), pairs)
        out.append(pa.table([part["q"].take(pa.array(with_any)), lists], names=schema.names).cast(schema))
    return pa.concat_tables(out)


def _met(pairs: DataFrame, index: Index, k: int, by: str, chunk: int) -> DataFrame:
    """A stored table (q, x) of what each query found in each cell or shelf (``by``) that it met."""
    schema = f"{_ddl(pairs, 'q')}, x array<struct<dist2: double, u: bigint>>"
    arrow = _arrow(schema)
    return meet(pairs.select("q", "c", "v", "bound", "held", by), index.points.select("c", by, *({"cell"} - {by}), "ids", "n", "v"), ["c", by], "q", lambda x, y: _best(x, y, k, arrow), schema, chunk=chunk)


def search(queries: DataFrame, index: Index, k: int, eps: float = 0.0, limit: int | None = None, met: list | None = None) -> DataFrame:
    """A stored table (q, x): x is the list of the ``k`` least (dist2, u) of each query (q, c, v[, held]), fewer where its
    class has fewer units; units in the list ``held`` are left out, which may not be longer than the index's copies - k.
    With ``eps`` the i-th distance found is at most 1 + eps times the true one. ``met`` gets tables of the pairs (q, cell)
    that have to meet."""
    held = F.col("held").cast("array<long>") if "held" in queries.columns else F.lit(None).cast("array<long>")
    q = queries.where("c IS NOT NULL AND v IS NOT NULL").select("q", "c", F.col("v").cast("array<double>").alias("v"), held.alias("held")).distinct()
    q = q.withColumns({"need": F.lit(k) + F.coalesce(F.array_size("held"), F.lit(0)), "bound": F.lit(float("inf"))})
    q = kept(q, "queries")

    def homes(x: pa.Table, nodes: Nodes) -> pa.Table:
        rows, at = nodes.homes(matrix(x["v"]), x["need"].to_numpy())
        return _took(x, rows, nodes.cell[at])

    home = _chosen(q, index, homes, limit)
    one = _met(home, index, k, "cell", CHUNK)
    # Of the units that are not held the k-th least distance; the homes hold that many if there are as many at all.
    second = q.drop("bound").join(_kth(one, k), "q", "left").withColumn("bound", F.coalesce(F.sqrt("d") / (1 + eps), F.lit(float("inf")))).select(*q.columns)
    rest = _chosen(second, index, _shelves_within, limit, _cells_within)
    two = _met(rest, index, k, "shelf", index.rows)
    out = kept(_least(one.unionByName(two), k), "nearest")
    if met is not None:
        pairs = _chosen(second, index, _cells_within, limit).select("q", "cell")
        met += [home.select("q", "cell"), pairs.join(home.select("q", "cell"), ["q", "cell"], "left_anti")]
    else:
        drop(home)
    drop(q, one, rest, two)
    return out


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(q, d): the k-th least squared distance of each query that has as many."""
    return _least(found, k).where(F.size("x") == k).select("q", F.element_at("x", k)["dist2"].alias("d"))


def _least(found: DataFrame, k: int) -> DataFrame:
    """(q, x): the k least (dist2, u) of each query's lists, of which it has one for each cell or shelf it met."""
    return found.groupBy("q").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("x")))), 1, k).alias("x"))


class LocalIndex:
    """The same cells in the memory of a task, for unit tables that are known to fit; ids ascend."""

    def __init__(self, ids: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, v = ids[order], v[order]
        n = len(ids)
        pivots = np.unique(v[np.linspace(0, n - 1, max(1, math.isqrt(n))).astype(int)], axis=0) if n else v[:0]
        cell = np.concatenate([squares(v[a : a + 4096], pivots).argmin(1) for a in range(0, n, 4096)]) if n else np.zeros(0, int)
        by_cell = np.argsort(cell, kind="stable")
        self.rows = [r for r in np.split(by_cell, np.flatnonzero(np.diff(cell[by_cell])) + 1) if len(r)]
        self.parts = [v[r] for r in self.rows]
        self.sizes = [(p * p).sum(1) for p in self.parts]
        self.place = np.zeros((2, n), int)  # of each row: its cell, and where it is there
        for c, r in enumerate(self.rows):
            self.place[0, r], self.place[1, r] = c, np.arange(len(r))
        self.centre = np.array([p.mean(0) for p in self.parts])
        self.radius = np.array([np.sqrt(((p - c) ** 2).sum(1)).max() for p, c in zip(self.parts, self.centre)])
        self.looked = 0

    @property
    def v(self) -> np.ndarray:
        out = np.zeros((len(self.ids), self.centre.shape[1] if self.rows else 0))
        for r, p in zip(self.rows, self.parts):
            out[r] = p
        return out

    def nearest_of_all(self, q: np.ndarray, held: list | None = None, eps: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """``nearest`` of many queries at once, a list of held ids for each: (rows, dist2), a row of -1 where there is
        none. A cell meets all queries that may find something nearer in it as one product."""
        n = len(q)
        row, best = np.full(n, -1), np.full(n, np.inf)
        if not self.rows or not n:
            return row, best
        out = [(i, a) for i, h in enumerate(held or []) if h is not None and len(h) for a in np.unique(h).tolist()]
        who, ids = (np.array(x, int) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))
        first, many = np.searchsorted(self.ids, ids), np.searchsorted(self.ids, ids, "right") - np.searchsorted(self.ids, ids)
        who, at = np.repeat(who, many), np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
        cell, place = self.place[:, at]
        order = np.argsort(cell, kind="stable")
        who, place, cut = who[order], place[order], np.searchsorted(cell[order], np.arange(len(self.rows) + 1))
        own = (q * q).sum(1)
        to_centre = np.sqrt(squares(q, self.centre))
        # The product form errs by some 1e-16 of the squared sizes.
        low = to_centre - self.radius - SLACK * (1 + to_centre + self.radius) - 1e-7 * np.sqrt(own[:, None] + (self.centre * self.centre).sum(1))
        homes = low.argmin(1)

        def look(c: int, some: np.ndarray) -> None:
            part, size = self.parts[c], self.sizes[c]
            rough = q[some] @ (-2.0 * part.T)
            rough += size
            if cut[c] < cut[c + 1]:
                to = np.full(n, -1)
                to[some] = np.arange(len(some))
                mine, there = to[who[cut[c] : cut[c + 1]]], place[cut[c] : cut[c + 1]]
                rough[mine[mine >= 0], there[mine >= 0]] = np.inf
            self.looked += rough.size
            margin = 2e-9 * (1 + own[some] + size.max())
            edge = np.minimum(best[some] - own[some], rough.min(1)) + margin
            i, j = np.nonzero((rough <= edge[:, None]) & np.isfinite(rough))
            if not len(i):
                return
            d, u, i = _exact(q[some], part, i, j), self.rows[c][j], some[i]
            nearest = np.lexsort((u, d, i))
            nearest = nearest[np.r_[True, np.diff(i[nearest]) > 0]]
            d, u, i = d[nearest], u[nearest], i[nearest]
            better = (d < best[i]) | (d == best[i]) & ((row[i] < 0) | (u < row[i]))
            best[i[better]], row[i[better]] = d[better], u[better]

        for c in np.unique(homes):
            look(c, np.flatnonzero(homes == c))
        for c in range(len(self.rows)):
            some = np.flatnonzero((homes != c) & (low[:, c] <= np.sqrt(best) / (1 + eps)))
            if len(some):
                look(c, some)
        return row, best

    def nearest(self, q: np.ndarray, held: np.ndarray | None = None, eps: float = 0.0) -> tuple[int, float] | None:
        """(row, dist2) of the nearest vector whose id is not held, of equally near ones the lesser id; with ``eps`` of
        one at most 1 + eps times as far. Cells are opened by their least possible distance until none can be nearer."""
        if not self.rows:
            return None
        to_centre = np.sqrt(((self.centre - q) ** 2).sum(1))
        low = to_centre - self.radius - SLACK * (1 + to_centre + self.radius)
        best, row = np.inf, -1
        for c in np.argsort(low):
            if row >= 0 and low[c] > np.sqrt(best) / (1 + eps):
                break
            d = ((self.parts[c] - q) ** 2).sum(1)
            if held is not None and len(held):
                d[np.isin(self.ids[self.rows[c]], held)] = np.inf
            self.looked += len(d)
            j = int(d.argmin())
            if d[j] < np.inf and (d[j], self.rows[c][j]) < (best, row if row >= 0 else np.inf):
                best, row = float(d[j]), int(self.rows[c][j])
        return (row, best) if row >= 0 else None


def _queries(queries: DataFrame, by: str | None, *more: str) -> DataFrame:
    return queries.select("q", (F.col(by).cast("string") if by else F.lit("")).alias("c"), "v", *more)


def _one_cell(units: DataFrame, by: str | None, copies: int) -> Index:
    """A few units as an index of one cell for each class, as yet without centres: all of it is home."""
    cls = F.col(by).cast("string") if by else F.lit("")
    rows = units.select(cls.alias("c"), F.col("u").cast("long").alias("u"), F.col("v").cast("array<double>").alias("v")).where("c IS NOT NULL AND v IS NOT NULL")
    return Index(_distinct(rows, copies).withColumns({"cell": F.lit(0).cast("long"), "shelf": F.lit(0).cast("long")}), None, copies)


def k_nearest(queries: DataFrame, units: DataFrame, k: int, by: str | None = None, exclude_self: bool = False, index: Index | None = None, limit: int | None = None) -> DataFrame:
    """(q, rank, u, dist2): the k nearest units of each query (q, v[, by]); of equal distances the lesser id. With ``by``,
    only units of the query's class; where it has fewer than k, there are fewer rows. ``index``: that of the units,
    if it is there already (``build``); without one, up to ``MOST`` units are one cell."""
    need = k + exclude_self
    own = _queries(queries, by)
    if index is None and units.count() <= MOST:
        q = kept(own.where("c IS NOT NULL AND v IS NOT NULL").distinct().select("q", "c", F.col("v").cast("array<double>").alias("v"), F.lit(float("inf")).alias("bound"), F.lit(None).cast("array<long>").alias("held"), F.lit(0).cast("long").alias("cell")), "queries")
        found = _least(_met(q, _one_cell(units, by, need), need, "cell", CHUNK), need)
        drop(q)
    else:
        index = index or build(units, by, need)
        if index.copies < need:
            raise ValueError(f"the index keeps {index.copies} ids of equal vectors, the search needs {need}")
        found = search(own, index, need, limit=limit)
    x = F.slice(F.filter("x", lambda e: e["u"] != F.col("q")), 1, k) if exclude_self else F.col("x")
    return found.select("q", F.posexplode(x).alias("i", "x")).select("q", (F.col("i") + 1).alias("rank"), F.col("x.u").alias("u"), F.col("x.dist2").alias("dist2"))


def meetings(queries: DataFrame, index: Index, k: int, by: str | None = None) -> dict[str, int]:
    """How far the index prunes a search: the pairs of query blocks (queries of one home) and cells that meet, of all."""
    met: list[DataFrame] = []
    search(_queries(queries, by), index, k, met=met)
    home, rest = met
    blocks = home.groupBy("q").agg(F.min("cell").alias("block"))
    pairs = home.unionByName(rest).join(blocks, "q").select("block", "cell").distinct().count()
    return {"met": pairs, "all": blocks.select("block").distinct().count() * index.cells.count()}


def radius_counts(queries: DataFrame, units: DataFrame, radius: float, exclude_self: bool = False, index: Index | None = None, limit: int | None = None) -> DataFrame:
    """(q, n): units within the radius of each query, 0 included; with ``exclude_self`` the unit of the query's id is not
    counted."""
    index = index or build(units, copies=1)
    q = kept(_queries(queries, None).where("v IS NOT NULL").distinct().withColumn("v", F.col("v").cast("array<double>")), "queries")

    within = lambda choose: lambda x, nodes: choose(x, nodes, np.full(x.num_rows, float(radius)))
    pairs = _chosen(q, index, within(_shelves_within), limit, within(_cells_within))
    schema = f"{_ddl(q, 'q')}, n long"
    arrow, edge = _arrow(schema), radius * radius

    def count(x: pa.Table, y: pa.Table) -> pa.Table:
        if not y.num_rows or not x.num_rows:
            return arrow.empty_table()
        cells, all_q, sums = _Cells(y), matrix(x["v"]), np.zeros(x.num_rows, np.int64)
        for at in range(0, x.num_rows, BLOCK):
            qv = all_q[at : at + BLOCK]
            own = (qv * qv).sum(1)
            rows, at_cell, whole = cells.nodes.within(qv, np.full(len(qv), float(radius)))
            order = np.argsort(at_cell, kind="stable")
            cut = np.searchsorted(at_cell[order], np.arange(len(cells.spans) + 1))
            for c, (a, b) in enumerate(cells.spans):
                here = order[cut[c] : cut[c + 1]]
                sums[at + rows[here[whole[here]]]] += cells.n[a:b].sum()
                some = rows[here[~whole[here]]]
                if not len(some):
                    continue
                u, n = cells.v[a:b], cells.n[a:b]
                rough = squares(qv[some], u)
                inside = rough <= edge
                margin = 1e-9 * (1 + edge + own[some][:, None] + (u * u).sum(1))
                i, j = np.nonzero(np.abs(rough - edge) <= margin)  # too near to tell
                inside[i, j] = _exact(qv[some], u, i, j) <= edge
                sums[at + some] += inside @ n
        return pa.table([x["q"], pa.array(sums)], schema=arrow)

    met = meet(pairs.select("q", "c", "v", "shelf"), index.points.drop("ids"), ["c", "shelf"], "q", count, schema, chunk=index.rows)
    out = q.select("q").distinct().join(met.groupBy("q").agg(F.sum("n").alias("n")), "q", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    drop(pairs)
    if exclude_self:
        own = units.select(F.col("u").alias("q"), F.col("v").cast("array<double>").alias("_w")).distinct()
        self_ = q.join(own, "q").where(V.dist2(F.col("v"), F.col("_w")) <= edge).groupBy("q").agg(F.count(F.lit(1)).alias("_self"))
        out = out.join(self_, "q", "left").select("q", (F.col("n") - F.coalesce("_self", F.lit(0))).alias("n"))
    return out


def nearest_given(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """(u, centre, dist2) for a few given centres, as expressions of the JVM."""
    each = F.array(*(F.struct(V.dist2(F.col("v"), V.literal(c)).alias("dist2"), F.lit(i).alias("centre")) for i, c in enumerate(centres)))
    return points.select("u", F.array_min(each).alias("m")).select("u", F.col("m.centre").alias("centre"), F.col("m.dist2").alias("dist2"))
