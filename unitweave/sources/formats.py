"""Raw matrices and waves as data sources of Spark: ``spark.read.format("speech-matrix")`` and ``("speech-wave")``.

A large file is cut into byte ranges of whole rows, a task each; files are checked against their sizes and headers when
they are listed, before any task runs. Of more than ``MANY`` files those of at most a range are only listed: tasks get
many of them, and check and read them. Filters on the utterance leave files out, and those on the frame or position
leave byte ranges out. Batches are Arrow. The writer takes rows of one utterance in one task (``by_utterance``), writes
under a name of the attempt, and the commit moves whole files into place, so that a lost or repeated task leaves nothing.

Files are reached through ``pyarrow.fs``: mounted folders, and the stores that it knows on the cluster's machines.

Rows: an empty file has no rows; a file whose size is no whole number of rows, or whose header is not that of 16-bit PCM,
fails, or is left out with ``skip_bad``; vectors of a length other than ``dim`` and null utterances fail on writing.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a range, and rows of a batch.
RANGE, BATCH = 32 << 20, 8192
#: Files from which on small ones share tasks, and files of a task at most.
MANY, FILES = 256, 4096
#: Files that the driver moves at once.
MOVES = 16
#: Samples of a row of the wave source.
SAMPLES = 4096
HTK_HEADER = 12
KINDS = {"float32": (np.dtype("<f4"), pa.float32()), "int16": (np.dtype("<i2"), pa.int16())}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _stem(name: str) -> str:
    return posixpath.basename(name).rpartition(".")[0] or posixpath.basename(name)


@dataclass
class ByteRange(InputPartition):
    """Rows [first, last) of a file whose rows begin at byte ``start``."""

    path: str
    utt: str
    start: int
    first: int
    last: int
    rate: int = 0
    channels: int = 1


@dataclass
class Files(InputPartition):
    """Whole small files (path, size), not yet looked into."""

    files: list[tuple[str, int]]


class _Ranges(DataSourceReader):
    """Lists files, applies filters on the utterance and on the row's number, and cuts what is left into ranges."""

    position = "frame"

    def __init__(self, options: dict):
        self.options = options
        self.path, self.skip_bad = options["path"], options.get("skip_bad", "false").lower() == "true"
        self.utts: set[str] | None = None
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("utt",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.utts = wanted if self.utts is None else self.utts & wanted
            elif column == (self.position,) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    last = f.value + (not isinstance(f, LessThan))
                    self.high = last if self.high is None else min(self.high, last)
                if self.position == "pos":  # rows hold several positions, so Spark looks again
                    yield f
            else:
                yield f

    def files(self) -> list[pafs.FileInfo]:
        fs, root = opened(self.path)
        info = fs.get_file_info(root)
        found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(root))
        suffix = self.options.get("suffix", "")
        return sorted((f for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")) and f.base_name.endswith(suffix)), key=lambda f: f.path)

    def about(self, fs: pafs.FileSystem, info: pafs.FileInfo) -> ByteRange:
        """All rows of a file; ValueError for a bad one."""
        raise NotImplementedError

    def row_bytes(self, whole: ByteRange) -> int:
        raise NotImplementedError

    def cut(self, fs: pafs.FileSystem, info: pafs.FileInfo, whole_file: bool = False) -> list[ByteRange]:
        try:
            whole = self.about(fs, info)
        except ValueError:
            if self.skip_bad:
                return []
            raise
        step = max(1, int(self.options.get("range_bytes", RANGE)) // self.row_bytes(whole))
        first, last = max(whole.first, self.low), whole.last if self.high is None else min(whole.last, self.high)
        step = max(1, last - first) if whole_file else step
        return [ByteRange(whole.path, whole.utt, whole.start, a, min(a + step, last), whole.rate, whole.channels) for a in range(first, last, step)]

    def partitions(self) -> list[InputPartition]:
        fs, _ = opened(self.path)
        found = [f for f in self.files() if self.utts is None or _stem(f.path) in self.utts]
        edge = min(RANGE, int(self.options.get("range_bytes", RANGE))) if len(found) > MANY else -1
        small = [f for f in found if f.size <= edge]
        count, packs, size = min(FILES, -(-len(small) // MANY)), [], 0
        for f in small:
            if not packs or len(packs[-1].files) >= count or size + f.size > RANGE:
                packs.append(Files([]))
                size = 0
            packs[-1].files.append((f.path, f.size))
            size += f.size
        return [*packs, *(r for f in found if f.size > edge for r in self.cut(fs, f))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Files):
            yield from self.batches(partition)
            return
        fs, _ = opened(self.path)
        held, rows = [], 0
        for path, size in partition.files:
            for part in self.cut(fs, pafs.FileInfo(path, pafs.FileType.File, size=size), whole_file=True):
                for batch in self.batches(part):
                    held.append(batch)
                    rows += max(batch.num_rows, part.last - part.first)
            if rows >= BATCH:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, rows = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    def batches(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        """The rows of a range."""
        raise NotImplementedError

    def rows(self, part: ByteRange, kind: np.dtype, width: int) -> Iterator[tuple[int, np.ndarray]]:
        """(number of the first row, rows) of a range, a batch at a time."""
        fs, _ = opened(self.path)
        size = kind.itemsize * width
        step = max(1, min(BATCH, (8 << 20) // size))
        with fs.open_input_file(part.path) as f:
            for a in range(part.first, part.last, step):
                n = min(step, part.last - a)
                yield a, np.frombuffer(f.read_at(n * size, part.start + a * size), kind).reshape(n, width)


class MatrixReader(_Ranges):
    def __init__(self, options: dict):
        super().__init__(options)
        self.dim, self.kind = int(options["dim"]), options.get("dtype", "float32")
        self.header = HTK_HEADER if options.get("header", "false").lower() == "true" else 0

    def row_bytes(self, whole: ByteRange) -> int:
        return self.dim * KINDS[self.kind][0].itemsize

    def about(self, fs, info) -> ByteRange:
        rows, rest = divmod(info.size - self.header, self.row_bytes(None)) if info.size else (0, 0)
        if rest or rows < 0:
            raise ValueError(f"{info.path}: {info.size} bytes are no rows of {self.dim}")
        return ByteRange(info.path, _stem(info.path), self.header, 0, rows)

    def batches(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        kind, arrow = KINDS[self.kind]
        for first, rows in self.rows(partition, kind, self.dim):
            n = len(rows)
            v = pa.ListArray.from_arrays(np.arange(0, n * self.dim + 1, self.dim, dtype=np.int32), pa.array(rows.ravel(), arrow).cast(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array([partition.utt] * n, pa.string()), pa.array(np.arange(first, first + n)), v], ["utt", "frame", "v"])


class WaveReader(_Ranges):
    """16-bit PCM; of several channels the first, or an error with ``mono``."""

    position = "pos"

    def row_bytes(self, whole: ByteRange) -> int:
        return 2 * whole.channels

    def about(self, fs, info) -> ByteRange:
        with fs.open_input_file(info.path) as f:
            head = f.read_at(min(12, info.size), 0)
            if len(head) < 12 or head[:4] != b"RIFF" or head[8:] != b"WAVE":
                raise ValueError(f"{info.path}: no wave")
            at, form = 12, None
            while at + 8 <= info.size:
                name, size = struct.unpack("<4sI", f.read_at(8, at))
                if name == b"fmt ":
                    form = struct.unpack("<HHIIHH", f.read_at(16, at + 8))
                if name == b"data":
                    if form is None or form[0] != 1 or form[5] != 16 or form[1] != 1 and self.options.get("mono", "false").lower() == "true":
                        raise ValueError(f"{info.path}: not 16-bit PCM" + " of one channel" * (form is not None and form[1] != 1))
                    size = min(size, info.size - at - 8)
                    if size % (2 * form[1]):
                        raise ValueError(f"{info.path}: the data ends within a sample")
                    return ByteRange(info.path, _stem(info.path), at + 8, 0, size // (2 * form[1]), form[2], form[1])
                at += 8 + size + size % 2
        raise ValueError(f"{info.path}: no data")

    def batches(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        for first, rows in self.rows(partition, np.dtype("<i2"), partition.channels):
            x = np.ascontiguousarray(rows[:, 0])
            cuts = np.r_[np.arange(0, len(x), SAMPLES), len(x)].astype(np.int32)
            n = len(cuts) - 1
            samples = pa.ListArray.from_arrays(cuts, pa.array(x, pa.int16()))
            yield pa.RecordBatch.from_arrays([pa.array([partition.utt] * n, pa.string()), pa.array([partition.rate] * n, pa.int32()), pa.array(first + cuts[:-1].astype(np.int64)), samples], ["utt", "rate", "pos", "samples"])


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (temporary, final)


class _FileWriter(DataSourceArrowWriter):
    """One file for each utterance, from rows in which it stands together and in order."""

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.job = uuid.uuid4().hex  # the same in all tasks

    def encoded(self, batch: pa.RecordBatch) -> bytes:
        raise NotImplementedError

    def finish(self, f, batch: pa.RecordBatch, size: int) -> None:
        """Completes a file whose rows have ``size`` bytes."""

    def begin(self, f, batch: pa.RecordBatch) -> None:
        pass

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = opened(self.path)
        attempt = posixpath.join(root, f"_attempt-{self.job}-{uuid.uuid4().hex}")
        fs.create_dir(attempt)
        done: dict[str, str] = {}
        now, f, size, last = None, None, 0, None
        for batch in iterator:
            names = batch.column(batch.schema.get_field_index("utt")).to_pylist()
            edges = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if names[a] != now:
                    if f is not None:
                        self.finish(f, last, size)
                        f.close()
                    now = names[a]
                    if now is None or now in done:
                        raise ValueError("an utterance is null" if now is None else f"{now}: its rows do not stand together")
                    done[now] = posixpath.join(attempt, now + self.suffix)
                    f, size = fs.open_output_stream(done[now]), 0
                    self.begin(f, part)
                data = self.encoded(part)
                f.write(data)
                size, last = size + len(data), part
        if f is not None:
            self.finish(f, last, size)
            f.close()
        return Written([(there, posixpath.join(root, utt + self.suffix)) for utt, there in done.items()])

    def commit(self, messages: list[Written | None]) -> None:
        fs, _ = opened(self.path)
        moves = [x for m in messages if m is not None for x in m.files]
        finals = [b for _, b in moves]
        twice = len(finals) != len(set(finals))
        there = [] if self.overwrite or not finals else [i.path for i in fs.get_file_info(finals) if i.type != pafs.FileType.NotFound]
        if twice or there:
            self.abort(messages)
            raise ValueError("an utterance came from two tasks" if twice else f"{there[0]} exists")
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda x: fs.move(*x), moves))
        self._clear(fs)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(opened(self.path)[0])

    def _clear(self, fs: pafs.FileSystem) -> None:
        root = opened(self.path)[1]
        for info in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if info.base_name.startswith(f"_attempt-{self.job}"):
                fs.delete_dir(info.path)


class MatrixWriter(_FileWriter):
    def encoded(self, batch: pa.RecordBatch) -> bytes:
        v = batch.column(batch.schema.get_field_index("v"))
        if v.null_count or v.flatten().null_count:
            raise ValueError("a null in a matrix")
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), int(self.options["dim"]))
        kind = KINDS[self.options.get("dtype", "float32")][0]
        return (np.clip(np.rint(x), -32768, 32767) if kind.itemsize == 2 else x).astype(kind).tobytes()


class WaveWriter(_FileWriter):
    """16-bit PCM of one channel; samples beyond 16 bits are clipped. The header's sizes come first, so rows have to say
    how many samples their utterance has: (utt, rate, n, samples)."""

    def begin(self, f, batch: pa.RecordBatch) -> None:
        rate, n = (batch.column(batch.schema.get_field_index(c))[0].as_py() for c in ("rate", "n"))
        f.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + 2 * n, b"WAVE", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16, b"data", 2 * n))

    def encoded(self, batch: pa.RecordBatch) -> bytes:
        x = batch.column(batch.schema.get_field_index("samples")).flatten().to_numpy(zero_copy_only=False).astype(float)
        return np.clip(np.rint(x), -32768, 32767).astype("<i2").tobytes()

    def finish(self, f, batch: pa.RecordBatch, size: int) -> None:
        n = batch.column(batch.schema.get_field_index("n"))[0].as_py()
        if size != 2 * n:
            raise ValueError(f"{size // 2} samples where {n} are announced")


class MatrixSource(DataSource):
    """Options: path, dim, dtype (float32, int16), header (12 bytes to leave out), suffix, skip_bad, range_bytes."""

    @classmethod
    def name(cls) -> str:
        return "speech-matrix"

    def schema(self) -> str:
        return "utt string, frame bigint, v array<float>"

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(dict(self.options), overwrite)


class WaveSource(DataSource):
    """Options: path, mono, suffix, skip_bad, range_bytes. A row holds up to 4,096 samples from position ``pos`` on."""

    @classmethod
    def name(cls) -> str:
        return "speech-wave"

    def schema(self) -> str:
        return "utt string, rate int, pos bigint, samples array<smallint>"

    def reader(self, schema: StructType) -> WaveReader:
        return WaveReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WaveWriter:
        return WaveWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats known; filters are pushed to Python sources only where that is switched on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (MatrixSource, WaveSource):
        spark.dataSource.register(source)


def by_utterance(rows: DataFrame, order: str) -> DataFrame:
    """The rows as the writers want them: an utterance, which becomes one file, in one task and in order."""
    return rows.repartition("utt").sortWithinPartitions("utt", order)
