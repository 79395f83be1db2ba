"""Readers and writers of the files that speech corpora come in: raw matrices, waves, marks, labels, line lists.

Readers go through Spark's own file sources, so any store that Spark reads will do; bytes are decoded in Arrow batches
where they lie. Bad files (a size that is no multiple of the row, marks that fall, a stereo wave) either fail or, with
``skip_bad``, are left out."""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.functions.scalars import stem

HTK_HEADER = 12
TYPES = {"float32": np.dtype("<f4"), "int16": np.dtype("<i2")}


def _binary(spark: SparkSession, path: str, pattern: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select(stem(F.col("path")).alias("utt"), "content")


def read_matrix(spark: SparkSession, path: str, dim: int, dtype: str = "float32", header: bool = False, pattern: str | None = None, skip_bad: bool = False) -> DataFrame:
    """(utt, frame, v) from headerless row-major matrices, or with a 12-byte header to leave out."""
    kind = TYPES[dtype]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for utt, content in zip(pdf.utt, pdf.content):
                raw = content[HTK_HEADER:] if header else content
                if len(raw) % (dim * kind.itemsize):
                    if skip_bad:
                        continue
                    raise ValueError(f"{utt}: {len(raw)} bytes are no rows of {dim}")
                rows = np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float32)
                for at in range(0, max(len(rows), 1), 10_000):
                    part = rows[at : at + 10_000]
                    yield pd.DataFrame({"utt": utt, "frame": np.arange(at, at + len(part), dtype=np.int32), "v": list(part)})

    return _binary(spark, path, pattern).mapInPandas(run, "utt string, frame int, v array<float>")


def matrix_bytes(rows: DataFrame, dtype: str = "float32") -> DataFrame:
    """(utt, content): the frames (utt, frame, v) of each utterance as the bytes of a matrix file."""
    kind = TYPES[dtype]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.stack(pdf.sort_values("frame").v.to_numpy())
        if dtype == "int16":
            grid = np.clip(grid, -32768, 32767)
        return pd.DataFrame({"utt": [pdf.utt.iloc[0]], "content": [grid.astype(kind).tobytes()]})

    return rows.groupBy("utt").applyInPandas(run, "utt string, content binary")


def write_matrix(rows: DataFrame, folder: str, suffix: str, dtype: str = "float32", overwrite: bool = False) -> None:
    """A file for each utterance, written by the tasks through Hadoop's file system; fails where one exists unless
    ``overwrite``. The folder has to be one that executors reach."""
    write_files(matrix_bytes(rows, dtype), folder, suffix, overwrite)


def write_files(contents: DataFrame, folder: str, suffix: str, overwrite: bool = False) -> None:
    """Files from (utt, content). Local and mounted folders are written by the executors; others have no Python writer
    here, so keep such contents in a table."""
    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("only mounted folders can be written as files; write the contents as a table instead")
    place = folder.removeprefix("file://")

    def put(rows) -> None:
        import os

        os.makedirs(place, exist_ok=True)
        for r in rows:
            name = os.path.join(place, r.utt + suffix)
            with open(name, "wb" if overwrite else "xb") as f:
                f.write(bytes(r.content))

    contents.select("utt", "content").foreachPartition(put)


def read_wave(spark: SparkSession, path: str, mono: bool = False, pattern: str | None = "*.wav") -> DataFrame:
    """(utt, rate, samples): 16-bit PCM; of several channels the first, or an error with ``mono``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for utt, content in zip(pdf.utt, pdf.content):
                with wave.open(io.BytesIO(content)) as w:
                    if w.getsampwidth() != 2 or mono and w.getnchannels() != 1:
                        raise ValueError(f"{utt}: not 16-bit" + " mono" * mono)
                    samples = np.frombuffer(w.readframes(w.getnframes()), "<i2")[:: w.getnchannels()]
                    yield pd.DataFrame({"utt": [utt], "rate": [w.getframerate()], "samples": [samples]})

    return _binary(spark, path, pattern).mapInPandas(run, "utt string, rate int, samples array<short>")


def wave_bytes(waves: DataFrame, normalise: bool = False) -> DataFrame:
    """(utt, content, clipped): WAV files of (utt, rate, samples array<double>); samples beyond 16 bits are clipped,
    or the peak is scaled to full range first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for utt, rate, samples in zip(pdf.utt, pdf.rate, pdf.samples):
                x = np.asarray(samples, float)
                peak = np.abs(x).max() if len(x) else 0.0
                if normalise and peak:
                    x = x / peak * 32767
                clipped = int((np.abs(np.rint(x)) > 32767).sum())
                held = io.BytesIO()
                with wave.open(held, "wb") as w:
                    w.setnchannels(1)
                    w.setsampwidth(2)
                    w.setframerate(int(rate))
                    w.writeframes(np.clip(np.rint(x), -32768, 32767).astype("<i2").tobytes())
                out.append((utt, held.getvalue(), clipped))
            yield pd.DataFrame(out, columns=["utt", "content", "clipped"])

    return waves.select("utt", "rate", F.col("samples").cast("array<double>").alias("samples")).mapInPandas(run, "utt string, content binary, clipped int")


def read_marks(spark: SparkSession, path: str, skip_bad: bool = True, pattern: str | None = None, drop_last: bool = False) -> DataFrame:
    """(utt, pm_ix, t_sec, voiced) from EST text files: the columns after the header's end. Files whose times fall are
    left out, or fail."""
    reader = spark.read
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("utt"), F.posexplode(F.filter(F.split(F.regexp_replace("value", r"(?s)^.*?EST_Header_End\s*", ""), r"\r?\n"), lambda x: F.trim(x) != "")).alias("pm_ix", "line"))
    parts = F.split(F.trim("line"), r"\s+")
    rows = rows.select("utt", "pm_ix", parts[0].cast("double").alias("t_sec"), F.try_element_at(parts, F.lit(2)).try_cast("int").alias("voiced"))
    from unitweave.operators.series import monotonic

    good = monotonic(rows, "utt", "pm_ix", "t_sec")
    if skip_bad:
        rows = rows.join(good.where("monotonic"), "utt", "left_semi")
    else:
        rows = rows.join(good, "utt").withColumn("t_sec", F.when(F.col("monotonic"), F.col("t_sec")).otherwise(F.raise_error(F.concat(F.lit("marks fall in "), F.col("utt"))).cast("double"))).drop("monotonic")
    if drop_last:
        from pyspark.sql import Window

        rows = rows.withColumn("_n", F.max("pm_ix").over(Window.partitionBy("utt"))).where("pm_ix < _n").drop("_n")
    return rows


def read_labels(spark: SparkSession, path: str, pattern: str, files: str | None = None, frame_100ns: int = 50_000) -> DataFrame:
    """(utt, seq, start, end, ll, l, c, r, rr, state) from lines ``start end label[state]`` in 100-ns units; pattern
    has five groups. Times become frames of 5 ms."""
    from unitweave.functions.labels import quinphone

    reader = spark.read
    if files:
        reader = reader.option("pathGlobFilter", files)
    lines = reader.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("utt"), F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("seq", "line"))
    parts = F.split(F.trim("line"), r"\s+", 3)
    label = parts[2]
    phones = quinphone(label, pattern)
    return lines.select("utt", "seq", F.floor(parts[0].cast("long") / frame_100ns).cast("int").alias("start"), F.floor(parts[1].cast("long") / frame_100ns).cast("int").alias("end"), *(p.alias(n) for p, n in zip(phones, ("ll", "l", "c", "r", "rr"))), F.regexp_extract(label, r"\[(\d+)\]\s*$", 1).alias("state"))


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    """(utt, seq, tokens): lines of Festival utterances whose eighth token is ``ph1``."""
    lines = spark.read.text(path, wholetext=True).select(stem(F.col("_metadata.file_path")).alias("utt"), F.posexplode(F.split("value", r"\r?\n")).alias("seq", "line"))
    return lines.withColumn("tokens", F.split(F.trim("line"), r"\s+")).where(F.try_element_at("tokens", F.lit(8)) == "ph1").select("utt", "seq", "tokens")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line): the lines that are not empty, trimmed."""
    return spark.read.text(path).select(F.trim("value").alias("line")).where("line <> ''")


def write_lines(rows: DataFrame, column: str, path: str, overwrite: bool = False) -> None:
    rows.select(column).write.mode("overwrite" if overwrite else "errorifexists").text(path)


def stream_folders(spark: SparkSession, folders: list[str], streams: list[str]) -> dict[str, str]:
    """The one folder of each stream, through Hadoop's file system; none or several are an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for s in streams:
        there = [f"{d}/{s}" for d in folders if (p := jvm.org.apache.hadoop.fs.Path(f"{d}/{s}")).getFileSystem(conf).exists(p)]
        if len(there) != 1:
            raise ValueError(f"stream {s}: {len(there)} folders")
        out[s] = there[0]
    return out


def read_streams(spark: SparkSession, folders: list[str], dims: dict[str, int]) -> DataFrame:
    """stream_frames (utt, stream, frame, v) of all streams."""
    from functools import reduce

    places = stream_folders(spark, folders, list(dims))
    return reduce(DataFrame.unionAll, (read_matrix(spark, places[s], n).select("utt", F.lit(s).alias("stream"), "frame", "v") for s, n in dims.items()))


def floats(*values: float) -> bytes:
    """The bytes of a float32 file."""
    return struct.pack(f"<{len(values)}f", *values)
