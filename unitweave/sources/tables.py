"""Stored unit databases and transition tables."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def condition_name(config: dict) -> str:
    """A name that follows from the settings alone."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:16]


class UnitDatabase:
    """Tables of one training condition: units, unit_join, stream_stats, and further ones by name."""

    def __init__(self, spark: SparkSession, root: str, config: dict):
        self.spark, self.path = spark, f"{root.rstrip('/')}/{condition_name(config)}"

    def write(self, name: str, table: DataFrame, overwrite: bool = False, by: str | None = None) -> None:
        """Fails where the table exists, unless ``overwrite``."""
        writer = table.write.mode("overwrite" if overwrite else "errorifexists")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.path}/{name}")

    def read(self, name: str, *columns: str) -> DataFrame:
        table = self.spark.read.parquet(f"{self.path}/{name}")
        return table.select(*columns) if columns else table


def spectra(frames: dict[str, DataFrame]) -> DataFrame:
    """(utt, frame, one column for each stream): only utterances and frames that all streams have."""
    out = None
    for name, table in frames.items():
        own = table.select("utt", "frame", F.col("v").alias(name))
        out = own if out is None else out.join(own, ["utt", "frame"])
    return out


TRANSITIONS = "from_index INT, to_index INT, natural BOOLEAN, labelled BOOLEAN, labelled_ok BOOLEAN, trained_on BOOLEAN, confidence FLOAT"


class TransitionTable:
    """Transitions in buckets of their first unit, so that the files of others are not opened for a unit's; lists are
    appended as they are, a pair that several of them hold stands there as often."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _bucket(self, unit: Column) -> Column:
        return F.pmod(F.xxhash64(unit.cast("long")), F.lit(self.buckets)).cast("int")

    def append(self, pairs: DataFrame, **given: Column) -> None:
        """Adds pairs (from_index, to_index); natural ones are those of neighbours, the other columns are as nothing is
        known, unless given."""
        a, b = (F.col(c).cast("int") for c in ("from_index", "to_index"))
        columns = {"from_index": a, "to_index": b, "natural": b == a + 1, "labelled": F.lit(False), "labelled_ok": F.lit(False), "trained_on": F.lit(False), "confidence": F.lit(0.5).cast("float")} | given
        rows = pairs.where("from_index IS NOT NULL AND to_index IS NOT NULL").select(*(c.alias(n) for n, c in columns.items())).withColumn("bucket", self._bucket(F.col("from_index")))
        rows.repartition("bucket").sortWithinPartitions("bucket", "from_index").write.mode("append").partitionBy("bucket").parquet(self.path)

    def scan(self) -> DataFrame:
        return self.spark.read.schema(f"{TRANSITIONS}, bucket INT").parquet(self.path).drop("bucket")

    def of(self, unit: int) -> DataFrame:
        """The transitions from one unit: one bucket's files, and of these the row groups that can hold it."""
        bucket = self.spark.range(1).select(self._bucket(F.lit(unit))).first()[0]
        rows = self.spark.read.schema(f"{TRANSITIONS}, bucket INT").parquet(self.path)
        return rows.where((F.col("bucket") == bucket) & (F.col("from_index") == unit)).drop("bucket")

    def of_all(self, units: DataFrame) -> DataFrame:
        """The transitions from the units (unit_id), by a join in which both sides have the bucket."""
        wanted = units.select(F.col("unit_id").cast("int").alias("from_index")).distinct().withColumn("bucket", self._bucket(F.col("from_index")))
        rows = self.spark.read.schema(f"{TRANSITIONS}, bucket INT").parquet(self.path)
        return rows.join(wanted, ["bucket", "from_index"]).select(*self.scan().columns)


def with_labels(table: DataFrame, answers: DataFrame) -> DataFrame:
    """A transition table with the answers (from_index, to_index, ok) put in; other rows stay."""
    known = answers.select("from_index", "to_index", F.col("ok").alias("_ok"))
    out = table.join(known, ["from_index", "to_index"], "left")
    return out.withColumns({"labelled": F.col("labelled") | F.col("_ok").isNotNull(), "labelled_ok": F.coalesce("_ok", "labelled_ok")}).drop("_ok").select(table.columns)


def _share(seed: int, *columns: str) -> Column:
    """The first digits of a hash of the seed and columns."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)).cast("binary")), 1, 14)


def split(names: DataFrame, utt: str, held_out: float = 0.05, seed: int = 1234) -> tuple[DataFrame, DataFrame]:
    """(training, validation) names by a hash; a name is always on the same side."""
    below = F.conv(F.substring(_share(seed, utt), 1, 8), 16, 10).cast("long") < int(held_out * (1 << 32))
    return names.where(~below), names.where(below)


def mini_batches(streams: dict[str, DataFrame], size: int, epoch: int, seed: int = 1234, first: int = 0) -> DataFrame:
    """(batch, row, utt, frame, a column for each stream): the frames that all streams (utt, frame, v) have, in batches of
    ``size`` (the last one of an epoch can be short), in an order that the seed and the epoch decide and the cluster does
    not, from batch ``first`` on. Ranks come from ranges of the order: no task sees all rows."""
    from unitweave.operators.select import ranked_globally

    rows = spectra(streams).withColumn("_o", _share(seed, "utt", "frame")).withColumn("_o", F.substring(F.md5(F.concat_ws(":", F.lit(str(epoch)), "_o").cast("binary")), 1, 14))
    ranked = ranked_globally(rows, ["_o", "utt", "frame"], "_r").drop("_o")
    batch = F.floor(F.col("_r") / size)
    return ranked.select(batch.alias("batch"), (F.col("_r") % size).alias("row"), "utt", "frame", *streams).where(F.col("batch") >= first)


def record_run(spark: SparkSession, path: str, name: str, settings: dict, result: float) -> None:
    """Appends a row (name, settings, result) to a table of tuning runs."""
    spark.createDataFrame([(name, json.dumps(settings, sort_keys=True, default=str), float(result))], "name string, settings string, result double").write.mode("append").parquet(path)
