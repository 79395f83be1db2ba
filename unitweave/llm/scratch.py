"""Shared scratch tables: lineage cuts that survive a lost executor.

Everything is written below the folder that the session names in ``spark.checkpoint.dir``; only where that is
unset and the master is local (tests, a laptop) a local folder is made and set; on a cluster that is an error. Tables are deleted when the driver's interpreter ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir`` (set to a local one only where it is unset)."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="unitweave-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of texts of a few MB: Spark's default of 10,000 rows costs tens of MB in the JVM and again in each
    worker. A setting that someone chose stays."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a scratch table."""
    path = f"{shared_dir(spark)}/unitweave/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table through Hadoop, so that any store Spark can write works."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the table behind a frame that ``stored`` returned."""
    if path := getattr(df, "_scratch", None):
        drop_path(df.sparkSession, path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                drop_path(spark, path)
        except Exception:  # the session is gone; its folder is the cluster's to clear
            return
