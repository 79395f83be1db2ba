"""Tables between the steps of an operator, below the folder that the session names in ``spark.checkpoint.dir``.

They cut lineage so that a lost executor costs no more than the step it was in. Where the setting is missing and the
master is local, a local folder is made and set; on a cluster that is an error. Tables that are not released go with the
driver's interpreter.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_open: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    name = "spark.checkpoint.dir"
    folder = spark.conf.get(name, None) or spark.sparkContext.getConf().get(name)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{name} has to name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="unitweave-")
        spark.conf.set(name, folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/unitweave/{name}-{uuid.uuid4().hex}"
    _open[path] = spark
    return path


def removed(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _open.pop(path, None)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a stored table."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what ``kept`` stored."""
    for df in tables:
        if path := getattr(df, "_stored_at", None):
            removed(df.sparkSession, path)


@atexit.register
def _at_exit() -> None:
    for path, spark in list(_open.items()):
        try:
            if spark.sparkContext._jsc is not None:
                removed(spark, path)
        except Exception:  # the session is gone; its folder is the cluster's to clear
            return
