"""Greedy search as targets arrive.

``attach`` runs each micro-batch of targets (utt, step, target) through the batch operator; what an utterance's search
has come to is kept in a table (utt, step, unit_id) under ``state``, one folder for each batch, so that a batch that
runs again after a failure replaces its own results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from unitweave.operators.search import greedy_search


def attach(targets: DataFrame, units: DataFrame, state: str, checkpoint: str) -> StreamingQuery:
    """Starts the search of a stream of targets. Steps of an utterance have to arrive in order; each utterance's whole
    run of steps within a batch continues from its last unit of earlier batches."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state)
        there = fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
        if there:
            past = spark.read.option("basePath", state).schema("utt string, step long, unit_id long, cost double, batch long").parquet(state).where(F.col("batch") < batch_id)
            last = past.join(batch.select("utt").distinct(), "utt", "left_semi").groupBy("utt").agg(F.max_by("unit_id", "step").alias("unit_id"))
            batch = batch.join(last.join(units.select("unit_id", F.col("cur").alias("begin")), "unit_id").select("utt", "begin"), "utt", "left")
        out = greedy_search(units, batch)
        out.write.mode("overwrite").parquet(f"{state}/batch={batch_id}")

    return targets.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
