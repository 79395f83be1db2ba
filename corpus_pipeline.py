"""The corpus pipeline: toxicity, near-duplicates, benchmark decontamination, personal data, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all rows its predecessor kept and its
decisions take effect. All but the last return the columns of documents. ``run`` applies them to documents, with a
stored table between two stages.

Rows: decisions go by the id. Rows that repeat an id go together; a row without an id is not removed by near-duplicates
and decontamination. Null texts are near to nothing, empty ones are copies of each other, of which one stays; neither
holds benchmark windows or personal data. Without labels, or without toxic ones among them, the first stage keeps all; without benchmark items so
does the third; empty tables give no rows. Further columns of documents are not carried. n_chars follows the text, and
stays as it is where that is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitweave.llm import decontaminate, mixing, near_duplicates, pii, toxicity
from unitweave.llm.scratch import small_batches, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL cannot train the dictionaries of the first stage.
ORACLE_SQL = None


#: Rejected ids up to which their list (8 bytes each) goes to every task; a longer one is joined by a shuffle.
BROADCAST_IDS = 500_000


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id is not in the one column ``gone`` of ``ids``."""
    ids = stored(ids.distinct(), "gone")
    near = F.broadcast if ids.count() <= BROADCAST_IDS else lambda x: x
    return docs.join(near(ids), F.col("doc_id") == F.col("gone"), "left_anti")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold go."""
    small_batches(spark)
    model = toxicity.fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text", "toxic")
    return toxicity.keep_ordinary(docs.select(*COLUMNS), model)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that of the least id."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    gone = near_duplicates.near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("gone"))
    return _without(docs, gone)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    small_batches(spark)
    docs = docs.select(*COLUMNS)
    index = decontaminate.build_index(docs)
    found = decontaminate.search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where(F.size("hits") > 0).select(F.col("doc").alias("gone")))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows."""
    small_batches(spark)
    done = pii.redacted(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each repetition of a document in the mix; the last can be a part of it."""
    small_batches(spark)
    return mixing.repetitions(docs.select(*COLUMNS))


STAGES = [("toxicity", toxic), ("near_duplicates", near), ("decontamination", benchmark), ("personal_data", personal), ("mixing", mix)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
