"""The registered queries of the training-data operators: each applies its operator, with production parameters, to
the whole of its tables. ``SQL`` holds DuckDB's form where SQL can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unitweave.llm import decontaminate, embeddings, fill_middle, language_id, language_model, mixing, near_duplicates, pii, repeats, token_counts, toxicity, vector_codes, warc
from unitweave.llm.scratch import small_batches

#: The vocabulary of op9, found through the package that ships the public tokenizers.
VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = decontaminate.build_index(_table(spark, sf_dir, "documents"))
    return decontaminate.digest(decontaminate.search(index, _table(spark, sf_dir, "benchmark")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, _table(spark, sf_dir, "labels"), "doc_id", "text", "toxic")
    return toxicity.scored(docs, model)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predicted(docs, language_id.learn(language_id.sample(docs, "doc_id", "text", "lang")))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.removed(_table(spark, sf_dir, "documents")).drop("kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(warc.archives(_table(spark, sf_dir, "pages")))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path(VOCABULARY))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(_table(spark, sf_dir, "documents"))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digest(fill_middle.rearranged(_table(spark, sf_dir, "documents")))


def op12_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scored(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_language_id, op4_near_duplicates, op5_repeats, op6_mixing, op7_warc, op8_embeddings, op9_token_counts, op10_pii, op11_fill_middle, op12_language_model, op13_vector_codes)}
SQL: dict[str, str] = {"op1_decontamination": decontaminate.SQL, "op6_mixing": mixing.SQL, "op7_warc": warc.SQL, "op8_embeddings": embeddings.SQL, "op10_pii": pii.SQL, "op11_fill_middle": fill_middle.SQL, "op13_vector_codes": vector_codes.SQL}
