"""Long texts and clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from unitweave.llm import language_id, mixing, pii, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_text_over_the_bound_is_passed_over(spark):
    rows = [(i, "x" * 50 if i % 5 else "y" * 5000, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = toxicity.drawn(df, "doc_id", "text", 600).collect()
    assert len(got) == 12 and all(len(r.text) == 50 for r in got)
    assert len(toxicity.drawn(df, "doc_id", "text", 100_000).collect()) == 40
    assert toxicity.drawn(df, "doc_id", "text", 10).count() == 0


def test_language_is_learned_beside_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_BYTES", 20_000)
    words = {"a": "ka lo mi ne pu", "b": "schrof krint blust grimf"}
    rows = [(i, words["ab"[i % 2]] * 5, "ab"[i % 2], None, None) for i in range(80)] + [(100 + i, "x" * 30_000, "a", None, None) for i in range(9)]
    docs = spark.createDataFrame(rows, DOCS)
    model = language_id.learn(language_id.sample(docs, "doc_id", "text", "lang"))
    assert model.languages == ["a", "b"]


@pytest.mark.parametrize("name", ["repetition", "size", "taken", "source_size", "target"])
def test_mixing_gives_way_to_its_own_names(spark, name):
    rows = [(i, "one two three", None, "ab"[i % 2], 13) for i in range(10)]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(map(tuple, mixing.repetitions(docs).collect()), key=str)
    done = mixing.repetitions(docs.withColumn(name, F.lit("clash")))
    assert len(set(done.columns)) == len(done.columns)
    assert sorted(map(tuple, done.select(mixing.repetitions(docs).columns).collect()), key=str) == want
    assert mixing.mixed(docs.withColumn(name, F.lit("clash"))).count() == 10


def test_redaction_keeps_other_columns(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cc now", "kept", "too")], "doc_id long, text string, _pii_email string, __pii_x string")
    got = pii.redacted(docs).first()
    assert got.asDict() == {"doc_id": 1, "text": "mail [EMAIL] now", "_pii_email": "kept", "__pii_x": "too"}


@pytest.mark.parametrize("rows", [[], [(1, None), (2, None), (3, ""), (4, ""), (None, "a few plain words here"), (5, "some other text that stands alone"), (6, "x@y.org writes to y@z.org again and again")]])
def test_pipeline_without_labels_and_benchmark(spark, tmp_path, rows):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.createDataFrame([(i, t, None, "s", 7) for i, t in rows], DOCS).withColumn("size", F.lit("clash")).withColumn("gone", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    for _, stage in pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
    shown = {6: "[EMAIL] writes to [EMAIL] again and again"}
    want = [(i, 7 if t is None else len(shown.get(i, t))) for i, t in rows if i != 4]  # the second empty text is a copy
    assert sorted(((r.doc_id, r.n_chars) for r in at.collect()), key=str) == sorted(want, key=str)
    mix = pipeline.run(spark, str(tmp_path))
    assert mix.columns[:5] == pipeline.COLUMNS and len(set(mix.columns)) == len(mix.columns)
    assert (mix.agg(F.sum("taken")).first()[0] or 0) == round(1.5 * sum(len((t or "").split()) for _, t in rows))
