"""Every registered query of the engine against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import math
import os
from pathlib import Path

import numpy as np
import pytest

from unitweave.plans import catalog, files, more  # noqa: F401

DATA = Path(os.environ.get("TESTDATA", "/root/testdata")) / "sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def plain(v):
    return None if v is None or isinstance(v, float) and math.isnan(v) else float(f"{v:.8g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in catalog.SQL:
        assert got
        return
    out = duck.sql(catalog.SQL[name])
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=repr)


def test_partitions_of_frames_grow_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(catalog, "TASK_ROWS", 500)
    d = str(DATA)
    n = spark.read.parquet(f"{d}/lineitem.parquet").count()
    out = catalog.QUERIES["compose_streams"](spark, d)
    assert out.rdd.getNumPartitions() >= n // 500 > 4


def test_samples_of_the_graph_go_to_the_ends_of_utterances(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(5)
    ids = [*range(9), *range(25, 30)]
    rows = [(i, rng.normal(size=catalog.DIM).tolist(), None if i == 4 else i % 4) for i in ids]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.utt, r.sample, r.step): r.unit_id for r in catalog.QUERIES["graph_samples"](spark, str(tmp_path)).collect()}
    assert set(got) == {(i // 25, s, i % 25) for i in ids for s in (0, 1)}
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    out = c.sql(f"SELECT utt, sample, step, unit_id FROM ({catalog.SQL['graph_samples']})").fetchall()
    assert len(out) == len(got) and got == {r[:3]: r[3] for r in out}
