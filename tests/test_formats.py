"""The matrix and wave data sources: ranges, filters, bad files, guards."""

from __future__ import annotations

import io
import os
import struct
import wave

import numpy as np
import pytest

from unitweave.sources import formats

MATRIX = "utt string, frame long, v array<float>"


@pytest.fixture(scope="module")
def known(spark):
    formats.register(spark)
    return spark


def saved(spark, rows, at, **options):
    df = spark.createDataFrame(rows, MATRIX)
    formats.by_utterance(df, "frame").write.format("speech-matrix").options(dim=3, **options).mode("append").save(str(at))


def loaded(spark, at, source="speech-matrix", **options):
    return spark.read.format(source).options(**options).load(str(at))


def test_matrices_in_ranges_and_by_filters(known, tmp_path):
    rows = [(f"u{k}", i, [float(k), float(i), 0.5]) for k in range(4) for i in range(50 + k)]
    saved(known, rows, tmp_path / "m", suffix=".f32")
    assert sorted(os.listdir(tmp_path / "m")) == [f"u{k}.f32" for k in range(4)]
    assert os.path.getsize(tmp_path / "m/u2.f32") == 52 * 12
    back = loaded(known, tmp_path / "m", dim=3, range_bytes=240)
    assert back.rdd.getNumPartitions() == 4 * 3 and sorted(map(tuple, back.collect())) == rows
    part = back.where("utt = 'u3' AND frame >= 25 AND frame < 41")
    assert part.rdd.getNumPartitions() == 1 and sorted(r.frame for r in part.collect()) == list(range(25, 41))
    some = back.where("utt IN ('u0', 'u9') AND v[1] > 44")
    assert some.rdd.getNumPartitions() == 3 and some.count() == 5
    reader = formats.MatrixReader({"path": str(tmp_path / "m"), "dim": "3"})
    assert [(p.utt, p.first, p.last) for p in reader.partitions()] == [(f"u{k}", 0, 50 + k) for k in range(4)]


def test_headers_shorts_and_bad_sizes(known, tmp_path):
    x = np.arange(24, dtype="<i2").reshape(8, 3)
    (tmp_path / "a.bin").write_bytes(b"h" * 12 + x.tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    (tmp_path / "_not.bin").write_bytes(b"x")
    got = loaded(known, tmp_path, dim=3, dtype="int16", header="true", suffix=".bin").orderBy("frame").collect()
    assert [list(r.v) for r in got] == x.tolist() and {r.utt for r in got} == {"a"}
    one = loaded(known, tmp_path / "a.bin", dim=3, dtype="int16", header="true")
    assert one.count() == 8
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="no rows of 3"):
        loaded(known, tmp_path, dim=3, dtype="int16", header="true").count()
    assert loaded(known, tmp_path, dim=3, dtype="int16", header="true", skip_bad="true").count() == 8


def test_writers_guard_files(known, tmp_path):
    rows = [("u", 0, [1.0, 2.0, 3.0]), ("w", 0, [4.0, 5.0, 6.0])]
    saved(known, rows, tmp_path / "m")
    with pytest.raises(Exception, match="exists"):
        saved(known, rows[:1], tmp_path / "m")
    assert sorted(os.listdir(tmp_path / "m")) == ["u", "w"]
    df = known.createDataFrame(rows[:1] * 2, MATRIX).repartition(2)
    with pytest.raises(Exception, match="two tasks|stand together"):
        df.write.format("speech-matrix").options(dim=3).mode("append").save(str(tmp_path / "n"))
    for bad in ([(None, 0, [1.0, 2.0, 3.0])], [("u", 0, [1.0])], [("u", 0, None)]):
        with pytest.raises(Exception):
            saved(known, bad, tmp_path / "o")
    assert [x for x in os.listdir(tmp_path / "o") if not x.startswith("_")] == []
    formats.by_utterance(known.createDataFrame(rows[:1], MATRIX), "frame").write.format("speech-matrix").options(dim=3).mode("overwrite").save(str(tmp_path / "m"))


def wav(samples, channels=1, width=2):
    held = io.BytesIO()
    with wave.open(held, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(8000)
        w.writeframes(samples.tobytes())
    return held.getvalue()


def test_waves(known, tmp_path):
    x = np.arange(-5000, 5001, dtype="<i2")
    (tmp_path / "a.wav").write_bytes(wav(x))
    rows = sorted(loaded(known, tmp_path, "speech-wave", range_bytes=6000).collect(), key=lambda r: r.pos)
    assert np.concatenate([r.samples for r in rows]).tolist() == x.tolist() and {r.rate for r in rows} == {8000} and len(rows) == 4
    part = loaded(known, tmp_path, "speech-wave", range_bytes=6000).where("pos >= 6000").collect()
    assert sorted(r.pos for r in part) == [6000, 9000]
    stereo = wav(np.stack([x, -x], 1).astype("<i2"), 2)
    extra = stereo[:12] + struct.pack("<4sI", b"LIST", 3) + b"abc\x00" + stereo[12:]  # a chunk of odd size before
    (tmp_path / "s.wav").write_bytes(extra)
    assert np.concatenate([r.samples for r in sorted(loaded(known, tmp_path / "s.wav", "speech-wave").collect(), key=lambda r: r.pos)]).tolist() == x.tolist()
    with pytest.raises(Exception, match="one channel"):
        loaded(known, tmp_path / "s.wav", "speech-wave", mono="true").count()
    for name, data in (("w", wav(x.astype("<i4"), 1, 4)), ("r", b"RIFFxxxxWAVE"), ("n", b"no")):
        (tmp_path / f"{name}.wav").write_bytes(data)
        with pytest.raises(Exception):
            loaded(known, tmp_path / f"{name}.wav", "speech-wave").count()
    assert loaded(known, tmp_path, "speech-wave", skip_bad="true").select("utt").distinct().count() == 2


def test_written_waves_are_waves(known, tmp_path):
    rows = [("a", 8000, 5, k, [float(k), 4e4][: 2 - (k == 2)]) for k in range(3)]
    df = known.createDataFrame(rows, "utt string, rate int, n long, part int, samples array<double>")
    formats.by_utterance(df, "part").drop("part").write.format("speech-wave").option("suffix", ".wav").mode("append").save(str(tmp_path / "w"))
    with wave.open(str(tmp_path / "w/a.wav")) as w:
        assert w.getframerate() == 8000 and np.frombuffer(w.readframes(9), "<i2").tolist() == [0, 32767, 1, 32767, 2]


def test_many_small_files_share_tasks(known, tmp_path):
    """A task reads many small files; filters and bad files hold there, too."""
    n = formats.MANY + 60
    for k in range(n):
        (tmp_path / f"u{k}.bin").write_bytes(np.full((k % 5, 3), k, "<f4").tobytes())
    df = loaded(known, tmp_path, dim=3)
    assert df.rdd.getNumPartitions() <= formats.MANY
    assert sorted((r.utt, r.frame, r.v[2]) for r in df.collect()) == sorted((f"u{k}", i, float(k)) for k in range(n) for i in range(k % 5))
    assert {r.frame for r in df.where("frame >= 1 AND frame < 3").collect()} == {1, 2}
    assert df.where("utt = 'u9'").count() == 4
    (tmp_path / "big.bin").write_bytes(np.zeros((50, 3), "<f4").tobytes())
    assert loaded(known, tmp_path, dim=3, range_bytes=120).where("utt = 'big'").count() == 50
    assert loaded(known, tmp_path, dim=3, range_bytes=120).count() == sum(k % 5 for k in range(n)) + 50
    (tmp_path / "bad.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="no rows of 3"):
        loaded(known, tmp_path, dim=3).count()
    assert loaded(known, tmp_path, dim=3, skip_bad="true").count() == sum(k % 5 for k in range(n)) + 50
