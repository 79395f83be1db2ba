"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, one on windows of ordinary text and one on those pieces of toxic windows that
toxic text compresses better than ordinary text does. A text is cut into windows of 48 bytes that begin at words and
overlap by half. A label tells that a text is toxic, not where; so the toxic training texts are dealt into folds, and
each fold's windows are compressed twice: with the text of the other toxic folds as dictionary, and with as much
ordinary text. A window gains where the first is shorter by more than nearly all held-out ordinary windows show; the
pieces without which the gain is lost are what the toxic dictionary is trained on, unless windows of ordinary text gain
by them nearly as often (``telling_pieces``).

In scoring, each window is compressed with the ordinary dictionary alone and with the toxic one chained before it, so
that windows without toxic content compress alike; the difference of the two lengths is the window's gain. How many
windows gain so many bytes, in share and in number, is calibrated on labelled texts. Labelled texts are split by a hash
of their text: one part trains dictionaries, one chooses among ``CANDIDATES``, and one, that nothing else has seen,
calibrates. A text is predicted toxic where the calibrated score reaches the threshold.

Learning uses a bounded sample of labelled rows (``MAX_TOXIC`` and ``MAX_ORDINARY``, chosen by a hash of the id, one
row of an id, and as many of them as have ``MAX_BYTES`` in all); scoring covers all rows and whole texts.

Rows: null and empty texts are one empty window and get a score like any other; repeated documents are rows of their
own; labels that are null are left out, of several labels of an id the largest holds. Without both classes among the
labels every score is the share of toxic labels (0 without labels).
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitweave.llm.scratch import stored

#: Labelled texts of each class that are learned from at most, and their bytes.
MAX_TOXIC, MAX_ORDINARY, MAX_BYTES = 3000, 8000, 32 << 20
#: Of them, hundredths that choose among the candidates (two halves), and that calibrate; the others train dictionaries.
CHOOSE, CALIBRATE = 20, 20
WINDOW, STEP, LEVEL = 48, 24, 5
#: Bytes of the ordinary dictionary at most, and of its windows for each of them: it should hold what is frequent.
ORDINARY_BYTES, ORDINARY_SHARE = 32768, 24
#: Windows of ordinary texts that its dictionary is trained on, about, and of others that stand against toxic ones: to
#: propose pieces, and to confirm them.
ORDINARY_WINDOWS, AGAINST, CONFIRM = 60_000, 80_000, 150_000
#: Parts of the toxic texts, each judged by the text of the others; bytes of that text; share of ordinary windows that
#: do not gain; bytes that a piece gains; how many times as often a proposed piece makes toxic windows gain as ordinary.
FOLDS, CLASS_BYTES, QUIET, PIECE_GAIN, PROPOSED = 4, 100_000, 0.9, 2, 3
#: The candidates: (how many times as often a confirmed piece makes toxic windows gain as ordinary ones, its windows for
#: each toxic text at least, bytes of the toxic dictionary for each byte of a piece).
CANDIDATES = ((10, 0.004, 3), (25, 0.004, 3), (50, 0.004, 2), (50, 0.004, 3), (100, 0.004, 3))
THRESHOLD, SEED = 0.7, 5
_WORD = regex.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_GAINS = np.array([1, 2, 3, 4, 5, 6, 8])


def fold(id_col: str) -> Column:
    """crc32 of the id's text modulo 3: rows of 1 are held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3, F.lit(0))


def windows(text: str | None) -> list[bytes]:
    """Overlapping windows of a text; each but the first begins at a word where there is one near."""
    raw = (text or "").lower().encode("utf-8", "surrogatepass")
    out, at = [], 0
    while True:
        out.append(raw[at : at + WINDOW])
        if at + WINDOW >= len(raw):
            return out
        blank = raw.find(b" ", at + STEP, at + WINDOW)
        at = blank if blank >= 0 else at + STEP


def _dictionary(samples: list[bytes], size: int, segment: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few samples: the samples are the dictionary
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(content) < 8:
        return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=WINDOW, **plain))
    params = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=WINDOW, min_match=4, **plain)
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=data, compression_params=params)


@dataclass
class Model:
    """Dictionaries and calibration; ``prior`` alone where nothing could be learned."""

    prior: float = 0.0
    ordinary: bytes = b""
    toxic: bytes = b""
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def scorer(self):
        """A function from texts to scores."""
        if not len(self.weight):
            return lambda texts: np.full(len(texts), self.prior)
        gains = gain_counter(self.ordinary, self.toxic)
        return lambda texts: self.calibrated(np.array([features(gains(t)) for t in texts]).reshape(len(texts), -1))

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -20, 20) @ self.weight[:-1] + self.weight[-1]
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def gain_counter(ordinary: bytes, toxic: bytes):
    """A function from a text to its windows' gains."""
    plain, chained = _compressor(ordinary).compress, _compressor(toxic + ordinary).compress

    def gains(text: str | None) -> np.ndarray:
        own = windows(text)
        return np.fromiter((len(plain(w)) - len(chained(w)) for w in own), np.int32, len(own))

    return gains


def features(gains: np.ndarray) -> np.ndarray:
    n = len(gains)
    counts = (gains[:, None] >= _GAINS).sum(0)
    return np.r_[counts / n, np.log1p(counts), gains.max() / 8, gains.mean(), np.log(n), np.sort(gains)[-3:].sum() / 16]


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ridge = 2 / len(y)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -60, 60)))
        grad = z.T @ (p - y) / len(y) + ridge * np.r_[w[:-1], 0]
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z / len(y) + ridge * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _gaining(groups: tuple[list[bytes], list[bytes]], gain, quiet: float) -> list[Counter]:
    """For each of the groups of windows, toxic and ordinary, how many lose their gain without each piece (a word of a
    window). A window gains by more than the share ``quiet`` of ordinary ones."""
    gains = [[gain(w) for w in group] for group in groups]
    least = max(PIECE_GAIN, np.quantile(gains[1], quiet) + 1) if gains[1] else PIECE_GAIN
    counts = [Counter(), Counter()]
    for group, of, count in zip(groups, gains, counts):
        for w, g in zip(group, of):
            if g >= least:
                count.update({m.group() for m in _WORD.finditer(w) if m.end() < len(w) and m.end() - m.start() >= 3 and g - gain(w[: m.start()] + w[m.end() :]) >= PIECE_GAIN})
    return counts


def telling_pieces(toxic: list[bytes], ordinary: bytes, cut: list[bytes]) -> dict[bytes, tuple[int, float]]:
    """The pieces by which windows of the toxic texts gain: for each the toxic windows that lose their gain without it,
    and how many times as often that is as in windows of ordinary texts (``cut``, that the dictionary ``ordinary`` was
    not trained on). Pieces are proposed by folds of the toxic texts and confirmed by a dictionary of them all."""
    parts: list[list[bytes]] = [[] for _ in range(FOLDS)]
    for t in toxic:
        parts[zlib.crc32(t) // 100 % FOLDS] += windows(t.decode("utf-8", "surrogatepass"))
    every = [w for part in parts for w in part]
    n = min(AGAINST, len(cut) // 2)
    against, rest = cut[:n], cut[n : n + CONFIRM]
    found = [Counter(), Counter()]
    for k, own in enumerate(parts):
        step = max(1, (len(every) - len(own)) * WINDOW // CLASS_BYTES)
        text = b"".join(w for i, part in enumerate(parts) if i != k for w in part[::step])[:CLASS_BYTES]
        with_toxic, with_more = _compressor(text + ordinary).compress, _compressor(b"".join(rest[: len(text)])[: len(text)] + ordinary).compress
        for count, more in zip(found, _gaining((own, against[k::FOLDS]), lambda w: len(with_more(w)) - len(with_toxic(w)), QUIET)):  # noqa: B023
            count.update(more)
    proposed = sorted((p for p, n in found[0].items() if n > 1 and n * len(against) >= PROPOSED * (found[1][p] + 1) * len(every)), key=lambda p: (found[0][p], p))
    plain, chained = _compressor(ordinary).compress, _compressor(b" ".join([b"", *proposed, b""])[-CLASS_BYTES:] + ordinary).compress
    usual = rest
    known, common = _gaining((every, usual), lambda w: len(plain(w)) - len(chained(w)), 0.5)
    return {p: (known[p], known[p] * max(1, len(usual)) / (common[p] + 1) / max(1, len(every))) for p in proposed if known[p]}


def learn(rows: list[tuple[str, int]]) -> Model:
    """rows: (text, label), in an order that does not depend on the cluster."""
    labels = np.array([y for _, y in rows], np.float64)
    prior = float(labels.mean()) if len(rows) else 0.0
    part = [zlib.crc32((t or "").encode("utf-8", "surrogatepass")) % 100 for t, _ in rows]
    train = [list(dict.fromkeys((t or "").lower().encode("utf-8", "surrogatepass") for (t, y), k in zip(rows, part) if k >= CHOOSE + CALIBRATE and y == label)) for label in (0, 1)]
    choose = [[r for r, k in zip(rows, part) if CHOOSE * h <= 2 * k < CHOOSE * (h + 1)] for h in (0, 1)]
    rest = [r for r, k in zip(rows, part) if CHOOSE <= k < CHOOSE + CALIBRATE]
    if not all(train) or any(len({y for _, y in x}) < 2 for x in (*choose, rest)):
        return Model(prior)
    every = max(1, sum(map(len, train[0])) // STEP // (ORDINARY_WINDOWS + AGAINST + CONFIRM))  # of windows one is taken
    cut: list[bytes] = []
    for t in train[0]:
        cut += windows(t.decode("utf-8", "surrogatepass"))[len(cut) % every :: every]
    np.random.default_rng(SEED).shuffle(cut)
    n = min(ORDINARY_WINDOWS, len(cut) // 3)
    ordinary = _dictionary(cut[:n], min(ORDINARY_BYTES, n * WINDOW // ORDINARY_SHARE), 16)
    del cut[:n]
    pieces = telling_pieces(train[1], ordinary, cut)
    del cut[:]
    plain = _compressor(ordinary).compress

    def lengths(compress, text: str) -> np.ndarray:
        return np.array([len(compress(w)) for w in windows(text)], np.int16)

    known = [[lengths(plain, t) for t, _ in x] for x in choose]
    truth = [np.array([y for _, y in x], np.float64) for x in choose]
    best, chosen = -np.inf, b""
    for ratio, share, room in CANDIDATES:
        least = max(2, share * len(train[1]))
        told = {p: n for p, (n, times) in sorted(pieces.items()) if n >= least and times >= ratio}
        samples = [x for p, n in told.items() for x in [(b" " + p) * max(2, -(-20 // (len(p) + 1))) + b" "] * n]
        if not samples:
            continue
        samples = [samples[i] for i in np.random.default_rng(SEED).permutation(len(samples))]  # the trainer looks at stretches
        toxic = _dictionary(samples, 300 + room * sum(len(p) + 1 for p in told), 24)
        chained = _compressor(toxic + ordinary).compress
        x = [np.array([features(n - lengths(chained, t)) for n, (t, _) in zip(k, part)]) for k, part in zip(known, choose)]
        fitness = 0.0
        for a in (0, 1):  # calibrated on one half, judged on the other
            p = np.clip(Model(prior, ordinary, toxic, *_logistic(x[a], truth[a])).calibrated(x[1 - a]), 1e-6, 1 - 1e-6)
            fitness += float((truth[1 - a] * np.log(p) + (1 - truth[1 - a]) * np.log(1 - p)).mean())
        if fitness > best:
            best, chosen = fitness, toxic
    if not chosen:
        return Model(prior)
    gains = gain_counter(ordinary, chosen)
    return Model(prior, ordinary, chosen, *_logistic(np.array([features(gains(t)) for t, _ in rest]), np.array([y for _, y in rest], np.float64)))


def _order(row) -> tuple[int, str, str]:
    """The place of a row (id, text, ...) among the learned ones."""
    return zlib.crc32(str(row[0]).encode()), str(row[0]), str(tuple(row[2:]))


def drawn(rows: DataFrame, id_col: str, text_col: str, most: int = MAX_BYTES) -> DataFrame:
    """The rows (id, text, other columns), one of each id (that of the least text), by a hash of the id, as long as their
    texts have ``most`` bytes in all; a text that does not fit is passed over, and the next ones are tried. rows: of a
    bounded number of ids; ids and sizes alone come to the driver."""
    more = [c for c in rows.columns if c not in (id_col, text_col)]
    one = stored(rows.groupBy(id_col, *more).agg(F.min(text_col).alias(text_col)), "sample").select(id_col, text_col, *more)
    sizes = one.select(id_col, F.coalesce(F.octet_length(text_col), F.lit(0)).alias("n"), *more).collect()
    sizes.sort(key=_order)
    fit, left = [], most
    for r in sizes:
        if r[1] <= left:
            fit.append((r[0],))
            left -= r[1]
    return one if len(fit) == len(sizes) else one.join(F.broadcast(one.sparkSession.createDataFrame(fit, one.select(id_col).schema)), id_col, "left_semi")


def bounded(rows: DataFrame, id_col: str, text_col: str, most: int = MAX_BYTES) -> list:
    """The rows that ``drawn`` chooses, in an order that does not depend on the cluster."""
    return sorted(drawn(rows, id_col, text_col, most).collect(), key=_order)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, label) of the learning folds, at most the bounds of ids of each class."""
    order = [F.xxhash64(id_col), F.col(id_col)]
    known = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_label")).where(F.col("_label").isNotNull() & F.col(id_col).isNotNull() & (fold(id_col) != 1)).groupBy(id_col).agg(F.max("_label").alias("_label"))
    chosen = [known.where(F.col("_label") == c).orderBy(*order).limit(n) for c, n in ((1, MAX_TOXIC), (0, MAX_ORDINARY))]
    ids = chosen[0].unionAll(chosen[1])  # at most the two bounds of rows
    return docs.select(id_col, text_col).join(F.broadcast(ids), id_col)


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> list[tuple[str, int]]:
    """Labelled texts of the learning folds, at most the bounds of each class, the same ones on every run."""
    return [(r[1], r[2]) for r in bounded(_labelled(docs, labels, id_col, text_col, label_col), id_col, text_col)]


def fitted(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """The model of the texts of ``sample``, learned in one task: the driver gets the model alone, and a lost executor
    costs a second attempt of that task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))), key=_order)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(learn([(r[1], r[2]) for r in rows]))], pa.binary())], ["model"])

    texts = drawn(_labelled(docs, labels, id_col, text_col, label_col), id_col, text_col)
    found = texts.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else learn([])


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                s = score(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], schema.names)

    return docs.select(id_col, (fold(id_col) == 1).alias("held_out"), text_col).mapInArrow(run, schema)


def keep_ordinary(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns."""
    held, schema, at = docs.sparkSession.sparkContext.broadcast(model), docs.schema, docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = held.value.scorer()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                yield part.filter(pa.array(score(part.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(run, schema)
