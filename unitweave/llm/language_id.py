"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is normalised (ASCII letters in lower case, other ASCII signs as one kind of gap) and read as its byte n-grams
of 2, 3 and 4 bytes, gaps included, so that they know where words begin and end. Each n-gram hashes to a row of an
embedding table; the mean of the rows goes through a linear softmax. Table and softmax are trained together by
stochastic gradient descent in numpy, and a temperature is fitted on texts kept out of it. As both steps are linear,
scoring adds up one small row of logits per n-gram.

The score is the calibrated probability of the predicted language. ``rejected`` marks predictions whose score is below
a limit that was set so that, of the calibration texts, at most ``REJECT`` of those above it are wrong. A text that is
null or has no letter is ``und`` with score 0.

Learning uses a bounded sample (``MAX_TEXTS``, chosen by a hash of the id; whole texts); scoring covers all rows and
whole texts. Rows: repeated documents are rows of their own; without any labelled text every prediction is ``und``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitweave.llm import textarrays as ta
from unitweave.llm.toxicity import MAX_BYTES, bounded, fold

MAX_TEXTS = 4000
BITS, DIM, EPOCHS, RATE = 15, 12, 6, 0.5
SIZES = (2, 3, 4)
#: N-grams of a training text that one step looks at (drawn anew in each epoch; all n-grams count when scoring).
DRAWN = 2000
REJECT = 0.01
UNKNOWN = "und"

_GAP = 32
NORMAL = ta.LOWER.copy()
NORMAL[:128][~ta.IS_WORD[:128][ta.LOWER[:128]]] = _GAP
NORMAL[48:58] = _GAP
_MIX = [np.uint32(x) for x in (2654435761, 2246822519, 3266489917)]
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True
_LETTER = regex.compile(r"\p{L}")


def ngrams(buf: np.ndarray) -> list[np.ndarray]:
    """For each size, the table row of the n-gram that begins at each byte."""
    x = NORMAL[buf].astype(np.uint32)
    out = []
    for size, mult in zip(SIZES, _MIX):
        n = max(0, len(x) - size + 1)
        code = x[:n].copy()
        for j in range(1, size):
            code = code << np.uint32(8) | x[j : j + n]
        with np.errstate(over="ignore"):
            code = (code ^ code >> np.uint32(15)) * mult
        out.append((code >> np.uint32(32 - BITS)).astype(np.int32))
    return out


@dataclass
class Model:
    languages: list[str] = field(default_factory=list)
    logits: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # a row per n-gram
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    limit: float = 0.0

    def raw(self, column: pa.Array) -> np.ndarray:
        """Logits of each text."""
        out = np.zeros((len(column), len(self.languages)))
        table = self.logits.astype(np.float32)
        for row, buf, offsets in ta.blocks(column):
            counts = np.zeros(len(offsets) - 1)
            for size, codes in zip(SIZES, ngrams(buf)):
                # n-grams that begin in a row and end in it
                begin, end = offsets[:-1], np.maximum(offsets[1:] - size + 1, offsets[:-1])
                ok = np.flatnonzero(end > begin)
                if not len(ok):
                    continue
                edges = np.stack([begin[ok], np.minimum(end[ok], len(codes))], 1).ravel()
                values = table[codes]
                sums = np.add.reduceat(np.r_[values, np.zeros((1, values.shape[1]), np.float32)], edges, axis=0, dtype=np.float64)[::2]
                out[row + ok] += sums
                counts[ok] += edges[1::2] - edges[::2]
            out[row : row + len(counts)] /= np.maximum(counts, 1)[:, None]
        return out + self.bias

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score)"""
        z = self.raw(column) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def has_letter(column: pa.Array) -> np.ndarray:
    out = np.zeros(len(column), bool)
    for row, buf, offsets in ta.blocks(column):
        count = np.r_[0, np.cumsum(_ASCII_LETTER[buf])]
        out[row : row + len(offsets) - 1] = count[offsets[1:]] > count[offsets[:-1]]
    for i in np.flatnonzero(~out):
        text = column[int(i)].as_py()
        out[i] = bool(text) and _LETTER.search(text) is not None
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def learn(rows: list[tuple[str, str]], seed: int = 5) -> Model:
    """rows: (text, language), in an order that does not depend on the cluster."""
    rows = [(t, x) for t, x in rows if t and x is not None]
    names = sorted({x for _, x in rows})
    if not rows:
        return Model()
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(names)}
    table, soft, bias = rng.normal(0, 0.1, (1 << BITS, DIM)), np.zeros((DIM, len(names))), np.zeros(len(names))
    codes = [np.concatenate(ngrams(np.frombuffer(t.encode("utf-8", "surrogatepass"), np.uint8))) for t, _ in rows]
    y = np.array([number[x] for _, x in rows])
    kept = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) % 5 == 0 for t, _ in rows])  # for calibration
    steps, total = 0, EPOCHS * int((~kept).sum())
    for _ in range(EPOCHS):
        for i in rng.permutation(np.flatnonzero(~kept)):
            own = codes[i]
            if not len(own):
                continue
            own = own[rng.integers(0, len(own), min(DRAWN, len(own)))]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = table[own].mean(0)
            error = _softmax(hidden @ soft + bias)
            error[y[i]] -= 1
            back = soft @ error
            soft -= rate * np.outer(hidden, error)
            bias -= rate * 0.1 * error
            np.subtract.at(table, own, rate * 10 * back / len(own))
    model = Model(names, (table @ soft).astype(np.float32), bias)
    kept = kept if kept.any() else ~kept
    z, t = model.raw(pa.array([rows[i][0] for i in np.flatnonzero(kept)], pa.large_string())), y[kept]
    # The temperature of the least log loss, and the limit of rejection.
    heats = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(_softmax(z / h)[np.arange(len(t)), t], 1e-12)).mean() for h in heats]
    model.temperature = float(heats[int(np.argmin(loss))])
    p = _softmax(z / model.temperature)
    score, right = p.max(1), p.argmax(1) == t
    order = np.argsort(-score)
    wrong = np.cumsum(~right[order]) / np.arange(1, len(t) + 1)
    good = np.flatnonzero(wrong <= REJECT)
    model.limit = float(score[order][good[-1]]) if len(good) else 1.0
    return model


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """Texts with a language of the learning folds, at most ``MAX_TEXTS``, the same ones on every run."""
    ids = docs.select(id_col).where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & (fold(id_col) != 1))
    ids = ids.orderBy(F.xxhash64(id_col), id_col).limit(MAX_TEXTS).distinct()
    rows = docs.select(id_col, text_col, lang_col).where(F.col(lang_col).isNotNull()).join(F.broadcast(ids), id_col)
    return [(r[1], r[2]) for r in bounded(rows, id_col, text_col, MAX_BYTES)]


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, lang_pred, score, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        names = np.array([*own.languages, UNKNOWN], object)
        for batch in batches:
            texts = batch.column(2)
            known = has_letter(texts)
            if own.languages:
                best, score = own.predict(texts)
            else:
                best, score, known = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
            best, score = np.where(known, best, len(own.languages)), np.where(known, score, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[best].tolist(), pa.string()), pa.array(score), pa.array(~known | (score < own.limit))], schema.names)

    return docs.select(id_col, (fold(id_col) == 1).alias("held_out"), text_col).mapInArrow(run, schema)
