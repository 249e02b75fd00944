"""Operator 10: language identification by string-kernel classification.

A text is the set of its byte 1- to 3-grams (letters in lower case; digits,
marks and spaces are one gap character), hashed into ``FEATURES`` places: a
blended-spectrum presence kernel K(x, y) = |x & y| / sqrt(|x| |y|).  Nystrom
landmarks are drawn from the training sample; the features K(x, L) K(L, L)^-1/2
feed a one-versus-rest kernel ridge regression.  Scoring folds the last two
factors and is one product of a batch's presence matrix with the landmarks and
one with the coefficients.

Learning uses text and non-null lang of rows outside the held-out fold; it is
fitted on a sample of about ``PER_LANGUAGE`` rows a language (at most twice as
many), of which executors send packed presence bits only.  Everything else
covers all rows and whole texts; long texts are read in segments.

Defined results: null text or text without a letter is ``und`` with score 0;
other columns are untouched, but those named ``lang_pred`` or ``score`` are
replaced; rows without doc_id are not held out and not learnt
from; ties go to the first language in order; with nothing to learn from, all
rows are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm import wordhash as W
from engramlake.llm.shared import arrow_map, bounded_sample, table

FEATURES = 1 << 13
PER_LANGUAGE = 400
LANDMARKS = 128
RIDGE = 1e-2
#: Texts in a product of matrices, and bytes of a text read at once.
BATCH, SEGMENT = 256, 1_000_000

_CODE = np.zeros(256, dtype=np.uint32)
_CODE[97:123] = np.arange(97, 123)
_CODE[65:91] = np.arange(97, 123)
_CODE[128:] = np.arange(128, 256)


def presence(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows of zeros and ones (float32): which hashed n-grams a text has."""
    out = np.zeros((len(at) - 1, FEATURES), dtype=np.float32)
    flat = out.reshape(-1)
    row = np.repeat(np.arange(len(at) - 1, dtype=np.int64) * FEATURES, np.diff(at))
    for start in range(0, len(data), SEGMENT):
        stop = min(len(data), start + SEGMENT + 2)
        c, r = _CODE[data[start:stop]], row[start:stop]
        gram = np.zeros_like(c)
        for n in range(1, 4):
            if len(c) < n:
                break
            gram = gram[: len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1 :] + np.uint32(n * 0x9E37)
            mixed = (gram ^ (gram >> np.uint32(15))) * np.uint32(0x85EBCA6B)
            place = (mixed >> np.uint32(19)).astype(np.int64)
            first = r[: len(place)]
            whole = first == r[n - 1 :]
            flat[(first + place)[whole]] = 1.0
    return out


def _blocks(column: pa.Array) -> Iterator[np.ndarray]:
    for row, data, at in W.runs(column):
        for k in range(0, len(at) - 1, BATCH):
            own = at[k : k + BATCH + 1]
            yield presence(data[own[0] : own[-1]], own - own[0])


class Model:
    """Landmarks and folded coefficients; a few MB whatever the input."""

    def __init__(self, bits: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        x = bits / np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1))
        pick = np.unique(np.linspace(0, len(x) - 1, min(LANDMARKS, len(x))).astype(int))
        self.marks = x[pick].T.astype(np.float32)
        values, vectors = np.linalg.eigh((x[pick] @ x[pick].T).astype(np.float64))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        phi = (x @ self.marks).astype(np.float64) @ root
        phi = np.hstack([phi, np.ones((len(phi), 1))])
        y = np.array([[1.0 if a == b else 0.0 for b in self.langs] for a in langs])
        w = np.array([1.0 / langs.count(a) for a in langs])[:, None]
        w = w / w.mean()
        solved = np.linalg.solve(phi.T @ (w * phi) + RIDGE * np.eye(phi.shape[1]), phi.T @ (w * y))
        self.coefficients, self.bias = (root @ solved[:-1]).astype(np.float32), solved[-1].astype(np.float32)

    def scores(self, bits: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(bits.sum(axis=1, keepdims=True), 1))
        return (bits @ self.marks) / norm @ self.coefficients + self.bias


def fit(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id") -> Model | None:
    """A model from the rows of ``docs``, or None if there are none."""
    rows = bounded_sample(docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).rlike(r"\p{L}")), lang, key, PER_LANGUAGE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.packbits(b.astype(bool), axis=1) for b in _blocks(batch.column(2))]
            packed = [x.tobytes() for p in packed for x in p]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["key", "lang", "bits"])

    found = arrow_map(rows.select(F.col(key).cast("string").alias("key"), F.col(lang).alias("lang"), F.col(text).cast("binary")), run, "key string, lang string, bits binary").toArrow()
    if not len(found):
        return None
    order = sorted(zip(found["key"].to_pylist(), found["lang"].to_pylist(), found["bits"].to_pylist()))
    bits = np.unpackbits(np.frombuffer(b"".join(b for _, _, b in order), dtype=np.uint8)).reshape(len(order), FEATURES)
    return Model(bits.astype(np.float32), [x for _, x, _ in order])


def predict(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` without the text and with lang_pred and score.  A narrow step."""
    names = [c for c in df.columns if c not in (text, "lang_pred", "score")]
    schema = df.select(*[F.col(f"`{c}`") for c in names], F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = np.array(batch.column(1).to_pylist(), dtype=bool)
            best = np.zeros(len(batch), dtype=np.int64)
            score = np.zeros(len(batch))
            if model is not None:
                k = 0
                for bits in _blocks(batch.column(0)):
                    s = model.scores(bits)
                    best[k : k + len(s)], score[k : k + len(s)] = s.argmax(axis=1), s.max(axis=1).clip(0, 1)
                    k += len(s)
            known = letters & (model is not None)
            langs = [model.langs[b] if g else "und" for b, g in zip(best.tolist(), known.tolist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(2 + i) for i in range(len(names))], pa.array(langs), pa.array(np.where(known, score, 0.0))], names=schema.names)

    letter = F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False))
    kept = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]
    return arrow_map(df.select(F.col(f"`{text}`").cast("binary").alias("t"), letter.alias("letter"), *kept), run, schema)


def held_out(key: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    return predict(docs.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "text"), model)
