"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of hashed n-grams (one to three characters, within words) are counted over all labelled training
rows; they fill a vector of DIM numbers whatever the corpus. The model is fitted on a sample of at most about FIT_ROWS
labelled rows, the same share of quota for each language, with follow-the-regularised-leader updates and elastic-net
penalties, and a temperature is chosen on a fifth of the sample that the fit leaves out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces

#: Hashed n-grams.
DIM = 1 << 15
#: Most labelled rows that the model is fitted on, about; statistics use all rows.
FIT_ROWS = 6000
#: Of follow-the-regularised-leader: step, smoothing, L1 and L2 penalties.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.001
EPOCHS = 4
UNKNOWN = "und"

_LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text and how often each occurs; none if it has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _LETTER[np.minimum(code, 0xFFFF)]
    for i in np.flatnonzero(code > 0xFFFF):
        letter[i] = chr(code[i]).isalpha()
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.where(letter, code, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space after each word
    c = np.concatenate(([32], code[keep], [32])).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ c[1:]) * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ c[2:]) * np.uint32(0xC2B2AE3D)
    found = np.bincount(np.concatenate((one, two, three)) >> np.uint32(17), minlength=DIM)
    at = np.flatnonzero(found)
    return at, found[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, DIM)))
    temperature: float = 1.0

    def vector(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        x = np.log1p(n) * self.idf[at]
        return x / (math.sqrt(float(x @ x)) or 1.0)

    def probabilities(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = self.weights[:, at] @ self.vector(at, n) / self.temperature
        p = np.exp(z - z.max())
        return p / p.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        at, n = counts(text)
        if not len(at) or not self.languages:
            return UNKNOWN, 0.0
        p = self.probabilities(at, n)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def train(model: Model, rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """Fit on (index of the language, n-grams, counts) rows, in this order, every fifth left out for the temperature.
    Vectors are made when they are needed, so that the rows are held in their small form only."""
    k = len(model.languages)
    z, n, w = np.zeros((k, DIM)), np.zeros((k, DIM)), np.zeros((k, DIM))
    data = [r for r in rows if len(r[1])]
    fit, rest = [x for i, x in enumerate(data) if i % 5], data[::5]
    for _ in range(EPOCHS):
        for y, at, c in fit:
            at = at.astype(np.int64)
            x = model.vector(at, c)
            own = w[:, at]
            s = own @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = p[:, None] * x[None, :]
            before = n[:, at]
            after = before + g * g
            new_z = z[:, at] + g - (np.sqrt(after) - np.sqrt(before)) / ALPHA * own
            z[:, at], n[:, at] = new_z, after
            w[:, at] = np.where(np.abs(new_z) <= L1, 0.0, -(new_z - np.sign(new_z) * L1) / ((BETA + np.sqrt(after)) / ALPHA + L2))
    model.weights = w
    scores = [(y, w[:, at.astype(np.int64)] @ model.vector(at, c)) for y, at, c in rest or data]
    if scores:
        ys, s = np.array([y for y, _ in scores]), np.array([s for _, s in scores])

        def loss(t: float) -> float:
            v = s / t
            v = v - v.max(axis=1, keepdims=True)
            return float((np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(ys)), ys]).mean())

        model.temperature = min((2.0 ** (e / 4) for e in range(-24, 13)), key=loss)
    return model


def _features(df: DataFrame) -> DataFrame:
    """(lang, n-grams, counts) as bytes, from (lang, text)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in pieces(whole)):
            found = [counts(t) for t in b.column(1).to_pylist()]
            at = [a.astype(np.uint16).tobytes() for a, _ in found]
            n = [c.astype(np.uint32).tobytes() for _, c in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["lang", "place", "at", "n"])

    return df.mapInArrow(work, "lang string, place long, at binary, n binary")


def _document_frequencies(texts: DataFrame) -> dict[int, int]:
    """How many texts hold each n-gram; at -1 the number of texts. DIM + 1 rows at most come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, total = np.zeros(DIM, np.int64), 0
        for b in (piece for whole in batches for piece in pieces(whole)):
            for t in b.column(0).to_pylist():
                df[counts(t)[0]] += 1
            total += b.num_rows
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], total))], ["at", "n"])

    summed = texts.mapInArrow(work, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return {r["at"]: r["n"] for r in summed.collect()}


def fit(labelled: DataFrame, rows: int = FIT_ROWS, key: str = "doc_id") -> Model:
    """A model of (``key``, text, lang) rows whose lang is not null. Rows are sampled by a hash of ``key``."""
    known = labelled.filter("lang IS NOT NULL").select(F.xxhash64(F.col(key)).alias("place"), "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row for each language
    df = _document_frequencies(known.select("text"))
    total = df.pop(-1, 0)
    idf = np.full(DIM, math.log(1 + total))
    for at, n in df.items():
        idf[at] = math.log((1 + total) / (1 + n)) + 1
    model = Model(sorted(sizes), idf)
    if not sizes:
        return model
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, min(1.0, rows / len(sizes) / n)).otherwise(share)
    near = known.filter(F.abs(F.col("place") % 1_000_003) / 1_000_003.0 < share)
    index = {x: i for i, x in enumerate(model.languages)}
    got = _features(near.select("lang", "text", "place")).toArrow()
    small = sorted(zip(got["place"].to_pylist(), got["lang"].to_pylist(), got["at"].to_pylist(), got["n"].to_pylist(), strict=True))
    del got
    return train(model, [(index[lang], np.frombuffer(at, np.uint16), np.frombuffer(n, np.uint32)) for _, lang, at, n in small])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (calibrated probability) added; columns of these names are replaced.
    Only the text is used. A text that is null or has no letter is ``und`` with score 0."""
    base = docs.drop("lang_pred", "score")
    names = base.columns
    inner = base.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text_col)
    schema = ", ".join(f"{c} {t}" for c, t in inner.dtypes) + ", lang_pred string, score double"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (piece for whole in batches for piece in pieces(whole)):
            found = [model.predict(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], [*b.schema.names, "lang_pred", "score"])

    return inner.mapInArrow(work, schema).toDF(*names, "lang_pred", "score")


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the key as text leaves ``fold`` modulo ``folds``; false for null."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of (doc_id, text, lang): the model learns from rows that are
    not held out. Repeated rows stay; without any labelled row all are ``und``."""
    base = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = fit(base.filter(~F.col("held_out")))
    small = base.select("doc_id", "held_out", "text")
    return predict(small, model).select("doc_id", "held_out", "lang_pred", "score")
