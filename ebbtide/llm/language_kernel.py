"""Language identification with a string kernel.

The blended-spectrum presence kernel counts the byte n-grams of 1 to 4 bytes
that two lower-cased texts share, normalised to 1 for equal sets. Landmark texts
give its Nyström features; one ridge regression for each language separates it
from the rest. A batch is scored by two matrix products: kernel values against
the landmarks, then the languages' coefficients.

Cases: `und` with score 0 for a null text or one without any letter, and
wherever nothing was learned; a null language is not learned from; every row
gives one row; a tie goes to the language first in alphabetical order. Texts
are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.llm.batches import bucket, map_text, ngram_codes, utf8
from ebbtide.llm.sampling import bounded, thinned

UNKNOWN = "und"


@dataclass(frozen=True)
class Settings:
    bits: int = 14
    longest: int = 4
    per_language: int = 400  # training texts of each language
    languages: int = 200  # commonest languages that are learned
    landmarks: int = 256
    ridge: float = 1e-3
    sharpness: float = 6.0
    seed: int = 5


def packed(column: pa.Array, settings: Settings) -> np.ndarray:
    """Which n-grams each text has, as packed bits."""
    return np.concatenate([np.packbits(presence(column.slice(i, 128), settings) > 0, axis=1) for i in range(0, len(column), 128)])


def presence(column: pa.Array, settings: Settings) -> np.ndarray:
    """Which n-grams each text has, scaled so that a row's product with itself is 1."""
    data, offsets = utf8(pc.utf8_lower(column))
    rows, width = len(offsets) - 1, 1 << settings.bits
    has = np.zeros(rows * width, np.float32)
    for n in range(1, settings.longest + 1):
        code, row = ngram_codes(data, offsets, n)
        has[row.astype(np.int64) * width + bucket(code, n, settings.bits)] = 1
    has = has.reshape(rows, width)
    return has / np.maximum(np.sqrt(has.sum(axis=1, keepdims=True)), 1)


@dataclass(frozen=True)
class Model:
    settings: Settings
    languages: list[str]
    landmarks: np.ndarray  # landmarks x slots
    coefficients: np.ndarray  # landmarks x languages
    intercept: np.ndarray

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.languages:
            return [UNKNOWN] * len(column), np.zeros(len(column))
        lettered = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
        best, sure = np.zeros(len(column), int), np.zeros(len(column))
        for begin in range(0, len(column), 128):
            values = presence(column.slice(begin, 128), self.settings) @ self.landmarks.T @ self.coefficients + self.intercept
            part = np.exp(self.settings.sharpness * (values - values.max(axis=1, keepdims=True)))
            best[begin : begin + 128] = values.argmax(axis=1)
            sure[begin : begin + 128] = 1 / part.sum(axis=1)
        names = np.array([*self.languages, UNKNOWN], object)
        return names[np.where(lettered, best, len(self.languages))].tolist(), np.where(lettered, sure, 0.0)


def fit(docs: DataFrame, settings: Settings = Settings(), text: str = "text", lang: str = "lang") -> Model:
    rows = docs.select(docs[text].alias("text"), docs[lang].alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sample = thinned(rows, "lang", settings.per_language, settings.languages, ["text"])
    bits = map_text(sample, ["lang", "_spot"], "text", [T.StructField("bits", T.BinaryType())], lambda piece: [[r.tobytes() for r in packed(piece.column("text"), settings)]])
    got = sorted((r["lang"], r["bits"]) for r in bounded(bits, 2 * settings.per_language * settings.languages).collect())
    if not got:
        return Model(settings, [], np.zeros((0, 1)), np.zeros((0, 0)), np.zeros(0))
    names = sorted({r[0] for r in got})
    truth = np.array([names.index(r[0]) for r in got])
    x = np.unpackbits(np.stack([np.frombuffer(r[1], np.uint8) for r in got]), axis=1).astype(np.float32)
    x /= np.maximum(np.sqrt(x.sum(axis=1, keepdims=True)), 1)
    # landmarks in turn from every language
    turn = np.random.default_rng(settings.seed).permutation(len(x))
    nth = np.zeros(len(x), int)
    for k in range(len(names)):
        own = turn[truth[turn] == k]
        nth[own] = np.arange(len(own))
    chosen = np.lexsort((truth, nth))[: settings.landmarks]
    landmarks = x[chosen]
    values, vectors = np.linalg.eigh((landmarks @ landmarks.T).astype(float))
    usable = values > 1e-6 * values.max()
    whiten = vectors[:, usable] / np.sqrt(values[usable])
    features = (x @ landmarks.T) @ whiten
    want = np.where(truth[:, None] == np.arange(len(names)), 1.0, -1.0)
    # every language weighs the same, however many texts it has
    weight = (1.0 / np.bincount(truth)[truth])[:, None]
    mean = (features * weight).sum(axis=0) / weight.sum()
    base = (want * weight).sum(axis=0) / weight.sum()
    centred = features - mean
    solved = np.linalg.solve(centred.T @ (centred * weight) + settings.ridge * np.eye(centred.shape[1]), centred.T @ ((want - base) * weight))
    return Model(settings, names, landmarks, (whiten @ solved).astype(np.float32), (base - mean @ solved).astype(np.float32))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``lang_pred`` and ``score``, the softmax share of the language's value."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return map_text(docs, keep, text, fields, lambda piece, m: m.predict(piece.column("text")), lambda: shared.value)
