"""Text quality by nearest-neighbour voting in a latent semantic space.

Texts become hashed counts of byte pairs and triples and counts of words that
repeat the word before, damped, weighted by their rarity and projected on the leading singular vectors of a labelled sample. The
labelled vectors are broadcast (their number and width are parameters); every
document is compared with all of them by blocked matrix products, and its
nearest neighbours vote with their labels, weighted by a power of the cosine.

Cases: labels that are null count as absent; a document with several labels
takes their mean, 0.5 and above as 1; a null or empty text, or one shorter than
two bytes, has no direction and gets the sample's share of label 1; without any
label the score is 0.5. Every input row gives one row; ties at the last
neighbour are resolved by the order of the sample. Long texts are counted whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.llm.batches import Words, bucket, filter_text, map_text, ngram_codes, utf8
from ebbtide.llm.sampling import bounded, thinned


@dataclass(frozen=True)
class Settings:
    bits: int = 11  # 2**bits slots of n-grams
    latent: int = 48
    per_label: int = 1500  # labelled documents of each label that are kept as neighbours
    neighbours: int = 15
    power: float = 12.0
    good_weight: float = 2.0  # votes of label 1, which is commoner than in the sample, count so much more
    repeat_weight: float = 2.0
    seed: int = 7


REPEAT_SLOTS = 4


def counts(column: pa.Array, bits: int) -> np.ndarray:
    """Damped counts, a row for each text, scaled to the text's length: n-grams, then words that repeat the word before."""
    data, offsets = utf8(column)
    rows, width = len(offsets) - 1, 1 << bits
    total = np.zeros(rows * width)
    for n in (2, 3):
        code, row = ngram_codes(data, offsets, n)
        total += np.bincount(row.astype(np.int64) * width + bucket(code, n, bits), minlength=rows * width)
    total = total.reshape(rows, width)
    length = np.maximum(np.diff(offsets), 1)[:, None]
    words = Words(column)
    number = np.diff(words.offsets)
    again = np.zeros(len(words.hash))
    again[1:] = words.hash[1:] == words.hash[:-1]
    again[words.offsets[:-1][number > 0]] = 0
    row = np.repeat(np.arange(rows), number)
    # one repeat is chance in a short text
    repeats = np.maximum(np.bincount(row, again, minlength=rows) - 1, 0) * 1000.0 / np.maximum(number, 60)
    # several slots give the repeats the weight of as many n-grams
    total = np.concatenate([total * (1000.0 / length), np.repeat(repeats[:, None], REPEAT_SLOTS, axis=1) ** 2], axis=1)
    return np.log1p(total).astype(np.float32)


@dataclass(frozen=True)
class Model:
    settings: Settings
    weight: np.ndarray  # rarity of each slot
    basis: np.ndarray  # slots x latent
    vectors: np.ndarray  # labelled unit vectors
    labels: np.ndarray
    share: float

    def project(self, rows: np.ndarray) -> np.ndarray:
        latent = (rows * self.weight) @ self.basis
        size = np.linalg.norm(latent, axis=1, keepdims=True)
        return np.where(size > 1e-9, latent / np.maximum(size, 1e-9), 0).astype(np.float32)

    def score(self, column: pa.Array) -> np.ndarray:
        if not len(self.vectors):
            return np.full(len(column), self.share)
        made = np.empty(len(column))
        for begin in range(0, len(column), 256):
            own = self.project(counts(column.slice(begin, 256), self.settings.bits))
            cosine = own @ self.vectors.T
            k = min(self.settings.neighbours, cosine.shape[1])
            near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
            pull = np.maximum(np.take_along_axis(cosine, near, 1).astype(float), 0) ** self.settings.power
            pull *= np.where(self.labels[near] > 0.5, self.settings.good_weight, 1.0)
            total = pull.sum(axis=1)
            vote = (pull * self.labels[near]).sum(axis=1)
            made[begin : begin + 256] = np.where(total > 0, vote / np.where(total > 0, total, 1), self.share)
        return np.clip(made, 0, 1)


def leading_vectors(x: np.ndarray, latent: int, seed: int) -> np.ndarray:
    """Right singular vectors of x by subspace iteration."""
    latent = min(latent, *x.shape)
    turn = np.random.default_rng(seed).standard_normal((x.shape[1], min(latent + 16, *x.shape))).astype(np.float32)
    for _ in range(6):
        turn = np.linalg.qr(x.T @ (x @ turn))[0]
    small = x @ turn
    return turn @ np.linalg.svd(small, full_matrices=False)[2].T[:, :latent]


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """``docs`` are the rows to learn from; ``labels`` holds doc_id and a label of 0 or 1."""
    known = (
        labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(doc_id).alias("_id"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    )
    both = docs.select(docs[doc_id].alias("_id"), docs[text].alias("text"))
    # choose by ids first; texts are read for the sample alone
    most = 4 * settings.per_label
    ids = bounded(thinned(known.join(both.select("_id"), "_id", "left_semi"), "_label", settings.per_label, 2, ["_id"]), most)
    rows = both.join(F.broadcast(ids.drop("_spot")), "_id")  # at most `most` rows
    packed = map_text(rows, ["_id", "_label"], "text", [T.StructField("counts", T.BinaryType())], lambda piece: [[r.tobytes() for r in counts(piece.column("text"), settings.bits)]])
    got = packed.orderBy(F.xxhash64("_id", "counts")).limit(most).collect()
    if not got:
        return Model(settings, np.ones((1 << settings.bits) + REPEAT_SLOTS, np.float32), np.zeros(((1 << settings.bits) + REPEAT_SLOTS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    x = np.stack([np.frombuffer(r["counts"], np.float32) for r in got])
    y = np.array([r["_label"] for r in got], float)
    weight = np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))).astype(np.float32) + np.float32(0.1)
    weight[-REPEAT_SLOTS:] = settings.repeat_weight
    unit = x * weight
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    basis = leading_vectors(unit, settings.latent, settings.seed).astype(np.float32)
    bare = Model(settings, weight, basis, np.zeros((0, 1), np.float32), y, float(y.mean()))
    vectors = bare.project(x)
    some = np.linalg.norm(vectors, axis=1) > 0
    return Model(settings, weight, basis, vectors[some], y[some], float(y.mean()))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", column: str = "score") -> DataFrame:
    """``keep`` columns and the score: the weighted share of label 1 among the nearest labelled texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_text(docs, keep, text, [T.StructField(column, T.DoubleType())], lambda piece, m: [m.score(piece.column("text"))], lambda: shared.value)


def accepted(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, as they are, that score ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return filter_text(docs, text, lambda piece, m: m.score(piece.column("text")) >= least, lambda: shared.value)
