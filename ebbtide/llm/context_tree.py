"""Language-model scores by context-tree weighting over bytes.

The next byte is eight binary decisions, each with its own context tree over the
bytes before. Every node of a tree keeps the Krichevsky-Trofimov estimate of its
counts; its weighted probability is half that estimate and half the product of
its children's, down to a fixed depth. A text's probability is that of the
trees learned from the training texts, which mixes the estimates of all depths.
Texts start after ``depth`` zero bytes and end with a zero byte.

Texts are dealt to blocks of bounded size. Each block lists its different
n-grams and words once, with their counts in training texts; counts are summed
over the corpus; n-grams are scored in groups of their last two context bytes,
and each block gets the scores of its own n-grams and words back. Nothing whose
size grows with the corpus is collected or broadcast.

Beside it stands the unigram score of words with half a count added to each.

Cases: A-Z are lower-cased; a null text counts as empty and has one token, its
end; without training texts every decision has probability one half; every row
gives one row; rows with a null id belong to the training texts; texts of any
length are read whole, a text larger than a block makes a larger block.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.llm.batches import pieces, span_hash, utf8
from ebbtide.session import stage

DEPTH = 4
GRAM, WORD = 0, 1
PIECE = 1 << 21  # text bytes whose n-grams are counted at once
END_WORD = np.int64(-1)


@dataclass(frozen=True)
class Settings:
    block_bytes: int = 12 << 20


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


class Texts:
    """n-gram codes and word hashes of a piece of the text column."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        data = _LOWER[data]
        self.length = np.diff(offsets)
        # each text between DEPTH zero bytes and one zero byte
        step = DEPTH + 1
        rows = len(self.length)
        padded = np.zeros(len(data) + rows * step, np.uint8)
        inside = np.arange(len(data)) + np.repeat(np.arange(rows) * step + DEPTH, self.length)
        padded[inside] = data
        begins = offsets[:-1] + np.arange(rows) * step + DEPTH
        self.grams = self.length + 1
        first = np.cumsum(self.grams) - self.grams
        at = np.arange(int(self.grams.sum())) + np.repeat(begins - first, self.grams)
        code = np.zeros(len(padded), np.uint64)
        for k in range(DEPTH, -1, -1):
            code[DEPTH:] = (code[DEPTH:] << np.uint64(8)) | padded[DEPTH - k : len(padded) - k]
        self.codes = code[at].view(np.int64)
        self.gram_start = first
        solid = ~_SPACE[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = False
        edge[offsets] = True
        before, after = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        before[1:], after[:-1] = solid, solid
        start = np.flatnonzero(after & (~before | edge))
        stop = np.flatnonzero(before & (~after | edge))
        self.words = span_hash(data, start, stop).view(np.int64)
        self.words[self.words == END_WORD] = 0
        self.word_offsets = np.searchsorted(start, offsets)
        self.word_offsets[-1] = len(start)


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Different values and the sums of their counts."""
    values, counts = np.concatenate([v for v, _ in parts]), np.concatenate([c for _, c in parts])
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    at = np.flatnonzero(new)
    return values[at], np.add.reduceat(counts, at) if len(at) else counts


def _uses(values: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different values, and how often each is among the training ones."""
    every = np.unique(values)
    own, n = np.unique(values[train], return_counts=True)
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, own)] = n
    return every, counts


def block_counts(table: pa.Table) -> tuple[tuple, tuple]:
    """Different n-grams and words of a block, each with their counts in training texts."""
    batch = table.combine_chunks().to_batches()[0]
    grams, words, ends = [], [], 0
    for piece in pieces(batch, "text", PIECE):
        texts = Texts(piece.column("text"))
        train = piece.column("train").to_numpy(zero_copy_only=False)
        grams.append(_uses(texts.codes, np.repeat(train, texts.grams)))
        words.append(_uses(texts.words, np.repeat(train, np.diff(texts.word_offsets))))
        ends += int(train.sum())
    words.append((np.array([END_WORD]), np.array([ends])))
    return _counted(grams), _counted(words)


class Lookup:
    """Values of 64-bit keys by open addressing, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(4, int(len(keys) * 3).bit_length()))
        self.mask = np.uint64((1 << (64 - int(self.shift))) - 1)
        self.table = np.full(int(self.mask) + 1, -1, np.int32)
        rest, step = np.arange(len(keys), dtype=np.int32), 0
        while len(rest):
            slot = self._slot(keys[rest], step)
            free = self.table[slot] < 0
            self.table[slot[free]] = rest[free]
            rest = rest[self.table[slot] != rest]
            step += 1

    def _slot(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift) + np.uint64(step) & self.mask

    def places(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; every key must be there."""
        found = self.table[self._slot(keys, 0)]
        rest, step = np.flatnonzero(self.keys[found] != keys), 1
        while len(rest):
            found[rest] = self.table[self._slot(keys[rest], step)]
            rest = rest[self.keys[found[rest]] != keys[rest]]
            step += 1
        return found


# ---- context trees ----

_SMALL = 4096
_LGAMMA_HALF = np.array([math.lgamma(i + 0.5) for i in range(_SMALL)])
_LGAMMA_ONE = np.array([math.lgamma(i + 1.0) for i in range(_SMALL)])


def _lgamma(n: np.ndarray, plus: float, table: np.ndarray) -> np.ndarray:
    """log gamma of n + plus: from a table for small n, else by Stirling's series."""
    x = np.maximum(n, _SMALL - 1) + plus
    large = (x - 0.5) * np.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(n < _SMALL, table[np.minimum(n, _SMALL - 1)], large)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _lgamma(zeros, 0.5, _LGAMMA_HALF) + _lgamma(ones, 0.5, _LGAMMA_HALF) - _lgamma(zeros + ones, 1.0, _LGAMMA_ONE) - math.log(math.pi)


def log_weighted(kt: np.ndarray, children: np.ndarray) -> np.ndarray:
    return math.log(0.5) + np.logaddexp(kt, children)


class Level:
    """Nodes of one depth: sorted keys (context << 8 | decision), counts, log estimate and log weighted probability."""

    def __init__(self, keys, zeros, ones, children=None):
        self.keys, self.zeros, self.ones = keys, zeros, ones
        self.kt = log_kt(zeros, ones)
        self.weighted = self.kt if children is None else log_weighted(self.kt, children)

    def parent(self, depth: int) -> "Level":
        """The level above, at ``depth``."""
        keys = self.keys & np.int64((1 << (8 * depth + 8)) - 1)
        order = np.argsort(keys, kind="stable")
        at = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, np.int64)
        total = lambda x: np.add.reduceat(x[order], at) if len(at) else x
        return Level(keys[order][at], total(self.zeros), total(self.ones), total(self.weighted))

    def own_share(self) -> np.ndarray:
        """The weight of a node's own estimate against its children's."""
        return np.exp(math.log(0.5) + self.kt - self.weighted)

    def one(self) -> np.ndarray:
        return (self.ones + 0.5) / (self.zeros + self.ones + 1.0)


def leaves(codes: np.ndarray, counts: np.ndarray) -> Level:
    """The deepest level from n-gram counts."""
    keys, bits = [], []
    byte = codes & 255
    for k in range(8):
        keys.append((codes >> 8) << 8 | (1 << k) | (byte >> (8 - k)))
        bits.append((byte >> (7 - k)) & 1)
    keys, bits, n = np.concatenate(keys), np.concatenate(bits), np.tile(counts, 8)
    order = np.argsort(keys, kind="stable")
    keys, bits, n = keys[order], bits[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    if not len(at):
        return Level(keys, n, n)
    return Level(keys[at], np.add.reduceat(n * (1 - bits), at), np.add.reduceat(n * bits, at))


def subtree(codes: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Levels of depth 2 to DEPTH, of n-grams seen in training."""
    seen = counts > 0
    levels = [leaves(codes[seen], counts[seen])]
    for depth in range(DEPTH - 1, 1, -1):
        levels.insert(0, levels[0].parent(depth))
    return levels


def upper_levels(last: np.ndarray, decision: np.ndarray, zeros: np.ndarray, ones: np.ndarray, weighted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each last byte and decision: the probability of a 1 from depths 0 and 1, and the weight left for deeper ones.

    The arguments are sums over the nodes of depth 2.
    """
    n0, n1, below = np.zeros((256, 256), np.int64), np.zeros((256, 256), np.int64), np.zeros((256, 256))
    n0[last, decision], n1[last, decision], below[last, decision] = zeros, ones, weighted
    seen = n0 + n1 > 0
    kt1 = log_kt(n0, n1)
    weighted1 = np.where(seen, log_weighted(kt1, below), 0.0)
    root0, root1 = n0.sum(axis=0), n1.sum(axis=0)
    kt0 = log_kt(root0, root1)
    weighted0 = log_weighted(kt0, weighted1.sum(axis=0))
    share0 = np.where(root0 + root1 > 0, np.exp(math.log(0.5) + kt0 - weighted0), 0.0)
    one = np.broadcast_to(share0 * (root1 + 0.5) / (root0 + root1 + 1.0), (256, 256))
    left = np.broadcast_to(1 - share0, (256, 256))
    share1 = np.exp(math.log(0.5) + kt1 - np.where(seen, weighted1, 0.0))
    one = np.where(seen, one + left * share1 * (n1 + 0.5) / (n0 + n1 + 1.0), one + left * 0.5)
    return one, np.where(seen, left * (1 - share1), 0.0)


def gram_scores(codes: np.ndarray, levels: list[Level], upper: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each n-gram's last byte after the others."""
    total = np.zeros(len(codes))
    byte, last = codes & 255, (codes >> 8) & 255
    for k in range(8):
        decision = (1 << k) | (byte >> (8 - k))
        one, left = upper[0][last, decision].copy(), upper[1][last, decision].copy()
        for depth, level in enumerate(levels, 2):
            key = ((codes >> 8) & np.int64((1 << (8 * depth)) - 1)) << 8 | decision
            at = np.minimum(np.searchsorted(level.keys, key), max(len(level.keys) - 1, 0))
            seen = level.keys[at] == key if len(level.keys) else np.zeros(len(key), bool)
            at = np.where(seen, at, 0)
            if depth == DEPTH:
                share = np.ones(len(level.keys))
            else:
                share = level.own_share()
            mine = np.where(seen, share[at] if len(share) else 0.0, 1.0)
            one += left * mine * np.where(seen, level.one()[at] if len(share) else 0.5, 0.5)
            left *= 1 - mine
        one = np.clip(one, 1e-300, 1 - 1e-16)
        total += np.log10(np.where((byte >> (7 - k)) & 1, one, 1 - one))
    return total


# ---- Spark ----


def score(docs: DataFrame, is_training: Column, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every row of ``docs``."""
    rows = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"), F.coalesce(is_training, F.lit(True)).alias("train"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / settings.block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    listed = T.StructType([T.StructField("block", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])

    def count(table: pa.Table) -> pa.Table:
        (codes, n), (words, m) = block_counts(table)
        kind = np.repeat(np.array([GRAM, WORD], np.int32), [len(codes), len(words)])
        block = np.full(len(kind), table.column("block")[0].as_py())
        return pa.table({"block": block, "kind": kind, "key": np.concatenate([codes, words]), "n": np.concatenate([n, m])})

    uses = stage(rows.groupBy("block").applyInArrow(count, listed), "uses")
    totals = stage(uses.groupBy("kind", "key").agg(F.sum("n").alias("n")), "totals")
    tokens, vocabulary = totals.where(F.col("kind") == WORD).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") > 0)).first()

    grams = totals.where(F.col("kind") == GRAM).select("key", "n", F.shiftrightunsigned("key", 8).bitwiseAND(F.lit(0xFFFF)).alias("pair"))
    summary = T.StructType([T.StructField("last", T.IntegerType()), T.StructField("decision", T.IntegerType()), T.StructField("zeros", T.LongType()), T.StructField("ones", T.LongType()), T.StructField("weighted", T.DoubleType())])

    def summarise(table: pa.Table) -> pa.Table:
        top = subtree(table.column("key").to_numpy(), table.column("n").to_numpy())[0]
        return pa.table({"last": ((top.keys >> 8) & 255).astype(np.int32), "decision": (top.keys & 255).astype(np.int32), "zeros": top.zeros, "ones": top.ones, "weighted": top.weighted})

    # at most 256 last bytes and 255 decisions come to the driver
    top = grams.groupBy("pair").applyInArrow(summarise, summary).groupBy("last", "decision").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("weighted").alias("weighted")).orderBy("last", "decision").toArrow()
    upper = upper_levels(*[top.column(c).to_numpy() for c in ("last", "decision", "zeros", "ones", "weighted")])
    shared = docs.sparkSession.sparkContext.broadcast(upper)

    def value(table: pa.Table) -> pa.Table:
        codes = table.column("key").to_numpy()
        return pa.table({"key": codes, "value": gram_scores(codes, subtree(codes, table.column("n").to_numpy()), shared.value)})

    valued = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.DoubleType())])
    gram_values = grams.groupBy("pair").applyInArrow(value, valued).select(F.lit(GRAM).alias("kind"), "key", "value", F.lit(False).alias("known"))
    word_values = totals.where(F.col("kind") == WORD).select("kind", "key", F.log10((F.col("n") + 0.5) / F.lit(tokens + 0.5 * (vocabulary + 1))).alias("value"), (F.col("n") > 0).alias("known"))
    values = uses.select("block", "kind", "key").join(gram_values.unionByName(word_values), ["kind", "key"])

    out = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("held_out", T.BooleanType()),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
            T.StructField("bits_per_byte", T.DoubleType()),
        ]
    )

    def rate(own: pa.Table, known: pa.Table) -> pa.Table:
        if not len(own):
            return pa.Table.from_batches([], arrow_schema())
        kind, key, val = (known.column(c).to_numpy() for c in ("kind", "key", "value"))
        flag = known.column("known").to_numpy(zero_copy_only=False)
        is_gram = kind == GRAM
        gram_at, gram_value = Lookup(key[is_gram]), val[is_gram]
        word_keys = key[~is_gram]
        word_at, word_value, word_known = Lookup(word_keys), val[~is_gram], flag[~is_gram].astype(np.int64)
        end = int(word_at.places(np.array([END_WORD]))[0])
        made = []
        for piece in pieces(own.combine_chunks().to_batches()[0], "text", PIECE):
            texts = Texts(piece.column("text"))
            model = np.add.reduceat(gram_value[gram_at.places(texts.codes)], texts.gram_start)
            at = word_at.places(texts.words)
            known_before = np.concatenate([[0], np.cumsum(word_known[at])])
            n = np.diff(texts.word_offsets)
            # per text, not as a difference of running sums: those lose digits
            base = np.array([word_value[at[a:b]].sum() for a, b in zip(texts.word_offsets, texts.word_offsets[1:])])
            made.append(
                pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pc.invert(piece.column("train")),
                        pa.array(n + 1),
                        pa.array(np.diff(known_before[texts.word_offsets]) + word_known[end]),
                        pa.array(np.full(len(piece), tokens)),
                        pa.array(base + word_value[end]),
                        pa.array(model),
                        pa.array(-model / math.log10(2) / texts.grams),
                    ],
                    schema=arrow_schema(),
                )
            )
        return pa.Table.from_batches(made, arrow_schema())

    def arrow_schema() -> pa.Schema:
        from pyspark.sql.pandas.types import to_arrow_schema

        return to_arrow_schema(out)

    return rows.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(rate, out)
