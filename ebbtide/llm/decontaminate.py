"""Documents that contain benchmark items, found by SimHashes of item-sized windows.

Items and windows are compared by their five-word shingles, counted as often as
they occur: the sum of the smaller counts over the sum of the larger. A window
has as many words as the item; a text that is shorter is one window. Of all
windows of a text the best one begins with a shingle of the item or ends with
the text, so these are looked at, and those that put a shared shingle in its
place in the item; a window with too few shared places to reach the similarity
is left out. The candidates of a window are the items whose SimHash is within
the radius of its own, of which blocks of bits find all; the exact similarity
verifies them. ``exact`` takes every item that shares enough places with the
window instead, and so finds what trying all windows finds.

The benchmark is read in groups of items of bounded size, each broadcast by
itself, so that its size doesn't matter.

Cases: words are lower-cased runs of letters and digits; an item of 1 to 4
words is one shingle of them all, and one without words or text is never found;
ids of items may have any type; a null or empty text holds none; every row is judged by itself, so repeated
rows get equal results; of equally good windows the first one looked at counts.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ebbtide.llm.batches import Words, filter_text, mix, pieces, shingles


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    similarity: float = 0.8
    radius: int = 19  # of 64 bits; at the similarity windows differ from items in ten bits on average
    exact: bool = False  # verify windows whatever their fingerprint
    items_at_once: int = 20_000
    bytes_at_once: int = 32 << 20  # of item texts in a broadcast; a longer item goes alone


def fingerprint(h: np.ndarray) -> np.uint64:
    """SimHash of shingle hashes: each bit is what most of them have."""
    bits = np.unpackbits(mix(h).view(np.uint8).reshape(len(h), 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(bits * 2 > len(h)).view(np.uint64)[0]


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Sum of the smaller counts over the sum of the larger."""
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    shared = int(np.minimum(n[i], m[j]).sum())
    return shared / (len(a) + len(b) - shared)


class Index:
    """Items by their shingles, and their fingerprints by blocks of bits."""

    def __init__(self, item_ids: list, texts: list[str], settings: Settings):
        self.settings = settings
        words = Words(pa.array(texts, pa.string()))
        h, offsets, _ = shingles(words, settings.shingle)
        size = np.diff(words.offsets)
        some = [i for i in range(len(texts)) if size[i]]
        self.ids = [item_ids[i] for i in some]
        self.words = size[some]
        self.shingles = [h[offsets[i] : offsets[i + 1]] for i in some]
        # (shingle, length) -> the items that have it, and where; short items have shorter shingles
        self.width = np.minimum(self.words, settings.shingle)
        own = np.concatenate(self.shingles) if some else np.zeros(0, np.uint64)
        item = np.repeat(np.arange(len(some)), [len(s) for s in self.shingles])
        offset = np.concatenate([np.arange(len(s)) for s in self.shingles]) if some else np.zeros(0, np.int64)
        self.tables = {}
        for k in np.unique(self.width):
            these = self.width[item] == k
            order = np.argsort(own[these], kind="stable")
            self.tables[int(k)] = (own[these][order], item[these][order], offset[these][order])

    @cached_property
    def prints(self) -> np.ndarray:
        return np.array([fingerprint(s) for s in self.shingles], np.uint64)

    @cached_property
    def blocks(self) -> list[tuple[np.uint64, np.uint64]]:
        edges = np.linspace(0, 64, self.settings.radius + 2).astype(int)
        return [(np.uint64(a), np.uint64((1 << int(b - a)) - 1)) for a, b in zip(edges, edges[1:])]

    @cached_property
    def index(self) -> dict[tuple[int, int], np.ndarray]:
        out: dict[tuple[int, int], np.ndarray] = {}
        for n, (shift, mask) in enumerate(self.blocks):
            part = (self.prints >> shift) & mask
            for value in np.unique(part):
                out[n, int(value)] = np.flatnonzero(part == value)
        return out

    def within(self, print_: np.uint64) -> np.ndarray:
        """All items whose fingerprint is within the radius."""
        near = [self.index.get((n, int((print_ >> shift) & mask))) for n, (shift, mask) in enumerate(self.blocks)]
        near = [x for x in near if x is not None]
        if not near:
            return np.zeros(0, np.int64)
        found = np.unique(np.concatenate(near))
        return found[np.bitwise_count(self.prints[found] ^ print_) <= self.settings.radius]

    def search(self, column: pa.Array) -> list[tuple]:
        """(row, item, first word, words, similarity): each item's best window in each text, the first of equals."""
        words = Words(column)
        found: dict[tuple[int, int], tuple[float, int, int]] = {}
        near: dict[tuple[int, int, int], np.ndarray] = {}
        for k, (known, items, offsets) in self.tables.items():
            h, bounds, first = shingles(words, k)
            if not len(h):
                continue
            place = np.searchsorted(known, h)
            hit = np.flatnonzero(known[np.minimum(place, len(known) - 1)] == h)
            if not len(hit):
                continue
            row = np.searchsorted(bounds, hit, "right") - 1
            low, high = np.searchsorted(known, h[hit]), np.searchsorted(known, h[hit], "right")
            each = np.repeat(np.arange(len(hit)), high - low)
            entry = np.repeat(low, high - low) + np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
            row, item = row[each], items[entry]
            place = first[hit][each] - words.offsets[row]
            length = words.offsets[row + 1] - words.offsets[row]
            # the part of the key that names row and item, and the last start of a window
            pair = (row * len(self.ids) + item) * (int(length.max()) + 1)
            last = length - np.minimum(self.words[item], length)
            starts, at = np.unique(np.concatenate([pair + np.clip(x, 0, last) for x in (place, place - offsets[entry])]), return_index=True)
            at %= len(pair)
            n = np.minimum(self.words[item], length)[at]
            size, whole = np.maximum(n - k + 1, 1), np.maximum(self.words[item[at]] - k + 1, 1)
            hits = np.unique(pair + place)
            most = np.minimum(np.searchsorted(hits, starts + size) - np.searchsorted(hits, starts), whole)
            bound = most / (size + whole - most)
            likely = np.flatnonzero(bound >= self.settings.similarity)
            # the best bounds first: others needn't be looked at once they can't be better
            likely = likely[np.lexsort((starts[likely], -bound[likely]))]
            for x in likely.tolist():
                r, i = int(row[at[x]]), int(item[at[x]])
                best, where = found.get((r, i), (0.0, 0, 0))[:2]
                if bound[x] < best:
                    continue
                s = int(starts[x] - pair[at[x]])
                begin = bounds[r] + s
                window = (r, s, int(n[x]))
                if not self.settings.exact:
                    if window not in near:
                        near[window] = self.within(fingerprint(h[begin : begin + size[x]]))
                    if i not in near[window]:
                        continue
                score = weighted_similarity(h[begin : begin + size[x]], self.shingles[i])
                if score >= self.settings.similarity and (score > best or score == best and s < where):
                    found[r, i] = (score, s, int(n[x]))
        return [(r, self.ids[i], s, n, score) for (r, i), (score, s, n) in sorted(found.items())]


def _groups(benchmark: DataFrame, item_id: str, text: str, settings: Settings):
    """The benchmark's items in groups of bounded size."""
    items = benchmark.select(benchmark[item_id].alias("item_id"), benchmark[text].alias("text")).where(F.col("text").isNotNull())
    count, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(1, math.ceil(count / settings.items_at_once), math.ceil(size / settings.bytes_at_once))
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else items
        yield [(r["item_id"], r["text"]) for r in own.distinct().orderBy("item_id", "text").collect()]


_indexes: dict = {}


def _setup(docs: DataFrame, items: list[tuple], settings: Settings):
    """A function that gives a worker the index of some items, built once."""
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def index() -> Index:
        if name not in _indexes:
            _indexes.clear()
            _indexes[name] = Index([i for i, _ in shared.value], [t for _, t in shared.value], settings)
        return _indexes[name]

    return index


def find(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id") -> DataFrame:
    """doc_id, item_id, first_word, n_words and similarity of every item found in a document, its best window."""
    taken = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"))
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("item_id", benchmark.schema[item_id].dataType),
            T.StructField("first_word", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("similarity", T.DoubleType()),
        ]
    )
    ids = to_arrow_type(schema["item_id"].dataType)
    out = None
    for group in _groups(benchmark, item_id, "text", settings):

        def run(batches, index_of=_setup(docs, group, settings)):
            index = index_of()
            for batch in batches:
                for piece in pieces(batch, "text"):
                    got = index.search(piece.column("text"))
                    if got:
                        row, item, start, n, score = zip(*got)
                        yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(pa.array(row)), pa.array(item, ids), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(score)], names=schema.names)

        found = taken.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), text: str = "text", item_id: str = "item_id") -> DataFrame:
    """The rows of ``docs``, as they are, in which no item is found."""

    def mask(piece, index):
        keep = np.ones(len(piece), bool)
        keep[[r for r, *_ in index.search(piece.column("text"))]] = False
        return keep

    for group in _groups(benchmark, item_id, "text", settings):
        docs = filter_text(docs, text, mask, _setup(docs, group, settings))
    return docs
