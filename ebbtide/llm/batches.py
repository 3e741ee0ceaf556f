"""Arrow text columns as byte arrays, in pieces of bounded size.

Every function here runs inside tasks. A null text counts as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Text bytes handled at once; a longer text is handled alone.
PIECE_BYTES = 1 << 18


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the n + 1 offsets of its rows."""
    wide = column.type in (pa.large_string(), pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"", column.type))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts hold at most ``limit`` bytes together."""
    ends = utf8(batch.column(text))[1]
    start = 0
    while start < len(batch):
        stop = max(start + 1, int(np.searchsorted(ends, ends[start] + limit, "right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row of every byte (or word) below the given offsets."""
    return np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))


def ngram_codes(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes (uint32, n up to 4) of all byte n-grams that lie in one row, and their rows."""
    if len(data) < n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int32)
    row = rows_of(offsets)
    code = data[: len(data) - n + 1].astype(np.uint32)
    for k in range(1, n):
        code = (code << np.uint32(8)) | data[k : len(data) - n + 1 + k]
    inside = row[: len(row) - n + 1] == row[n - 1 :]
    return code[inside], row[: len(row) - n + 1][inside]


def bucket(code: np.ndarray, n: int, bits: int) -> np.ndarray:
    """n-gram codes dealt to 2**bits slots by multiplication."""
    mixed = (code + np.uint32(n * 0x9E3779B9 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
    mixed ^= mixed >> np.uint32(15)
    return (mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits)


WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[list(range(48, 58)) + list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed scramble of 64-bit values (the finalizer of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLY)


class Words:
    """Words of a text column: runs of ASCII letters and digits and of all other
    characters from U+0080 on; lower-cased, so that copies match in any case.

    ``start`` and ``stop`` are byte places in ``data``, ``hash`` the 64-bit
    hash of each word and ``offsets`` the words of each row.
    """

    def __init__(self, column: pa.Array):
        self.data, self.byte_offsets = utf8(pc.utf8_lower(column))
        byte_offsets = self.byte_offsets
        is_word = WORD_BYTE[self.data]
        edge = np.ones(len(self.data) + 1, bool)
        edge[1:-1] = False
        edge[byte_offsets] = True
        before = np.zeros(len(self.data) + 1, bool)
        before[1:] = is_word
        after = np.zeros(len(self.data) + 1, bool)
        after[:-1] = is_word
        self.start = np.flatnonzero(after & (~before | edge))
        self.stop = np.flatnonzero(before & (~after | edge))
        self.offsets = np.searchsorted(self.start, byte_offsets)
        self.offsets[-1] = len(self.start)
        self.hash = span_hash(self.data, self.start, self.stop)


_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the base of span_hash, and of its inverse mod 2**64; kept for the next piece."""
    if len(_powers[0]) < n:
        size = max(n, PIECE_BYTES + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            own = np.full(size, base)
            own[0] = 1
            _powers[i] = np.multiply.accumulate(own)
    return [p[:n] for p in _powers]


def span_hash(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span: differences of a running polynomial, moved to a common power."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_HASH[data] * up[:-1], out=running[1:])
    return mix((running[stop] - running[start]) * down[start] + (stop - start).astype(np.uint64) * _MULTIPLY)


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all runs of k words in one row, the rows' offsets, and each run's first word.

    A row of 1 to k - 1 words has one run, of all its words.
    """
    count = np.diff(words.offsets)
    number = np.where(count >= k, count - k + 1, (count > 0).astype(count.dtype))
    offsets = np.concatenate([[0], np.cumsum(number)])
    first = np.repeat(words.offsets[:-1], number) + np.arange(offsets[-1]) - np.repeat(offsets[:-1], number)
    size = np.repeat(np.minimum(count, k), number)
    h = np.zeros(len(first), np.uint64)
    for j in range(k):
        here = np.minimum(first + j, max(len(words.hash) - 1, 0))
        h = np.where(j < size, mix(h * np.uint64(3) + words.hash[here] + np.uint64(j)), h) if len(first) else h
    return h, offsets, first


def labelled(h: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Hashes made unique within a row by the number of earlier equal ones."""
    if not len(h):
        return h
    row = rows_of(offsets)
    order = np.lexsort((h, row))
    sorted_h, sorted_row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (sorted_h[1:] != sorted_h[:-1]) | (sorted_row[1:] != sorted_row[:-1])
    begin = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    nth = np.zeros(len(h), np.uint64)
    nth[order] = (np.arange(len(h)) - begin).astype(np.uint64)
    return np.where(nth > 0, mix(h + nth * _MULTIPLY), h)


def map_text(
    docs: DataFrame,
    keep: list[str],
    text: str,
    fields: list[T.StructField],
    work: Callable[[pa.RecordBatch], list],
    setup: Callable[[], object] | None = None,
    limit: int = PIECE_BYTES,
) -> DataFrame:
    """``keep`` columns and the new ``fields``; ``work`` gets pieces of the column named text.

    It returns one array a field. With ``setup``, work gets its value too.
    """
    names = [f"k{i}" for i in range(len(keep))]
    taken = docs.select(*[docs[c].alias(n) for c, n in zip(keep, names)], docs[text].alias("text"))
    schema = T.StructType([T.StructField(c, docs.schema[c].dataType) for c in keep] + fields)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        have = setup() if setup else None
        for batch in batches:
            for piece in pieces(batch, "text", limit):
                made = work(piece, have) if setup else work(piece)
                arrays = [piece.column(n).cast(out.field(i).type) for i, n in enumerate(names)]
                arrays += [a if isinstance(a, pa.Array) else pa.array(a, out.field(len(names) + i).type) for i, a in enumerate(made)]
                yield pa.RecordBatch.from_arrays(arrays, schema=out)

    return taken.mapInArrow(run, schema)


def filter_text(docs: DataFrame, text: str, mask: Callable, setup: Callable[[], object]) -> DataFrame:
    """The rows of ``docs``, all columns, where ``mask(piece, setup())`` is true."""
    place = docs.columns.index(text)

    def run(batches):
        have = setup()
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(place)], names=["text"])
            at = 0
            for piece in pieces(texts, "text"):
                yield batch.slice(at, len(piece)).filter(pa.array(mask(piece, have)))
                at += len(piece)

    return docs.mapInArrow(run, docs.schema)
