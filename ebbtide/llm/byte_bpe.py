"""Byte-level BPE encoding and decoding by backtracking over an Aho-Corasick automaton.

A token sequence is what merging by rank gives if and only if every two
neighbours are: merging the bytes of the pair alone gives just that pair. So a
piece is encoded by taking the longest token at each place that is compatible
with its left neighbour, and going back to a shorter one where none fits.
Compatibility follows from the tokens' own merges, is worked out once for each
pair and kept. Bytes are mapped to the 256 characters of Latin-1, over which
pyahocorasick finds the longest token of each place of a piece in one pass; the shorter
ones are a fixed chain.

Cases: a null text counts as empty; an empty text has no tokens and the hash of
no bytes; equal rows give equal rows; texts of any length are encoded whole,
piece by piece; other columns aren't read.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ebbtide.llm.batches import map_text

#: Encoded pieces, and compared pairs, kept in a worker; beyond it the older half goes.
KEPT_PIECES = 300_000
KEPT_PAIRS = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a vocabulary file: base64 and a number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


@dataclass(frozen=True)
class Vocabulary:
    """Ranks of the tokens and what merging makes of each token's own bytes; worked out once, on the driver.

    ``left`` and ``right`` are the two tokens of a token's last merge, ``left`` is
    -1 for single bytes and -2 for tokens that merging their bytes doesn't give.
    ``shorter`` is the longest other token that the token begins with and that
    merging gives, or -1.
    """

    ranks: dict[bytes, int]
    left: dict[int, int]
    right: dict[int, int]
    shorter: dict[int, int]

    @classmethod
    def of(cls, ranks: dict[bytes, int]) -> Vocabulary:
        left, right = {}, {}
        for token, rank in ranks.items():
            parts, last = merge(ranks, token)
            given = len(parts) == 1
            left[rank], right[rank] = (last if last else (-1, -1)) if given else (-2, -2)
        shorter = {}
        for token, rank in ranks.items():
            begins = (ranks.get(token[:n], -1) for n in range(len(token) - 1, 0, -1))
            shorter[rank] = next((r for r in begins if r >= 0 and left[r] != -2), -1)
        return cls(ranks, left, right, shorter)


def merge(ranks: dict[bytes, int], piece: bytes) -> tuple[list[int], tuple[int, int] | None]:
    """Merging by rank as defined, lowest rank first and leftmost, and the last two tokens merged; for short byte strings."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    last = None
    while len(parts) > 1:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[best] + parts[best + 1] not in ranks:
            break
        last = ranks[parts[best]], ranks[parts[best + 1]]
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    return [ranks[p] for p in parts], last


class Encoder(dict):
    """Piece of text -> its ids as little-endian 32-bit integers."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        import ahocorasick
        import regex

        super().__init__()
        self.v = vocabulary
        self.split = regex.compile(pattern).findall
        self.token = {rank: token for token, rank in vocabulary.ranks.items()}
        self.size = {rank: len(token) for token, rank in vocabulary.ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.merged = {(a, vocabulary.right[rank]): rank for rank, a in vocabulary.left.items() if a >= 0}
        self.automaton = ahocorasick.Automaton()
        for token, rank in vocabulary.ranks.items():
            # a token that merging its own bytes doesn't give can only stand for a whole piece
            if vocabulary.left[rank] != -2:
                self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        self.automaton.make_automaton()

    def __reduce__(self):
        raise TypeError("built inside each worker")

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves a boundary between the two tokens.

        Both are taken apart again, the later merge first, along the boundary. If
        the two parts that meet there make a token that merging would have made
        before the merge that was just undone, the boundary wouldn't have lasted.
        Equal ranks are merged from the left.
        """
        left, right, merged = self.v.left, self.v.right, self.merged
        before = 1 << 60  # ranks below this were merged while the two parts met
        while True:
            if merged.get((a, b), before) < before:
                return False
            if left[a] >= 0 and (a > b or left[b] < 0):
                before, a = a, right[a]
            elif left[b] >= 0:
                # of equal ranks, one that began further left would have come first
                before, b = b + 1, left[b]
            else:
                return True

    def backtrack(self, piece: bytes) -> list[int]:
        longest: list[int] = [-1] * (len(piece) + 1)  # at each place; as an end further right comes later
        for end, (more, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - more] = rank
        size_of, shorter, pairs, n = self.size, self.v.shorter, self.pairs, len(piece)
        dead: set[int] = set()  # places from which no way leads to the end, given all before
        ids: list[int] = []
        at, last, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                end = at + size_of[token]
                if end not in dead:
                    if last < 0:
                        break
                    fits = pairs.get((last, token))
                    if fits is None:
                        if len(pairs) >= KEPT_PAIRS:
                            for key in list(itertools.islice(pairs, KEPT_PAIRS // 2)):
                                del pairs[key]
                        fits = pairs[last, token] = self.compatible(last, token)
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                at, last, token = end, token, longest[end]
            else:  # back, to a shorter token before
                dead.add(at)
                taken = ids.pop()
                at -= size_of[taken]
                last, token = ids[-1] if ids else -1, shorter[taken]
        return ids

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.v.ranks.get(raw)
        ids = [whole] if whole is not None else self.backtrack(raw)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= KEPT_PIECES:  # the older half goes
            for key in list(itertools.islice(self, KEPT_PIECES // 2)):
                del self[key]
        if len(raw) <= 64:
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.split(text)))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_encoders: dict = {}


def _setup(docs: DataFrame, path: str, pattern: str):
    """A function that gives a worker its encoder, built once for each vocabulary and pattern."""
    ranks = read_ranks(path)
    name = hashlib.sha256(repr((sorted(ranks.items()), pattern)).encode()).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.of(ranks))  # a vocabulary file has a fixed size (about 50,000 tokens)

    def encoder() -> Encoder:
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoder(shared.value, pattern)
        return _encoders[name]

    return encoder


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with the token ids of each text as ``tokens``, array<int>."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "tokens"]
    encoder_of = _setup(docs, path, pattern)

    def work(piece, encoder):
        packed = [encoder.encode(t or "") for t in piece.column("text").to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))]

    return map_text(docs, keep, text, [T.StructField("tokens", T.ArrayType(T.IntegerType()))], work, encoder_of)


def decode(tokens: DataFrame, path: str, pattern: str, column: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with the bytes of the token ids as ``decoded``, binary."""
    keep = [c for c in (tokens.columns if keep is None else keep) if c != "decoded"]
    encoder_of = _setup(tokens, path, pattern)
    schema = T.StructType([tokens.schema[c] for c in keep] + [T.StructField("decoded", T.BinaryType())])

    def run(batches):
        encoder = encoder_of()
        for batch in batches:
            made = [encoder.decode(np.array(ids or [], "<u4").tobytes()) for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(made, pa.binary())], names=[*keep, "decoded"])

    return tokens.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the packed ids and of the bytes decoded from them.

    Encodes and decodes in one pass, so that ids of long texts need not be stored.
    """
    encoder_of = _setup(docs, path, pattern)

    def work(piece, encoder):
        counts, ids, texts = [], [], []
        for t in piece.column("text").to_pylist():
            packed = encoder.encode(t or "")
            counts.append(len(packed) // 4)
            ids.append(hashlib.sha256(packed).hexdigest())
            texts.append(hashlib.sha256(encoder.decode(packed)).hexdigest())
        return [counts, ids, texts]

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    return map_text(docs, [doc_id], text, fields, work, encoder_of)
