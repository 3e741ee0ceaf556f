"""SentencePiece encoding and decoding for merge-type vocabularies.

A text is normalised as the model says (spaces become "▁") and taken apart into
characters. An agenda holds the adjacent pairs of symbols whose concatenation is
a piece; the pair of best score, the leftmost of equals, is merged, and the pairs
with its new neighbours come in, until the agenda is empty. Characters that are no
piece become bytes. If no piece holds a "▁" after another character, as is usual,
no merge reaches over such a place, so a text is cut there into chunks. Chunks
that a worker hasn't met yet are encoded together: in each step every chunk's
agenda gives its best pair. A chunk of many characters has a heap of its own, so
that texts without spaces take n log n time. Decoding is the library's; ids are
compared with the library's batch by batch (``agrees``): each chunk when a worker first
meets it, or each text where texts don't fall apart into chunks.

Cases: a null text counts as empty, and an empty one has no ids; equal rows give
equal rows; texts of any length are encoded whole; other columns aren't read.
Vocabularies that aren't of the merge type, have no byte fallback or hold
user-defined or unused pieces are refused.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ebbtide.llm.batches import map_text

SPACE = "▁"
#: Chunks of more characters get a heap of their own.
LONG_CHUNK = 64
#: Chunks whose ids a worker keeps; beyond it the older half goes.
KEPT_CHUNKS = 300_000
_MULTIPLY = np.int64(0x9E3779B97F4A7C15 - (1 << 64))
NEVER = np.int32(np.iinfo(np.int32).max)


@dataclass(frozen=True)
class Vocabulary:
    """What encoding needs of a model, as arrays; made once, on the driver.

    Symbols are the pieces' ids and, from ``pieces`` on, characters that only
    occur inside pieces. ``left * symbols + right`` of every pair that may merge
    is in ``pairs``, sorted, with the piece it makes and that piece's place in
    the order of scores.
    """

    model: bytes
    pieces: int
    symbols: int
    char: np.ndarray  # sorted code points
    char_symbol: np.ndarray
    pairs: np.ndarray
    made: np.ndarray
    rank: np.ndarray
    byte_ids: np.ndarray  # id of each byte's piece
    plain: bool  # normalising only puts "▁" for spaces and before the text
    cuts: bool  # no merge reaches over a "▁" that follows another character


def read_vocabulary(path: str) -> Vocabulary:
    from sentencepiece import sentencepiece_model_pb2 as proto

    with open(path, "rb") as f:
        raw = f.read()
    model = proto.ModelProto.FromString(raw)
    kinds = proto.ModelProto.SentencePiece
    if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
        raise ValueError("only merge-type models with byte fallback can be read")
    if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
        raise ValueError("models with user-defined or unused pieces can't be read")
    normal = [(i, p.piece, p.score) for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
    symbol = {piece: i for i, piece, _ in normal}
    for c in sorted({c for _, piece, _ in normal for c in piece}):
        symbol.setdefault(c, len(model.pieces) + len(symbol) - len(normal))
    symbols = len(model.pieces) + len(symbol) - len(normal)
    place = {score: n for n, score in enumerate(sorted({s for *_, s in normal}, reverse=True))}
    pairs = sorted(
        (symbol[piece[:cut]] * symbols + symbol[piece[cut:]], i, place[score])
        for i, piece, score in normal
        for cut in range(1, len(piece))
        if piece[:cut] in symbol and piece[cut:] in symbol
    )
    chars = sorted((ord(s), i) for s, i in symbol.items() if len(s) == 1)
    byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
    spec = model.normalizer_spec
    return Vocabulary(
        raw,
        len(model.pieces),
        symbols,
        np.array([c for c, _ in chars], np.uint32),
        np.array([i for _, i in chars], np.int64),
        np.array([k for k, _, _ in pairs], np.int64),
        np.array([i for _, i, _ in pairs], np.int64),
        np.array([r for *_, r in pairs], np.int32),
        np.array([byte_ids[b] for b in range(256)], np.int32),
        not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix,
        not any(re.search(f"[^{SPACE}]{SPACE}", piece) for _, piece, _ in normal),
    )


class Encoder(dict):
    """Chunk of normalised text -> its ids as little-endian 32-bit integers.

    Where every chunk begins with a "▁", that one is left out of the key.
    """

    def __init__(self, vocabulary: Vocabulary):
        import sentencepiece

        super().__init__()
        self.v = vocabulary
        self.library = sentencepiece.SentencePieceProcessor(model_proto=vocabulary.model)
        self.head = SPACE if vocabulary.plain and vocabulary.cuts else ""
        # where a pair stands in the sorted list, by a hash of it; slots of several pairs are marked
        bits = max(4, int(len(vocabulary.pairs) * 8).bit_length())
        self.shift = np.int64(63 - bits)
        place = self.place(vocabulary.pairs)
        self.slot = np.zeros(1 << bits, np.int32)
        self.slot[place] = np.arange(len(place))
        self.shared = np.bincount(place, minlength=1 << bits) > 1
        self.wrong: set[str] = set()  # chunks that the library encodes in another way; none, as far as known
        self.cut = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall if vocabulary.cuts else lambda text: [text] if text else []

    def __reduce__(self):
        raise TypeError("built inside each worker")

    def place(self, key: np.ndarray) -> np.ndarray:
        return ((key * _MULTIPLY) & np.int64((1 << 63) - 1)) >> self.shift

    def normalise(self, text: str) -> str:
        if self.v.plain:
            return SPACE + text.replace(" ", SPACE) if text else ""
        return self.library.normalize(text)

    def chunks(self, text: str) -> list[str]:
        if self.head and SPACE not in text and "  " not in text and text[:1] != " ":
            return text.split(" ") if text else []
        return [c[len(self.head) :] for c in self.cut(self.normalise(text))]

    def symbols(self, text: str) -> np.ndarray:
        """A symbol for each character; -1 - code point for one that no piece holds."""
        code = np.frombuffer(text.encode("utf-32-le"), "<u4")
        at = np.minimum(np.searchsorted(self.v.char, code), len(self.v.char) - 1)
        return np.where(self.v.char[at] == code, self.v.char_symbol[at], -1 - code.astype(np.int64))

    def merges(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The piece that each pair makes, and its place in the order of scores; NEVER for pairs that make none."""
        key = left * self.v.symbols + right
        at = self.slot[self.place(key)]
        good = (self.v.pairs[at] == key) & (left >= 0) & (right >= 0)
        # the few pairs whose slot belongs to another one
        other = np.flatnonzero(~good & self.shared[self.place(key)])
        if len(other):
            at[other] = np.minimum(np.searchsorted(self.v.pairs, key[other]), len(self.v.pairs) - 1)
            good[other] = (self.v.pairs[at[other]] == key[other]) & (left[other] >= 0) & (right[other] >= 0)
        return self.v.made[at], np.where(good, self.v.rank[at], NEVER)

    def together(self, chunks: list[str]) -> list[bytes]:
        """Ids of many chunks; every step merges the best pair of each."""
        sym = self.symbols(self.head + self.head.join(chunks))
        size = np.fromiter(map(len, chunks), np.int64, len(chunks)) + len(self.head)
        owner = np.repeat(np.arange(len(chunks)), size)
        done_sym, done_owner = [], []
        inside = np.append(owner[1:] == owner[:-1], False)
        following = np.append(sym[1:], -1)
        made, rank = self.merges(sym, following)
        rank[~inside] = NEVER
        while len(sym):
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(owner)))
            best = np.repeat(np.minimum.reduceat(rank, starts), sizes)
            over = best == NEVER
            if over.any():
                done_sym.append(sym[over])
                done_owner.append(owner[over])
                left = ~over
                sym, owner, made, rank, best = sym[left], owner[left], made[left], rank[left], best[left]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == best)
            hit = hit[np.append(True, owner[hit[1:]] != owner[hit[:-1]])]  # the leftmost
            sym[hit] = made[hit]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            moved = np.cumsum(keep)[hit] - 1
            sym, owner, made, rank = sym[keep], owner[keep], made[keep], rank[keep]
            # pairs that the merged symbols are part of
            changed = np.concatenate([moved, moved[moved > 0] - 1])
            last = np.minimum(changed + 1, len(sym) - 1)
            made[changed], now = self.merges(sym[changed], sym[last])
            now[(owner[changed] != owner[last]) | (changed == last)] = NEVER
            rank[changed] = now
        sym, owner = np.concatenate(done_sym), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return self.packed(sym[order], np.bincount(owner, minlength=len(chunks)))

    def alone(self, chunk: str) -> bytes:
        """Ids of one long chunk: an agenda of pairs by score and place."""
        v, sym = self.v, self.symbols(self.head + chunk).tolist()
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        known: dict[tuple[int, int], tuple[int, int] | None] = {}

        def merge(a: int, b: int) -> tuple[int, int] | None:
            if (a, b) not in known:
                key = a * v.symbols + b
                at = int(np.searchsorted(v.pairs, key)) if a >= 0 and b >= 0 else len(v.pairs)
                known[a, b] = (int(v.rank[at]), int(v.made[at])) if at < len(v.pairs) and v.pairs[at] == key else None
            return known[a, b]

        agenda = []
        for i in range(n - 1):
            got = merge(sym[i], sym[i + 1])
            if got:
                agenda.append((got[0], i, sym[i], sym[i + 1], got[1]))
        heapq.heapify(agenda)
        gone = bytearray(n)
        while agenda:
            _, i, a, b, piece = heapq.heappop(agenda)
            j = after[i]
            if gone[i] or j >= n or sym[i] != a or sym[j] != b:
                continue  # one of the two has been merged with another
            sym[i], gone[j] = piece, 1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if 0 <= x and y < n:
                    got = merge(sym[x], sym[y])
                    if got:
                        heapq.heappush(agenda, (got[0], x, sym[x], sym[y], got[1]))
        kept = np.array([s for s, g in zip(sym, gone) if not g], np.int64)
        return self.packed(kept, np.array([len(kept)]))[0]

    def packed(self, sym: np.ndarray, count: np.ndarray) -> list[bytes]:
        """Each chunk's ids; symbols that are no piece become the pieces of their bytes."""
        ends = np.cumsum(count)
        odd = np.flatnonzero((sym < 0) | (sym >= self.v.pieces))
        if len(odd):
            back = {int(s): int(c) for c, s in zip(self.v.char, self.v.char_symbol) if s >= self.v.pieces}
            raw = [chr(-1 - s if s < 0 else back[s]).encode() for s in sym[odd].tolist()]
            width = np.ones(len(sym), np.int64)
            width[odd] = [len(r) for r in raw]
            ends = np.cumsum(width)[ends - 1]
            out = np.repeat(sym, width)
            spread = np.repeat(np.isin(np.arange(len(sym)), odd), width)
            out[spread] = self.v.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
            sym = out
        ids = sym.astype("<i4").tobytes()
        begin = np.concatenate([[0], ends[:-1]])
        return [ids[a * 4 : b * 4] for a, b in zip(begin.tolist(), ends.tolist())]

    def learn(self, chunks: list[str]) -> list[str]:
        """Encode the chunks that aren't kept yet; returns the long ones."""
        fresh = list(dict.fromkeys(itertools.filterfalse(self.__contains__, chunks)))
        if len(self) + len(fresh) > KEPT_CHUNKS:
            # this batch's chunks stay; of the others, the older half goes
            own = set(chunks)
            for c in [c for n, c in enumerate(self) if n < len(self) // 2 and c not in own]:
                del self[c]
        short = [c for c in fresh if len(c) <= LONG_CHUNK]
        if short:
            self.update(zip(short, self.together(short)))
        long = [c for c in fresh if len(c) > LONG_CHUNK]
        self.update((c, self.alone(c)) for c in long)
        if self.head:
            asked = [c for c in fresh if c]  # a lone "▁" has nothing to merge
            self.wrong.update(c for c, ids in zip(asked, self.library.encode(asked, num_threads=1)) if _ids(self[c]) != ids)
        return long

    def agrees(self, texts: list[str], ids: list[list[int]]) -> list[bool]:
        """Whether the library gives these ids: asked for each chunk once where texts fall apart, else for each text."""
        if not self.head:
            return [own == other for own, other in zip(ids, self.library.encode(texts, num_threads=1))]
        return [not self.wrong or self.wrong.isdisjoint(self.chunks(t)) for t in texts]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.chunks(t) for t in texts]
        long = self.learn(list(itertools.chain.from_iterable(parts)))
        out = [b"".join(map(self.__getitem__, p)) for p in parts]
        for c in long:
            del self[c]  # so that what is kept is bounded by the number of chunks
        return out


_encoders: dict = {}


def _setup(docs: DataFrame, path: str):
    """A function that gives a worker its encoder, built once for each vocabulary."""
    vocabulary = read_vocabulary(path)
    name = hashlib.sha256(vocabulary.model).hexdigest()
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary has a fixed size (some MB)

    def encoder() -> Encoder:
        if name not in _encoders:
            _encoders.clear()
            _encoders[name] = Encoder(shared.value)
        return _encoders[name]

    return encoder


def _ids(packed: bytes) -> list[int]:
    return np.frombuffer(packed, "<i4").tolist()


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (default: all) with the ids of each text as ``pieces``, array<int>."""
    keep = [c for c in (docs.columns if keep is None else keep) if c != "pieces"]

    def work(piece, encoder):
        packed = encoder.encode([t or "" for t in piece.column("text").to_pylist()])
        offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))]

    return map_text(docs, keep, text, [T.StructField("pieces", T.ArrayType(T.IntegerType()))], work, _setup(docs, path))


def decode(pieces: DataFrame, path: str, column: str = "pieces", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with the text of the ids as ``decoded``; null and empty lists give an empty text."""
    keep = [c for c in (pieces.columns if keep is None else keep) if c != "decoded"]
    encoder_of = _setup(pieces, path)
    schema = T.StructType([pieces.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        library = encoder_of().library
        for batch in batches:
            made = [library.decode(ids) if ids else "" for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(made, pa.string())], names=[*keep, "decoded"])

    return pieces.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", checked: bool = True) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the ids as decimal text and of the text decoded from them.

    With ``checked`` also ``agrees``: whether the library gives the same ids. Encodes,
    decodes and checks in one pass, so that ids of long texts need not be stored.
    """

    def work(piece, encoder):
        texts = [t or "" for t in piece.column("text").to_pylist()]
        ids = [_ids(p) for p in encoder.encode(texts)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out = [[len(i) for i in ids], [sha(",".join(map(str, i))) for i in ids], [sha(encoder.library.decode(i) if i else "") for i in ids]]
        return out + [encoder.agrees(texts, ids)] if checked else out

    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
    return map_text(docs, [doc_id], text, fields + [T.StructField("agrees", T.BooleanType())] * checked, work, _setup(docs, path))
