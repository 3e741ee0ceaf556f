"""Line deduplication: one line of each group of equal or nearly equal lines stays.

A line is normalised to its lower-cased words. Equal lines are combined. Two
different ones are near if at most a fifth of the longer one's words is edited and
their SimHashes are within a radius. They meet in blocks. Where one edit is allowed,
a line's blocks are itself and itself without each one of its words: two such lines
share one, as the pigeonhole principle has it for one edit. Blocks of longer lines are runs of two words. All runs have
one order, and a line takes its first ones, as many as the allowed edits can't all change: an inserted word changes one run,
any other edit two that stand side by side, and a longer near line needs insertions for what it has more. Of two near lines
that whose last run taken comes first keeps one of its runs, which the other then has taken too. Any order would
do; runs that begin with a rare word come first, so that few lines meet. What meets
in a block is tested by the SimHashes, sizes, places of the run and parities of word counts before any pair
leaves the task, and decided by the edit distance itself. What stands before the kept run, and behind it, is edited
apart, so places allow what sizes would not; places past the 1,022nd word and of repeated runs reject nothing.

Of a crowded block, where many lines are within the radius, a line is compared with
the first one and a few others at first. The links found are contracted, and then all lines
of the block are compared that stand in different components, in parts of bounded size; so copies
with edits, however many, cost few pairs each, and no link between components is left out. Connected lines form a group, and
the group's first occurrence stays: that with the smallest document id, then the
smallest row key and line number.

With a radius of 64 the exact way is taken instead. Cut the longer line into one run of words
more than edits are allowed: one run at least stands whole in the other, so a key of every run
(three words of it, two in lines of five words) meets the keys of all words of the other. In runs
of four words and more the smaller of two neighbouring keys stands for both. Every pair that meets
in a key is compared: its places must allow the edits and so must the lengths and the parities
of word counts.

Cases: a line without words is kept always; a null text stays null, an empty one
empty, and a text whose lines all go becomes empty, its row stays; a null
document id sorts first; rows equal in id and text are one occurrence and are
treated alike; line ends are "\\n"; lines of any length take part whole; other
columns are returned as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.llm.batches import Words, mix, pieces, powers
from ebbtide.llm.graph import components, extended, may_hold, membership
from ebbtide.llm.order_minhash import alike
from ebbtide.session import discard, settle
from ebbtide.session import stage_tidily as stage


@dataclass(frozen=True)
class Settings:
    similarity: float = 0.8  # least share of words that needn't be edited
    radius: int = 16  # bits in which SimHashes of near lines may differ; 64 takes the exact way, by all runs of words
    runs: int = 5  # runs of three words that stand for a line of some length; 0: as many runs of two words as it takes to miss no near line
    beside: int = 4  # lines before it, besides its key's first, that a line is compared with at first
    block: int = 1024  # lines of a key that are compared at once afterwards


# What the operator does unless told otherwise: no block is left out.
WHOLE = Settings(runs=0)
_STEP = np.uint64(0xD6E8FEB86659FD93)
LONG = (1 << 16) - 1  # size of this many words or more
SLOTS = 1 << 16  # to which words are dealt when they are counted
LOTS = 8  # at most so many parts of all blocks are shuffled one after the other
LOT = 1 << 18  # lines for which there is a part


class Lines:
    """Lines of a text column that have words: row, number in the text, hash of the words, and their words."""

    def __init__(self, column: pa.Array):
        self.words = words = Words(column)
        ends = np.flatnonzero(words.data == 10)
        number = np.searchsorted(ends, words.start)  # newlines before each word
        count = np.diff(words.offsets)
        row = np.repeat(np.arange(len(count)), count)
        new = np.ones(len(number), bool)
        new[1:] = (number[1:] != number[:-1]) | (row[1:] != row[:-1])
        self.first = np.flatnonzero(new)
        self.row = row[self.first]
        self.size = np.diff(np.append(self.first, len(number)))
        # newlines before the text's first byte
        heads = words.byte_offsets[:-1]
        self.number = number[self.first] - np.searchsorted(ends, heads)[self.row]
        place = (np.arange(len(number)) - np.repeat(self.first, self.size)).astype(np.uint64)
        self.hash = mix(np.add.reduceat(mix(words.hash + place * _STEP), self.first) + self.size.astype(np.uint64)).view(np.int64) if len(number) else np.zeros(0, np.int64)

    def simhash(self) -> np.ndarray:
        """Each bit is what most words of the line have; of words' hashes, with repeats."""
        if not len(self.first):
            return np.zeros(0, np.int64)
        # runs of at most 255 words of a line, so that a bit's count fits into a byte
        runs = -(-self.size // 255)
        begin = np.cumsum(runs) - runs
        place = np.arange(int(runs.sum())) - np.repeat(begin, runs)
        start = np.repeat(self.first, runs) + place * 255
        counts = np.empty((8, len(start)), np.uint64)
        for k in range(8):
            # eight bits at once, each in a byte of its own
            counts[k] = np.add.reduceat((self.words.hash >> np.uint64(k)) & np.uint64(0x0101010101010101), start)
        each = np.ascontiguousarray(counts.T).view(np.uint8).reshape(len(start), 64)
        if len(start) > len(begin):
            each = np.add.reduceat(each, begin, axis=0, dtype=np.int32)
        return np.packbits(each * np.int32(2) > self.size[:, None], axis=1).view(np.int64)[:, 0]

    def info(self) -> np.ndarray:
        """The number of words, 65535 for as many or more, and below it the parities of how often words occur that are dealt to 32 slots."""
        if not len(self.first):
            return np.zeros(0, np.int64)
        odd = np.bitwise_xor.reduceat(np.uint64(1) << (self.words.hash >> np.uint64(59)), self.first)
        return (np.minimum(self.size, LONG) << 32) | odd.astype(np.int64)

    def sketches(self) -> np.ndarray:
        """Each line's number of words, 32 bits, and the parities of how often words occur that are dealt to 256 slots, as 36 bytes."""
        out = np.empty((len(self.first), 9), np.uint32)
        if len(out):
            out[:, 0] = self.size
            slot = self.words.hash >> np.uint64(56)
            bit, part = np.uint64(1) << (slot & np.uint64(63)), slot >> np.uint64(6)
            for k in range(4):
                out[:, 1 + 2 * k : 3 + 2 * k] = np.bitwise_xor.reduceat(np.where(part == k, bit, np.uint64(0)), self.first).view(np.uint32).reshape(-1, 2)
        return out.view(np.uint8)

    def sketch(self, i: int) -> bytes:
        """One of ``sketches``."""
        return self.sketches()[i].tobytes()

    def packed(self, i: int) -> bytes:
        """Hashes of the line's words, 32 bits each."""
        return (self.words.hash[self.first[i] : self.first[i] + self.size[i]] >> np.uint64(32)).astype(np.uint32).tobytes()


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits for a row's id and text."""
    return F.unhex(F.md5(F.concat_ws("\x00", F.coalesce(doc_id.cast("string"), F.lit("null")), text)))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def levels(rows: DataFrame) -> np.ndarray:
    """How common the words of each slot are, 0 to 255, counted on all texts; it orders runs of words and has no part in what is found.

    At most ``SLOTS`` rows reach the driver.
    """

    def run(batches):
        count = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for piece in pieces(batch, "text"):
                count += np.bincount(_slot(Words(piece.column("text")).hash), minlength=SLOTS)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["slot", "n"])

    counted = rows.select("text").mapInArrow(run, "slot long, n long")
    found = counted.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(SLOTS)
    count[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    return np.minimum(np.log2(count + 1) * 4, 255).astype(np.uint8)


def _occurrences(rows: DataFrame, settings: Settings) -> DataFrame:
    """Every line with words; ``sim``, ``info``, ``blocks`` and ``sketch`` where a task meets it first. A block's last ten bits are its place."""
    common = rows.sparkSession.sparkContext.broadcast(levels(rows) if settings.radius < 64 and not settings.runs else None)
    schema = T.StructType(
        [
            rows.schema["doc_id"],
            rows.schema["row"],
            T.StructField("line", T.IntegerType()),
            T.StructField("h", T.LongType()),
            T.StructField("sim", T.LongType()),
            T.StructField("info", T.LongType()),
            T.StructField("blocks", T.ArrayType(T.LongType())),
            T.StructField("sketch", T.BinaryType()),
        ]
    )

    def run(batches):
        seen: set[int] = set()  # spares the shuffle most equal lines
        for batch in batches:
            for piece in pieces(batch, "text"):
                lines = Lines(piece.column("text"))
                take = pa.array(lines.row)
                fresh = np.zeros(len(lines.hash), bool)
                for i, h in enumerate(lines.hash.tolist()):
                    if h not in seen:
                        seen.add(h)
                        fresh[i] = True
                if len(seen) > 200_000:
                    seen.clear()
                these = np.flatnonzero(fresh)
                count = np.zeros(len(fresh), np.int64)
                key = np.zeros(0, np.int64)
                if settings.radius < 64:
                    key, own, at = placed_blocks(lines, these, settings, common.value)
                    key = (key & ~FREE) | at
                    count[these] = np.bincount(own, minlength=len(these))
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(key), mask=pa.array(count == 0) if len(count) else None)
                sim, info = pa.array(lines.simhash(), mask=~fresh), pa.array(lines.info(), mask=~fresh)
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(36), len(fresh), [pa.array(fresh).buffers()[1], pa.py_buffer(lines.sketches())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(take), piece.column("row").take(take), pa.array(lines.number.astype(np.int32)), pa.array(lines.hash), sim, info, held, sketch], names=schema.names)

    return rows.mapInArrow(run, schema)


def _words(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``h`` and the packed words of every wanted line; ``wanted`` has h and the row of an occurrence."""
    spark = rows.sparkSession
    lines_wanted = spark.sparkContext.broadcast(membership(wanted, "h"))
    rows_wanted = spark.sparkContext.broadcast(membership(wanted.select(F.xxhash64("row").alias("place")), "place"))
    schema = T.StructType([T.StructField("h", T.LongType()), T.StructField("row", T.BinaryType()), T.StructField("words", T.BinaryType())])

    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(rows_wanted.value, batch.column("place").to_numpy())))
            for piece in pieces(batch, "text"):
                lines = Lines(piece.column("text"))
                own = np.flatnonzero(may_hold(lines_wanted.value, lines.hash))
                yield pa.RecordBatch.from_arrays([pa.array(lines.hash[own]), piece.column("row").take(pa.array(lines.row[own])), pa.array([lines.packed(i) for i in own.tolist()], pa.binary())], names=schema.names)

    found = rows.select("row", F.xxhash64("row").alias("place"), "text").mapInArrow(run, schema)
    return found.join(wanted, ["h", "row"], "left_semi").groupBy("h").agg(F.first("words").alias("words"))


PLACE_BITS = 10  # of a block, for its place
FREE = (1 << PLACE_BITS) - 1  # place of a block that may stand anywhere in a line
ANYWHERE = (1 << 14) - 1  # place of a key that a line has more than once, or too far on to be noted


def allowed(size: np.ndarray, similarity: float) -> np.ndarray:
    """Most edits between a line of so many words and one that isn't longer."""
    return (size * (1 - similarity) + 1e-9).astype(np.int64)


def _allows(size: np.ndarray, similarity: float, least: int, most: int) -> np.ndarray:
    """Which lines may be near a line that isn't shorter and allows so many edits."""
    length = np.arange(int(size.max() / similarity + 1e-9) + 2)
    some = np.concatenate([[0], np.cumsum((allowed(length, similarity) >= least) & (allowed(length, similarity) <= most))])
    last = (size / similarity + 1e-9).astype(np.int64)
    return some[last + 1] > some[size]


@lru_cache(1024)
def _needed(size: int, similarity: float) -> np.ndarray:
    """How many runs of two words of a line the edits to no near line can all change, by the number of disjoint pairs of neighbours among the runs.

    With g insertions and p other edits the runs are changed, if they are no more than g + p + the lesser of p and those pairs.
    """
    length = np.arange(size, int(size / similarity + 1e-9) + 1)  # of the longer line
    edits = allowed(length, similarity)
    other = edits - (length - size)  # edits that needn't be insertions; fewer, the longer that line is
    edits, other = edits[other >= 0], other[other >= 0]
    pairs = np.arange(other[0] + 1)
    last = np.searchsorted(-other, -pairs, "right")
    later = np.append(np.maximum.accumulate((edits + other)[::-1])[::-1], 0)
    return 1 + np.maximum(edits[last - 1] + pairs, later[last])


def _taken(line: np.ndarray, place: np.ndarray, rank: np.ndarray, size: np.ndarray, similarity: float) -> np.ndarray:
    """How many runs each line takes; ``line`` and ``place`` of all its different runs by place, and their ``rank``."""
    have = np.bincount(line, minlength=len(size))
    each, at = np.unique(size, return_inverse=True)
    tables = [_needed(int(n), similarity) for n in each]
    most = np.array([len(t) for t in tables])[at] - 1
    begin = (np.cumsum([len(t) for t in tables]) - [len(t) for t in tables])[at]
    needed = np.concatenate(tables)
    low, high = np.minimum(needed[begin], have), np.minimum(needed[begin + most], have)
    for _ in range(8):  # where this ends early, a line takes more than it needs
        middle = (low + high) // 2
        some = np.flatnonzero(rank < middle[line])
        own, spot = line[some], place[some]
        new = np.ones(len(some), bool)
        new[1:] = (own[1:] != own[:-1]) | (spot[1:] != spot[:-1] + 1)
        first = np.flatnonzero(new)
        pairs = np.bincount(own[first], np.diff(np.append(first, len(some))) // 2, minlength=len(size)).astype(np.int64)
        good = middle >= needed[begin + np.minimum(pairs, most)]
        high, low = np.where(good, middle, high), np.where(good, low, np.minimum(middle + 1, high))
        if (low == high).all():
            break
    return high


def blocks(lines: Lines, these: np.ndarray, settings: Settings, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of the lines named by ``these`` and each block's line, in the order of lines; ``common`` tells how common words are."""
    return placed_blocks(lines, these, settings, common)[:2]


def placed_blocks(lines: Lines, these: np.ndarray, settings: Settings, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``blocks``, and the place of each one's run in its line; ``FREE`` where a line has it more than once, it is too far on to be noted or no run."""
    size = lines.size[these]
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin = np.cumsum(size) - size
    line = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(line)) - begin[line]
    words = lines.words.hash[np.repeat(lines.first[these], size) + place]
    found = []
    # one edit: the line itself, and without each of its words
    one = _allows(size, settings.similarity, 1, 1)
    if one.any():
        own = np.flatnonzero(one[line])
        up, down = (p[1] for p in powers(2))
        scale = np.ones(int(size[one].max()) + 1, np.uint64)
        np.multiply.accumulate(np.full(len(scale) - 1, up), out=scale[1:])
        term = mix(words[own]) * scale[place[own]]
        running = np.cumsum(term)
        first = np.flatnonzero(place[own] == 0)
        n = size[line[own[first]]]
        before = running[first] - term[first]
        total = running[first + n - 1] - before
        of = np.repeat(np.arange(len(first)), n)
        upto = running - before[of]
        without = (upto - term) + (total[of] - upto) * down
        shorter = allowed(size[line[own]], settings.similarity) == 1
        named = lambda value, n: mix(value + n.astype(np.uint64) * _STEP)
        found.append((named(total, n), line[own[first]], np.full(len(first), FREE)))
        found.append((named(without, n[of] - 1)[shorter], line[own[shorter]], np.full(int(shorter.sum()), FREE)))
    # more edits: runs of words, those that come first
    more = _allows(size, settings.similarity, 2, 1 << 40)
    inside = np.flatnonzero(more[line] & (place + (3 if settings.runs else 2) <= size[line]))
    if len(inside):
        own = line[inside]
        if settings.runs:
            h = mix(mix(words[inside] * np.uint64(3) + words[inside + 1]) * np.uint64(3) + words[inside + 2])
        else:  # what is common stands in the first byte
            level = np.uint64(0) if common is None else common[_slot(words[inside])].astype(np.uint64)
            h = (mix(words[inside] * np.uint64(3) + words[inside + 1]) >> np.uint64(8)) | (level << np.uint64(56))
        order = np.lexsort((h, own))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (own[order][1:] != own[order][:-1])
        again = np.diff(np.append(np.flatnonzero(new), len(h))) > 1
        order = order[new]
        # runs of the former sample are no proof of anything, so their places aren't either
        at = np.where(again | bool(settings.runs), FREE, np.minimum(place[inside[order]], FREE))
        line_of = own[order]
        nth = np.arange(len(order)) - np.searchsorted(line_of, line_of)
        if settings.runs:
            first = nth < settings.runs
        else:
            rank = np.full(len(h), len(h))
            rank[order] = nth
            once = np.flatnonzero(rank < len(h))
            first = nth < _taken(own[once], place[inside[once]], rank[once], size, settings.similarity)[line_of]
        found.append((h[order[first]], line_of[first], at[first]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, own, at = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((key, own))
    key, own, at = key[order], own[order], at[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    return key[new].view(np.int64), own[new], at[new]


def _sorted_pairs(x: np.ndarray, y: np.ndarray) -> list[pa.Array]:
    pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
    return [pa.array(pair[:, 0]), pa.array(pair[:, 1])]


def _may_be_near(sim: np.ndarray, info: np.ndarray, x: np.ndarray, y: np.ndarray, settings: Settings) -> np.ndarray:
    """Which of the pairs of rows x and y have SimHashes within the radius, and sizes, parities and places of what they share that allow the edits."""
    # unsigned: of a negative number the bits of its absolute value are counted
    good = np.bitwise_count((sim[x] ^ sim[y]).view(np.uint64)) <= settings.radius
    left = np.flatnonzero(good)
    a, b = info[x[left]], info[y[left]]
    size, other, at, place = (a >> 32) & LONG, (b >> 32) & LONG, a >> 48, b >> 48
    longer = np.maximum(size, other)
    most = allowed(longer, settings.similarity)
    # words before the run that meets and words after it need edits of their own
    less, shift = size - other, at - place
    moved = np.where((at == FREE) | (place == FREE), np.abs(less), np.abs(shift) + np.abs(less - shift))
    fits = (moved <= most) & (np.bitwise_count((a ^ b) & 0xFFFFFFFF) <= 2 * most)
    good[left] = fits | (longer == LONG)
    return good


def _expanded(low: np.ndarray, high: np.ndarray, at_once: int = 1 << 20):
    """Places x and y of all pairs of each place x with the places low[x] to high[x], in parts of bounded size."""
    count = np.maximum(high - low, 0)
    total = np.cumsum(count)
    begin = 0
    while begin < len(count):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + at_once, "right")))
        n = count[begin:stop]
        x = np.repeat(np.arange(begin, stop), n)
        yield x, np.repeat(low[begin:stop] - (np.cumsum(n) - n), n) + np.arange(len(x))
        begin = stop


def _meetings(keyed: DataFrame, settings: Settings) -> DataFrame:
    """Rows of two sorts: pairs ``a``, ``b`` to compare, without a key; and members ``a`` with ``key`` and ``sim`` of crowded keys.

    A key's lines give all their pairs within the radius, unless these are many
    more than the lines or the lines are more than a block. Such a crowded key gives pairs with its
    first line and with the last few lines before, and its members, for ``_others``. Of a key of any size no more
    than a block is held.
    """
    beside, block = settings.beside, settings.block
    names = ["key", "a", "b", "sim", "info"]

    def paired(pairs):
        a, b = (np.concatenate(p) for p in zip(*pairs))
        if len(a):
            a, b = _sorted_pairs(a, b)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([none, a, b, none, none], names=names)

    def crowded(key, h, sim, info, first, held):
        """Lines of crowded keys in order; the first ``held`` have been here before, ``first`` has h, sim and info of each one's key's first line."""
        n = len(key)
        both = [np.concatenate([own, other]) for own, other in zip((h, sim, info), first)]
        x = np.flatnonzero((np.arange(n) >= held) & (h != first[0]))
        good = _may_be_near(both[1], both[2], x, x + n, settings)
        pairs = [(h[x[good]], first[0][x[good]])]
        for d in range(1, beside + 1):
            x = np.arange(max(d, held), n)
            x = x[key[x] == key[x - d]]
            good = _may_be_near(sim, info, x, x - d, settings)
            pairs.append((h[x[good]], h[x[good] - d]))
        yield from paired(pairs)
        own = [c[held:] for c in (key, h, sim, info)]
        yield pa.RecordBatch.from_arrays([pa.array(own[0]), pa.array(own[1]), pa.nulls(n - held, pa.int64()), pa.array(own[2]), pa.array(own[3])], names=names)

    def whole(key, h, sim, info):
        """All lines of some keys."""
        start = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(start) - 1
        begins = np.flatnonzero(start)
        size = np.diff(np.append(begins, len(key)))
        few = size[group] <= block
        end = (begins + size)[group]
        found, count = [], np.zeros(len(size), np.int64)
        for x, y in _expanded(np.arange(1, len(key) + 1), np.where(few, end, 0)):
            good = _may_be_near(sim, info, x, y, settings)
            x, y = x[good], y[good]
            count += np.bincount(group[x], minlength=len(size))
            found.append((x, y))
        many = (size > block) | (count > (beside + 1) * size)
        yield from paired([(h[x[own]], h[y[own]]) for x, y in found for own in [~many[group[x]]]] or [(h[:0], h[:0])])
        own = np.flatnonzero(many[group])
        if len(own):
            first = begins[group[own]]
            yield from crowded(key[own], h[own], sim[own], info[own], (h[first], sim[first], info[first]), 0)

    def run(batches):
        held = [np.zeros(0, np.int64) for _ in range(4)]
        open_ = None  # first line of the crowded key that is passing by
        same = lambda n: [np.full(n, v) for v in open_]
        for batch in batches:
            if not len(batch):
                continue
            columns = [np.concatenate([old, batch.column(c).to_numpy()]) for old, c in zip(held, ("key", "h", "sim", "info"))]
            before = len(held[0]) if open_ else 0
            keep = np.ones(len(columns[0]), bool)  # equal lines come from several tasks
            keep[1:] = (columns[0][1:] != columns[0][:-1]) | (columns[1][1:] != columns[1][:-1])
            columns = [c[keep] for c in columns]
            key = columns[0]
            last = int(np.searchsorted(key, key[-1]))
            begin = 0
            if open_:  # more of the crowded key
                begin = int(np.searchsorted(key, key[0], "right"))
                yield from crowded(*[c[:begin] for c in columns], same(begin), before)
                if begin == len(key):
                    held = [c[-beside:] for c in columns]
                    continue
                open_ = None
            if last > begin:
                yield from whole(*[c[begin:last] for c in columns])
            held = [c[last:] for c in columns]
            if len(held[0]) > block:
                open_ = tuple(c[0] for c in held[1:])
                yield from crowded(*held, same(len(held[0])), 0)
                held = [c[-beside:] for c in held]
        if len(held[0]) and not open_:
            yield from whole(*held)

    return keyed.repartition("key").sortWithinPartitions("key", "h").mapInArrow(run, "key long, a long, b long, sim long, info long")


def _others(members: DataFrame, roots: DataFrame, sketches: DataFrame, settings: Settings) -> DataFrame:
    """Pairs ``a``, ``b`` of lines of one key, within the radius, whose sketches allow the edits and that stand in different components."""
    classed = members.join(roots.withColumnRenamed("node", "h"), "h", "left").withColumn("root", F.coalesce("root", "h"))
    sizes = classed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key", F.ceil(F.col("n") / settings.block).alias("lots"))
    # lots of about a block each: of crowded keys no task holds all
    dealt = classed.join(sizes, "key").join(sketches, "h").withColumn("lot", F.pmod(F.xxhash64("h"), F.col("lots")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
    dealt = dealt.select("key", F.least("lot", "other").alias("i"), F.greatest("lot", "other").alias("j"), "lot", "root", "h", "sim", "info", "sketch")

    def run(batches):
        held: list[list[np.ndarray]] = []
        names = ["key", "i", "j", "lot", "root", "h", "sim", "info"]

        def pairs():
            key, i, j, lot, root, h, sim, info, sketch = (np.concatenate(x) for x in zip(*held))
            change = lambda *columns: np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)])
            ends = np.append(np.flatnonzero(change(key, i, j)), len(key))
            group = np.cumsum(change(key, i, j)) - 1
            runs = np.append(np.flatnonzero(change(key, i, j, root)), len(key))
            run = np.cumsum(change(key, i, j, root)) - 1
            # each line with those of later components of its group
            for x, y in _expanded(runs[run + 1], ends[group + 1]):
                good = (i[x] == j[x]) | (lot[x] != lot[y])
                x, y = x[good], y[good]
                good = _may_be_near(sim, info, x, y, settings)
                x, y = x[good], y[good]
                good = _within(sketch[x], sketch[y], settings.similarity)
                if good.any():
                    yield pa.RecordBatch.from_arrays(_sorted_pairs(h[x[good]], h[y[good]]), names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(c).to_numpy() for c in names]
            columns.append(np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint8).reshape(-1, 36))
            # what comes before the last group is whole
            same = np.ones(len(batch), bool)
            for c in columns[:3]:
                same &= c == c[-1]
            whole = int(np.argmax(same))
            if whole or (held and any(held[-1][c][-1] != columns[c][0] for c in range(3))):
                held.append([c[:whole] for c in columns])
                yield from pairs()
                held.clear()
            held.append([c[whole:] for c in columns])
        if held:
            yield from pairs()

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "root").mapInArrow(run, "a long, b long").distinct()


def line_keys(lines: Lines, these: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the lines named by ``these``, each key's line, and what is known of it.

    The latter has below the sign bit: 14 of the key's place, 16 of the line's
    words, one that is set if the key belongs to a run of the line as the longer
    one, and 32 of the parities of its word counts.
    """
    size = lines.size[these]
    if not len(size):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    line = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
    words = lines.words.hash[np.repeat(lines.first[these], size) + place]
    odd = np.bitwise_xor.reduceat(np.uint64(1) << (words >> np.uint64(59)), np.cumsum(size) - size)
    # words in a run, by the length of the longer line; which of them some longer line of the allowed length has
    most = int(size.max() / similarity + 1e-9) + 1
    length = np.arange(most + 1)
    run = length // (allowed(length, similarity) + 1)
    last = np.minimum((size / similarity + 1e-9).astype(np.int64), most)
    has = lambda test: np.concatenate([[0], np.cumsum(test)])[last + 1] > np.concatenate([[0], np.cumsum(test)])[size]
    edits = allowed(length, similarity)
    found = []
    for k in (1, 2, 3):
        asked = has((run == k if k < 3 else run >= 3) & (edits > 0))
        if not asked.any():
            continue
        full = has((run == 3) & (edits > 0)) if k == 3 else asked
        fits = np.flatnonzero(asked[line] & (place + k <= size[line]))
        if not len(fits):
            continue
        h = words[fits]
        for j in range(1, k):
            h = mix(h * np.uint64(3) + words[fits + j])
        own, at = line[fits], place[fits]
        # runs of the line as the longer one, and the edits that leave one of them whole
        width = run[size[own]]
        runs = edits[size[own]] + 1
        longer = (np.minimum(width, 3) == k) & (runs > 1)
        wide = longer & (width >= 4)
        start = longer & (at % np.maximum(np.where(wide, 4, k), 1) == 0) & (at // np.maximum(np.where(wide, 4, k), 1) < runs)
        next_smaller = np.zeros(len(h), bool)
        next_smaller[:-1] = h[1:] < h[:-1]
        moved = np.flatnonzero(start & wide & next_smaller)
        start[moved] = False
        start[moved + 1] = True
        kept = full[own] | start
        if k == 3:  # the smaller of each two neighbours
            beside = own[1:] == own[:-1]
            kept[1:] |= beside & (h[1:] <= h[:-1])
            kept[:-1] |= beside & (h[:-1] <= h[1:])
            kept |= size[own] == 3
        found.append((mix(h[kept] + np.uint64(k)), own[kept], at[kept], start[kept]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, own, at, start = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((key, own))
    key, own, at, start = key[order], own[order], at[order], start[order]
    # a line's key once
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    begin = np.flatnonzero(new)
    again = np.diff(np.append(begin, len(key))) > 1
    at = np.where(again, ANYWHERE, np.minimum(at[begin], ANYWHERE))
    start = np.logical_or.reduceat(start, begin)
    key, own = key[begin], own[begin]
    info = (at << 49) | (np.minimum(size[own], LONG) << 33) | (start.astype(np.int64) << 32) | odd[own].astype(np.int64)
    return key.view(np.int64), own, info


def met(key: np.ndarray, h: np.ndarray, info: np.ndarray, similarity: float, at_once: int = 1 << 20):
    """Pairs of lines that share a key and may be near; rows are sorted by key and info, no key is cut."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    ends = np.append(np.flatnonzero(new), len(key))
    many = np.diff(ends)[group] > 1
    at, size, odd = info >> 49, (info >> 33) & LONG, (info & 0xFFFFFFFF).astype(np.uint64)
    place = (group << 15) | at
    longer = np.flatnonzero(many & ((info >> 32) & 1 == 1))
    edits = allowed(size[longer], similarity)
    free = (at[longer] == ANYWHERE) | (size[longer] == LONG)
    base = group[longer] << 15
    low = np.where(free, ends[group[longer]], np.searchsorted(place, base + np.maximum(at[longer] - edits, 0)))
    high = np.where(free, ends[group[longer] + 1], np.searchsorted(place, base + np.minimum(at[longer] + edits, ANYWHERE - 1), "right"))
    # and those with the key anywhere
    tail = np.where(free, high, np.searchsorted(place, base + ANYWHERE))
    tail_end = ends[group[longer] + 1]
    low, high = np.concatenate([low, tail]), np.concatenate([high, np.where(free, high, tail_end)])
    longer, edits = np.concatenate([longer, longer]), np.concatenate([edits, edits])
    count = high - low
    some = count > 0
    longer, edits, low, count = longer[some], edits[some], low[some], count[some]
    # parts of bounded size; a longer list is cut
    cut = -(-count // at_once)
    nth = np.arange(int(cut.sum())) - np.repeat(np.cumsum(cut) - cut, cut)
    longer, edits = np.repeat(longer, cut), np.repeat(edits, cut)
    low, count = np.repeat(low, cut) + nth * at_once, np.minimum(np.repeat(count, cut) - nth * at_once, at_once)
    total = np.cumsum(count)
    begin = 0
    while begin < len(count):
        stop = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + at_once, "right")))
        n = count[begin:stop]
        x = np.repeat(longer[begin:stop], n)
        y = np.repeat(low[begin:stop], n) + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        most = np.repeat(edits[begin:stop], n)
        less = size[x] - size[y]
        shift = at[x] - at[y]
        sure = (at[x] < ANYWHERE) & (at[y] < ANYWHERE)
        good = (less >= 0) & (less <= most) & (np.bitwise_count(odd[x] ^ odd[y]) <= 2 * most) & (~sure | (np.abs(shift) + np.abs(less - shift) <= most))
        good = (good | (size[x] == LONG)) & (h[x] != h[y])
        x, y = x[good], y[good]
        if len(x):
            pair = np.unique(np.stack([np.minimum(h[x], h[y]), np.maximum(h[x], h[y])], axis=1), axis=0)
            yield pair[:, 0], pair[:, 1]
        begin = stop


def _keyed(rows: DataFrame, similarity: float) -> DataFrame:
    """``key``, ``h`` and ``info`` of every line's keys."""

    def run(batches):
        seen: set[int] = set()  # spares the shuffle most equal lines
        for batch in batches:
            for piece in pieces(batch, "text"):
                lines = Lines(piece.column("text"))
                fresh = []
                for i, h in enumerate(lines.hash.tolist()):
                    if h not in seen:
                        seen.add(h)
                        fresh.append(i)
                if len(seen) > 200_000:
                    seen.clear()
                fresh = np.array(fresh, np.int64)
                key, own, info = line_keys(lines, fresh, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(lines.hash[fresh][own]), pa.array(info)], names=["key", "h", "info"])

    return rows.select("text").mapInArrow(run, "key long, h long, info long")


def _pairs(keyed: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a``, ``b`` of lines that meet in a key and may be near."""

    def run(batches):
        held: list[list[np.ndarray]] = []

        def pairs():
            key, h, info = (np.concatenate(x) for x in zip(*held))
            for a, b in met(key, h, info, similarity):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not len(batch):
                continue
            columns = [batch.column(c).to_numpy() for c in ("key", "h", "info")]
            # what comes before the last key is whole
            whole = int(np.searchsorted(columns[0], columns[0][-1]))
            if whole or (held and held[-1][0][-1] != columns[0][0]):
                held.append([c[:whole] for c in columns])
                yield from pairs()
                held.clear()
            held.append([c[whole:] for c in columns])
        if held:
            yield from pairs()

    return keyed.repartition("key").sortWithinPartitions("key", "info").mapInArrow(run, "a long, b long").distinct()


def within(x: list[bytes], y: list[bytes], similarity: float) -> np.ndarray:
    """Which pairs of sketches allow the edits: an edit changes the size by one at most, and two parities."""
    return _within(*(np.frombuffer(b"".join(s), np.uint8).reshape(len(s), 36) for s in (x, y)), similarity)


def _within(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    m, n = (np.ascontiguousarray(s[:, :4]).view(np.uint32)[:, 0].astype(np.int64) for s in (a, b))
    most = allowed(np.maximum(m, n), similarity)
    odd = np.bitwise_count(np.ascontiguousarray(a).view(np.uint32)[:, 1:] ^ np.ascontiguousarray(b).view(np.uint32)[:, 1:])
    return (np.abs(m - n) <= most) & (odd.sum(axis=1, dtype=np.int64) <= 2 * most)


def _sketched(pairs: DataFrame, sketches: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose ``sketches`` allow the edits."""
    both = pairs.join(sketches.toDF("a", "x"), "a").join(sketches.toDF("b", "y"), "b")

    def judge(batches):
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(within(batch.column("x").to_pylist(), batch.column("y").to_pylist(), similarity)))

    return stage(both.mapInArrow(judge, "a long, b long"), "line-pairs")


def _verified(pairs: DataFrame, distinct: DataFrame, rows: DataFrame, settings: Settings) -> DataFrame:
    """The pairs whose lines are near; ``distinct`` has h and the row of an occurrence."""
    wanted = pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct().join(distinct.select("h", "row"), "h")
    words = stage(_words(rows, stage(wanted, "lines-wanted")), "line-words")
    similarity = settings.similarity
    both = pairs.join(words.toDF("a", "x"), "a").join(words.toDF("b", "y"), "b")

    def verify(batches):
        for batch in batches:
            good = [alike(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return stage(both.mapInArrow(verify, "a long, b long"), "line-links")


def meetings(seen: DataFrame, settings: Settings) -> DataFrame:
    """``_meetings`` of the blocks of all lines; blocks are dealt to lots, one after the other, of which each is shuffled alone."""
    lots = min(LOTS, 1 + seen.count() // LOT)
    blocks_ = seen.where(F.col("blocks").isNotNull()).select(F.explode("blocks").alias("block"), "h", "sim", "info")
    key = F.shiftright("block", PLACE_BITS)
    placed = F.col("info").bitwiseOR(F.shiftleft(F.col("block").bitwiseAND(F.lit(FREE).cast("long")), 48))
    keyed = blocks_.select(key.alias("key"), "h", "sim", placed.alias("info"))
    found = [stage(_meetings(keyed.where(F.pmod("key", F.lit(lots)) == lot), settings), "line-meetings") for lot in range(lots)]
    return reduce(lambda a, b: a.unionByName(b), found)


def near_lines(seen: DataFrame, distinct: DataFrame, rows: DataFrame, settings: Settings, met_: DataFrame | None = None) -> DataFrame:
    """``node`` and ``root`` of all lines that are linked to another one; ``met_`` are the ``meetings`` of ``seen``."""
    sketches = stage(seen.where(F.col("sketch").isNotNull()).select("h", "sketch").dropDuplicates(["h"]), "line-sketches")
    linked = lambda pairs: settle(lambda: _verified(_sketched(pairs, sketches, settings.similarity), distinct, rows, settings), "line-links")
    if settings.radius >= 64:
        pairs = stage(_pairs(_keyed(rows, settings.similarity), settings.similarity), "line-pairs")
        return components(pairs if pairs.isEmpty() else linked(pairs), "a", "b")
    met_ = meetings(seen, settings) if met_ is None else met_
    pairs = stage(met_.where(F.col("key").isNull()).select("a", "b").distinct(), "line-pairs")
    if pairs.isEmpty():
        return components(pairs, "a", "b")
    roots = components(linked(pairs), "a", "b")
    # a key's line is a member once, see ``_meetings``
    members = met_.where(F.col("key").isNotNull()).select("key", F.col("a").alias("h"), "sim", "info")
    rest = stage(_others(members, roots, sketches, settings).join(pairs, ["a", "b"], "left_anti"), "line-pairs")
    if rest.isEmpty():
        return roots
    late = settle(lambda: _verified(rest, distinct, rows, settings), "line-links")
    return roots if late.isEmpty() else extended(roots, late, "a", "b")


def surplus(docs: DataFrame, settings: Settings = WHOLE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (its key) and ``drop``, the sorted numbers of its lines that go."""
    rows = docs.select(docs[doc_id].alias("doc_id"), row_key(docs[doc_id], docs[text]).alias("row"), docs[text].alias("text"))
    seen = stage(_occurrences(rows, settings), "lines")
    met_ = None
    if settings.radius < 64:
        met_ = meetings(seen, settings)
        # blocks are most of the lines' bytes
        whole, seen = seen, stage(seen.drop("sim", "info", "blocks"), "lines")
        discard(whole)
    place = F.struct("doc_id", "row", "line")
    # equal rows are one occurrence: count their lines once
    distinct = stage(seen.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")), "distinct-lines")
    roots = settle(lambda: near_lines(seen, distinct.select("h", "first.row"), rows, settings, met_), "components")
    grouped = distinct.select("h", "first").join(roots.withColumnRenamed("node", "h"), "h")
    firsts = grouped.groupBy("root").agg(F.min("first").alias("keep"))
    near = grouped.join(firsts, "root").select("h", "keep")
    equal = distinct.where(F.col("first") != F.col("last")).join(near, "h", "left_anti").select("h", F.col("first").alias("keep"))
    keep = stage(near.unionByName(equal), "line-groups")
    gone = seen.join(keep, "h").where(place != F.col("keep")).select("row", "line").distinct()
    return gone.groupBy("row").agg(F.sort_array(F.collect_list("line")).alias("drop"))


def _without(docs: DataFrame, settings: Settings, doc_id: str, text: str) -> tuple[DataFrame, str, str]:
    """``docs`` with the lines to drop and the number of lines; the names of these columns."""
    key, drop = "__row", "__drop"
    dropped = settle(lambda: surplus(docs, settings, doc_id, text), "surplus-lines").select(F.col("row").alias(key), F.col("drop").alias(drop))
    # the text need not be sorted: a partition's drops are the smaller side
    return docs.withColumn(key, row_key(docs[doc_id], docs[text])).join(dropped.hint("shuffle_hash"), key, "left"), key, drop


def deduplicate(docs: DataFrame, settings: Settings = WHOLE, doc_id: str = "doc_id", text: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with the surplus lines taken out of the text; with ``report`` also n_lines and n_dropped."""
    joined, key, drop = _without(docs, settings, doc_id, text)
    extra = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())] if report else []
    schema = T.StructType([f for f in docs.schema.fields if not report or f.name not in ("n_lines", "n_dropped")] + extra)
    names = [f.name for f in schema.fields]

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            texts, total, gone = [], [], []
            for t, numbers in zip(batch.column(text).to_pylist(), batch.column(drop).to_pylist()):
                total.append(0 if t is None else t.count("\n") + 1)
                gone.append(len(numbers or ()))
                if numbers:
                    numbers = set(numbers)
                    t = "\n".join(line for i, line in enumerate(t.split("\n")) if i not in numbers)
                texts.append(t)
            made = {text: pa.array(texts, out.field(text).type)}
            if report:
                made |= {"n_lines": pa.array(total, pa.int64()), "n_dropped": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays([made[n] if n in made else batch.column(n).cast(out.field(n).type) for n in names], schema=out)

    return joined.select(*[n for n in names if n not in ("n_lines", "n_dropped") or not report], drop).mapInArrow(run, schema)
