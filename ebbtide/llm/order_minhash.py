"""Near-duplicate documents by Order MinHash.

A text's k-mers are its five-word shingles, made unique by the number of earlier
equal ones. A sketch takes the few k-mers that a random order puts first and
keeps them in the order of the text, so that it depends on the order of the text
as edit distance does. Texts that share two neighbouring sketches are candidates
(one alone would gather all texts that hold some common passage). Each text is
compared with a few of its buckets' first ones, those it shares most buckets with; an alignment of the words
decides, which gives up once more words are edited than the similarity allows.
Linked texts form classes. In a few rounds each text then meets a few texts of
other classes, its neighbours in a random order of its buckets, and what links
is contracted; a large group of variants is mostly one class after that, at a few comparisons a
text. In the last step every two texts of a bucket that still are of different
classes are compared, in blocks, if counts of words, dealt to 256 slots,
don't already show too many edits, and aligned there, so that no pair leaves its task but a link; texts that links
of that task have joined need no more. So no link is lost, and nothing is left to repeat.

Equal texts are combined before all this, so that a group of copies costs one
text; the pivot of a large group is sent to as many tasks as its partners need.

Cases: a null text counts as empty, and texts without words are copies only of
texts equal to them; texts of fewer than five words are one k-mer of all words;
words are lower-cased runs of letters and digits; a class is named by its
smallest document id, null if none of its documents has one; every input row
gives one row; texts of any length take part whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbtide.llm.batches import Words, labelled, map_text, mix, pieces, shingles
from ebbtide.llm.graph import components, extended, may_hold, membership
from ebbtide.session import settle, stage


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    similarity: float = 0.8  # least share of words that needn't be edited
    sketches: int = 20
    ordered: int = 2  # k-mers in a sketch
    apart: tuple[int, ...] = (1, 2)  # sketches so far apart, around the circle, make a bucket together
    agreeing: int = 0  # sketches of two texts that agree, in the second step; 0 compares all that share a bucket
    partners: int = 256  # texts that one task aligns with a pivot
    block: int = 1024  # texts of a bucket that are compared at once in the last step
    rounds: int = 3  # of comparing a few texts of other classes, before the last step
    few: int = 4  # texts that a text is compared with in such a round
    seed: int = 3


def sketch(column: pa.Array, settings: Settings) -> np.ndarray:
    """``sketches`` values for each text with words; rows of zeros for others."""
    words = Words(column)
    h, offsets, _ = shingles(words, settings.shingle)
    h = labelled(h, offsets)
    size = np.diff(offsets)
    out = np.zeros((len(size), settings.sketches), np.uint64)
    constants = np.random.default_rng(settings.seed).integers(1, 1 << 63, (settings.sketches, 2), dtype=np.uint64) | np.uint64(1)
    few = np.flatnonzero((size > 0) & (size <= settings.ordered))
    for i in few:  # all k-mers, in the order of the text
        value = constants[:, 0]
        for x in h[offsets[i] : offsets[i + 1]]:
            value = mix(value * np.uint64(3) + x)
        out[i] = value
    many = np.flatnonzero(size > settings.ordered)
    if not len(many):
        return out
    if len(many) < np.count_nonzero(size):
        inside = np.repeat(size > settings.ordered, size)
        h = h[inside]
    size = size[many]
    starts = np.cumsum(size) - size
    for j, (a, b) in enumerate(constants):
        p = (h ^ a) * b
        p ^= p >> np.uint64(29)
        p *= np.uint64(0x94D049BB133111EB)
        places = []
        for _ in range(settings.ordered):
            least = np.minimum.reduceat(p, starts)
            at = np.flatnonzero(p == np.repeat(least, size))
            if len(at) > len(many):  # equal hashes of different k-mers: the first counts
                at = at[np.unique(np.searchsorted(starts, at, "right"), return_index=True)[1]]
            places.append(at)
            p[at] = np.uint64(0xFFFFFFFFFFFFFFFF)
        value = np.full(len(many), a)
        for at in np.sort(np.stack(places), axis=0):
            value = mix(value * np.uint64(3) + h[at])
        out[many, j] = value
    return out


COLUMN = 1 << 15  # words of the shorter sequence of which a column of the table is held


def edits_within(a: np.ndarray, b: np.ndarray, limit: int) -> int | None:
    """Edit distance of two word sequences, or None if above ``limit``.

    Follows the furthest-reaching path of each diagonal inside the band, which is quick for few edits; with many allowed it
    goes on by whole columns of the table once that has become cheaper.
    """
    n, m = len(a), len(b)
    if abs(n - m) > limit:
        return None
    if not n or not m:
        return max(n, m)
    turn = max(8, int((m * (1 + n * 1e-4)) ** 0.5))
    if limit <= 2 * turn or min(n, m) > COLUMN:
        turn = limit
    left, right, width = a.tobytes(), b.tobytes(), a.itemsize
    own, other = a.tolist(), b.tolist()

    def run(x: int, y: int) -> int:
        """Number of equal words from here on."""
        most = min(n - x, m - y)
        if most <= 0 or own[x] != other[y]:
            return 0
        done, step = 0, 8
        while done < most:
            step = min(step, most - done)
            i, j = (x + done) * width, (y + done) * width
            if left[i : i + step * width] == right[j : j + step * width]:
                done += step
                step *= 2
            elif step == 1:
                return done
            else:
                step = max(1, step // 2) if step > 1 else 1
                while step > 1 and left[i : i + step * width] != right[j : j + step * width]:
                    step //= 2
                if left[i : i + step * width] != right[j : j + step * width]:
                    return done
        return done

    goal = m - n  # diagonals are y - x
    reach = {0: run(0, 0)}
    if goal == 0 and reach[0] >= n:
        return 0
    for d in range(1, turn + 1):
        new = {}
        # a diagonal from which the goal can't be reached within the limit is left
        spare = limit - d
        for k in range(max(-d, goal - spare, -n), min(d, goal + spare, m) + 1):
            x = max(reach.get(k, -2) + 1, reach.get(k + 1, -2) + 1, reach.get(k - 1, -2))
            if x < 0:
                continue
            x = min(x, n, m - k)
            x += run(x, x + k)
            new[k] = x
            if k == goal and x >= n:
                return d
        reach = new
    return None if turn == limit else _by_columns(own, other, limit) if n <= m else _by_columns(other, own, limit)


def _by_columns(own: list, other: list, limit: int) -> int | None:
    """Edit distance of two sequences or None if above ``limit``: a column of the table is two numbers, whose bits tell where it rises and falls."""
    n = len(own)
    at: dict[int, int] = {}
    for i, x in enumerate(own):
        at[x] = at.get(x, 0) | 1 << i
    full, last = (1 << n) - 1, 1 << (n - 1)
    rises, falls, edits = full, 0, n
    left = len(other)
    for x in other:
        same = at.get(x, 0)
        down = same | falls
        across = (((same & rises) + rises) ^ rises) | same
        more = falls | (full & ~(across | rises))
        less = rises & across
        left -= 1
        if more & last:
            edits += 1
        elif less & last:
            edits -= 1
        if edits - left > limit:
            return None
        more = (more << 1) | 1
        rises = full & ((less << 1) | ~(down | more))
        falls = full & more & down
    return edits


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether at most 1 - similarity of the longer one's words are edited."""
    longer = max(len(a), len(b))
    limit = int(longer * (1 - similarity) + 1e-9)
    if abs(len(a) - len(b)) > limit:
        return False
    # words without a partner each need an edit
    x, n = np.unique(a, return_counts=True)
    y, m = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if longer - int(np.minimum(n[i], m[j]).sum()) > limit:
        return False
    return edits_within(a, b, limit) is not None


def _word_arrays(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """``key`` and the packed word hashes of every wanted text."""
    bits = rows.sparkSession.sparkContext.broadcast(membership(wanted.select(F.xxhash64("key").alias("place")), "place"))
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("words", T.BinaryType())])

    def run(batches):
        seen: set[bytes] = set()  # spares the shuffle most copies
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(bits.value, batch.column("place").to_numpy())))
            fresh = []
            for i, key in enumerate(batch.column("key").to_pylist()):
                if key not in seen:
                    fresh.append(i)
                    seen.add(key)
            if len(seen) > 200_000:
                seen.clear()
            for piece in pieces(batch.take(pa.array(fresh, pa.int64())), "text"):
                words = Words(piece.column("text"))
                packed = (words.hash >> np.uint64(32)).astype(np.uint32)
                own = [packed[a:b].tobytes() for a, b in zip(words.offsets, words.offsets[1:])]
                yield pa.RecordBatch.from_arrays([piece.column("key"), pa.array(own, pa.binary())], names=schema.names)

    return rows.select("key", F.xxhash64("key").alias("place"), "text").mapInArrow(run, schema).join(wanted, "key", "left_semi").dropDuplicates(["key"])


def verified(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs ``a``, ``b`` whose texts are alike.

    A pivot's partners are dealt to tasks of bounded size; each of these gets the pivot once.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count("*") / settings.partners).alias("parts"))
    dealt = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")))
    asked = dealt.select("a", "part", F.col("b").alias("key")).unionByName(dealt.select("a", "part", F.col("a").alias("key")).distinct())
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    similarity = settings.similarity

    def align(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        pivot = table.column("a")[0].as_py()
        words = [np.frombuffer(w, np.uint32) for w in table.column("words").to_pylist()]
        own = words[keys.index(pivot)]
        good = [k for k, w in zip(keys, words) if k != pivot and alike(own, w, similarity)]
        return pa.table({"a": pa.array([pivot] * len(good), pa.binary()), "b": pa.array(good, pa.binary())})

    return asked.join(texts, "key").groupBy("a", "part").applyInArrow(align, schema)


SLOTS = 256


def profile(words: np.ndarray) -> np.ndarray:
    """How many words fall into each slot, 65535 at most."""
    return np.minimum(np.bincount(words & np.uint32(SLOTS - 1), minlength=SLOTS), 65535).astype(np.uint16)


def may_be_alike(own: np.ndarray, others: np.ndarray, n: int, m: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the others' profiles allow the similarity: each edit changes a slot's count by one at most."""
    differ = others.astype(np.int32) - own
    least = np.maximum(np.maximum(differ, 0).sum(axis=1), np.maximum(-differ, 0).sum(axis=1))
    return least <= (np.maximum(n, m) * (1 - similarity) + 1e-9).astype(np.int64)


def _profiles(texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            words = [np.frombuffer(w, np.uint32) for w in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(w) for w in words], pa.int64()), pa.array([profile(w).tobytes() for w in words], pa.binary()), batch.column("words")], names=["key", "n_words", "profile", "words"])

    return texts.select("key", "words").mapInArrow(run, "key binary, n_words long, profile binary, words binary")


def _first_look(inside: DataFrame, settings: Settings) -> DataFrame:
    """Each text with a few first texts of its buckets, those it shares most buckets with; ``inside`` has key and the bucket's first one ``a``.

    What links goes through these pivots in most cases; the last step compares what is left of different classes.
    """
    shared = inside.where(F.col("key") != F.col("a")).groupBy("a", F.col("key").alias("b")).count()
    # a text has as many pivots as buckets at most
    spot = F.struct((-F.col("count")).alias("order"), "a")
    return shared.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(spot)), 1, settings.few).alias("few")).select(F.explode("few.a").alias("a"), "b")


def _lots(classed: DataFrame, block: int) -> DataFrame:
    """The texts of buckets with several classes, in lots of about ``block``, once for each other lot they meet (``i``, ``j``, i <= j).

    A class of more than a block has lots of its own, whose texts are not sent to each other; smaller
    classes share lots. So a large class costs its texts once for each lot of the others. No bucket is numbered in one task.
    With a column ``weight`` a text counts as so many.
    """
    weight = F.sum("weight") if "weight" in classed.columns else F.count("*")
    per = classed.groupBy("bucket", "root").agg(weight.alias("n"))
    whole = per.groupBy("bucket").agg(F.count("*").alias("roots"), F.ceil(F.sum(F.when(F.col("n") <= block, F.col("n")).otherwise(0)) / block).alias("shared")).where("roots > 1")
    # a row for each so many texts of a bucket
    along = Window.partitionBy("bucket").orderBy("root")
    large = per.where(F.col("n") > block).withColumn("parts", F.ceil(F.col("n") / block)).join(whole.select("bucket", "shared"), "bucket")
    large = large.select("bucket", "root", "parts", (F.col("shared") + F.sum("parts").over(along) - F.col("parts")).alias("first"))
    added = large.groupBy("bucket").agg(F.sum("parts").alias("added"))
    sizes = whole.join(added, "bucket", "left").select("bucket", "shared", (F.col("shared") + F.coalesce("added", F.lit(0))).alias("lots"))
    own = F.pmod(F.xxhash64("key"), F.coalesce("parts", "shared"))
    dealt = classed.join(sizes, "bucket").join(large, ["bucket", "root"], "left").withColumn("lot", F.coalesce("first", F.lit(0)) + own)
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
    apart = F.col("first").isNull() | (F.col("other") < F.col("first")) | (F.col("other") >= F.col("first") + F.col("parts"))
    return each.where(apart).select("bucket", "band", F.least("lot", "other").alias("i"), F.greatest("lot", "other").alias("j"), "lot", "key", "root")


WEIGHT = 2048  # words for which a text counts once more in the size of lots


def _second_look(members: DataFrame, own: DataFrame, roots: DataFrame, settings: Settings) -> DataFrame:
    """Candidate pairs of different classes: every two texts of a bucket whose profiles allow the similarity.

    ``members`` has bucket, band and key of buckets with several texts;
    ``own`` has key, sketches, n_words and profile. If it has ``words`` too, pairs are aligned at once, and of those that
    are alike so many are returned that all of them are connected.
    """
    classed = members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    aligned = "words" in own.columns
    if aligned:  # lots of long texts hold fewer
        classed = classed.join(own.select("key", F.ceil((F.col("n_words") + 1) / WEIGHT).alias("weight")), "key")
    met = _lots(classed, settings.block)
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
    pairs_of_sketches = np.array(bands(settings))

    def compare(table: pa.Table) -> pa.Table:
        keys = table.column("key").to_pylist()
        lot = table.column("lot").to_numpy()
        root = table.column("root").combine_chunks().dictionary_encode().indices.to_numpy()
        band = table.column("band")[0].as_py()
        values = np.array(table.column("sketches").combine_chunks().flatten()).reshape(len(keys), -1)
        sizes = table.column("n_words").to_numpy()
        profiles = np.frombuffer(b"".join(table.column("profile").to_pylist()), np.uint16).reshape(len(keys), SLOTS)
        same_lot = bool(table.column("i")[0].as_py() == table.column("j")[0].as_py())
        words = [np.frombuffer(w, np.uint32) for w in table.column("words").to_pylist()] if aligned else None
        root = root.copy()
        a, b = [], []
        for x in range(len(keys) if root.any() else 0):
            # pairs inside one class are settled
            good = root[x + 1 :] != root[x]
            if not same_lot:
                good &= lot[x + 1 :] != lot[x]
            later = np.flatnonzero(good) + x + 1
            agree = values[later] == values[x]
            # two texts meet in every bucket they share; the first one is enough
            first = (agree[:, pairs_of_sketches[:, 0]] & agree[:, pairs_of_sketches[:, 1]]).argmax(axis=1)
            later = later[(agree.sum(axis=1) >= settings.agreeing) & (first == band)]
            later = later[may_be_alike(profiles[x], profiles[later], sizes[x], sizes[later], settings.similarity)]
            if aligned:
                linked = []
                for y in later.tolist():
                    if root[y] != root[x] and alike(words[x], words[y], settings.similarity):
                        linked.append(y)
                        root[root == root[y]] = root[x]
                later = linked
            a += [min(keys[x], keys[y]) for y in later]
            b += [max(keys[x], keys[y]) for y in later]
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    return met.join(own, "key").groupBy("bucket", "i", "j").applyInArrow(compare, schema).distinct()


def _neighbours(members: DataFrame, roots: DataFrame, settings: Settings, turn: int) -> DataFrame:
    """A few pairs of different classes for each text: it and the one before it in a random order of a bucket's texts.

    The order is made anew in each turn, in lots of bounded size.
    """
    classed = members.select("bucket", "key").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    sizes = classed.groupBy("bucket").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket", F.ceil(F.col("n") / settings.block).alias("lots"))
    lots = classed.join(sizes, "bucket").withColumn("order", F.xxhash64("key", F.lit(turn))).withColumn("lot", F.pmod(F.xxhash64("order"), F.col("lots")))
    ordered = Window.partitionBy("bucket", "lot").orderBy("order", "key")
    beside = lots.select("key", "root", F.lag("key").over(ordered).alias("other"), F.lag("root").over(ordered).alias("other_root")).where(F.col("other_root") != F.col("root"))
    pairs = beside.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct()
    # a text has a pair a bucket at most; the last step sees to those left out here
    spot = F.struct(F.xxhash64("a", "b", F.lit(turn)).alias("spot"), "b")
    return pairs.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(spot)), 1, settings.few).alias("few")).select("a", F.explode("few.b").alias("b"))


def bands(settings: Settings) -> list[tuple[int, int]]:
    """The sketches that make a bucket together."""
    return [(i, (i + d) % settings.sketches) for d in settings.apart for i in range(settings.sketches)]


def classes(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Texts' keys (``key``: 16 bytes for each different text) with the class' smallest id, and its first text's key."""
    rows = docs.select(docs[doc_id].alias("doc_id"), text_key(docs[text]).alias("key"), docs[text].alias("text"))
    return settle(lambda: _classes(rows, settings), "classes"), rows


def _classes(rows: DataFrame, settings: Settings) -> DataFrame:
    fields = [T.StructField("sketches", T.ArrayType(T.LongType()))]

    def work(piece):
        values = sketch(piece.column("text"), settings)
        none = ~values.any(axis=1)
        offsets = np.arange(len(values) + 1, dtype=np.int32) * settings.sketches
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64).ravel()), mask=pa.array(none) if none.any() else None)]

    sketched = map_text(rows, ["doc_id", "key"], "text", fields, work)
    found = stage(sketched, "sketches")
    keys = stage(found.groupBy("key").agg(F.min("doc_id").alias("doc_id")), "text-keys")
    buckets_of = F.array(*[F.xxhash64(F.lit(i), F.lit(j), F.col("sketches")[i], F.col("sketches")[j]) for i, j in bands(settings)])
    # copies have the same sketches: they are combined before the shuffle
    each = found.where(F.col("sketches").isNotNull()).select("key", F.posexplode(buckets_of).alias("band", "bucket")).distinct()
    buckets = each.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("z")).where(F.col("a") != F.col("z"))
    inside = stage(each.join(buckets.select("bucket", "a"), "bucket"), "buckets")
    pairs = stage(_first_look(inside, settings), "pairs")
    wanted = inside.select("key").distinct()
    texts = stage(_word_arrays(rows, wanted), "texts")
    links = stage(verified(pairs, texts, settings), "links")
    roots = components(links, "a", "b")
    members = inside.select("bucket", "band", "key")
    for turn in range(settings.rounds):
        more = stage(_neighbours(members, roots, settings, turn).join(pairs, ["a", "b"], "left_anti"), "pairs")
        if more.isEmpty():
            break
        pairs = pairs.unionByName(more)
        found_links = stage(verified(more, texts, settings), "links")
        if not found_links.isEmpty():
            roots = extended(roots, found_links, "a", "b")
    own = found.join(wanted, "key", "left_semi").dropDuplicates(["key"]).select("key", "sketches").join(_profiles(texts), "key")
    late = stage(_second_look(members, own, roots, settings), "links")
    if not late.isEmpty():
        roots = extended(roots, late, "a", "b")
    named = keys.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))["key"].alias("first_key"))
    return named.join(least, "root").select("key", "class_id", "first_key")


def text_key(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def membership_of(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and class_id, a row for each input row."""
    found, rows = classes(docs, settings, doc_id, text)
    return rows.select("doc_id", "key").join(found.select("key", "class_id"), "key").select("doc_id", "class_id")


def first_of_each(docs: DataFrame, settings: Settings = Settings(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of each class one document, that with the smallest id.

    Of rows with that same id and text one stays.
    """
    found, rows = classes(docs, settings, doc_id, text)
    kept = found.where(F.col("key") == F.col("first_key")).select(F.col("key").alias("__key"), F.col("class_id").alias("__class"))
    keyed = docs.withColumn("__key", text_key(docs[text]))
    # by id and key: copies of one text are spread over all tasks
    stays = keyed.join(kept.hint("shuffle_hash"), (keyed["__key"] == kept["__key"]) & keyed[doc_id].eqNullSafe(kept["__class"]), "left_semi")
    # whole rows are only compared if some id and text are repeated
    if not rows.groupBy("doc_id", "key").count().where("count > 1").isEmpty():
        stays = stays.dropDuplicates(["__key"])
    return stays.select(*docs.columns)
