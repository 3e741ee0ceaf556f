import itertools
import os
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbtide import session
from ebbtide.llm import fuzzy_lines as fl
from ebbtide.llm.graph import may_hold, membership
from ebbtide.llm.order_minhash import edits_within


def normal(line):
    return tuple(re.findall(r"[0-9a-z\x80-\U0010ffff]+", line.lower()))


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(2)
    vocabulary = ["w%d" % i for i in range(400)]
    lines = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    for line in list(lines[:25]):  # near lines
        words = line.split()
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        lines.append(" ".join(words))
    lines += [lines[3].upper() + "!!", "  " + lines[4], "", "---", " ".join(["long"] * 700), " ".join(["long"] * 699)]
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randrange(1, 9))) for _ in range(50)]
    rows = [(i * 7 % 50, t, "x") for i, t in enumerate(texts)] + [(60, None, "x"), (61, "", "x"), (62, "\n\n", "x"), (None, texts[0], "y"), (63, lines[0] + "\r\n" + lines[0], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_lines string")


def brute(rows):
    """Texts without surplus lines, from all pairs of different lines."""
    settings = fl.Settings(radius=64)
    seen = {}
    for r in rows:
        for n, line in enumerate((r["text"] or "").split("\n")):
            if normal(line):
                seen.setdefault(normal(line), []).append(((r["doc_id"] is not None, r["doc_id"] or 0), n, r["text"]))
    keys = sorted(seen)
    lines = fl.Lines(pa.array([" ".join(k) for k in keys]))
    words = [np.frombuffer(lines.packed(i), np.uint32) for i in range(len(keys))]
    sims = lines.simhash().view(np.uint64)
    root = list(range(len(keys)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(keys)), 2):
        limit = int(max(len(words[i]), len(words[j])) * (1 - settings.similarity) + 1e-9)
        if int(sims[i] ^ sims[j]).bit_count() <= settings.radius and edits_within(words[i], words[j], limit) is not None:
            root[top(i)] = top(j)
    first = {}
    for i, k in enumerate(keys):
        first[top(i)] = min([*seen[k], *([first[top(i)]] if top(i) in first else [])])
    out = []
    for r in rows:
        if r["text"] is None:
            out.append((r["doc_id"], None))
            continue
        kept = []
        for n, line in enumerate(r["text"].split("\n")):
            if not normal(line) or first[top(keys.index(normal(line)))] == ((r["doc_id"] is not None, r["doc_id"] or 0), n, r["text"]):
                kept.append(line)
        out.append((r["doc_id"], "\n".join(kept)))
    return sorted(out, key=str)


def test_against_all_pairs(made):
    got = fl.deduplicate(made, fl.Settings(radius=64))
    assert got.columns == made.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == brute(made.collect())
    assert any(t != r for t, r in zip(brute(made.collect()), sorted(((r["doc_id"], r["text"]) for r in made.collect()), key=str)))


def test_report_and_clashing_names(made):
    got = fl.deduplicate(made, report=True)
    assert sorted(got.columns) == ["doc_id", "n_dropped", "n_lines", "text"]
    lost = sum((r["text"] or "").count("\n") for r in made.collect()) - sum((r["text"] or "").count("\n") for r in got.collect())
    assert 0 <= got.agg(F.sum("n_dropped")).first()[0] - lost <= got.count()


def test_odd_rows(documents, nothing):
    got = {(r["doc_id"], r["n_chars"]): r["text"] for r in fl.deduplicate(documents).collect()}
    assert got[3, None] is None and got[4, 0] == "" and got[6, 5] == "\n\n  \n"
    assert got[1, 56] and got[2, 56] == ""
    assert fl.deduplicate(nothing).count() == 0
    assert fl.deduplicate(documents).count() == documents.count()


def test_simhash_of_long_lines_against_counting():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(n)) for n in (1, 2, 254, 255, 256, 600, 1500)]
    lines = fl.Lines(pa.array(["\n".join(texts), *texts]))
    got = lines.simhash().view(np.uint64)
    for i in range(len(lines.first)):
        own = lines.words.hash[lines.first[i] : lines.first[i] + lines.size[i]]
        bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1)
        # the bits of a hash are kept byte by byte, each byte's from the lowest
        want = {int(b) for b in range(64) if ((own >> np.uint64(b)) & np.uint64(1)).sum() * 2 > len(own)}
        assert int(got[i]).bit_count() == len(want) == int((bits.sum(axis=0, dtype=int) * 2 > len(own)).sum())
    assert (got[: len(texts)] == got[len(texts) :]).all()


def test_fingerprints_on_both_sides_of_zero_are_compared_by_bits():
    settings = fl.Settings()
    rng = np.random.default_rng(4)
    sim = rng.integers(-(1 << 63), 1 << 63, 400, dtype=np.int64)
    other = sim.copy()
    for i in range(400):  # every other one within the radius, the sign bit among those that differ
        for bit in {63, *rng.choice(63, 7 if i % 2 else 40, replace=False).tolist()}:
            other[i] ^= np.int64(-(1 << 63)) if bit == 63 else np.int64(1 << bit)
    both, info = np.concatenate([sim, other]), np.full(800, 30 << 32)
    good = fl._may_be_near(both, info, np.arange(400), np.arange(400, 800), settings)
    want = [(int(a) ^ int(b)) & ((1 << 64) - 1) for a, b in zip(sim, other)]
    assert good.tolist() == [w.bit_count() <= settings.radius for w in want] and good.sum() == 200


def test_lines_of_one_edit_share_a_block():
    rng = random.Random(0)
    for _ in range(200):
        words = ["w%d" % rng.randrange(50) for _ in range(rng.randrange(5, 10))]
        other = list(words)
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            other[at] = "new"
        elif kind == 1:
            del other[at]
        elif len(words) < 9:
            other.insert(at, "new")
        lines = fl.Lines(pa.array([" ".join(words), " ".join(other)]))
        key, own = fl.blocks(lines, np.arange(2), fl.Settings())
        assert set(key[own == 0]) & set(key[own == 1]), (words, other)


def test_blocks_are_bounded_and_the_same_in_any_piece():
    rng = random.Random(1)
    texts = [" ".join("w%d" % rng.randrange(300) for _ in range(n)) for n in [0, 1, 3, 4, 5, 9, 10, 12, 30, 200, 5000]]
    key, own = fl.blocks(fl.Lines(pa.array(texts)), np.arange(10), fl.Settings())  # the empty one is no line
    together = {i: set(key[own == i].tolist()) for i in range(10)}
    sizes = [len(together[i]) for i in range(10)]
    assert sizes[:3] == [0, 0, 1] and sizes[3] == 6 and all(n == 5 for n in sizes[5:]) and max(sizes) <= 16
    for i, text in enumerate(texts[1:]):
        own_key, _ = fl.blocks(fl.Lines(pa.array([text])), np.arange(1), fl.Settings())
        assert set(own_key.tolist()) == together[i]


@pytest.mark.parametrize("exact", [True, False])
def test_links_of_a_table(spark, exact):
    """The default finds at least nine tenths of the links that the exact way finds, and no others."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    groups = {}
    for settings in (fl.Settings(radius=64), fl.Settings() if not exact else fl.Settings(radius=64)):
        rows = docs.select("doc_id", fl.row_key(docs["doc_id"], docs["text"]).alias("row"), "text")
        seen = fl._occurrences(rows, settings)
        distinct = seen.groupBy("h").agg(F.first("row").alias("row"))
        groups[settings.radius] = {r["node"]: r["root"] for r in fl.near_lines(seen, distinct, rows, settings).collect()}
    whole, own = groups[64], groups[64 if exact else fl.Settings().radius]
    assert whole and set(own) <= set(whole)
    same = [own.get(n) is not None and own.get(n) == own.get(r) for n, r in whole.items() if n != r]
    assert sum(same) >= (1.0 if exact else 0.9) * len(same)
    assert all(whole[n] == whole[r] for n, r in own.items())


def test_variants_of_one_line_cost_few_pairs(spark):
    rng = random.Random(5)
    vocabulary = ["w%d" % i for i in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(30)]
    rows = [(i, " ".join(edited(rng, base, 2, vocabulary))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    settings = fl.Settings(block=200)
    keyed = docs.select("doc_id", fl.row_key(docs["doc_id"], docs["text"]).alias("row"), "text")
    seen = fl._occurrences(keyed, settings)
    met = fl._meetings(seen.where("blocks is not null").select(F.explode("blocks").alias("key"), "h", "sim", "info"), settings)
    assert met.where("key is null").select("a", "b").distinct().count() <= (settings.beside + 1) * settings.runs * 1500
    left = [r["text"] for r in fl.deduplicate(docs, settings).collect()]
    assert sum(t != "" for t in left) == 1


def test_lines_of_a_text():
    lines = fl.Lines(pa.array(["One two\n\n  three", None, "ONE, two!\nx"]))
    assert list(zip(lines.row.tolist(), lines.number.tolist(), lines.size.tolist())) == [(0, 0, 2), (0, 2, 1), (2, 0, 2), (2, 1, 1)]
    assert lines.hash[0] == lines.hash[2] and len(set(lines.hash.tolist())) == 3


def test_membership_filter(spark):
    values = [3, -5, 1 << 40, -(1 << 50) + 7, (1 << 23) - 1, 0, 32767, 32768]
    bits = membership(spark.createDataFrame([(v,) for v in values], "h long"), "h")
    assert may_hold(bits, np.array(values)).all()
    assert not may_hold(bits, np.array([1, 2, 4, 100, 32769])).any()
    assert not membership(spark.createDataFrame([], "h long"), "h").any()


def edited(rng, words, edits, vocabulary):
    """The words after so many random edits."""
    words = list(words)
    for _ in range(edits):
        i, kind = rng.randrange(len(words)), rng.randrange(3)
        words[i : i + (kind != 1)] = [] if kind == 2 and len(words) > 1 else [rng.choice(vocabulary)]
    return words


@pytest.mark.parametrize("size", [3, 50, 4000])
@pytest.mark.parametrize("similarity", [0.8, 0.9, 0.65])
def test_keys_miss_no_pair(size, similarity):
    rng = random.Random(size)
    vocabulary = ["v%d" % i for i in range(size)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 4, 5, 6, 8, 9, 10, 15, 16, 20, 31, 50, 90]))]
        most = int(len(words) * (1 - similarity) + 1e-9)
        even = list(words)  # edits as far apart as can be
        for i in range(most):
            even[min((i + 1) * (len(words) // most) - 1, len(words) - 1)] = "other"
        texts += [words, edited(rng, words, most, vocabulary), even]
    lines = fl.Lines(pa.array([" ".join(w) for w in texts]))
    these = np.unique(lines.hash, return_index=True)[1]
    key, own, info = fl.line_keys(lines, these, similarity)
    order = np.lexsort((info, key))
    h = lines.hash[these][own]
    found = []
    for at_once in (1 << 20, 5):
        found.append({p for a, b in fl.met(key[order], h[order], info[order], similarity, at_once) for p in zip(a.tolist(), b.tolist())})
    assert found[0] == found[1]
    words = {int(lines.hash[i]): np.frombuffer(lines.packed(i), np.uint32) for i in these}
    want = set()
    for a, b in itertools.combinations(sorted(words), 2):
        if edits_within(words[a], words[b], int(max(len(words[a]), len(words[b])) * (1 - similarity) + 1e-9)) is not None:
            want.add((a, b))
    assert len(want) > 20 and want <= found[0]


def test_near_lines_beyond_the_fingerprints_reach(spark):
    rng = random.Random(8)
    vocabulary = ["w%d" % i for i in range(2000)]
    rows = []
    for i in range(120):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(10, 60))]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(edited(rng, words, len(words) // 5, vocabulary)))]
    got = {r["doc_id"]: r["text"] for r in fl.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), fl.Settings(radius=64)).collect()}
    assert all((got[i] == "") == bool(i % 2) for i in got)


def test_sketches_allow_every_near_line_and_few_others():
    rng = random.Random(8)
    near, far = [], []
    for _ in range(300):
        words = ["w%d" % rng.randrange(500) for _ in range(rng.randrange(5, 120))]
        other = list(words)
        for _ in range(len(words) // 5):
            at = rng.randrange(len(other))
            other[at : at + rng.randrange(2)] = ["w%d" % rng.randrange(500)] * rng.randrange(2)
        near.append((words, other))
        if len(words) > 20:
            cut = len(words) * 6 // 10
            far.append((words, words[:cut] + ["v%d" % rng.randrange(5000) for _ in words[cut:]]))
    for pairs, least, most in ((near, 1, 1), (far, 0, 0.1)):
        lines = [fl.Lines(pa.array([" ".join(p[i]) for p in pairs])) for i in (0, 1)]
        x, y = ([own.sketch(i) for i in range(len(pairs))] for own in lines)
        edits = [edits_within(*(np.frombuffer(own.packed(i), np.uint32) for own in lines), 200) for i in range(len(pairs))] if pairs is near else None
        good = fl.within(x, y, 0.8)
        if edits is not None:
            assert all(good[i] for i, (a, b) in enumerate(pairs) if edits[i] is not None and edits[i] <= int(max(len(a), len(b)) * 0.2 + 1e-9))
        assert least * 0.9 <= good.mean() <= max(most, 0.1)


def test_shuffles_of_a_written_step_are_gone(spark):
    places = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    held = lambda: {f for d in places for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}
    before, set_before = held(), spark.conf.get(session.TIDY, "false")
    made = fl.stage(spark.range(5000).groupBy((F.col("id") % 70).alias("k")).count().repartition(3), "tidy")
    assert sorted(r["count"] for r in made.collect())[0] == 71 and not held() - before
    assert spark.conf.get(session.TIDY, "false") == set_before


def test_members_of_crowded_keys_come_once(spark):
    rng = random.Random(5)
    rows = [(k, h, 0, (10 << 32)) for k in range(3) for h in range(90)] * 2
    rng.shuffle(rows)
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        met = fl._meetings(spark.createDataFrame(rows, "key long, h long, sim long, info long").repartition(4), fl.Settings(block=40))
        members = [(r["key"], r["a"]) for r in met.where("key is not null").collect()]
    finally:
        spark.conf.set(size, before)
    assert sorted(members) == [(k, h) for k in range(3) for h in range(90)]


def test_all_of_a_crowded_key_are_compared(spark):
    rng = random.Random(12)
    vocabulary = ["w%d" % i for i in range(5000)]
    same = ["all", "of", "these", "share"]
    lines = [same + [rng.choice(vocabulary) for _ in range(16)] for _ in range(300)]
    near = [same + edited(rng, line[4:], 4, vocabulary) for line in lines]
    rows = list(enumerate(" ".join(w) for w in lines + near))
    got = {r["doc_id"]: r["text"] for r in fl.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), fl.Settings(radius=64)).collect()}
    assert sorted(i for i, text in got.items() if text) == list(range(300))


@pytest.mark.parametrize("size", [10, 14, 15, 23, 40, 61])
def test_near_lines_of_several_edits_share_a_block(size):
    rng = random.Random(size)
    settings, missed = fl.WHOLE, 0
    vocabulary = ["v%d" % i for i in range(500)]
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(size)]
        other = list(words)
        # edits as far apart as they can be, so that few runs stay whole
        most = int(size * 0.2 + 1e-9)
        for e in range(most):
            at = min(len(other) - 1, (e + 1) * size // (most + 1))
            if rng.random() < 0.7:
                other[at] = "new%d" % e
            else:
                del other[at]
        lines = fl.Lines(pa.array([" ".join(words), " ".join(other)]))
        key, own = fl.blocks(lines, np.arange(2), settings)
        missed += not set(key[own == 0].tolist()) & set(key[own == 1].tolist())
    assert missed == 0


@pytest.mark.parametrize("size", [8, 9, 10, 13, 16, 20])
def test_no_near_line_changes_all_runs_taken(size):
    """Whatever the order of runs; and far fewer runs are taken than two an edit and one."""
    rng = np.random.default_rng(size)
    lines = fl.Lines(pa.array([" ".join("v%d" % i for i in range(size))]))
    taken = []
    for _ in range(20):
        common = rng.integers(0, 256, fl.SLOTS).astype(np.uint8)
        key, _ = fl.blocks(lines, np.arange(1), fl.WHOLE, common)
        h = lines.words.hash
        run = (fl.mix(h[:-1] * np.uint64(3) + h[1:]) >> np.uint64(8)) | (common[fl._slot(h[:-1])].astype(np.uint64) << np.uint64(56))
        places = np.flatnonzero(np.isin(run.view(np.int64), key)).tolist()
        taken.append(len(places))
        for longer in range(size, int(size / 0.8 + 1e-9) + 1):
            edits = int(longer * 0.2 + 1e-9)
            for inserted in range(longer - size, edits + 1):
                others = edits - inserted
                # the runs in order, each changed by an insertion or, with the next one, by another edit
                left = [(0, inserted, others)]
                while left:
                    at, i, o = left.pop()
                    assert at < len(places), (places, longer)
                    if i:
                        left.append((at + 1, i - 1, o))
                    if o:
                        left.append((at + 1 + (at + 1 < len(places) and places[at + 1] == places[at] + 1), i, o - 1))
    assert max(taken) <= 2 * int(size / 0.8 * 0.2 + 1e-9) + 1 and (size < 13 or np.mean(taken) < 2 * int(size * 0.2 + 1e-9) + 1)


@pytest.mark.parametrize("size", [10, 15, 23, 40, 61])
@pytest.mark.parametrize("ordered", [True, False])
def test_near_lines_share_a_run_in_any_order(size, ordered):
    rng = random.Random(size)
    common = np.random.default_rng(size).integers(0, 256, fl.SLOTS).astype(np.uint8) if ordered else None
    vocabulary = ["v%d" % i for i in range(40 if size % 2 else 500)]
    texts = []
    for _ in range(150):
        words = [rng.choice(vocabulary) for _ in range(size)]
        texts += [words, edited(rng, words, int(size * 0.2 + 1e-9), ["new%d" % i for i in range(9)]), list(words)]
        for i in range(int(size / 0.8 + 1e-9) - size):  # words put in, as many as the longer line allows
            texts[-1].insert((i + 1) * (size + i) // (size // 4 + 1), "put")
    lines = fl.Lines(pa.array([" ".join(w) for w in texts]))
    key, own = fl.blocks(lines, np.arange(len(texts)), fl.WHOLE, common)
    held = [set(key[own == i].tolist()) for i in range(len(texts))]
    for i in range(0, len(texts), 3):
        for j in (i + 1, i + 2):
            a, b = (np.frombuffer(lines.packed(x), np.uint32) for x in (i, j))
            if edits_within(a, b, int(max(len(a), len(b)) * 0.2 + 1e-9)) is not None and (len(a) != len(b) or (a != b).any()):
                assert held[i] & held[j], (texts[i], texts[j])


def test_complete_blocks_are_fewer_than_runs_of_three_words_need():
    """A line of 40 words took 31 runs of three words; and common words don't make blocks where a line has rare ones."""
    rng = random.Random(2)
    texts = [" ".join("c%d" % rng.randrange(20) if i % 2 else "r%d" % rng.randrange(10**9) for i in range(40)) for _ in range(200)]
    lines = fl.Lines(pa.array(texts))
    common = np.zeros(fl.SLOTS, np.uint8)
    common[fl._slot(fl.Lines(pa.array([" ".join("c%d" % i for i in range(20))])).words.hash)] = 200
    key, own = fl.blocks(lines, np.arange(200), fl.WHOLE, common)
    assert np.bincount(own).max() <= 20
    assert (np.unique(key, return_counts=True)[1] > 1).sum() == 0
