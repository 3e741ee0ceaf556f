import difflib
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from ebbtide.llm import order_minhash as om
from ebbtide.llm.batches import Words, labelled, shingles
from ebbtide.llm.graph import components, extended


def naive_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_edit_distance_against_the_full_table():
    rng = random.Random(5)
    for _ in range(400):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 30))]
        b = [x for x in a if rng.random() > 0.15] if rng.random() < 0.6 else [rng.randrange(4) for _ in range(rng.randrange(0, 30))]
        b = [rng.randrange(4) if rng.random() < 0.1 else x for x in b]
        want = naive_edits(a, b)
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        for limit in (0, 1, 3, want - 1, want, 40):
            if limit >= 0:
                assert om.edits_within(x, y, limit) == (want if want <= limit else None)


def test_profiles_never_rule_out_what_is_alike():
    rng = np.random.default_rng(7)
    for _ in range(300):
        a = rng.integers(0, 1 << 32, rng.integers(1, 60), dtype=np.uint32)
        b = a.copy()
        b[rng.random(len(b)) < 0.2] = 5
        b = b[rng.random(len(b)) > 0.1]
        if len(b) and om.alike(a, b, 0.8):
            assert om.may_be_alike(om.profile(a), om.profile(b)[None, :], len(a), np.array([len(b)]), 0.8).all()
    far = om.may_be_alike(om.profile(a), om.profile(rng.integers(0, 1 << 32, len(a), dtype=np.uint32))[None, :], len(a), np.array([len(a)]), 0.8)
    assert len(a) < 20 or not far.any()


def test_occurrence_labels():
    h = np.array([5, 5, 7, 5, 5], np.uint64)
    got = labelled(h, np.array([0, 3, 5]))
    assert got[0] == 5 and got[2] == 7 and got[3] == 5 and got[1] == got[4] and got[1] != 5


def test_words_and_shingles():
    words = Words(pa.array(["A b, C-d É x", None, "", "one two", "  "]))
    assert np.diff(words.offsets).tolist() == [6, 0, 0, 2, 0]
    h, offsets, first = shingles(words, 5)
    assert np.diff(offsets).tolist() == [2, 0, 0, 1, 0] and first.tolist() == [0, 1, 6]
    again = Words(pa.array(["zz zz", "a B c d é", "é x", "b c d é x"]))
    k, bounds, _ = shingles(again, 5)
    assert k[bounds[1]] == h[0] and k[bounds[3]] == h[1]


def test_a_sketch_depends_on_the_order():
    rng = random.Random(3)
    sentences = [" ".join(rng.choice("abcdefghij") * 3 + str(rng.randrange(99)) for _ in range(12)) for _ in range(12)]
    text, turned = " ".join(sentences), " ".join(sentences[::-1])
    same = om.sketch(pa.array([text, text.upper(), turned, "", "a b"]), om.Settings())
    assert (same[0] == same[1]).all() and not same[3].any() and same[4].any()
    assert (same[0] == same[2]).mean() < 0.7


def make(spark):
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randrange(60, 200))] for _ in range(40)]
    texts = [" ".join(w) for w in base]
    for w in base[:15]:  # near copies, of which some of near copies
        copy = list(w)
        for _ in range(4):
            copy = list(copy)
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    for w in base[15:20]:  # half of the text is another's
        texts.append(" ".join(w[: len(w) // 2] + [rng.choice(vocabulary) for _ in range(len(w) // 2)]))
    texts += [texts[0], texts[0], texts[3].upper() + "!", "a b c", "a b c", "a b d", "", "...", "..."]
    rng.shuffle(texts)
    rows = [(i * 3 % 1000, t, "x") for i, t in enumerate(texts)] + [(5000, None, "x"), (None, texts[0], "x"), (3, texts[1], "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, class_id string")


@pytest.fixture(scope="module")
def made(spark):
    return make(spark)


def brute_classes(rows):
    """Components over all pairs of different texts."""
    texts = sorted({r["text"] or "" for r in rows})
    words = Words(pa.array(texts))
    packed = [(words.hash[a:b] >> np.uint64(32)).astype(np.uint32) for a, b in zip(words.offsets, words.offsets[1:])]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(packed[i]) and len(packed[j]) and om.alike(packed[i], packed[j], 0.8):
            root[top(i)] = top(j)
    at = {t: top(i) for i, t in enumerate(texts)}
    least = {}
    for r in rows:
        if r["doc_id"] is not None:
            least[at[r["text"] or ""]] = min(least.get(at[r["text"] or ""], 1 << 60), r["doc_id"])
    return sorted(((r["doc_id"], least.get(at[r["text"] or ""])) for r in rows), key=str)


@pytest.mark.parametrize("settings", [om.Settings(), om.Settings(partners=2, block=3)])
def test_classes_against_all_pairs(made, settings):
    got = sorted((tuple(r) for r in om.membership_of(made, settings).collect()), key=str)
    want = brute_classes(made.collect())
    assert got == want


def test_one_of_each_class_stays(made):
    kept = om.first_of_each(made)
    assert kept.columns == made.columns
    got = sorted(r["doc_id"] for r in kept.collect())
    assert got == sorted({c for _, c in brute_classes(made.collect())})


def test_odd_rows(documents, nothing):
    got = om.membership_of(documents).collect()
    assert len(got) == documents.count()
    assert {r["class_id"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert {r["class_id"] for r in got if r["doc_id"] in (3, 4)} == {3}
    assert om.first_of_each(documents).count() == 6
    assert om.membership_of(nothing).count() == 0 and om.first_of_each(nothing).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 301), (301, 302), (302, 300), (400, 400)]
    got = components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [3, 50, 61]
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_ratio_of_difflib_agrees_on_near_copies():
    a = np.arange(100, dtype=np.uint32)
    b = a.copy()
    b[[3, 50, 77]] = 999
    assert om.edits_within(a, b, 20) == 3
    assert difflib.SequenceMatcher(None, a.tolist(), b.tolist(), autojunk=False).ratio() > 0.95


@pytest.mark.parametrize("block", [1024, 150])
def test_a_large_group_of_different_variants(spark, block):
    rng = random.Random(21)
    settings = om.Settings(block=block)
    base = [f"w{rng.randrange(4000)}" for _ in range(300)]
    texts = []
    for _ in range(1000):
        words = list(base)
        n = rng.randrange(24, 61)  # 8 to 20 % in one block
        start = rng.randrange(len(words) - n)
        words[start : start + n] = [f"v{rng.randrange(9000)}" for _ in range(n)]
        texts.append(" ".join(words))
    values = om.sketch(pa.array(texts), settings)
    words = Words(pa.array(texts))
    packed = [(words.hash[a:b] >> np.uint64(32)).astype(np.uint32) for a, b in zip(words.offsets, words.offsets[1:])]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    # all candidate pairs; those already of one class change nothing
    for i in range(len(texts)):
        agree = values[i + 1 :] == values[i]
        shared = np.any([agree[:, a] & agree[:, b] for a, b in om.bands(settings)], axis=0) & (agree.sum(axis=1) >= settings.agreeing)
        for j in (np.flatnonzero(shared) + i + 1).tolist():
            if top(i) != top(j) and om.alike(packed[i], packed[j], 0.8):
                root[top(i)] = top(j)
    least = {}
    for i in range(len(texts)):
        least[top(i)] = min(least.get(top(i), i), i)
    got = om.membership_of(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), settings)
    assert {r["doc_id"]: r["class_id"] for r in got.collect()} == {i: least[top(i)] for i in range(len(texts))}


def test_texts_of_a_bucket_are_compared_whatever_their_other_sketches(spark):
    words = ["w%d" % i for i in range(120)]
    edited = [w if i % 6 else "x%d" % i for i, w in enumerate(words)]  # a sixth of the words: alike, but few shingles stay
    keys = [bytes([i]) * 16 for i in range(2)]
    shared = np.arange(40).reshape(2, 20)
    shared[1, :2] = shared[0, :2]  # two sketches agree, which makes a bucket
    packed = [(Words(pa.array([" ".join(t)])).hash >> np.uint64(32)).astype(np.uint32) for t in (words, edited)]
    assert om.alike(*packed, 0.8)
    own = spark.createDataFrame([(bytearray(k), s.tolist(), len(p), bytearray(om.profile(p).tobytes())) for k, s, p in zip(keys, shared, packed)], "key binary, sketches array<long>, n_words long, profile binary")
    members = spark.createDataFrame([(1, 0, bytearray(k)) for k in keys], "bucket long, band int, key binary")
    roots = spark.createDataFrame([], "node binary, root binary")
    assert om._second_look(members, own, roots, om.Settings()).count() == 1


def test_a_text_meets_few_pivots_and_a_large_class_is_not_sent_to_itself(spark):
    settings = om.Settings()
    # text 60 has 40 buckets, with another first text each, but for three that share text 0
    rows = [(b, b % 40, bytearray([60]), bytearray([0 if b < 3 else b])) for b in range(40)]
    inside = spark.createDataFrame(rows, "bucket long, band int, key binary, a binary")
    pairs = {(bytes(r["a"]), bytes(r["b"])) for r in om._first_look(inside, settings).collect()}
    assert len(pairs) == settings.few and (bytes([0]), bytes([60])) in pairs

    key = lambda i: bytearray(i.to_bytes(4, "big"))
    classed = [(1, 0, key(i), key(0)) for i in range(1000)] + [(1, 0, key(i), key(i)) for i in range(2000, 2005)]
    classed += [(2, 1, key(i), key(i % 2)) for i in range(300)] + [(3, 2, key(i), key(0)) for i in range(300)]
    met = om._lots(spark.createDataFrame(classed, "bucket long, band int, key binary, root binary"), 100).collect()
    assert len([r for r in met if r["bucket"] == 1]) == 1000 + 5 * 11 and not [r for r in met if r["bucket"] == 3]
    groups = {}
    for r in met:
        groups.setdefault((r["bucket"], r["i"], r["j"]), []).append(r)
    found = []
    for (bucket, i, j), texts in groups.items():
        for x, y in itertools.combinations(texts, 2):
            if x["root"] != y["root"] and (i == j or x["lot"] != y["lot"]):
                found.append((bucket, *sorted((bytes(x["key"]), bytes(y["key"])))))
    assert len(found) == len(set(found)) == 1000 * 5 + 10 + 150 * 150


def test_many_edits_are_counted_by_columns():
    rng = random.Random(9)
    turned = 0
    for _ in range(150):
        a = [rng.randrange(60) for _ in range(rng.randrange(60, 200))]
        b = [rng.randrange(60) if rng.random() < 0.2 else x for x in a if rng.random() > 0.05]
        want = naive_edits(a, b)
        x, y = np.array(a, np.uint32), np.array(b, np.uint32)
        for limit in (want - 1, want, 2 * want):
            assert om.edits_within(x, y, limit) == om.edits_within(y, x, limit) == (want if want <= limit else None)
            assert om._by_columns(a, b, limit) == (want if want <= limit else None)
        turned += want > 20
    assert turned > 100


def test_more_edges_extend_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    table = lambda e: spark.createDataFrame(e, "a long, b long")
    want = {r["node"]: r["root"] for r in components(table(edges), "a", "b").collect()}
    got = {r["node"]: r["root"] for r in extended(components(table(edges[:80]), "a", "b"), table(edges[80:]), "a", "b").collect()}
    assert set(got) == set(want)
    classes = lambda found: sorted(sorted(n for n in found if found[n] == r) for r in set(found.values()))
    assert classes(got) == classes(want) and all(got[r] == r for r in got.values())


def test_the_last_step_returns_links_not_pairs(spark):
    """Texts that are not alike, though their profiles allow it, leave no row; of a group of copies links connect all."""
    words = ["w%d" % i for i in range(100)]
    texts = [words[:50] + words[50:][::-1], words[::-1], words] + [words[:i] + ["x"] + words[i + 1 :] for i in range(30)]
    packed = [(Words(pa.array([" ".join(t)])).hash >> np.uint64(32)).astype(np.uint32) for t in texts]
    rows = [(bytearray([i]), list(range(20)), len(p), bytearray(om.profile(p).tobytes()), bytearray(p.tobytes())) for i, p in enumerate(packed)]
    own = spark.createDataFrame(rows, "key binary, sketches array<long>, n_words long, profile binary, words binary")
    members = spark.createDataFrame([(1, 0, bytearray([i])) for i in range(33)], "bucket long, band int, key binary")
    roots = spark.createDataFrame([], "node binary, root binary")
    for block in (1024, 10):
        links = om._second_look(members, own, roots, om.Settings(block=block))
        found = {r["node"]: r["root"] for r in components(links, "a", "b").collect()}
        assert set(found) == {bytes([i]) for i in range(2, 33)} and len(set(found.values())) == 1
        assert block < 1024 or links.count() == 30
    # without words, the candidates
    assert om._second_look(members, own.drop("words"), roots, om.Settings()).count() == 33 * 32 // 2
