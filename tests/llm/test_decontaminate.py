import random
from collections import Counter

import pyarrow as pa
import pytest

from ebbtide.llm import decontaminate as dc
from tests.llm.test_fuzzy_lines import normal

SMALL = "/root/testdata/sf0.001"
EXACT = dc.Settings(exact=True)


def grams(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))) if words else Counter()


def brute(docs, items):
    """Best item-sized window of every item in every text, by trying all windows."""
    out = set()
    for doc_id, text in docs:
        words = normal(text or "")
        for item_id, item in items:
            own = normal(item or "")
            if not own:
                continue
            k = min(5, len(own))
            want = grams(own, k)
            best = 0.0
            for i in range(len(words) - len(own) + 1):
                have = grams(words[i : i + len(own)], k)
                shared = sum((want & have).values())
                best = max(best, shared / (sum(want.values()) + sum(have.values()) - shared))
            if best >= 0.8:
                out.add((doc_id, item_id, round(best, 9)))
    return out


def found(df):
    return {(r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in df.collect()}


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(4)
    vocabulary = ["w%d" % i for i in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(n)) for i, n in enumerate([3, 5, 6, 12, 20, 30, 45, 60, 60, 2])]
    docs = [(100 + i, text(80)) for i in range(15)]
    for i, item in items:
        place = rng.randrange(60)
        changed = list(item)
        if i % 2 and len(item) > 40:
            changed[0] = changed[-1] = "other"
        docs.append((200 + i, text(place) + changed + text(20)))
        docs.append((300 + i, text(10) + item[: max(len(item) // 2, 1)] + text(30)))
    rows = [(i, " ".join(w).upper() + ".") for i, w in docs] + [(1, None), (2, ""), (3, "..."), (200, " ".join(items[5][1]))]
    bench = [(i, " ".join(w)) for i, w in items] + [(50, None), (51, ""), (52, "?!")]
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, item_id string"), spark.createDataFrame([(*b, 0.5) for b in bench], "item_id long, text string, similarity double")


def test_against_all_windows(made):
    docs, bench = made
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()], [(b["item_id"], b["text"]) for b in bench.collect()])
    assert len(want) > 10
    assert found(dc.find(docs, bench, EXACT)) == want
    assert found(dc.find(docs, bench)) <= want and len(found(dc.find(docs, bench))) >= 0.9 * len(want)
    # items in several groups
    assert found(dc.find(docs, bench, dc.Settings(items_at_once=3, exact=True))) == want
    kept = dc.clean(docs, bench, dc.Settings(items_at_once=4, exact=True))
    assert kept.columns == docs.columns
    bad = {w[0] for w in want}
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] != 200) == sorted(r["doc_id"] for r in docs.collect() if r["doc_id"] not in bad | {200})


def test_test_data_against_all_windows(spark):
    docs, bench = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    items = [(b["item_id"], b["text"]) for b in bench.collect()]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if len(r["text"] or "") < 3000]
    short = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, items)
    assert found(dc.find(short, bench, EXACT)) == want
    by_fingerprint = {w[:2] for w in found(dc.find(short, bench))}
    assert by_fingerprint <= {w[:2] for w in want} and len(by_fingerprint) >= 0.9 * len(want)


def test_ids_of_items_keep_their_type(made):
    docs, bench = made
    named = bench.selectExpr("concat('item-', item_id) as item_id", "text")
    want = {(d, f"item-{i}", s) for d, i, s in found(dc.find(docs, bench))}
    got = dc.find(docs, named)
    assert got.schema["item_id"].dataType.simpleString() == "string" and found(got) == want
    assert dc.clean(docs, named).count() == dc.clean(docs, bench).count()


def test_odd_rows(documents, nothing, spark):
    bench = spark.createDataFrame([(1, "its long winding banks")], "item_id long, text string")
    assert {r["doc_id"] for r in dc.find(documents, bench).collect()} == {1, 2}
    assert dc.find(documents, bench).count() == 3
    assert dc.clean(documents, bench).count() == documents.count() - 3
    assert dc.find(nothing, bench).count() == 0 and dc.clean(nothing, bench).count() == 0
    assert dc.find(documents, bench.limit(0)).count() == 0 and dc.clean(documents, bench.limit(0)).count() == documents.count()


def test_blocks_find_all_within_the_radius():
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghijkl") for _ in range(30)) for _ in range(60)]
    index = dc.Index(list(range(60)), texts, dc.Settings())
    for probe in index.prints[:20]:
        for flips in (0, 5, 19):
            value = int(probe)
            for bit in rng.sample(range(64), flips):
                value ^= 1 << bit
            near = {i for i, p in enumerate(index.prints) if int(p ^ probe.dtype.type(value)).bit_count() <= 19}
            assert set(index.within(probe.dtype.type(value)).tolist()) == near


def test_weighted_similarity():
    a, b = pa.array([1, 1, 2, 3]).to_numpy(), pa.array([1, 2, 2, 4]).to_numpy()
    assert dc.weighted_similarity(a, b) == 2 / 6


def all_windows(texts, items):
    """Best similarity of every item in every text, with whole texts where they are shorter."""
    out = {}
    for r, words in enumerate(texts):
        for i, own in enumerate(items):
            k, n = min(5, len(own)), min(len(own), len(words))
            want = grams(own, k)
            for s in range(len(words) - n + 1):
                have = grams(words[s : s + n], k)
                shared = sum((want & have).values())
                score = shared / (sum(want.values()) + sum(have.values()) - shared)
                if score >= 0.8:
                    out[r, i] = max(out.get((r, i), 0), round(score, 9))
    return out


def test_cut_swapped_and_short_texts_against_all_windows():
    rng = random.Random(6)
    items, texts = [], []
    for n in (38, 38, 30, 45, 60, 24, 7, 5):
        item = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(n)]
        other = lambda m: ["o%d" % rng.randrange(900) for _ in range(m)]
        items.append(item)
        texts += [other(30) + item[:-3], item[3:] + other(30), item[:-1], item[1:], item[2:-2]]
        texts += [other(20) + item[: n - 3] + item[n - 2 :], item[:2] + item[3:] + other(20)]
        texts += [other(9) + item[n // 2 :] + item[: n // 2] + other(9), item[n // 2 :] + item[: n // 2]]
        texts += [other(9) + item[: n // 3] + ["x"] + item[n // 3 :] + other(9), other(50)]
    index = dc.Index(list(range(len(items))), [" ".join(w) for w in items], EXACT)
    got = {(r, i): round(score, 9) for r, i, _, _, score in index.search(pa.array([" ".join(w) for w in texts]))}
    want = all_windows(texts, items)
    assert got == want and len(want) > 30
    shortest = min(len(texts[r]) - len(items[i]) for r, i in want)
    assert shortest < 0


def test_recall_of_fingerprints_at_the_edge_of_the_similarity():
    rng = random.Random(12)
    items, texts = [], []
    for i in range(300):
        n = rng.randrange(12, 70)
        item = ["a%d" % rng.randrange(5000) for _ in range(n)]
        items.append(item)
        # cut as far as the similarity allows, moved, or with a word changed
        cut = max(int((n - 4) * 0.2) // 2 - 1, 0)
        other = ["o%d" % rng.randrange(5000) for _ in range(40)]
        texts += [other + item[cut : n - cut] + other, other + item[cut:], item[2:] + other, other + item + other]
        at = rng.randrange(n)
        texts.append(other + item[:at] + ["x"] + item[at + 1 :] + other)
    columns = pa.array([" ".join(w) for w in texts])
    whole, short = ({(r, i) for r, i, *_ in dc.Index(list(range(300)), [" ".join(w) for w in items], s).search(columns)} for s in (EXACT, dc.Settings()))
    assert len(whole) > 900 and short <= whole
    print("recall of fingerprints", len(short) / len(whole), len(whole))
    assert len(short) >= 0.97 * len(whole)
