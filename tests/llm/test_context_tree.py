import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import context_tree as ct

SMALL = "/root/testdata/sf0.001"
LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def lowered(text):
    return (text or "").encode().translate(LOW)


class Tree:
    """Context trees kept as dictionaries and weighted by recursion."""

    def __init__(self, texts):
        self.counts = {}
        for text in texts:
            self.walk(text, self.add)
        self.memo = {}

    def walk(self, text, visit):
        data = b"\0" * ct.DEPTH + lowered(text) + b"\0"
        for i in range(ct.DEPTH, len(data)):
            context = data[i - ct.DEPTH : i]
            for k in range(8):
                visit(context, (1 << k) | (data[i] >> (8 - k)), (data[i] >> (7 - k)) & 1)

    def add(self, context, decision, bit):
        for d in range(ct.DEPTH + 1):
            self.counts.setdefault((context[ct.DEPTH - d :], decision), [0, 0])[bit] += 1

    def kt(self, node):
        a, b = self.counts.get(node, (0, 0))
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node):
        if node not in self.memo:
            context, decision = node
            kt = self.kt(node)
            if len(context) == ct.DEPTH:
                self.memo[node] = kt
            else:
                below = sum(self.weighted((bytes([c]) + context, decision)) for c in range(256) if (bytes([c]) + context, decision) in self.counts)
                self.memo[node] = math.log(0.5) + np.logaddexp(kt, below)
        return self.memo[node]

    def one(self, context, decision, depth=0):
        """Probability of a 1 at the node of the last ``depth`` bytes."""
        node = (context[ct.DEPTH - depth :], decision)
        if node not in self.counts:
            return 0.5
        a, b = self.counts[node]
        own = (b + 0.5) / (a + b + 1)
        if depth == ct.DEPTH:
            return own
        share = math.exp(math.log(0.5) + self.kt(node) - self.weighted(node))
        return share * own + (1 - share) * self.one(context, decision, depth + 1)

    def score(self, text):
        total = 0.0

        def visit(context, decision, bit):
            nonlocal total
            p = self.one(context, decision)
            total += math.log10(p if bit else 1 - p)

        self.walk(text, visit)
        return total


def base(texts, training):
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0d]+", lowered(t))
    counts = Counter(w for t in training for w in [*tokens(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for t in texts:
        own = [*tokens(t), None]
        out.append((len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_scores_against_recursion(spark, block_bytes):
    texts = ["The cat sat on the mat. THE END", "the dog sat on the log", "Été à la mer, été au lac", "", None, "the the the\tthe\x0bthe", "a", "zzz qqq", "東京 the", "x" * 300, "one\x00zero"]
    docs = spark.createDataFrame([(i, t, i % 4 != 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, train boolean, score string")
    training = [t for i, t in enumerate(texts) if i % 4 != 3]
    got = {r["doc_id"]: r for r in ct.score(docs, F.col("train"), ct.Settings(block_bytes)).collect()}
    tree = Tree(training)
    assert len(got) == len(texts)
    for i, (text, want) in enumerate(zip(texts, base(texts, training))):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[:3] and r["held_out"] == (i % 4 == 3)
        assert r["base_score"] == pytest.approx(want[3], rel=1e-12)
        assert r["score"] == pytest.approx(tree.score(text), rel=1e-9), text
        assert r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / (len(lowered(text)) + 1))


def test_base_of_the_test_data(spark):
    from ebbtide.llm import queries
    from ebbtide.llm.sampling import held_out

    rows = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", held_out(F.col("doc_id"), 5, 1).alias("h")).collect()
    want = dict(zip([r["doc_id"] for r in rows], base([r["text"] for r in rows], [r["text"] for r in rows if not r["h"]])))
    got = queries.context_tree_scores(spark, SMALL).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3]
        assert r["base_score"] == pytest.approx(want[r["doc_id"]][3], rel=1e-11)
    held = [r["bits_per_byte"] for r in got if r["held_out"] and r["n_tokens"] > 30]
    assert 0 < np.mean(held) < 4.5


def test_probabilities_of_all_next_bytes_add_up_to_one():
    texts = ["abracadabra", "alakazam", "abc"]
    grams = ct._counted([(t.codes, np.ones(len(t.codes), np.int64)) for t in [ct.Texts(pa.array(texts))]])
    tops = {}
    levels = {}
    for pair in {(int(c) >> 8) & 0xFFFF for c in grams[0]}:
        own = (grams[0] >> 8) & 0xFFFF == pair
        levels[pair] = ct.subtree(grams[0][own], grams[1][own])
        top = levels[pair][0]
        for k, a, b, w in zip(top.keys.tolist(), top.zeros, top.ones, top.weighted):
            now = tops.setdefault(((k >> 8) & 255, k & 255), [0, 0, 0.0])
            now[0] += a
            now[1] += b
            now[2] += w
    keys = sorted(tops)
    upper = ct.upper_levels(*[np.array(x) for x in ([k[0] for k in keys], [k[1] for k in keys], [tops[k][0] for k in keys], [tops[k][1] for k in keys], [tops[k][2] for k in keys])])
    for context in (b"abra", b"zzzz", b"\0\0\0\0", b"zabr"):
        codes = np.array([int.from_bytes(context + bytes([x]), "big") for x in range(256)], np.int64)
        pair = (int(codes[0]) >> 8) & 0xFFFF
        own = levels.get(pair, ct.subtree(np.zeros(0, np.int64), np.zeros(0, np.int64)))
        assert (10 ** ct.gram_scores(codes, own, upper)).sum() == pytest.approx(1)


def test_odd_rows(documents, nothing):
    got = ct.score(documents, F.lit(True)).collect()
    assert len(got) == documents.count() and not any(r["held_out"] for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (3, 4)} == {1}
    assert ct.score(nothing, F.lit(True)).count() == 0
    untrained = ct.score(documents, F.lit(False)).collect()
    assert all(r["bits_per_byte"] == pytest.approx(8) and r["n_known"] == 0 and r["base_score"] == 0 for r in untrained)


def test_lookup_of_many_keys():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(-(1 << 62), 1 << 62, 5000))
    asked = rng.choice(keys, 20000)
    assert (keys[ct.Lookup(keys).places(asked)] == asked).all()


def test_large_counts_by_series():
    n = np.array([0, 1, 4094, 4095, 4096, 10**6])
    assert np.allclose(ct._lgamma(n, 0.5, ct._LGAMMA_HALF), [math.lgamma(x + 0.5) for x in n], rtol=1e-13)
    assert np.allclose(ct._lgamma(n, 1.0, ct._LGAMMA_ONE), [math.lgamma(x + 1.0) for x in n], rtol=1e-13)
