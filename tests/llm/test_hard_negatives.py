import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import hard_negatives as hn
from ebbtide.llm import oracles, queries

SMALL = "/root/testdata/sf0.001"


def brute(ids, labels, x, anchors, positives=5, negatives=3, window=(50, 95)):
    out = set()
    for a in np.flatnonzero(anchors):
        score = [int(s) for s in x.astype(object) @ x[a].astype(object)]
        order = sorted(range(len(ids)), key=lambda i: (-score[i], ids[i]))
        for p in [i for i in order if labels[i] == labels[a] and i != a][:positives]:
            fits = [i for i in order if labels[i] != labels[a] and window[0] * score[p] <= 100 * score[i] <= window[1] * score[p]]
            out |= {(int(ids[a]), int(ids[p]), n + 1, int(ids[i]), score[p], score[i]) for n, i in enumerate(fits[:negatives])}
    return out


def found(df):
    rows = df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


def table(spark, ids, labels, x):
    rows = [(int(i), None if l is None else int(l), [float(v) for v in row]) for i, l, row in zip(ids, labels, x)]
    return spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("part", F.lit(0))


def run(rows, every, settings):
    return found(hn.mine(hn.usable(rows, F.col("label"), F.col("vec_id") % every == 0, settings), settings))


# blocks, trees and anchors at once of any size
WHOLE, PARTS, BITS = hn.Settings(), hn.Settings(block_rows=60, trees=2, anchors=40), hn.Settings(block_rows=30, trees=3, levels=3, shrink=2.0)


@pytest.mark.parametrize("kind, settings", [("uniform", PARTS), ("clustered", BITS), ("clustered", WHOLE), ("whole", BITS), ("lengths", PARTS)])
def test_equals_comparing_all(spark, kind, settings):
    rng = np.random.default_rng(5)
    n, dims = 700, 6
    x = rng.standard_normal((n, dims))
    if kind == "clustered":
        x = rng.standard_normal((12, dims))[rng.integers(0, 12, n)] + 0.01 * x
    if kind == "whole":  # many ties and repeats
        x = rng.integers(-2, 3, (n, dims)).astype(float)
    if kind == "lengths":
        x *= np.exp(rng.uniform(-4, 4, (n, 1)))
    x = x.astype(np.float32)
    ids, labels = rng.permutation(n) - 20, np.where(rng.random(n) < 0.4, 0, rng.integers(0, 5, n))
    want = brute(ids, labels, np.floor(256 * x.astype(float)).astype(np.int64), ids % 9 == 0)
    assert len(want) > 100
    assert run(table(spark, ids, labels, x), 9, settings) == want


def test_the_tables_rows_by_sql(spark):
    from tests.check_oracle import compare, connect

    assert compare(queries.hard_negative_rows(spark, SMALL), connect(SMALL), oracles.HARD_NEGATIVES) == []


def test_odd_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    good = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.5]), (2, 2, [0.7, 0.0]), (3, 2, [0.9, 0.0]), (4, 3, [0.2, 1.0]), (5, 3, [0.0, 0.0])]
    odd = [(10, None, [1.0, 0.0]), (11, 1, None), (12, 1, [nan, 0.0]), (13, 2, [0.8, None]), (14, 2, [inf, 0.0]), (15, 2, []), (16, 2, [0.8, 0.0, 0.0]), (None, 2, [0.8, 0.0]), (17, 2, [2.0**20, 0.0]), (2, 2, [0.7, 0.0])]
    rows = spark.createDataFrame(good + odd, "vec_id long, label int, embedding array<float>")
    want = {(0, 1, 1, 3, 65536, 58880), (0, 1, 2, 2, 65536, 45824)}
    assert run(rows, 100, hn.Settings()) == want
    # labels of other types, and an anchor alone with its label
    assert run(rows.withColumn("label", F.col("label").cast("string")), 100, hn.Settings()) == want
    assert run(rows.where("vec_id <> 1"), 100, hn.Settings()) == set()
    assert run(rows.limit(0), 100, hn.Settings()) == set()
    assert run(rows.where("vec_id > 1"), 1000, hn.Settings()) == set()


def test_large_components_are_exact(spark):
    ids, labels = np.arange(40), np.arange(40) % 2
    x = np.random.default_rng(1).uniform(900_000, 1_000_000, (40, 3))
    rows = spark.createDataFrame([(int(i), int(l), v.tolist()) for i, l, v in zip(ids, labels, x)], "vec_id long, label int, embedding array<double>")
    settings = hn.Settings(window=(50, 100))
    want = brute(ids, labels, np.floor(256 * x).astype(np.int64), ids % 10 == 0, window=(50, 100))
    assert want and run(rows, 10, settings) == want


def test_radii_cover_and_nothing_outside_a_window_is_compared():
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 8)) * 300
    x = np.floor(centres[rng.integers(0, 40, 2000)] + rng.standard_normal((2000, 8)) * 3)
    tree = hn.Tree.build(np.arange(2000), x, hn.Settings())
    assert sorted(tree.ids.tolist()) == list(range(2000))
    extra = np.sqrt(tree.reach - (tree.x**2).sum(axis=1))
    whole = np.column_stack([tree.x, extra])

    def all_below(g):
        """Children, what hangs on them, and the row's further levels."""
        out, todo = [], [g]
        while todo:
            g = todo.pop()
            rows = range(tree.begin[g], tree.end[g])
            out += rows
            todo += [tree.entry[c] for c in rows if tree.entry[c] >= 0] + ([tree.then[g]] if tree.then[g] >= 0 else [])
        return out

    assert sorted(all_below(0)) == list(range(1, 2000))
    for g in range(len(tree.point)):
        reached = np.linalg.norm(whole[all_below(g)] - whole[tree.point[g]], axis=1)
        assert reached.max() <= tree.radius[g]
    # on clustered rows a search compares a small part
    seen = 0
    for q in x[:50]:
        search = hn.Search(q, np.array([-(1 << 62)]), np.array([1 << 62]), 5)
        hn.look_through(tree, [search])
        score = (tree.x @ q).astype(int)
        order = np.lexsort((tree.ids, -score))[:5]
        assert search.best[0] == [(-score[i], tree.ids[i]) for i in order]
        seen += search.seen
    assert seen < 0.25 * 50 * 2000
