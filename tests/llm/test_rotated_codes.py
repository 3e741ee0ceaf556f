import numpy as np
from pyspark.sql import functions as F

from ebbtide.llm import rotated_codes as rc

SMALL = "/root/testdata/sf0.001"


def brute(ids, x, queries, k):
    out = {}
    for q in queries:
        score = rc.exact(np.repeat(x[ids == q], len(ids), axis=0), x, np.arange(len(ids)), np.arange(len(ids)))
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(score[i])) for i in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def test_recall_and_exact_scores(spark):
    vectors = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = vectors.orderBy("vec_id").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows])
    want = brute(ids, x, ids[ids % 20 == 0], 20)
    # blocks of any size give nearly all, and only true scores
    for settings in (rc.Settings(), rc.Settings(base_rows=100, query_rows=7)):
        got = found(rc.nearest(vectors, F.col("vec_id") % 20 == 0, 20, settings))
        assert got.keys() == want.keys()
        scores = {q: dict(brute(ids, x, [q], len(ids))[q]) for q in list(got)[:3]}
        assert all(scores[q][v] == s for q in scores for v, s in got[q])
        assert all(len(v) == 20 and v == sorted(v, key=lambda p: (-p[1], p[0])) for v in got.values())
        hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
        assert hits >= 0.95 * 20 * len(want)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [1.0, None]), (7, [inf, 1.0]), (8, [1.0, 0.0, 0.0]), (None, [1.0, 1.0]), (9, [-1.0, 0.5]), (9, [-1.0, 0.5])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    got = found(rc.nearest(vectors, F.col("vec_id") == 0, 20))
    assert got == {0: [(1, 1.0), (2, 1.0), (9, -1.0)]}
    assert rc.nearest(vectors.limit(0), F.col("vec_id") == 0).count() == 0
    assert rc.nearest(vectors, F.col("vec_id") == 77).count() == 0
    assert rc.nearest(vectors.where("vec_id = 0"), F.col("vec_id") == 0).count() == 0


def test_bounds_hold_for_nearly_all():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((2000, 64)), rng.standard_normal((20, 64))
    centre, turn = x.mean(axis=0), rc.rotation(64, 3)
    assert np.allclose(turn @ turn.T, np.eye(64))
    bits, length, kept = rc.encode(x, centre, turn)
    assert bits.shape == (2000, 8)
    estimate, error = rc.bounds(q, bits, length, kept, centre, turn, 3.0)
    off = np.abs(estimate - q @ x.T)
    assert (off <= error).mean() > 0.99
    assert abs((estimate - q @ x.T).mean()) < 0.1
