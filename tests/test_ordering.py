"""Quantiles, running totals, ranks and metrics against plain numpy, on one range and on many."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbtide.functions.columns import normalise_name, right_closed_bin
from ebbtide.operators import audit, distribution, metrics, ordering
from ebbtide.operators.ordering import hash_rank, running_totals, sample_n

MANY = 7  # rows per range small enough to force many ranges


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.lognormal(2, 1.5, 400), 2)
    # one group holds most rows and one value repeats a lot
    groups = np.where(rng.random(400) < 0.7, "hot", rng.choice(["x", "y"], 400))
    values[rng.random(400) < 0.3] = 3.0
    data = [(g, float(v)) for g, v in zip(groups, values)] + [("x", None), ("y", float("nan")), (None, 1.0), (None, 9.0)]
    return data, spark.createDataFrame(data, "g string, v double")


@pytest.mark.parametrize("per_range", [MANY, 10**6])
def test_quantiles_match_numpy(numbers, per_range):
    data, df = numbers
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]
    got = distribution.quantiles(df, ["v"], shares, ["g"], rows_per_range=per_range).collect()
    assert len(got) == 4 * len(shares)
    for r in got:
        want = np.quantile([v for g, v in data if g == r["g"] and v is not None and v == v], r["share"])
        assert r["quantile"] == pytest.approx(want), (r["g"], r["share"])


@pytest.mark.parametrize("per_range", [MANY, 10**6])
@pytest.mark.parametrize("descending", [True, False])
def test_running_totals(numbers, per_range, descending):
    data, df = numbers
    kept = df.filter("v is not null and not isnan(v)")
    combined = ordering.combine(kept, "v", {"n": F.lit(1)}, ["g"])
    got = running_totals(combined, "v", ["n"], ["g"], descending, per_range).collect()
    for r in got:
        same = [v for g, v in data if g == r["g"] and v is not None and v == v]
        want = sum(v >= r["v"] if descending else v <= r["v"] for v in same)
        assert (r["cum_n"], r["all_n"]) == (want, len(same))


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    if not pos or not neg:
        return None
    return np.mean([1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg])


@pytest.mark.parametrize("per_range", [MANY, 10**6])
def test_auc_with_ties(spark, per_range):
    rng = np.random.default_rng(1)
    pairs = [(int(y), float(np.round(s, 1))) for y, s in zip(rng.random(200) < 0.3, rng.random(200) * 20)]
    df = spark.createDataFrame(pairs, "y int, s double")
    auc = metrics.roc_auc(df, "y", "s", rows_per_range=per_range).first()["auc"]
    assert auc == pytest.approx(brute_auc(pairs))
    flipped = metrics.roc_auc(df.withColumn("s", -F.col("s")), "y", "s", rows_per_range=per_range).first()["auc"]
    assert flipped == pytest.approx(1 - auc)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=30))
def test_auc_property(spark, pairs):
    df = spark.createDataFrame([(y, s / 2) for y, s in pairs], "y int, s double")
    got = metrics.roc_auc(df, "y", "s").first()["auc"]
    want = brute_auc(pairs)
    assert got is None if want is None else got == pytest.approx(want)


@pytest.mark.parametrize("per_range", [2, 10**6])
def test_curves(spark, per_range):
    pairs = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.3), (1, 0.2)]
    df = spark.createDataFrame(pairs, "y int, s double")
    roc = {r["threshold"]: (r["fpr"], r["tpr"]) for r in metrics.roc_curve(df, "y", "s", rows_per_range=per_range).collect()}
    assert roc == {
        None: (0.0, 0.0), 0.9: (0.0, pytest.approx(1 / 3)), 0.8: (0.5, pytest.approx(2 / 3)),
        0.3: (1.0, pytest.approx(2 / 3)), 0.2: (1.0, 1.0),
    }
    pr = {r["threshold"]: (r["precision"], r["recall"]) for r in metrics.pr_curve(df, "y", "s", rows_per_range=per_range).collect()}
    assert pr[None] == (1.0, 0.0) and pr[0.8] == (pytest.approx(2 / 3), pytest.approx(2 / 3)) and len(pr) == 5
    ap = metrics.average_precision(df, "y", "s", rows_per_range=per_range).first()
    assert ap["average_precision"] == pytest.approx(1 / 3 * 1 + 1 / 3 * 2 / 3 + 1 / 3 * 3 / 5)
    assert ap["baseline_precision"] == pytest.approx(0.6)


@pytest.mark.parametrize("per_range", [2, 10**6])
def test_missing_equal_and_text_values_behave_alike_in_any_number_of_ranges(spark, per_range):
    nan = float("nan")
    pairs = [(1, 0.9), (0, 0.1), (1, 0.8), (0, 0.2), (0, nan), (1, None)]
    df = spark.createDataFrame(pairs, "y int, s double")
    assert metrics.roc_auc(df, "y", "s", rows_per_range=per_range).first()["auc"] == pytest.approx(1.0)
    same = df.select("y", F.lit(0.5).alias("s"))
    assert metrics.roc_auc(same, "y", "s", rows_per_range=per_range).first()["auc"] == pytest.approx(0.5)
    words = spark.createDataFrame([(w,) for w in ("b", "a", "c", "a", None)], "w string")
    got = running_totals(ordering.combine(words, "w", {"n": F.lit(1)}), "w", ["n"], rows_per_range=per_range).collect()
    assert {r["w"]: (r["cum_n"], r["all_n"]) for r in got} == {"a": (2, 4), "b": (3, 4), "c": (4, 4)}
    one = running_totals(spark.createDataFrame([(1.0, 2)], "v double, n int"), "v", ["n"], rows_per_range=per_range).collect()
    assert [(r["cum_n"], r["all_n"]) for r in one] == [(2, 2)]
    none = running_totals(spark.createDataFrame([], "v double, n int"), "v", ["n"], rows_per_range=per_range)
    assert none.count() == 0


def test_hash_rank_is_a_permutation_and_sampling_is_exact(spark):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("c"))
    ranked = hash_rank(df, "k", 1, ["c"]).collect()
    for c, n in ((1, 50), (0, 450)):
        assert sorted(r["hash_rank"] for r in ranked if r["c"] == c) == list(range(1, n + 1))
    sample = sample_n(df, 60, 1, "k", ["c"]).collect()
    assert sum(r["c"] for r in sample) == 50 and len(sample) == 110
    first = {r["k"] for r in ranked if r["c"] == 0 and r["hash_rank"] <= 60}
    assert first == {r["k"] for r in sample if r["c"] == 0}
    assert {r["k"] for r in sample_n(df, 60, 2, "k").collect()} != {r["k"] for r in sample_n(df, 60, 3, "k").collect()}


def test_threshold_sweep_is_whole_and_monotone(spark):
    rng = np.random.default_rng(2)
    pairs = [(int(rng.random() < s), float(round(s, 2))) for s in rng.random(300)] + [(1, 0.45), (0, 0.45)]
    df = spark.createDataFrame(pairs, "y int, s double")
    rows = sorted(metrics.threshold_sweep(df, "y", "s", 120, 15).collect(), key=lambda r: r["threshold"])
    assert [r["threshold"] for r in rows] == [k / 20 for k in range(2, 19)]
    for r in rows:
        tp = sum(y == 1 and s >= r["threshold"] for y, s in pairs)
        fp = sum(y == 0 and s >= r["threshold"] for y, s in pairs)
        assert (r["tp"], r["fp"], r["tp"] + r["fp"] + r["fn"] + r["tn"]) == (tp, fp, len(pairs))
        assert r["business_cost"] == 120 * r["fn"] + 15 * r["fp"]
    assert all(a["recall"] >= b["recall"] for a, b in zip(rows, rows[1:]))
    best = metrics.optimal_threshold(metrics.threshold_sweep(df, "y", "s", 120, 15)).first()
    cheapest = min(rows, key=lambda r: (r["business_cost"], r["threshold"]))
    assert best["optimal_threshold"] == cheapest["threshold"]
    saved = metrics.threshold_savings(metrics.threshold_sweep(df, "y", "s", 120, 15)).first()
    half = next(r for r in rows if r["threshold"] == 0.5)
    assert saved["savings"] == half["business_cost"] - cheapest["business_cost"]


def test_metrics_on_one_class_and_no_positives(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.2)], "y int, s double")
    m = metrics.classification_metrics(df, "y", "s", 0.5).first()
    assert (m["accuracy"], m["precision"], m["recall"], m["f1"]) == (1.0, 0.0, 0.0, 0.0)
    assert metrics.roc_auc(df, "y", "s").first()["auc"] is None


def test_published_class_ratio():
    assert 883630 / 87330 == pytest.approx(10.118287, abs=1e-6)


def test_class_balance(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "is_churn int")
    b = audit.class_balance(df).first()
    assert (b["n_majority"], b["n_minority"], b["class_weight_ratio"], b["overall_churn_rate"]) == (3, 1, 3.0, 0.25)


def test_right_closed_bins(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (1.0,), (1.1,), (2.0,), (2.1,), (None,)], "v double")
    got = [r[0] for r in df.select(right_closed_bin(F.col("v"), (0, 1, 2), ("low", "high"))).collect()]
    assert got == [None, "low", "low", "high", "high", None, None]


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    values = [float(v) for v in rng.gamma(2, 10, 500)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = {r["bin"]: r["n"] for r in distribution.histogram(df, "v", 40, 0.99).collect()}
    counts, _ = np.histogram(np.minimum(values, np.quantile(values, 0.99)), bins=40)
    assert got == {i: int(n) for i, n in enumerate(counts) if n}
    same = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [(r["bin"], r["n"]) for r in distribution.histogram(same, "v", 10).collect()] == [(0, 2)]


def test_numeric_summary_and_box(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    s = distribution.numeric_summary(df, ["v"]).first()
    assert (s["n"], s["p25"], s["p50"], s["p75"], s["max"]) == (5, 2.0, 3.0, 4.0, 100.0)
    assert s["std"] == pytest.approx(np.std(values, ddof=1))
    box = distribution.box_summary(df, ["v"], "g").first()
    assert (box["whisker_low"], box["whisker_high"]) == (1.0, 4.0)


def test_sketch_quantiles_are_close(spark):
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    got = {r["share"]: r["quantile"] for r in distribution.approx_quantiles(df, ["v"], [0.5, 0.9]).collect()}
    assert got[0.5] == pytest.approx(500, abs=2) and got[0.9] == pytest.approx(900, abs=2)


def test_split_is_exclusive_at_the_boundaries(spark):
    dates = [0, 20151231, 20160101, 20160630, 20160701, None]
    df = spark.createDataFrame([(d, 0) for d in dates], "d int, is_churn int")
    got = [r["split"] for r in audit.temporal_split(df, "d", 20160101, 20160701).collect()]
    assert got == ["train", "train", "val", "val", "test", "train"]


def test_names():
    assert normalise_name("segment_At-Risk") == "segment_At_Risk"
