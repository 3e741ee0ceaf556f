"""Fitted models: known optima, exact attributions, folds, selection."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ebbtide.learning import classify, explain, forest, matrix, newton, segments, value
from ebbtide.learning.classify import Spec

NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    x = np.round(rng.normal(size=(400, 4)), 3)
    p = 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] + x[:, 0] * x[:, 2] - 1)))
    y = (rng.random(400) < p).astype(float)
    clv = 100 + 30 * x[:, 0] - 12 * x[:, 3] + rng.normal(size=400)
    data = [
        (i, ("train", "train", "val", "test")[i % 4], float(t), float(v), *map(float, r)) for i, (r, t, v) in enumerate(zip(x, y, clv))
    ]
    df = spark.createDataFrame(data, "msno long, split string, is_churn double, clv double, a double, b double, c double, d double")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(df).cache()


def part(table, *names):
    return table.filter(F.col("split").isin(*names))


def test_balanced_weights_sum_to_rows(table):
    weighted = table.withColumn("w", matrix.class_weights(table))
    by = {r["is_churn"]: r["s"] for r in weighted.groupBy("is_churn").agg(F.sum("w").alias("s")).collect()}
    assert by[0.0] == pytest.approx(200) and by[1.0] == pytest.approx(200)


def test_linear_classifier_is_at_the_penalised_optimum(table):
    train = part(table, "train")
    model = classify.fit_classifier(train, Spec("lr", "linear"))
    coef, icpt = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    rows = model.stages[0].transform(train.withColumn("w", matrix.class_weights(train))).select(
        vector_to_array("scaled").alias("x"), "is_churn", "w"
    ).collect()
    x, y, w = (np.array([r[i] for r in rows]) for i in range(3))
    # gradient of 0.5 |b|² + sum of weighted log losses (C = 1)
    residual = w * (1 / (1 + np.exp(-(x @ coef + icpt))) - y)
    assert np.abs(x.T @ residual + coef).max() < 0.05 and abs(residual.sum()) < 0.05


def test_newton_fit_is_at_the_optimum_and_agrees_with_the_first_order_fit(table):
    train = part(table, "train")
    weighted = train.withColumn("w", matrix.class_weights(train)).withColumn("same", F.lit(3.0))
    odd = weighted.limit(1).withColumn("a", F.lit(None).cast("double")).unionByName(weighted.limit(1).withColumn("b", F.lit(float("nan"))))
    fitted = newton.fit_newton(weighted.unionByName(odd), [*NAMES, "same"], weight="w")
    assert fitted.converged and len(fitted.steps) < 12 and fitted.steps[-1][5] == 0
    assert all(later <= earlier for earlier, later in zip(fitted.loss, fitted.loss[1:]))
    rows = np.array([[r[c] for c in (*NAMES, "is_churn", "w")] for r in weighted.collect()])
    x = (rows[:, :4] - np.array(fitted.mean[:4])) / np.array(fitted.deviation[:4])
    coef = np.array(fitted.steps[-1])
    residual = rows[:, 5] * (1 / (1 + np.exp(-(x @ coef[1:5] + coef[0]))) - rows[:, 4])
    assert np.abs(x.T @ residual + coef[1:5]).max() < 1e-6 and abs(residual.sum()) < 1e-6
    first_order = classify.churn_scores(classify.fit_classifier(train, Spec("lr", "linear")), table, "lr")
    both = first_order.join(table.select("msno", fitted.probability().alias("p")), "msno")
    assert both.agg(F.max(F.abs(F.col("p") - F.col("churn_prob")))).first()[0] < 0.01


def test_newton_steps_are_halved_where_the_loss_would_grow_and_empty_input_is_refused(spark):
    apart = spark.createDataFrame([(float(i), float(i > 4)) for i in range(10)] + [(1e6, 1.0)], "x double, is_churn double")
    fitted = newton.fit_newton(apart, ["x"], penalty=1e-6, max_steps=40)
    assert all(later <= earlier * (1 + 1e-9) + 1e-12 for earlier, later in zip(fitted.loss, fitted.loss[1:]))
    assert np.isfinite(fitted.steps[-1]).all()
    with pytest.raises(ValueError):
        newton.fit_newton(apart.limit(0), ["x"])


def test_ridge_is_at_the_penalised_optimum(table):
    model = value.fit_ridge(table, 10.0)
    x = np.array([r[0] for r in model.stages[0].transform(table).select(vector_to_array("scaled")).collect()])
    y = np.array([r["clv"] for r in table.select("clv").collect()])
    want = np.linalg.solve(x.T @ x + 10.0 * np.eye(4), x.T @ (y - y.mean()))
    assert model.stages[-1].coefficients.toArray() == pytest.approx(want, rel=1e-9)


def conditional(leaves, x, present):
    """Score when only the given features are known, by its definition."""
    total = 0.0
    for leaf in leaves:
        w = 1.0
        for f, lo, hi, r in zip(leaf.features, leaf.low, leaf.high, leaf.share):
            w *= float(lo < x[f] <= hi) if f in present else r
        total += w * leaf.value
    return total


def shapley(leaves, x, n):
    out = []
    for i in range(n):
        rest = [f for f in range(n) if f != i]
        out.append(
            sum(
                math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n)
                * (conditional(leaves, x, set(s) | {i}) - conditional(leaves, x, set(s)))
                for k in range(n)
                for s in itertools.combinations(rest, k)
            )
        )
    return out


def boosted(table):
    return classify.fit_classifier(part(table, "train"), Spec("g", "boosted", {"rounds": 4, "depth": 4, "rate": 0.3}))


@pytest.mark.parametrize("kind", ["boosted", "forest", "value forest", "value boosted"])
def test_tree_attributions_are_exact_and_add_up(spark, table, kind):
    train, test = part(table, "train"), part(table, "test")
    if kind == "boosted":
        model = boosted(table)
        raw = lambda: {r["msno"]: math.log(r["churn_prob"] / (1 - r["churn_prob"])) for r in classify.churn_scores(model, test, "m").collect()}
    elif kind == "forest":
        model = classify.fit_classifier(train, Spec("f", "forest", {"trees": 4, "depth": 4, "min_leaf": 3}))
        raw = lambda: {r["msno"]: r["churn_prob"] for r in classify.churn_scores(model, test, "m").collect()}
    else:
        model = value.fit_forest(train, 4, 4, 2) if kind == "value forest" else value.fit_boosted(train, {"rounds": 4, "depth": 4, "rate": 0.3})
        raw = lambda: {r["msno"]: r["predicted_clv"] for r in value.predictions(model, test, "m").collect()}
    leaves = explain.as_leaves(explain.leaf_table(spark, model.stages[-1]).toPandas())
    long = explain.attributions(test, model, NAMES).collect()
    sums, cells = {}, {}
    for r in long:
        sums[r["msno"]] = sums.get(r["msno"], r["base_value"]) + r["contribution"]
        cells[(r["msno"], r["feature"])] = r["contribution"]
        assert r["base_value"] == pytest.approx(explain.base_of(leaves), abs=1e-9)
    assert len(long) == 4 * test.count()
    for m, want in raw().items():
        assert sums[m] == pytest.approx(want, abs=1e-6)
    for r in test.limit(5).collect():
        want = shapley(leaves, [r[n] for n in NAMES], 4)
        assert [cells[(r["msno"], n)] for n in NAMES] == pytest.approx(want, abs=1e-9)


def test_single_leaf_and_repeated_features():
    x = np.array([[0.0, 5.0]])
    only = explain.Leaf(np.array([], int), np.array([]), np.array([]), np.array([]), 3.0)
    assert explain.base_of([only]) == 3.0 and not explain.leaf_contributions(x, [only]).any()


def test_patterns_of_many_columns():
    rng = np.random.default_rng(2)
    passes = (rng.random((50, 70)) < 0.5)[rng.integers(0, 50, 300)]
    first, which = explain.patterns(passes)
    assert len(first) == len(np.unique(passes, axis=0)) and (passes[first][which] == passes).all()


def test_attributions_do_not_depend_on_blocks_and_spans(spark, table):
    model = classify.fit_classifier(part(table, "train"), Spec("f", "forest", {"trees": 9, "depth": None, "min_leaf": 1}))
    leaves = explain.leaf_table(spark, model.stages[-1])
    # a repeated row, a missing value, a key that is missing, and columns named like those used inside
    test = part(table, "test").withColumn("_row", F.lit(7)).withColumn("feature", F.lit("f"))
    odd = test.limit(1).withColumn("a", F.lit(None).cast("double"))
    test = test.unionByName(test.limit(2)).unionByName(odd).unionByName(odd.withColumn("msno", F.lit(None).cast("long")))
    dealt, spans = explain.in_spans(leaves, 50)
    sizes = {r["span"]: r["count"] for r in dealt.groupBy("span").count().collect()}
    assert spans > 5 and set(sizes) == set(range(spans)) and max(sizes.values()) <= 50 and sum(sizes.values()) == leaves.count()

    def cells(**sized):
        rows = explain.tree_attributions(test, leaves, NAMES, **sized).collect()
        return sorted((str(r["msno"]), r["feature"], round(r["contribution"], 9), str(r["value"]), round(r["base_value"], 9)) for r in rows)

    one = cells()
    assert len(one) == 4 * test.count() and one == cells(leaves_per_span=50, rows_per_block=30)
    assert explain.tree_attributions(test.limit(0), leaves, NAMES).collect() == []


def test_attributions_of_many_deep_trees(spark, table):
    model = classify.fit_classifier(part(table, "train"), Spec("g", "boosted", {"rounds": 60, "depth": 6, "rate": 0.1}))
    test = part(table, "test")
    long = explain.attributions(test, model, NAMES).groupBy("msno").agg((F.sum("contribution") + F.first("base_value")).alias("raw"))
    both = classify.churn_scores(model, test, "m").join(long, "msno")
    assert both.count() == 100
    assert both.agg(F.max(F.abs(F.col("raw") - F.log(F.col("churn_prob") / (1 - F.col("churn_prob")))))).first()[0] < 1e-6


def test_attribution_plan_holds_no_nodes_and_no_cross_join(spark, table):
    model = boosted(table)
    plan = explain.attributions(part(table, "test"), model, NAMES)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_linear_model_attributions_add_up(table):
    train = part(table, "train")
    model = classify.fit_classifier(train, Spec("lr", "linear"))
    long = explain.attributions(train, model, NAMES)
    got = {r["msno"]: r["s"] for r in long.groupBy("msno").agg(F.sum("contribution").alias("s")).collect()}
    for r in classify.churn_scores(model, train, "m").limit(20).collect():
        logit = math.log(r["churn_prob"] / (1 - r["churn_prob"]))
        assert got[r["msno"]] + model.stages[-1].intercept == pytest.approx(logit, abs=1e-6)
    # explained against other rows, the base value is the score at their means
    other = explain.attributions(train, model, NAMES, part(table, "val"))
    raw = {r["msno"]: r["s"] for r in other.groupBy("msno").agg((F.sum("contribution") + F.first("base_value")).alias("s")).collect()}
    for r in classify.churn_scores(model, train, "m").limit(20).collect():
        assert raw[r["msno"]] == pytest.approx(math.log(r["churn_prob"] / (1 - r["churn_prob"])), abs=1e-6)


def test_out_of_fold_scores_cover_each_train_row_once(table):
    folds = classify.assign_folds(part(table, "train").select("msno", "is_churn"), 5)
    sizes = folds.groupBy("is_churn", "fold").count().collect()
    for c in (0.0, 1.0):
        per = [r["count"] for r in sizes if r["is_churn"] == c]
        assert len(per) == 5 and max(per) - min(per) <= 1
    folded = part(table, "train").join(folds.drop("is_churn"), "msno")
    specs = [Spec("lr", "linear"), Spec("g", "boosted", {"rounds": 2, "depth": 2, "rate": 0.3})]
    oof = classify.out_of_fold(folded, specs)
    assert oof.count() == 2 * 200 == oof.select("msno", "model").distinct().count()
    meta = classify.meta_features(oof.drop("fold"), specs)
    assert meta.count() == 200
    kind, model, aucs = classify.fit_meta(meta, meta, 3)
    assert kind in ("linear", "boosted") and all(r["auc"] > 0.7 for r in aucs.collect())


def test_grid_and_search_return_their_best_point(table):
    train, val = part(table, "train"), part(table, "val")
    grid, spec = classify.forest_grid(train, val, {"trees": (3,), "depth": (2, None), "min_leaf": (1, 20)})
    rows = grid.collect()
    top = max(rows, key=lambda r: (r["auc"], -r["point"]))
    assert len(rows) == 4 and (spec.params["depth"] or 30) == top["depth"] and spec.params["min_leaf"] == top["min_leaf"]
    ranges = {**classify.BOOST_RANGES, "rounds": (2, 4)}
    trials, best = classify.tune(train, val, ranges, trials=3)
    seen = trials.orderBy("trial").collect()
    assert [r["best_so_far"] for r in seen] == list(np.maximum.accumulate([r["auc"] for r in seen]))
    top = max(seen, key=lambda r: (r["auc"], -r["trial"]))
    assert best.params["rounds"] == top["stopped_round"] and 1 <= top["stopped_round"] <= best.params["most_rounds"] <= 4
    assert 0.01 <= best.params["rate"] <= 0.3 and 2 <= best.params["most_rounds"]
    assert seen[-1]["best_so_far"] > 0.65


def test_staged_aucs_equal_those_of_shorter_fits(table):
    train, val = part(table, "train"), part(table, "val")
    p = {"rounds": 12, "depth": 4, "rate": 0.2, "row_share": 0.8, "column_share": 0.7}
    curve = {r["round"]: r["auc"] for r in classify.staged_aucs(classify.fit_classifier(train, Spec("g", "boosted", p)), val).collect()}
    assert sorted(curve) == list(range(1, 13))
    for rounds in (1, 7, 12):
        short = classify.fit_classifier(train, Spec("g", "boosted", {**p, "rounds": rounds}))
        scores = classify.churn_scores(short, val, "g").withColumn("churn_prob", F.round("churn_prob", 12))
        assert curve[rounds] == pytest.approx(classify.evaluate(scores).first()["auc"], abs=1e-9)


def stop_plainly(aucs, patience):
    best, at = None, None
    for i, a in enumerate(aucs, 1):
        if a is not None and (best is None or a > best):
            best, at = a, i
        elif at is not None and i - at >= patience:
            break
    return best, len(aucs) if at is None else at


def test_stopping_equals_going_round_by_round(spark):
    rng = np.random.default_rng(5)
    curves = [list(map(float, rng.integers(0, 40, n) / 40 + np.linspace(0, 0.5, n))) for n in (1, 5, 30, 80, 200)]
    curves += [[0.5] * 20, [None] * 6, [None, 0.6, None, 0.5, 0.7], [0.9, *[0.1] * 9, 0.95]]
    rows = [(i, r, a) for i, c in enumerate(curves) for r, a in enumerate(c, 1)]
    df = spark.createDataFrame(rows, "trial int, round int, auc double").repartition(4)
    for patience in (1, 3, 10, 1000):
        got = {r["trial"]: (r["auc"], r["stopped_round"]) for r in classify.stopped_rounds(df, ["trial"], patience).collect()}
        assert got == {i: stop_plainly(c, patience) for i, c in enumerate(curves)}


def test_a_search_goes_on_where_it_broke_off(table, tmp_path, monkeypatch):
    train, val = part(table, "train"), part(table, "val")
    ranges = {**classify.BOOST_RANGES, "rounds": (2, 3), "depth": (2, 3)}
    fit, fitted = classify.fit_classifier, []

    def counted(rows, spec, *rest):
        fitted.append(spec.params)
        if len(fitted) == 3:
            raise RuntimeError("lost")
        return fit(rows, spec, *rest)

    monkeypatch.setattr(classify, "fit_classifier", counted)
    monkeypatch.setattr(classify, "side_by_side", lambda jobs: [j() for j in jobs])
    ledger = str(tmp_path / "ledger")
    with pytest.raises(RuntimeError):
        classify.tune(train, val, ranges, trials=4, ledger=ledger)
    found, best = classify.tune(train, val, ranges, trials=4, ledger=ledger)
    assert len(fitted) == 3 + 2 and found.count() == 4
    # a finished search fits nothing, and gives the same as one that never broke off
    again, same = classify.tune(train, val, ranges, trials=4, ledger=ledger)
    assert len(fitted) == 5 and best == same and again.exceptAll(found).count() == 0
    whole, other = classify.tune(train, val, ranges, trials=4, ledger=str(tmp_path / "whole"))
    assert len(fitted) == 9 and best == other and whole.exceptAll(found).count() == 0
    # other rows, ranges or seeds are other searches
    names = {
        classify.search_ledger(train, val, ranges, 1, "a"), classify.search_ledger(train, val, ranges, 2, "a"),
        classify.search_ledger(val, train, ranges, 1, "a"), classify.search_ledger(train, val.limit(5), ranges, 1, "a"),
        classify.search_ledger(train, val, classify.BOOST_RANGES, 1, "a"), classify.search_ledger(train.repartition(7), val, ranges, 1, "a"),
    }
    assert len(names) == 5


def test_two_step_scores_val_and_test_and_models_persist(table, tmp_path):
    scores, first, _, seconds = classify.two_step(
        part(table, "train"), part(table, "val"), part(table, "test"), Spec("g", "boosted", {"rounds": 3, "depth": 3, "rate": 0.3})
    )
    assert {(r["split"], r["n"]) for r in scores.groupBy("split").agg(F.count("*").alias("n")).collect()} == {("val", 100), ("test", 100)}
    assert seconds > 0 and all(r["auc"] > 0.65 for r in classify.evaluate(scores, ["model", "split"]).collect())
    classify.save_model(first, str(tmp_path / "m"))
    again = classify.churn_scores(classify.load_model(str(tmp_path / "m")), part(table, "val"), "g")
    assert again.exceptAll(scores.filter("split = 'val'")).count() == 0


def test_ridges_share_what_no_penalty_changes(table):
    some = value.fit_ridges(table, [0.1, 10.0])
    assert some[0].stages[0] is some[1].stages[0]
    for alpha, model in zip([0.1, 10.0], some):
        alone = value.fit_ridge(table, alpha).stages[-1]
        assert model.stages[-1].coefficients.toArray() == pytest.approx(alone.coefficients.toArray(), rel=1e-9)
        assert model.stages[-1].intercept == pytest.approx(alone.intercept, rel=1e-9)


def test_ridge_sweep_and_selection(table):
    rows, best, model = value.ridge_alpha_sweep(part(table, "train"), part(table, "val"))
    per = {r["alpha"]: r["rmse"] for r in rows.collect()}
    assert set(per) == {0.01, 0.1, 1.0, 10.0, 100.0} and best == min(per, key=per.get)
    scored = value.predictions(model, part(table, "val"), "ridge").unionByName(
        value.predictions(value.fit_forest(part(table, "train"), 3, 2, 5), part(table, "val"), "forest")
    )
    assert value.best_model(value.compare(scored)) == "ridge"


def test_kmeans_segments_find_separate_groups(spark):
    rng = np.random.default_rng(4)
    centres = [(20000, 0.9, 0.1, 300, 3), (6000, 0.7, 0.2, 150, 20), (3000, 0.3, 0.4, 100, 70), (0, 0, 0, 0, 800)]
    data = [
        (i * 50 + j, int(rng.random() < 0.1), *[float(c * rng.uniform(0.95, 1.05)) for c in centre])
        for i, centre in enumerate(centres)
        for j in range(50)
    ]
    cols = ", ".join(f"{c} double" for c in segments.CLUSTER_FEATURES)
    m = segments.cluster_matrix(spark.createDataFrame(data, f"msno long, is_churn int, {cols}"))
    named = segments.kmeans_segments(m, 4, starts=3)
    got = {r["g"]: r["s"] for r in named.groupBy((F.col("msno") / 50).cast("int").alias("g")).agg(F.collect_set("segment_label").alias("s")).collect()}
    assert got == {0: ["Power Users"], 1: ["Casual Listeners"], 2: ["At-Risk"], 3: ["Dormant"]}
    sweep = {r["k"]: r for r in segments.k_sweep(m, (2, 4), starts=2).collect()}
    assert sweep[4]["inertia"] < sweep[2]["inertia"] and sum(r["recommended"] for r in sweep.values()) == 1
    plane, shares = segments.pca_projection(m)
    assert plane.count() == 200 and shares[0] >= shares[1] and sum(shares) <= 1 + 1e-9


def blobs(spark, n=240, seed=8):
    rng = np.random.default_rng(seed)
    points = rng.standard_normal((4, 5))[rng.integers(0, 4, n)] * 3 + rng.standard_normal((n, 5))
    points[-3:] = points[0]  # repeated rows
    cols = ", ".join(f"{c} double" for c in segments.CLUSTER_FEATURES)
    rows = [(i, int(i % 7 == 0), *map(float, p)) for i, p in enumerate(points)]
    return segments.cluster_matrix(spark.createDataFrame(rows, f"msno long, is_churn int, {cols}").repartition(5))


def scaled_rows(matrix):
    return np.array([r["scaled"].toArray() for r in matrix.orderBy("msno").collect()])


def plain_lloyd(points, centres, passes):
    for _ in range(passes):
        near = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([points[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)])
        if (((new - centres) ** 2).sum(axis=1) <= segments.TOLERANCE**2).all():
            return new
        centres = new
    return centres


def test_all_starts_move_as_each_would_alone(spark):
    m = blobs(spark)
    points = scaled_rows(m)
    first = segments.first_centres(m, (2, 3, 5), 3, 42)
    assert first.keys() == {(k, s) for k in (2, 3, 5) for s in range(3)}
    # also one centre so far away that no row is nearest to it
    first["lost"] = np.vstack([points[:2], np.full((1, 5), 1e6)])
    settled = segments.lloyd(m, first)
    for key, centres in first.items():
        assert np.allclose(settled[key], plain_lloyd(points, centres, segments.PASSES), atol=1e-9), key
    assert (settled["lost"][2] == 1e6).all()


def test_sweep_costs_and_silhouettes(spark):
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    m = blobs(spark)
    points = scaled_rows(m)
    judge = ClusteringEvaluator(featuresCol="scaled", predictionCol="cluster", distanceMeasure="squaredEuclidean")
    sweep = {r["k"]: r for r in segments.k_sweep(m, (2, 4, 6), starts=4).collect()}
    fits = segments.fit_starts(m, (2, 4, 6), 4)
    for k, (centres, rows) in fits.items():
        cost = ((points[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1).sum()
        assert abs(sweep[k]["inertia"] - cost) < 1e-6 * cost
        assert sum(r["n"] for r in rows) == len(points)
        named = segments.assigned(m, centres).withColumn("cluster", F.col("cluster").cast("double"))
        assert abs(sweep[k]["silhouette"] - judge.evaluate(named)) < 1e-9
        # no worse than the library's own search
        other = KMeans(k=k, seed=1, featuresCol="scaled").fit(m).summary.trainingCost
        assert cost <= other * 1.02


def test_one_cluster_a_row_and_equal_rows(spark):
    cols = ", ".join(f"{c} double" for c in segments.CLUSTER_FEATURES)
    same = segments.cluster_matrix(spark.createDataFrame([(i, 0, 1.0, 2.0, 3.0, 4.0, 5.0) for i in range(6)], f"msno long, is_churn int, {cols}"))
    (row,) = segments.k_sweep(same, (2,), starts=2).collect()
    assert row["inertia"] == 0 and row["silhouette"] == 0 and row["recommended"]


def test_grown_forest_splits_like_a_direct_search_and_does_not_depend_on_parts(spark, table):
    train, test = part(table, "train"), part(table, "test")
    found = {}
    for size in (10, 60, 10_000):
        made = forest.grow(train, [(0, 1), (1, 5), (2, 1)], "features", matrix.balance(train), 42, True, size)
        scores = forest.GrownForest(made, [0, 1, 2]).scored(test, ["msno"]).collect()
        found[size] = (sorted((r["msno"], r["probability"]) for r in scores), made)
    assert found[10][0] == found[60][0] == found[10_000][0] and len(found[10][0]) == test.count()
    # several parts a tree where they are small, and no part above its size
    nodes = found[10][1]["nodes"]
    roots = nodes.filter("node = 0 and left >= 0")
    assert roots.count() > 10 and roots.agg(F.max(F.col("n0") + F.col("n1"))).first()[0] <= 10
    # every leaf keeps its least rows, siblings of one prediction are joined, and all rows drawn are in some leaf
    leaves = found[60][1]["nodes"].filter("left < 0").groupBy("tree").agg(F.min(F.col("n0") + F.col("n1")).alias("least"), F.sum(F.col("n0") + F.col("n1")).alias("rows")).collect()
    ids = np.array([r[0] for r in train.select(F.xxhash64("msno")).collect()])
    for r in leaves:
        assert r["least"] >= (5 if r["tree"] == 1 else 1)
        assert r["rows"] == forest.drawn(ids, forest.tree_hash(42, r["tree"])).sum()
    best = forest.best_bins(np.array([[3.0, 0, 2] + [0] * 29]), np.array([[0.0, 4, 1] + [0] * 29]), np.array([2]), (1.0, 1.0), 1)
    assert best[0][0] == 0 and best[1][0] == pytest.approx(0.5 - 0.7 * (1 - (2 / 7) ** 2 - (5 / 7) ** 2))


def test_unlimited_forest_is_never_held_by_the_driver_and_the_smaller_one_is_its_first_trees(spark, table):
    train, val = part(table, "train"), part(table, "val")
    three, nine = classify.grown_forests(train, [Spec("f", "forest", {"trees": n, "depth": None, "min_leaf": 1}) for n in (3, 9)])
    assert three.trees == nine.trees[:3] and three.grown is nine.grown
    alone = classify.fit_classifier(train, Spec("f", "forest", {"trees": 3, "depth": None, "min_leaf": 1}))
    assert isinstance(alone, forest.GrownForest) and isinstance(alone.nodes(), type(train))
    scores = lambda m: sorted(r["churn_prob"] for r in classify.churn_scores(m, val, "m").collect())
    assert scores(alone) == scores(three)
    # as good as Spark's own, and explained exactly
    own = classify.evaluate(classify.churn_scores(nine, val, "m")).first()["auc"]
    other = classify.fit_classifier(train, Spec("f", "forest", {"trees": 9, "depth": 29, "min_leaf": 1}))
    assert own > classify.evaluate(classify.churn_scores(other, val, "m")).first()["auc"] - 0.08
    assert nine.featureImportances.toArray().sum() == pytest.approx(1.0) and nine.featureImportances.toArray()[0] > 0.2
    long = explain.attributions(val, nine, NAMES).groupBy("msno").agg((F.sum("contribution") + F.first("base_value")).alias("raw"))
    both = classify.churn_scores(nine, val, "m").join(long, "msno")
    assert both.count() == val.count() and both.agg(F.max(F.abs(F.col("raw") - F.col("churn_prob")))).first()[0] < 1e-9


def test_linear_classifier_takes_a_few_newton_passes_and_keeps_its_parts(table):
    train = part(table, "train")
    model = classify.fit_classifier(train, Spec("lr", "linear"))
    assert model.fitted.converged and len(model.fitted.steps) < 12
    x = model.stages[0].transform(train).select(vector_to_array("scaled").alias("x"), "msno").collect()
    z = {r["msno"]: float(np.dot(r["x"], model.stages[-1].coefficients.toArray())) + model.stages[-1].intercept for r in x}
    for r in classify.churn_scores(model, train, "m").collect():
        assert r["churn_prob"] == pytest.approx(1 / (1 + math.exp(-z[r["msno"]])), abs=1e-9)


def test_kmeans_sums_of_many_sets_are_those_of_each(spark, table):
    rows = table.withColumnRenamed("features", "scaled")
    x = np.array([r[0] for r in rows.select(vector_to_array("scaled")).collect()])
    sets = [x[:3], x[5:9], x[:1]]
    for own, found in zip(sets, segments.one_pass(segments.points(rows), sets)):
        far = ((x[:, None] - own) ** 2).sum(axis=2)
        for i, r in enumerate(found):
            mine = far.argmin(axis=1) == i
            assert r["n"] == mine.sum() and r["sum"] == pytest.approx(x[mine].sum(axis=0))
            assert r["cost"] == pytest.approx(far[mine, i].sum()) and r["square"] == pytest.approx((x[mine] ** 2).sum())


def test_kmeans_sums_are_those_of_each_row(spark, table):
    rows = table.select(F.col("features").alias("scaled"))
    own = np.array([[0.0, 0, 0, 0], [1, 0, 0, 0], [9, 9, 9, 9]])
    x = np.array([r[0] for r in segments.points(rows).collect()])
    assert segments.points(segments.points(rows)).columns == ["p"]
    near = ((x[:, None] - own[None]) ** 2).sum(axis=2).argmin(axis=1)
    for i, r in enumerate(segments.one_pass(segments.points(rows), [own])[0]):
        assert r["n"] == (near == i).sum() and r["sum"] == pytest.approx(x[near == i].sum(axis=0)) and r["square"] == pytest.approx((x[near == i] ** 2).sum())


def test_bins_are_cut_from_one_summary_a_feature(spark):
    rng = np.random.default_rng(5)
    columns = [rng.normal(size=600), rng.integers(0, 4, 600).astype(float), np.full(600, 7.0), np.full(600, np.nan), rng.normal(size=600)]
    columns[4][::3] = np.nan
    rows = [(i, *[float(v) for v in r]) for i, r in enumerate(zip(*columns))]
    df = spark.createDataFrame(rows, "msno long, a double, b double, c double, d double, e double").repartition(5)
    made = VectorAssembler(inputCols=list("abcde"), outputCol="features", handleInvalid="keep").transform(df)
    facts = {r["i"]: r for r in forest.bin_facts(made, "features").collect()}
    assert sorted(facts) == [0, 1, 2, 4]
    cuts = forest.bin_cuts(made, "features")
    assert len(cuts) == 5 and cuts[1] == (0.0, 1.0, 2.0) and cuts[2] == () and cuts[3] == ()
    for i in (0, 4):
        known = np.sort(columns[i][~np.isnan(columns[i])])
        exact = {known[max(0, math.ceil(len(known) * s / 32) - 1)] for s in range(1, 32)}
        assert facts[i]["least"] == known[0] and facts[i]["most"] == known[-1]
        assert cuts[i] == tuple(sorted({*exact, known[0]} - {known[-1]}))[-31:]
