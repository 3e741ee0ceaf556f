"""Value, campaign, segments, selection and linear attributions."""

import pytest
from pyspark.sql import functions as F

from ebbtide.operators import attribution, campaign, metrics, segments, value


@pytest.fixture(scope="module")
def scores(spark):
    return spark.createDataFrame(
        [("a", 0, 0.9), ("b", 0, 0.8), ("c", 1, 0.7), ("d", 0, 0.2), ("e", 1, 0.5)],
        "msno string, is_churn int, churn_prob double",
    )


@pytest.fixture(scope="module")
def values(spark):
    return spark.createDataFrame([("a", 400.0), ("b", 100.0), ("d", 300.0), ("x", 9999.0)], "msno string, predicted_clv double")


@pytest.fixture(scope="module")
def named(spark):
    return spark.createDataFrame([("a", "Power Users"), ("b", "At-Risk"), ("d", "Dormant")], "msno string, segment_label string")


def test_campaign(scores, values, named):
    scored = campaign.campaign_scoring(scores, values, 0.5)
    got = {r["msno"]: r for r in campaign.campaign_target(scored, 0.5).collect()}
    # median of the non-zero values is 300, the value equal to it counts as high
    assert {m for m, r in got.items() if r["is_high_value"]} == {"a", "d"}
    assert {m for m, r in got.items() if r["predicted_churn"]} == {"a", "b", "c", "e"}
    assert {m for m, r in got.items() if r["is_target"]} == {"a"}
    assert got["c"]["predicted_clv"] == 0.0
    target = campaign.campaign_target(scored, 0.5)
    roi = campaign.campaign_roi(target).first()
    assert roi["net_roi"] == pytest.approx(0.9 * 400 * 0.25 - 8) and roi["campaign_cost"] == 8.0
    assert roi["roi_pct"] == pytest.approx(roi["net_roi"] / 8 * 100)
    grid = {(r["retention_rate"], r["offer_cost"]): r for r in campaign.roi_sensitivity(target).collect()}
    assert len(grid) == 63
    assert grid[(0.25, 8.0)]["net_roi"] == pytest.approx(roi["net_roi"]) and grid[(0.25, 8.0)]["near_breakeven"]
    by_segment = campaign.segment_roi(scored, named)
    seg = {r["segment"]: r for r in by_segment.collect()}
    # no predicted churner in Dormant; c and e have no segment
    assert set(seg) == {"Power Users", "At-Risk", "Unknown"} and seg["Unknown"]["outlook"] == "loss"
    everyone = scored.filter("predicted_churn = 1").agg(F.sum(F.expr("churn_prob * predicted_clv * 0.25 - 8"))).first()[0]
    assert sum(r["net_roi"] for r in seg.values()) == pytest.approx(everyone)
    assert campaign.recommended_segment(by_segment).first()["segment"] == "Power Users"
    assert campaign.roi_summary(campaign.campaign_roi(target), by_segment).count() == 4


def test_campaign_without_targets(spark, scores):
    none = spark.createDataFrame([], "msno string, predicted_clv double")
    target = campaign.campaign_target(campaign.campaign_scoring(scores, none, 0.5))
    roi = campaign.campaign_roi(target).first()
    assert (roi["n_predicted_churners"], roi["net_roi"], roi["roi_pct"]) == (0, 0.0, 0.0)
    assert all(r["net_roi"] == 0 for r in campaign.roi_sensitivity(target).collect())


def test_published_campaign_cost():
    assert 2869 * 8 == 22952
    assert 1257503.4095909216 / 22952 * 100 == pytest.approx(5478.840230005759)


def test_clv_target(spark):
    labelled = spark.createDataFrame(
        [("a", "train", 0), ("b", "train", 0), ("c", "train", 1), ("d", "test", 0), ("e", "val", 0)],
        "msno string, split string, is_churn int",
    )
    tx = spark.createDataFrame(
        [("a", 300, 30), ("b", 100, 300), ("c", 10, 10), ("d", 9000, 30), ("e", 5, 0)],
        "msno string, total_paid int, days_as_member int",
    )
    got = {r["msno"]: r for r in value.clv_target(labelled, tx).collect()}
    # churned (c) and zero-day (e) subscribers have no value
    assert set(got) == {"a", "b", "d"}
    assert got["a"]["clv_raw"] == pytest.approx(3600) and got["b"]["clv_raw"] == pytest.approx(120)
    cap = 120 + 0.99 * (3600 - 120)
    assert got["d"]["clv"] == pytest.approx(cap) and got["b"]["clv"] == pytest.approx(120)


def test_segment_value_and_priority(spark, values, named):
    summary = value.segment_value(values, named)
    got = {r["segment_label"]: r for r in summary.collect()}
    assert got["Unknown"]["mean_clv"] == 9999.0 and got["Power Users"]["median_clv"] == 400.0
    churn = spark.createDataFrame([("Power Users", 1), ("Power Users", 0)], "segment_label string, is_churn int")
    pri = value.segment_priority(summary, churn).collect()
    assert [(r["segment_label"], r["priority_score"]) for r in pri] == [("Power Users", 200.0)]


def test_name_segments(spark):
    profile = spark.createDataFrame(
        [(0, 5.0, 0.9), (1, 800.0, 0.0), (2, 60.0, 0.3), (3, 20.0, 0.7)],
        "cluster int, days_since_last_log double, completion_rate double",
    )
    got = {r["cluster"]: r["segment_label"] for r in segments.name_segments(profile).collect()}
    assert got == {1: "Dormant", 0: "Power Users", 2: "At-Risk", 3: "Casual Listeners"}
    two = segments.name_segments(profile.filter("cluster < 2")).collect()
    assert {r["cluster"]: r["segment_label"] for r in two} == {1: "Dormant", 0: "Power Users"}
    five = profile.unionByName(spark.createDataFrame([(4, 10.0, 0.5)], profile.schema))
    assert [r["segment_label"] for r in segments.name_segments(five).collect()].count("Casual Listeners") == 2


def test_standardize_and_assign(spark):
    df = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    z = [(r["z_a"], r["z_b"]) for r in segments.standardize(df, ["a", "b"]).orderBy("a").collect()]
    assert z == [(-1.0, 0.0), (1.0, 0.0)]
    got = segments.assign_centroid(df, ["a"], [[0.0], [2.0], [4.0]]).orderBy("a").collect()
    # both points lie midway: the lower cluster number is taken
    assert [(r["cluster"], r["distance"]) for r in got] == [(0, 1.0), (1, 1.0)]


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (5.0, 4.0)], "y double, p double")
    m = metrics.regression_metrics(df, "y", "p").first()
    assert m["rmse"] == pytest.approx((2 / 3) ** 0.5) and m["mae"] == pytest.approx(2 / 3)
    assert m["r2"] == pytest.approx(1 - 2 / 8)
    assert [r["residual"] for r in metrics.residuals(df, "y", "p").orderBy("y").collect()] == [-1.0, 0.0, 1.0]


@pytest.mark.parametrize("ensemble_auc, chosen", [(0.9817, "b"), (0.9870, "ens"), (None, "b")])
def test_select_final_model(spark, ensemble_auc, chosen):
    rows = [("a", 0.909), ("b", 0.9815)] + ([("ens", ensemble_auc)] if ensemble_auc else [])
    got = metrics.select_final_model(spark.createDataFrame(rows, "model string, auc double"), "ens").first()
    assert got["final_model"] == chosen and got["auc"] == dict(rows)[chosen]


def test_explanation_cases(scores):
    got = {r["case_id"]: r for r in attribution.explanation_cases(scores, 0.6).collect()}
    assert (got["A"]["msno"], got["B"]["msno"], got["C"]["msno"]) == ("a", "d", "e")
    assert got["C"]["case_type"] == "false negative"
    alarm = {r["case_id"]: r for r in attribution.explanation_cases(scores, 0.1).collect()}
    assert (alarm["C"]["msno"], alarm["C"]["case_type"]) == ("a", "false positive")


def test_linear_attributions_add_up(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 6.0)], "msno string, x double, y double")
    long = attribution.linear_attributions(df, {"x": 2.0, "y": -1.0})
    total = {r["msno"]: r["total_contribution"] for r in attribution.total_contribution(long).collect()}
    assert total == {"a": pytest.approx(-2 + 2), "b": pytest.approx(2 - 2)}
    top = attribution.attribution_importance(long).orderBy("importance_rank").first()
    assert top["mean_abs_contribution"] == pytest.approx(2.0) and top["feature"] == "x"
