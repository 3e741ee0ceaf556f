"""The whole study over generated tables, with few and small models."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from ebbtide.config import STAR_SCHEMA
from ebbtide.operators.campaign import campaign_roi
from ebbtide.plans.modelling import QUICK, Modelling
from ebbtide.plans.study import Study
from ebbtide.sources import star_schema

TABLES = "/root/testdata/sf0.01"
TINY = dataclasses.replace(
    QUICK,
    forest_grid={"trees": (4,), "depth": (3, None), "min_leaf": (5,)},
    trials=1,
    folds=2,
    starts=1,
    value_forest={"trees": 3, "depth": 3, "min_leaf": 5},
    value_excluded=("total_paid", "days_as_member"),
)


@pytest.fixture(scope="module")
def models(spark):
    study = Study(
        star_schema.transaction_drops(spark, TABLES),
        star_schema.log_drops(spark, TABLES),
        star_schema.train_labels(spark, TABLES),
        star_schema.members(spark, TABLES),
        dataclasses.replace(STAR_SCHEMA, feature_cutoff=STAR_SCHEMA.label_cutoff, fit_on="train"),
    )
    return Modelling(study, TINY)


def test_features_stay_before_the_label_window(models):
    m = models.study.master()
    assert m.agg(F.max("last_transaction")).first()[0] < STAR_SCHEMA.label_cutoff
    assert len(models.names) == 35
    assert m.count() == m.select("msno").distinct().count() == 1500


def test_models_are_compared_selected_and_applied(models):
    table = {r["model"]: r for r in models.comparison().collect()}
    assert len(table) == 5 and all(r["train_seconds"] > 0 for r in table.values())
    singles = {k: r["auc"] for k, r in table.items() if k != "Stacking Ensemble"}
    ensemble_wins = table["Stacking Ensemble"]["auc"] - max(singles.values()) >= 0.005
    assert models.final_name() == ("Stacking Ensemble" if ensemble_wins else max(singles, key=lambda k: (singles[k], k)))
    decided = models.decided_scores()
    later = models.split("val", "test").count()
    assert decided.count() == 5 * later == decided.select("msno", "model").distinct().count()
    assert decided.filter((F.col("churn_prob") >= models.threshold()) != (F.col("predicted_churn") == 1)).count() == 0


def test_values_leave_out_what_defines_them(models):
    assert "total_paid" not in models.value_names and len(models.value_names) == 33
    assert {r["feature"] for r in models.value_attributions(20).select("feature").distinct().collect()} == set(models.value_names)
    assert models.value_comparison().count() == 8


def test_campaign_scope(models):
    retained, everyone = models.clv_predictions("labelled_retained"), models.clv_predictions("all")
    test = models.split("test")
    assert everyone.count() == test.count()
    assert retained.join(test.filter("is_churn = 1"), "msno").count() == 0
    known = models.campaign("labelled_retained")
    # this scope can only ever target subscribers who did not churn
    assert known.filter("is_target = 1 and is_churn = 1").count() == 0
    roi = campaign_roi(models.campaign("all")).first()
    assert roi["campaign_cost"] == 8.0 * roi["n_predicted_churners"]


def test_cases_and_top_risk(models):
    cases = models.case_attributions()
    assert {r["case_id"] for r in cases.collect()} == {"A", "B", "C"}
    assert cases.agg(F.max("place")).first()[0] <= 15
    assert models.top_risk_attributions(10).select("msno").distinct().count() == 10


def test_two_efforts_on_one_study_have_their_own_models(models):
    other = Modelling(models.study, dataclasses.replace(TINY, value_forest={"trees": 1, "depth": 1, "min_leaf": 5}))
    assert other.cluster_matrix() is not models.cluster_matrix()
    assert models.matrix()[0].select("msno").count() == 1500


def test_fitted_segments_reach_the_model_matrix(models):
    sizes = {r["segment_label"]: r["count"] for r in models.kmeans_segments().groupBy("segment_label").count().collect()}
    assert {r["segment_label"]: r["count"] for r in models.segmented().groupBy("segment_label").count().collect()} == sizes


def test_leaves_and_column_shares_become_tree_settings():
    from ebbtide.learning.matrix import column_strategy, tree_depth

    assert [tree_depth({"leaves": n}) for n in (2, 8, 24, 31, 32)] == [2, 3, 5, 5, 5] and tree_depth({"depth": 7, "leaves": 2}) == 7
    assert column_strategy({}) == column_strategy({"column_share": 1.0}) == "all" and column_strategy({"column_share": 0.6}) == "0.6"
