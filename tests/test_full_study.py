"""Registered model queries do the full study, and a search fits no more rounds than it needs."""

import types

import pytest

from ebbtide.learning import classify
from ebbtide.plans import catalog
from ebbtide.plans.modelling import Effort
from tests.test_learning import part, table  # noqa: F401

FINDINGS = [
    "clv_model_comparison", "final_model", "gbt2_metrics", "meta_learners", "model_campaign", "model_comparison", "model_explanation_cases", "oof_scores", "rf_metrics",
    "stacking_metrics", "tree_attribution_importance",
]


@pytest.mark.parametrize("name", FINDINGS)
def test_model_queries_take_the_full_effort(spark, monkeypatch, name):
    """Of every number of trees, rounds, trials, folds and starts."""
    asked = []

    class Stop(Exception):
        pass

    def matrix(self):
        asked.append(self.effort)
        raise Stop

    study = types.SimpleNamespace(fitted={})
    monkeypatch.setattr(catalog, "star_schema_study", lambda spark, sf_dir: study)
    monkeypatch.setattr(catalog.Modelling, "matrix", matrix)
    with pytest.raises(Stop):
        catalog.QUERIES[name](None, "")
    full = Effort()
    assert asked == [full]
    assert full.trials == 50 and full.folds == 5 and full.meta_rounds == 100 and full.starts == 10
    assert full.forest_grid == {"trees": (100, 300), "depth": (5, 10, None), "min_leaf": (1, 5, 20)}
    assert full.boost_ranges["rounds"] == full.leafwise_ranges["rounds"] == (200, 1000)
    assert full.value_forest == {"trees": 300, "depth": 10, "min_leaf": 5}


def test_trials_fitted_in_parts_stop_where_whole_ones_do(table, tmp_path, monkeypatch):  # noqa: F811
    train, val = part(table, "train"), part(table, "val")
    ranges = {**classify.BOOST_RANGES, "rounds": (14, 16), "depth": (2, 4)}
    fit, fitted = classify.fit_classifier, []
    monkeypatch.setattr(classify, "fit_classifier", lambda rows, spec, *rest: fitted.append(spec.params["rounds"]) or fit(rows, spec, *rest))
    kept = lambda found: {r["trial"]: (r["stopped_round"], round(r["auc"], 9)) for r in found.collect()}
    whole, best = classify.tune(train, val, ranges, trials=4, ledger=str(tmp_path / "whole"), patience=3)
    assert len(fitted) == 4 and min(fitted) >= 14
    fitted.clear()
    monkeypatch.setattr(classify, "FIRST_ROUNDS", 4)
    parts, same = classify.tune(train, val, ranges, trials=4, ledger=str(tmp_path / "parts"), patience=3)
    assert kept(parts) == kept(whole) and same == best
    assert sorted(set(fitted))[0] == 4 and len(fitted) > 4
    # a curve that a shorter patience has cut is fitted again
    fitted.clear()
    longer, _ = classify.tune(train, val, ranges, trials=4, ledger=str(tmp_path / "parts"), patience=1000)
    uncut, _ = classify.tune(train, val, ranges, trials=4, ledger=str(tmp_path / "whole"), patience=1000)
    assert kept(longer) == kept(uncut)


def test_stops_are_those_of_the_curves(spark):
    curves = [[0.5, 0.6, 0.6, 0.6], [0.5, 0.6, 0.6, 0.6, 0.6], [None] * 9, [None, 0.7, None, 0.2], [0.9, 0.1, 0.1, 0.1, 0.95], [0.1, 0.2, 0.3, 0.4, 0.5]]
    got = [classify.has_stopped(c, 3) for c in curves]
    assert got == [False, True, False, False, True, False]
    rows = [(i, r, a) for i, c in enumerate(curves) for r, a in enumerate([*c, 1.0], 1)]
    later = spark.createDataFrame(rows, "trial int, round int, auc double")
    stopped = {r["trial"]: r["stopped_round"] for r in classify.stopped_rounds(later, ["trial"], 3).collect()}
    assert all((stopped[i] <= len(c)) == s for i, (c, s) in enumerate(zip(curves, got)))
