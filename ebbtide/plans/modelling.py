"""Fitting, tuning, stacking, selecting and applying models over one study."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.learning import classify, explain, matrix, segments, value
from ebbtide.learning.classify import Spec
from ebbtide.operators import attribution, campaign, metrics, ordering
from ebbtide.plans.study import Study
from ebbtide.session import stage

ENSEMBLE = "Stacking Ensemble"
BOOSTED, LEAFWISE, FOREST, LINEAR = "Boosted Trees", "Boosted Trees (wide)", "Random Forest", "Logistic Regression"


@dataclass(frozen=True)
class Effort:
    """How much is tried per model family. The rows used are always all rows.

    The defaults are the full study, which the registered queries do. ``QUICK`` keeps
    every step and every grid axis but fits fewer and smaller trees, for tests.
    """

    forest_grid: dict = field(default_factory=lambda: dict(classify.FOREST_GRID))
    boost_ranges: dict = field(default_factory=lambda: dict(classify.BOOST_RANGES))
    leafwise_ranges: dict = field(default_factory=lambda: dict(classify.LEAFWISE_RANGES))
    trials: int = 50
    folds: int = 5
    meta_rounds: int = 100
    starts: int = 10
    value_forest: dict = field(default_factory=lambda: dict(value.FOREST))
    # The value target is computed from total_paid and days_as_member; naming
    # them here fits value models that cannot just read it off.
    value_excluded: tuple = ()
    ks: tuple = tuple(range(2, 9))


QUICK = Effort(
    forest_grid={"trees": (5, 10), "depth": (3, 6, None), "min_leaf": (1, 5, 20)},
    boost_ranges={**classify.BOOST_RANGES, "rounds": (4, 10), "depth": (3, 4)},
    leafwise_ranges={**classify.LEAFWISE_RANGES, "rounds": (4, 10), "leaves": (8, 32)},
    trials=4,
    folds=5,
    meta_rounds=5,
    value_forest={"trees": 20, "depth": 6, "min_leaf": 5},
)


class Modelling:
    """Model steps of a study; each is done once per session and its result kept."""

    def __init__(self, study: Study, effort: Effort = Effort()):
        self.study = study
        self.effort = effort
        self._kept: dict[str, object] = {}

    def _once(self, name: str, build: Callable[[], object]):
        if name not in self._kept:
            self._kept[name] = build()
        return self._kept[name]

    def matrix(self) -> tuple[DataFrame, list[str]]:
        return self._once("matrix", lambda: matrix.model_matrix(self.segmented()))

    def segmented(self) -> DataFrame:
        """Master rows with the fitted ``cluster`` and ``segment_label``."""
        found = self.kmeans_segments().select("msno", "cluster", "segment_label")
        return self._once("segmented", lambda: stage(self.study.master().join(found, "msno", "left"), "fitted-segments"))

    def split(self, *names: str) -> DataFrame:
        return self.matrix()[0].filter(F.col("split").isin(*names))

    @property
    def names(self) -> list[str]:
        return self.matrix()[1]

    # classifiers

    def linear(self):
        """Two-step scores, models and fit time of the linear classifier."""
        return self._once("linear", lambda: self._two_step(Spec(LINEAR, "linear")))

    def _two_step(self, spec: Spec):
        return classify.two_step(self.split("train"), self.split("val"), self.split("test"), spec)

    def forest_grid(self):
        return self._once(
            "forest-grid", lambda: classify.forest_grid(self.split("train"), self.split("val"), self.effort.forest_grid)
        )

    def forest(self):
        return self._once("forest", lambda: self._two_step(self.forest_grid()[1]))

    def tuned(self, name: str):
        ranges, seed = {
            BOOSTED: (self.effort.boost_ranges, 42),
            LEAFWISE: (self.effort.leafwise_ranges, 43),
        }[name]
        return self._once(
            f"tuned-{name}",
            lambda: classify.tune(self.split("train"), self.split("val"), ranges, self.effort.trials, seed, name),
        )

    def boosted(self, name: str):
        return self._once(f"two-step-{name}", lambda: self._two_step(self.tuned(name)[1]))

    def base_specs(self) -> list[Spec]:
        return [self.forest_grid()[1], self.tuned(BOOSTED)[1], self.tuned(LEAFWISE)[1]]

    def out_of_fold(self) -> DataFrame:
        def build() -> DataFrame:
            train = self.split("train")
            folds = classify.assign_folds(train.select("msno", "is_churn"), self.effort.folds).drop("is_churn")
            folded = stage(train.join(folds, "msno"), "folded")
            specs = self.base_specs()
            start = time.monotonic()
            scores = stage(classify.out_of_fold(folded, specs, self.effort.folds), "out-of-fold")
            self._kept["out-of-fold-seconds"] = time.monotonic() - start
            return scores

        return self._once("out-of-fold", build)

    def stacking(self) -> dict:
        """Meta learner on out-of-fold scores; base models refitted on the whole train split."""

        def build() -> dict:
            specs = self.base_specs()
            base = [self.forest()[1], self.boosted(BOOSTED)[1], self.boosted(LEAFWISE)[1]]
            later = None
            for spec, model in zip(specs, base):
                part = classify.churn_scores(model, self.split("val", "test"), spec.name)
                later = part if later is None else later.unionByName(part)
            oof_meta = stage(classify.meta_features(self.out_of_fold().drop("fold"), specs), "meta-train")
            later_meta = stage(classify.meta_features(later, specs), "meta-later")
            kind, model, table = classify.fit_meta(
                oof_meta, later_meta.filter(F.col("split") == "val"), self.effort.meta_rounds
            )
            scores = classify.churn_scores(model, later_meta, ENSEMBLE)
            return {"kind": kind, "model": model, "table": table, "scores": scores, "base": base}

        return self._once("stacking", build)

    def all_scores(self) -> DataFrame:
        """Validation and test scores of all five models."""

        def build() -> DataFrame:
            out = self.stacking()["scores"]
            for step in (self.linear(), self.forest(), self.boosted(BOOSTED), self.boosted(LEAFWISE)):
                out = out.unionByName(step[0])
            return stage(out, "churn-scores")

        return self._once("all-scores", build)

    def comparison(self) -> DataFrame:
        """Validation metrics and fit seconds of all five models."""
        val = self.all_scores().filter(F.col("split") == "val")
        steps = {LINEAR: self.linear(), FOREST: self.forest(), BOOSTED: self.boosted(BOOSTED), LEAFWISE: self.boosted(LEAFWISE)}
        seconds = {name: step[3] for name, step in steps.items()} | {ENSEMBLE: self._kept["out-of-fold-seconds"]}
        return metrics.model_comparison(val, "is_churn", "churn_prob", 0.5, seconds)

    def final_name(self) -> str:
        """Selected model; a one-row result reaches the driver."""
        return self._once(
            "final-name", lambda: metrics.select_final_model(self.comparison(), ENSEMBLE).first()["final_model"]
        )

    def final_scores(self) -> DataFrame:
        return self.all_scores().filter(F.col("model") == self.final_name())

    def threshold(self, split: str = "val") -> float:
        """Cheapest threshold on a split (``val``, so that test stays unseen)."""
        c = self.study.config

        def build() -> float:
            rows = self.final_scores().filter(F.col("split") == split)
            sweep = metrics.threshold_sweep(rows, "is_churn", "churn_prob", c.fn_cost, c.fp_cost)
            return metrics.optimal_threshold(sweep).first()["optimal_threshold"]

        return self._once(f"threshold-{split}", build)

    def decided_scores(self) -> DataFrame:
        """All model scores with the decision at the chosen threshold."""
        return self.all_scores().withColumn("predicted_churn", (F.col("churn_prob") >= self.threshold()).cast("int"))

    def explained_model(self) -> PipelineModel:
        """The selected model, or the boosted one where the ensemble was selected."""
        steps = {LINEAR: self.linear, FOREST: self.forest, LEAFWISE: lambda: self.boosted(LEAFWISE)}
        return steps.get(self.final_name(), lambda: self.boosted(BOOSTED))()[2]

    # values

    def _value_table(self, df: DataFrame) -> DataFrame:
        return matrix.without(df, self.names, self.effort.value_excluded)[0] if self.effort.value_excluded else df

    @property
    def value_names(self) -> list[str]:
        return [n for n in self.names if n not in self.effort.value_excluded]

    def value_rows(self, *splits: str) -> DataFrame:
        def build() -> DataFrame:
            valued = self.matrix()[0].join(self.study.clv().select("msno", "clv"), "msno")
            return stage(self._value_table(valued), "value-matrix")

        return self._once("value-rows", build).filter(F.col("split").isin(*splits))

    def ridge(self):
        return self._once("ridge", lambda: value.ridge_alpha_sweep(self.value_rows("train"), self.value_rows("val")))

    def value_models(self) -> dict[str, PipelineModel]:
        def build() -> dict[str, PipelineModel]:
            train = self.value_rows("train")
            # the stopped round belongs to the classifier; a regressor takes the rounds as drawn
            points = [self.tuned(n)[1].params for n in (BOOSTED, LEAFWISE)]
            boosted = [{**p, "rounds": p["most_rounds"]} for p in points]
            fits = matrix.side_by_side(
                [
                    lambda: value.fit_forest(train, **self.effort.value_forest),
                    lambda: value.fit_boosted(train, boosted[0]),
                    lambda: value.fit_boosted(train, boosted[1]),
                ]
            )
            return {"Ridge": self.ridge()[2], FOREST: fits[0], BOOSTED: fits[1], LEAFWISE: fits[2]}

        return self._once("value-models", build)

    def value_predictions(self) -> DataFrame:
        def build() -> DataFrame:
            rows = self.value_rows("val", "test")
            out = None
            for name, model in self.value_models().items():
                part = value.predictions(model, rows, name)
                out = part if out is None else out.unionByName(part)
            return stage(out, "value-predictions")

        return self._once("value-predictions", build)

    def value_comparison(self) -> DataFrame:
        return value.compare(self.value_predictions())

    def best_value_name(self, split: str = "val") -> str:
        return self._once(f"best-value-{split}", lambda: value.best_model(self.value_comparison(), split))

    def clv_predictions(self, scope: str = "labelled_retained", split: str = "test") -> DataFrame:
        """Predicted values of the best model.

        ``labelled_retained`` covers subscribers known to have stayed, which
        needs the true label; ``all`` values everyone, as a campaign must.
        """
        name = self.best_value_name()
        if scope == "labelled_retained":
            kept = self.value_predictions().filter((F.col("model") == name) & (F.col("split") == split))
            return kept.select("msno", "actual_clv", "predicted_clv")
        everyone = value.predictions(self.value_models()[name], self._value_table(self.split(split)), name)
        return everyone.select("msno", "actual_clv", "predicted_clv")

    # attributions

    def churn_attributions(self, rows: DataFrame) -> DataFrame:
        features = self.split("test").join(rows.select("msno"), "msno", "left_semi")
        return explain.attributions(features, self.explained_model(), self.names, self.split("train"))

    def sampled_attributions(self, n: int | None = None) -> DataFrame:
        """Attributions of all test rows, or of a sample of ``n``."""
        rows = self.split("test").select("msno")
        return self.churn_attributions(rows if n is None else ordering.sample_n(rows, n, 42, "msno"))

    def value_attributions(self, n: int | None = None) -> DataFrame:
        """Attributions of all valued test rows, or of a sample of ``n``."""
        rows = self.value_rows("test").select("msno")
        rows = rows if n is None else ordering.sample_n(rows, n, 42, "msno")
        features = self.value_rows("test").join(rows, "msno", "left_semi")
        return explain.attributions(
            features, self.value_models()[self.best_value_name()], self.value_names, self.value_rows("train")
        )

    def top_risk_attributions(self, n: int = 100) -> DataFrame:
        top = stage(attribution.top_risk(self.final_scores().filter(F.col("split") == "test"), n), "top-risk")
        return self.churn_attributions(top).join(top.select("msno", "churn_prob"), "msno")

    def case_attributions(self) -> DataFrame:
        """Strongest contributions for the highest and lowest risk and the most confident mistake."""
        test = self.final_scores().filter(F.col("split") == "test")
        cases = stage(attribution.explanation_cases(test, self.threshold()), "cases")
        return attribution.explain_cases(cases, self.churn_attributions(cases))

    # campaign

    def campaign(self, scope: str = "all") -> DataFrame:
        """Test subscribers with decision, value and target flags from the fitted models."""
        scores = self.final_scores().filter(F.col("split") == "test").select("msno", "is_churn", "churn_prob")
        scored = campaign.campaign_scoring(scores, self.clv_predictions(scope), self.threshold())
        return campaign.campaign_target(scored, self.study.config.high_value_quantile)

    # segments

    def cluster_matrix(self) -> DataFrame:
        return self._once("cluster-matrix", lambda: segments.cluster_matrix(self.study.master()))

    def k_sweep(self) -> DataFrame:
        return segments.k_sweep(self.cluster_matrix(), self.effort.ks, self.effort.starts)

    def kmeans_segments(self) -> DataFrame:
        return self._once(
            "kmeans", lambda: stage(segments.kmeans_segments(self.cluster_matrix(), 4, self.effort.starts), "kmeans")
        )
