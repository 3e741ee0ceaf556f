"""Exact evaluation metrics as aggregates over scored tables.

A scored table has a 0/1 label and a score; ``by`` names columns (a model
name, a feature) to evaluate separately. Scores are combined to distinct
values before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.config import STEP, THRESHOLD_STEPS
from ebbtide.functions.columns import ratio
from ebbtide.operators.ordering import ROWS_PER_RANGE, combine, running_totals


def _by_score(scored: DataFrame, label: str, score: str, by: Sequence[str], descending: bool, rows_per_range: int) -> DataFrame:
    y = F.col(label).cast("bigint")
    counts = combine(scored, score, {"pos": y, "neg": 1 - y}, by)
    return running_totals(counts, score, ["pos", "neg"], by, descending, rows_per_range)


def _no_threshold() -> Column:
    return F.lit(None).cast("double").alias("threshold")


def _with_end_point(ranked: DataFrame, by: Sequence[str], point: Column, extra: Column) -> DataFrame:
    """One point per row, and ``extra`` once per group next to its highest score."""
    highest = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
    return ranked.select(*by, F.inline(F.when(highest, F.array(extra, point)).otherwise(F.array(point))))


def roc_auc(scored: DataFrame, label: str, score: str, by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Share of (positive, negative) pairs ranked right, ties counting half; NULL with one class only."""
    ranked = _by_score(scored, label, score, by, False, rows_per_range)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    wins = pos * (F.col("cum_neg") - neg + neg / 2)
    sums = ranked.groupBy(*by).agg(
        F.sum(wins).alias("_wins"),
        F.max("all_pos").cast("double").alias("_p"),
        F.max("all_neg").cast("double").alias("_n"),
    )
    return sums.select(*by, ratio(F.col("_wins"), F.col("_p") * F.col("_n")).alias("auc"))


def roc_curve(scored: DataFrame, label: str, score: str, by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(threshold, fpr, tpr) at every distinct score, and the origin with a NULL threshold."""
    ranked = _by_score(scored, label, score, by, True, rows_per_range)
    point = F.struct(
        F.col(score).cast("double").alias("threshold"),
        ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"),
    )
    origin = F.struct(_no_threshold(), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return _with_end_point(ranked, by, point, origin)


def pr_curve(scored: DataFrame, label: str, score: str, by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """(threshold, precision, recall) at every distinct score, and the end point (NULL, 1, 0)."""
    ranked = _by_score(scored, label, score, by, True, rows_per_range)
    point = F.struct(
        F.col(score).cast("double").alias("threshold"),
        ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio(F.col("cum_pos"), F.col("all_pos")).alias("recall"),
    )
    end = F.struct(_no_threshold(), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return _with_end_point(ranked, by, point, end)


def average_precision(scored: DataFrame, label: str, score: str, by: Sequence[str] = (), rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Sum of precision weighted by each step in recall, with the positive rate as baseline."""
    ranked = _by_score(scored, label, score, by, True, rows_per_range)
    step = ratio(F.col("pos"), F.col("all_pos")) * ratio(F.col("cum_pos"), F.col("cum_pos") + F.col("cum_neg"))
    return ranked.groupBy(*by).agg(
        F.sum(step).alias("average_precision"),
        F.max(ratio(F.col("all_pos"), F.col("all_pos") + F.col("all_neg"))).alias("baseline_precision"),
    )


def confusion_matrix(scored: DataFrame, label: str, score: str, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """tn, fp, fn, tp and their percentages at ``score >= threshold``."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    actual, predicted = F.col(label) == 1, F.col(score) >= cut
    cells = {"tn": ~actual & ~predicted, "fp": ~actual & predicted, "fn": actual & ~predicted, "tp": actual & predicted}
    counts = scored.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in cells.items()])
    whole = F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")
    return counts.select("*", *[ratio(F.col(k) * 100, whole).alias(f"{k}_pct") for k in cells])


def _or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _precision(tp: Column, fp: Column) -> Column:
    return _or_zero(ratio(tp, tp + fp))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _or_zero(ratio(tp * 2, tp * 2 + fp + fn))


def classification_metrics(scored: DataFrame, label: str, score: str, threshold: float | Column, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy, precision, recall and F1 at a threshold; 0 where a denominator is empty."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return confusion_matrix(scored, label, score, threshold, by).select(
        *by,
        _or_zero(ratio(tp + tn, tn + fp + fn + tp)).alias("accuracy"),
        _precision(tp, fp).alias("precision"),
        _or_zero(ratio(tp, tp + fn)).alias("recall"),
        _f1(tp, fp, fn).alias("f1"),
    )


def class_report(scored: DataFrame, label: str, score: str, threshold: float | Column) -> DataFrame:
    """Precision, recall, F1 and support per class with macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def line(name: str, hit: Column, false_alarm: Column, missed: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class_name"),
            _precision(hit, false_alarm).alias("precision"),
            _or_zero(ratio(hit, hit + missed)).alias("recall"),
            _f1(hit, false_alarm, missed).alias("f1"),
            (hit + missed).cast("bigint").alias("support"),
        )

    stayed, churned = line("Not Churn", tn, fn, fp), line("Churn", tp, fp, fn)

    def averaged(name: str, weight_stayed: Column, weight_churned: Column, whole: Column) -> Column:
        mean = lambda f: ratio(stayed.getField(f) * weight_stayed + churned.getField(f) * weight_churned, whole)
        return F.struct(
            F.lit(name).alias("class_name"),
            mean("precision").alias("precision"),
            mean("recall").alias("recall"),
            mean("f1").alias("f1"),
            (tn + fp + fn + tp).cast("bigint").alias("support"),
        )

    accuracy = ratio(tp + tn, tn + fp + fn + tp)
    overall = F.struct(
        F.lit("accuracy").alias("class_name"),
        accuracy.alias("precision"),
        accuracy.alias("recall"),
        accuracy.alias("f1"),
        (tn + fp + fn + tp).cast("bigint").alias("support"),
    )
    macro = averaged("macro avg", F.lit(1.0), F.lit(1.0), F.lit(2.0))
    weighted = averaged("weighted avg", tn + fp, fn + tp, tn + fp + fn + tp)
    matrix = confusion_matrix(scored, label, score, threshold)
    return matrix.select(F.inline(F.array(stayed, churned, overall, macro, weighted)))


def threshold_sweep(
    scored: DataFrame,
    label: str,
    score: str,
    fn_cost: float,
    fp_cost: float,
    steps: Sequence[int] = THRESHOLD_STEPS,
    step: float = STEP,
) -> DataFrame:
    """Confusion counts, cost and metrics at each threshold, from one pass over the rows.

    Each row is reduced to how many thresholds its score reaches; the sweep is
    then worked out on those few counts.
    """
    per_unit = round(1 / step)
    cuts = [k / per_unit for k in sorted(steps)]
    reached = sum((F.when(F.col(score) >= F.lit(t), 1).otherwise(0) for t in cuts), F.lit(0))
    y = F.col(label).cast("bigint")
    counts = scored.filter(F.col(score).isNotNull()).groupBy(reached.alias("reached")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )
    grid = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts, 1)])
    laid_out = counts.select("reached", "pos", "neg", F.inline(grid))
    above = F.col("reached") >= F.col("place")
    cells = laid_out.groupBy("threshold").agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~above, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~above, F.col("neg")).otherwise(0)).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return cells.select(
        "threshold", "tp", "fp", "fn", "tn",
        (fn * fn_cost + fp * fp_cost).alias("business_cost"),
        _f1(tp, fp, fn).alias("f1"),
        _precision(tp, fp).alias("precision"),
        _or_zero(ratio(tp, tp + fn)).alias("recall"),
    )


def optimal_threshold(sweep: DataFrame) -> DataFrame:
    """The cheapest row of a sweep (lowest threshold on ties) and the best-F1 threshold."""
    row = F.struct(*[F.col(c) for c in sweep.columns])
    best = sweep.agg(
        F.min_by(row, F.struct("business_cost", "threshold")).alias("best"),
        F.min_by("threshold", F.struct((-F.col("f1")).alias("f1"), F.col("threshold"))).alias("best_f1_threshold"),
    )
    return best.select(F.col("best.*"), "best_f1_threshold").withColumnRenamed("threshold", "optimal_threshold")


def threshold_savings(sweep: DataFrame, default: float = 0.5) -> DataFrame:
    """Cost at the default threshold against the cheapest one."""
    costs = sweep.agg(
        F.max(F.when(F.abs(F.col("threshold") - default) < 1e-9, F.col("business_cost"))).alias("cost_default"),
        F.min("business_cost").alias("cost_optimal"),
        F.min_by("threshold", F.struct("business_cost", "threshold")).alias("optimal_threshold"),
    )
    saved = F.col("cost_default") - F.col("cost_optimal")
    return costs.select(
        "optimal_threshold", "cost_default", "cost_optimal",
        saved.alias("savings"),
        ratio(saved * 100, F.col("cost_default")).alias("savings_pct"),
    )


def regression_metrics(scored: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """RMSE, MAE and R² in one aggregate."""
    y, error = F.col(actual), F.col(actual) - F.col(predicted)
    sums = scored.groupBy(*by).agg(
        F.count(y).alias("n"), F.avg(error * error).alias("mse"), F.avg(F.abs(error)).alias("mae"), F.var_pop(y).alias("var")
    )
    return sums.select(*by, "n", F.sqrt("mse").alias("rmse"), "mae", (1 - ratio(F.col("mse"), F.col("var"))).alias("r2"))


def residuals(scored: DataFrame, actual: str, predicted: str) -> DataFrame:
    return scored.select("*", (F.col(actual) - F.col(predicted)).alias("residual"))


def model_comparison(
    scored: DataFrame, label: str, score: str, threshold: float, train_seconds: dict[str, float] | None = None
) -> DataFrame:
    """One row per model: AUC, F1, precision and recall on one scored table with a ``model`` column."""
    auc = roc_auc(scored, label, score, by=["model"])
    rest = classification_metrics(scored, label, score, threshold, by=["model"])
    table = auc.join(rest, "model").select("model", "auc", "f1", "precision", "recall")
    if train_seconds is None:
        return table
    seconds = F.create_map(*[F.lit(x) for pair in train_seconds.items() for x in pair])
    return table.withColumn("train_seconds", F.element_at(seconds, F.col("model")))


def select_final_model(comparison: DataFrame, ensemble: str, least_gain: float = 0.005) -> DataFrame:
    """The best single model, unless the ensemble's AUC beats it by ``least_gain`` or more."""
    best_first = F.when(F.col("model") != ensemble, F.struct((-F.col("auc")).alias("worse"), F.col("model")))
    picked = comparison.agg(
        F.max(F.when(F.col("model") != ensemble, F.col("auc"))).alias("single_auc"),
        F.min_by("model", best_first).alias("single_model"),
        F.max(F.when(F.col("model") == ensemble, F.col("auc"))).alias("ensemble_auc"),
    )
    gain = F.coalesce(F.col("ensemble_auc") - F.col("single_auc"), F.lit(0.0))
    keep_single = gain < least_gain
    return picked.select(
        F.when(keep_single, F.col("single_model")).otherwise(F.lit(ensemble)).alias("final_model"),
        F.when(keep_single, F.col("single_auc")).otherwise(F.col("ensemble_auc")).alias("auc"),
        (gain * 100).alias("ensemble_gain_pp"),
    )
