"""Retention campaign economics on a scored table (msno, is_churn, churn_prob)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.config import OFFER_COSTS, RETENTION_STEPS, STEP
from ebbtide.functions.columns import flag, ratio
from ebbtide.operators.distribution import quantiles

# Row name of the whole campaign, breakeven band.
OVERALL = "ALL (high-value target)"
NEAR_BREAKEVEN = 10_000


def campaign_scoring(scores: DataFrame, values: DataFrame, threshold: float | Column) -> DataFrame:
    """Scores with the churn decision and the predicted value (0 where none is known)."""
    cut = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    joined = scores.join(values.select("msno", "predicted_clv"), "msno", "left")
    return joined.select(
        "msno",
        "is_churn",
        "churn_prob",
        flag(F.col("churn_prob") >= cut).alias("predicted_churn"),
        F.coalesce("predicted_clv", F.lit(0.0)).alias("predicted_clv"),
    )


def campaign_target(scored: DataFrame, share: float = 0.75) -> DataFrame:
    """Add is_high_value (at or above the quantile of non-zero values) and is_target."""
    cut = quantiles(scored.filter(F.col("predicted_clv") > 0), ["predicted_clv"], [share]).select("quantile").scalar()
    valued = scored.withColumn("is_high_value", flag(F.col("predicted_clv") >= cut))
    return valued.withColumn("is_target", flag((F.col("predicted_churn") == 1) & (F.col("is_high_value") == 1)))


def _returns(rows: DataFrame, by: Sequence[str], retention: float, cost: float) -> DataFrame:
    gain = F.col("churn_prob") * F.col("predicted_clv") * retention - cost
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_predicted_churners"),
        F.avg("predicted_clv").alias("mean_clv"),
        F.avg("churn_prob").alias("mean_churn_prob"),
        F.sum(gain).alias("net_roi"),
    )
    spent = F.col("n_predicted_churners") * F.lit(float(cost))
    return sums.select(
        *by,
        "n_predicted_churners",
        "mean_clv",
        "mean_churn_prob",
        F.coalesce("net_roi", F.lit(0.0)).alias("net_roi"),
        spent.alias("campaign_cost"),
        F.coalesce(ratio(F.col("net_roi") * 100, spent), F.lit(0.0)).alias("roi_pct"),
    )


def campaign_roi(targeted: DataFrame, retention: float = 0.25, cost: float = 8.0) -> DataFrame:
    """Expected return of making the offer to every target."""
    return _returns(targeted.filter(F.col("is_target") == 1), [], retention, cost)


def roi_sensitivity(
    targeted: DataFrame,
    retention_steps: Sequence[int] = RETENTION_STEPS,
    offer_costs: Sequence[float] = OFFER_COSTS,
    step: float = STEP,
) -> DataFrame:
    """Net return over a grid of retention rates and offer costs.

    The return is linear in both, so one aggregate row serves the whole grid.
    """
    per_unit = round(1 / step)
    grid = F.array(
        *[
            F.struct(F.lit(k / per_unit).alias("retention_rate"), F.lit(float(c)).alias("offer_cost"))
            for k in retention_steps
            for c in offer_costs
        ]
    )
    gross = targeted.filter(F.col("is_target") == 1).agg(
        F.coalesce(F.sum(F.col("churn_prob") * F.col("predicted_clv")), F.lit(0.0)).alias("gross"),
        F.count(F.lit(1)).alias("n_target"),
    )
    cells = gross.select("gross", "n_target", F.inline(grid))
    net = F.col("gross") * F.col("retention_rate") - F.col("offer_cost") * F.col("n_target")
    return cells.select("retention_rate", "offer_cost", net.alias("net_roi")).withColumn(
        "near_breakeven", F.abs("net_roi") < NEAR_BREAKEVEN
    )


def segment_roi(scored: DataFrame, segments: DataFrame, retention: float = 0.25, cost: float = 8.0) -> DataFrame:
    """Expected return per segment when every predicted churner gets the offer."""
    churners = scored.filter(F.col("predicted_churn") == 1)
    named = churners.join(segments.select("msno", F.col("segment_label").alias("segment")), "msno", "left")
    named = named.withColumn("segment", F.coalesce("segment", F.lit("Unknown")))
    out = _returns(named, ["segment"], retention, cost)
    return out.withColumn("outlook", F.when(F.col("net_roi") >= 0, "gain").otherwise("loss"))


def in_order(few: DataFrame, by: str, tie: str) -> DataFrame:
    """A table of a few rows, one a segment, with its ``position`` from the largest ``by`` down."""
    return few.withColumn("position", F.row_number().over(Window.orderBy(F.col(by).desc(), F.col(tie)))).orderBy("position")


def recommended_segment(by_segment: DataFrame) -> DataFrame:
    """The segment with the largest net return."""
    return by_segment.orderBy(F.col("net_roi").desc(), F.col("segment")).limit(1)


def roi_summary(overall: DataFrame, by_segment: DataFrame) -> DataFrame:
    """The whole campaign and every segment in one table."""
    columns = ["segment", *overall.columns]
    return overall.withColumn("segment", F.lit(OVERALL)).select(*columns).unionByName(by_segment.select(*columns))
