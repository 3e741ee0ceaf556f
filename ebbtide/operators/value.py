"""Customer value target and value summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.operators.distribution import quantiles

DAYS_PER_MONTH, MONTHS_PER_YEAR = 30, 12


def clv_target(labelled: DataFrame, tx: DataFrame, cap_share: float = 0.99, fit_split: str = "train") -> DataFrame:
    """Yearly value of retained subscribers, capped at a quantile of one split.

    ``labelled`` has msno, split and is_churn. Subscribers that churned or
    were never a member for a whole day have no value.
    """
    paid = tx.select("msno", "total_paid", "days_as_member")
    retained = (
        labelled.select("msno", "split", "is_churn")
        .filter(F.col("is_churn") == 0)
        .join(paid, "msno")
        .filter(F.col("days_as_member") > 0)
    )
    months = F.col("days_as_member").cast("double") / DAYS_PER_MONTH
    raw = retained.select("msno", "split", (F.col("total_paid") / months * MONTHS_PER_YEAR).alias("clv_raw"))
    cap = quantiles(raw.filter(F.col("split") == fit_split), ["clv_raw"], [cap_share]).select("quantile").scalar()
    return raw.withColumn("clv", F.least(F.col("clv_raw"), cap))


def clv_training_set(features: DataFrame, clv: DataFrame) -> DataFrame:
    """Feature rows of the subscribers that have a value, with that value."""
    return features.join(clv.select("msno", "clv"), "msno")


def segment_value(predictions: DataFrame, segments: DataFrame) -> DataFrame:
    """Mean and median predicted value per segment."""
    joined = predictions.join(segments.select("msno", "segment_label"), "msno", "left").select(
        F.coalesce("segment_label", F.lit("Unknown")).alias("segment_label"), "predicted_clv"
    )
    medians = quantiles(joined, ["predicted_clv"], [0.5], ["segment_label"]).select(
        "segment_label", F.col("quantile").alias("median_clv")
    )
    means = joined.groupBy("segment_label").agg(
        F.avg("predicted_clv").alias("mean_clv"), F.count("predicted_clv").alias("n_customers")
    )
    return means.join(medians, "segment_label")


def segment_priority(values: DataFrame, labelled_segments: DataFrame) -> DataFrame:
    """Mean value times churn rate: expected value at risk per subscriber of a segment."""
    churn = labelled_segments.groupBy("segment_label").agg(F.avg("is_churn").alias("churn_rate"))
    joined = values.join(churn, "segment_label")
    return joined.select(
        "segment_label", "mean_clv", "churn_rate", (F.col("mean_clv") * F.col("churn_rate")).alias("priority_score")
    )

