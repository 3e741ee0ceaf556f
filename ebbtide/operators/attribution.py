"""Contributions of features to predictions, as long tables (msno, feature, contribution, value)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def linear_attributions(df: DataFrame, coefficients: Mapping[str, float], background: DataFrame | None = None) -> DataFrame:
    """coefficient · (value − mean of the background rows) for each feature of a linear model."""
    names = list(coefficients)
    means = (df if background is None else background).agg(
        F.struct(*[F.avg(c).alias(c) for c in names]).alias("m")
    ).scalar()
    parts = df.select(
        "msno",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(c).alias("feature"),
                        ((F.col(c) - means.getField(c)) * F.lit(float(b))).alias("contribution"),
                        F.col(c).cast("double").alias("value"),
                    )
                    for c, b in coefficients.items()
                ]
            )
        ),
    )
    return parts


def attribution_importance(attributions: DataFrame) -> DataFrame:
    """Features ranked by mean absolute contribution."""
    means = attributions.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
    order = W.orderBy(F.col("mean_abs_contribution").desc(), F.col("feature"))
    return means.withColumn("importance_rank", F.row_number().over(order))


def top_risk(scored: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` subscribers with the highest churn probability."""
    return scored.orderBy(F.col("churn_prob").desc(), F.col("msno")).limit(n)


def explanation_cases(scored: DataFrame, threshold: float) -> DataFrame:
    """Highest risk (A), lowest risk (B), and the most confident mistake (C).

    C is the missed churner with the highest probability; without a missed
    churner it is the false alarm with the highest probability.
    """
    row = F.struct("msno", "churn_prob", "is_churn")
    rising = F.struct(F.col("churn_prob"), F.col("msno"))
    falling = F.struct((-F.col("churn_prob")).alias("p"), F.col("msno"))
    predicted = F.col("churn_prob") >= threshold
    missed = (F.col("is_churn") == 1) & ~predicted
    alarm = (F.col("is_churn") == 0) & predicted
    picked = scored.filter(F.col("churn_prob").isNotNull()).agg(
        F.min_by(row, falling).alias("a"),
        F.min_by(row, rising).alias("b"),
        F.min_by(row, F.when(missed, falling)).alias("fn"),
        F.min_by(row, F.when(alarm, falling)).alias("fp"),
    )

    def case(name: str, kind, picked_row):
        return F.struct(F.lit(name).alias("case_id"), kind.alias("case_type"), picked_row.alias("row"))

    cases = F.array(
        case("A", F.lit("highest risk"), F.col("a")),
        case("B", F.lit("lowest risk"), F.col("b")),
        case(
            "C",
            F.when(F.col("fn").isNotNull(), "false negative").otherwise("false positive"),
            F.coalesce("fn", "fp"),
        ),
    )
    return picked.select(F.inline(cases)).filter(F.col("row").isNotNull()).select("case_id", "case_type", "row.*")


def explain_cases(cases: DataFrame, attributions: DataFrame, n_features: int = 15) -> DataFrame:
    """The strongest contributions of each case."""
    joined = cases.select("case_id", "case_type", "msno", "churn_prob", "is_churn").join(attributions, "msno")
    order = W.partitionBy("case_id").orderBy(F.abs("contribution").desc(), F.col("feature"))
    return joined.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n_features)


def total_contribution(attributions: DataFrame, keys: Sequence[str] = ("msno",)) -> DataFrame:
    return attributions.groupBy(*keys).agg(F.sum("contribution").alias("total_contribution"))


def feature_place(importance: DataFrame, feature: str, within: int = 10) -> DataFrame:
    """Rank of one feature in an importance table and whether it is among the first ``within``."""
    return importance.filter(F.col("feature") == feature).select(
        "feature", "importance_rank", (F.col("importance_rank") <= within).alias("is_top")
    )
