"""Demographic features and category ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ebbtide.functions.columns import flag, one_hot
from ebbtide.functions.dates import days_before
from ebbtide.session import stage

# Accepted ages and gender codes.
AGE_FROM, AGE_TO = 5, 100
GENDERS = {"gender_male": "male", "gender_female": "female"}


def frequency_rank(df: DataFrame, column: str, rank_name: str) -> DataFrame:
    """Rank 1..n of each value of a category by row count, equal counts by value.

    The window runs over one row per category, after the counts are combined.
    """
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n_rows"))
    order = W.orderBy(F.col("n_rows").desc(), F.col(column).asc())
    return counts.withColumn(rank_name, F.row_number().over(order).cast("bigint"))


def top_categories(df: DataFrame, column: str, k: int) -> list:
    """The ``k`` most frequent values, most frequent first (``k`` values reach the driver)."""
    ranked = frequency_rank(df, column, "rk").filter(F.col("rk") <= k).orderBy("rk")
    return [row[column] for row in ranked.select(column).collect()]


def registered_via_onehot(members: DataFrame, top: list, naming: str = "value") -> DataFrame:
    """Member ids with 0/1 columns for the top registration channels and one for the rest."""
    return members.select("msno", *via_columns(top, naming))


def via_columns(top: list, naming: str) -> list[Column]:
    names = [f"reg_via_{v}" if naming == "value" else f"reg_via_top{i}" for i, v in enumerate(top, start=1)]
    via = F.col("registered_via")
    return one_hot(via, dict(zip(names, top))) + [flag(~F.coalesce(via.isin(*top), F.lit(False))).alias("reg_via_other")]


def member_features(
    members: DataFrame,
    snapshot: str,
    top_k: int = 5,
    naming: str = "value",
    fit_on: Column | None = None,
) -> DataFrame:
    """Age, tenure, city rank, gender and channel columns per member.

    ``fit_on`` restricts the rows the city rank and the channel list are
    counted on (for example to the train cohort).
    """
    fitted = members if fit_on is None else members.filter(fit_on)
    city_rank = stage(frequency_rank(fitted.select("city"), "city", "city_freq_rank"), "city-rank").drop("n_rows")
    top = top_categories(fitted.select("registered_via"), "registered_via", top_k)
    tenure = days_before(snapshot, F.col("registration_init_time"))
    return members.join(city_rank, "city", "left").select(
        "msno",
        "city_freq_rank",
        F.when(F.col("bd").between(AGE_FROM, AGE_TO), F.col("bd")).alias("age"),
        F.when(tenure >= 0, tenure).alias("membership_tenure"),
        *one_hot(F.col("gender"), GENDERS),
        flag(F.col("gender").isNull()).alias("gender_unknown"),
        *via_columns(top, naming),
        "registration_init_time",
    )
