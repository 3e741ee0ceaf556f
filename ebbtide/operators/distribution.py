"""Summaries of numeric columns: quantiles, histograms, box data, rates by group."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import known, null_safe_on, percent
from ebbtide.operators.ordering import ROWS_PER_RANGE, running_totals
from ebbtide.session import stage


def long_form(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., feature, value) rows with missing values left out."""
    values = df.select(*keep, *[known(F.col(c)).alias(c) for c in columns])
    return values.unpivot(list(keep), list(columns), "feature", "value").filter(F.col("value").isNotNull())


def quantiles(
    df: DataFrame,
    columns: Sequence[str],
    shares: Sequence[float],
    by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Exact linearly interpolated quantiles as (by..., feature, share, quantile).

    Values are counted, ranked across tasks, and only the two order statistics
    next to each quantile are kept; value ranges that hold none are skipped.
    """
    keys = [*by, "feature"]
    counted = long_form(df, columns, by).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))

    def ranks(total: Column, share: Column) -> tuple[Column, Column]:
        position = (total - 1) * share
        return F.floor(position) + 1, F.ceil(position) + 1

    def within(rank: Column, before: Column, size: Column) -> Column:
        return (rank > before) & (rank <= before + size)

    def needed(before: Column, size: Column, total: Column) -> Column:
        hits = [within(rank, before, size) for s in shares for rank in ranks(total, F.lit(float(s)))]
        return reduce(lambda a, b: a | b, hits)

    ranked = running_totals(counted, "value", ["n"], keys, rows_per_range=rows_per_range, needed=needed)
    wanted = ranked.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    position = (F.col("all_n") - 1) * F.col("share")
    low, high = ranks(F.col("all_n"), F.col("share"))

    def holds(rank: Column) -> Column:
        return within(rank, F.col("cum_n") - F.col("n"), F.col("n"))

    ends = (
        wanted.filter(holds(low) | holds(high))
        .groupBy(*keys, "share")
        .agg(
            F.max(F.when(holds(low), F.col("value"))).alias("low"),
            F.max(F.when(holds(high), F.col("value"))).alias("high"),
            F.max(position - F.floor(position)).alias("part"),
        )
    )
    return ends.select(*keys, "share", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("quantile"))


def approx_quantiles(
    df: DataFrame, columns: Sequence[str], shares: Sequence[float], by: Sequence[str] = (), accuracy: int = 10000
) -> DataFrame:
    """Sketch-based quantiles of the same shape: one pass and no value shuffle."""
    keys = [*by, "feature"]
    sketched = long_form(df, columns, by).groupBy(*keys).agg(
        F.percentile_approx("value", [float(s) for s in shares], accuracy).alias("q")
    )
    shares_col = F.array(*[F.lit(float(s)) for s in shares])
    return sketched.select(*keys, F.inline(F.arrays_zip(shares_col.alias("share"), F.col("q").alias("quantile"))))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, minimum, quartiles and maximum per column."""
    basic = long_form(df, columns).groupBy("feature").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    q = quantiles(df, columns, (0.25, 0.5, 0.75))
    quartiles = q.groupBy("feature").agg(
        *[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(name) for name, s in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75))]
    )
    return basic.join(quartiles, "feature")


def cap_at_quantile(df: DataFrame, column: str, share: float, fit_on: Column | None = None) -> DataFrame:
    """Add ``<column>_capped``: values above the quantile are pulled down to it."""
    fitted = df if fit_on is None else df.filter(fit_on)
    cap = quantiles(fitted, [column], [share]).select("quantile").scalar()
    return df.withColumn(f"{column}_capped", F.when(F.col(column).isNotNull(), F.least(F.col(column).cast("double"), cap)))


def histogram(df: DataFrame, column: str, bins: int, cap_share: float | None = None) -> DataFrame:
    """Counts in ``bins`` equal-width bins between minimum and maximum, the last bin closed."""
    values = df.select(known(F.col(column)).alias("v")).filter(F.col("v").isNotNull())
    if cap_share is not None:
        values = cap_at_quantile(values, "v", cap_share).select(F.col("v_capped").alias("v"))
    span = values.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("span")).scalar()
    lo, hi = span.getField("lo"), span.getField("hi")
    width = (hi - lo) / F.lit(float(bins))
    slot = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col("v") - lo) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    )
    counts = values.select(slot.cast("bigint").alias("bin"), lo.alias("lo"), width.alias("width")).groupBy(
        "bin", "lo", "width"
    ).agg(F.count(F.lit(1)).alias("n"))
    left = F.col("lo") + F.col("bin") * F.col("width")
    return counts.select("bin", left.alias("bin_from"), (left + F.col("width")).alias("bin_to"), "n")


def rounded_value_counts(df: DataFrame, column: str, digits: int = 1) -> DataFrame:
    """How often each value occurs after rounding half to even."""
    return df.groupBy(F.bround(column, digits).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def box_summary(df: DataFrame, columns: Sequence[str], by: str) -> DataFrame:
    """Quartiles and 1.5-IQR whiskers per group and column; whiskers end on data points."""
    q = quantiles(df, columns, (0.25, 0.5, 0.75), [by])
    boxes = stage(
        q.groupBy(by, "feature").agg(
            *[F.max(F.when(F.col("share") == s, F.col("quantile"))).alias(n) for n, s in (("q1", 0.25), ("med", 0.5), ("q3", 0.75))]
        ),
        "boxes",
    )
    values = long_form(df, columns, [by])
    joined = values.join(boxes, null_safe_on(values, boxes, [by, "feature"])).select(
        values["*"], boxes["q1"], boxes["med"], boxes["q3"]
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    ends = joined.groupBy(by, "feature", "q1", "med", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(F.col("value") >= F.col("q1") - reach, F.col("value"))).alias("low_end"),
        F.max(F.when(F.col("value") <= F.col("q3") + reach, F.col("value"))).alias("high_end"),
    )
    return ends.select(
        by, "feature", "n", "q1", "med", "q3",
        F.least("low_end", "q1").alias("whisker_low"),
        F.greatest("high_end", "q3").alias("whisker_high"),
    )


def rate_by(df: DataFrame, dimension: Column | str, label: str, name: str) -> DataFrame:
    """Rows, positives and positive percentage per value of a dimension."""
    key = F.col(dimension) if isinstance(dimension, str) else dimension
    return df.groupBy(key.alias(name)).agg(
        F.count(label).alias("n_customers"),
        F.sum(label).alias("churned"),
        percent(F.sum(label), F.count(label)).alias("churn_rate"),
    )


def mean_profile(df: DataFrame, key: str, columns: Sequence[str], label: str) -> DataFrame:
    """Mean of each column, size and positive percentage per group."""
    return df.groupBy(key).agg(
        *[F.avg(c).alias(c) for c in columns],
        F.count(F.lit(1)).alias("n_customers"),
        (F.avg(label) * 100).alias("churn_rate_pct"),
    )
