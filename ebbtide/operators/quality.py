"""Checks and profiles of raw tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import percent
from ebbtide.operators.master import null_counts
from ebbtide.operators.ordering import sample_n

# Ages outside (0, 120] are flagged.
AGE_ABOVE, AGE_UP_TO = 0, 120


def share_where(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """(n_rows, name, pct): how many rows meet a condition."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(condition).alias(name))
    return counts.withColumn("pct", percent(F.col(name), F.col("n_rows")))


def invalid_ages(members: DataFrame) -> DataFrame:
    return share_where(members, (F.col("bd") <= AGE_ABOVE) | (F.col("bd") > AGE_UP_TO), "n_invalid")


def overpaid(tx: DataFrame) -> DataFrame:
    listed = F.col("plan_list_price")
    return share_where(tx, (F.col("actual_amount_paid") > listed) & (listed > 0), "n_overpaid")


def zero_seconds(logs: DataFrame) -> DataFrame:
    return share_where(logs, F.col("total_secs") == 0, "n_zero")


def key_overlap(left: DataFrame, right: DataFrame, key: str = "msno") -> DataFrame:
    """Distinct keys on each side, in both, and on one side only: one shuffle of the two key columns."""
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(
        right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    presence = tagged.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return presence.agg(
        F.count_if(F.col("l") == 1).alias("n_left"),
        F.count_if(F.col("r") == 1).alias("n_right"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 1)).alias("n_both"),
        F.count_if((F.col("l") == 1) & (F.col("r") == 0)).alias("n_only_left"),
        F.count_if((F.col("l") == 0) & (F.col("r") == 1)).alias("n_only_right"),
    )


def churn_rates(label_files: Mapping[str, DataFrame]) -> DataFrame:
    """Rows and churn percentage per label file."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n"), (F.avg("is_churn") * 100).alias("churn_rate_pct")).withColumn(
            "label_file", F.lit(name)
        )
        for name, df in label_files.items()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rows_per_source(unioned: DataFrame) -> DataFrame:
    return unioned.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column: position, type, rows, nulls and null percentage."""
    counts = null_counts(df)
    layout = F.create_map(
        *[F.lit(x) for i, (name, kind) in enumerate(df.dtypes) for x in (name, f"{i}:{kind}")]
    )
    tagged = counts.withColumn("_layout", F.element_at(layout, F.col("column_name")))
    return tagged.select(
        F.substring_index("_layout", ":", 1).cast("int").alias("position"),
        "column_name",
        F.expr("substr(_layout, instr(_layout, ':') + 1)").alias("data_type"),
        "n_rows",
        "nulls",
        "null_pct",
    )


def preview(df: DataFrame, n: int = 3) -> DataFrame:
    """A few rows to look at; which ones is not defined."""
    return df.limit(n)


def sampled_null_profile(df: DataFrame, key: str, n: int = 100_000, seed: int = 42) -> DataFrame:
    """Null counts on a sample of exactly ``n`` rows (all rows where there are fewer)."""
    return null_counts(sample_n(df, n, seed, key))
