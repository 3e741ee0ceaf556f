"""One row per labelled subscriber: join, imputation, null audits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import known, percent

# Feature columns by origin, in model order.
TRANSACTION_FEATURES = (
    "total_paid", "avg_payment", "max_payment", "discount_rate", "n_transactions", "avg_plan_days",
    "auto_renew_rate", "cancel_rate", "days_as_member", "n_payment_methods",
)
LOG_FEATURES = (
    "total_secs", "avg_daily_secs", "max_daily_secs", "total_songs_played", "completion_rate", "skip_rate",
    "unique_songs_ratio", "active_days", "days_since_last_log",
)
MEMBER_FEATURES = (
    "city_freq_rank", "age", "membership_tenure", "gender_male", "gender_female", "gender_unknown",
)
DATE_COLUMNS = (
    "first_transaction", "last_transaction", "last_expire_date", "last_log_date", "first_log_date",
    "registration_init_time",
)


def via_feature_names(columns: Sequence[str]) -> list[str]:
    return [c for c in columns if c.startswith("reg_via_")]


def feature_columns(columns: Sequence[str]) -> list[str]:
    """The ordered model features of a master table (named, never found by exclusion)."""
    segments = [c for c in columns if c.startswith("segment_") and c != "segment_label"]
    return [*TRANSACTION_FEATURES, *LOG_FEATURES, *MEMBER_FEATURES, *via_feature_names(columns), *segments]


def master_features(labels: DataFrame, tx: DataFrame, logs: DataFrame, members: DataFrame) -> DataFrame:
    """Every labelled subscriber with whatever is known; each join is one row to at most one row."""
    return labels.join(tx, "msno", "left").join(logs, "msno", "left").join(members, "msno", "left")


def whole_number_medians(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Exact medians of day- or year-valued columns as one row.

    Values are counted first, so the percentile only ever holds one entry per
    distinct day or year.
    """
    rows = df if fit_on is None else df.filter(fit_on)
    counted = (
        rows.select(*[F.col(c).cast("bigint").alias(c) for c in columns])
        .unpivot([], list(columns), "feature", "value")
        .filter(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.agg(
        *[
            F.percentile(F.when(F.col("feature") == c, F.col("value")), F.lit(0.5), F.col("n")).alias(c)
            for c in columns
        ]
    )


def impute(master: DataFrame, max_log_days: int, fit_on: Column | None = None) -> DataFrame:
    """Fill every gap of the master table.

    No logs: zeros, and the longest silence for days_since_last_log. Age and
    tenure: median over the joined rows (or over ``fit_on`` rows). No member
    record: most common city rank, unknown gender, no channel, date 0. No
    transactions at all: payment features 0, while the payment dates stay NULL
    (``missing_feature_flags`` counts these subscribers).
    """
    medians = whole_number_medians(master, ("age", "membership_tenure"), fit_on)
    median = medians.select(F.struct("age", "membership_tenure").alias("m")).scalar()
    fills: dict[str, Column] = {c: F.lit(0) for c in (*TRANSACTION_FEATURES, *LOG_FEATURES)}
    fills |= {c: F.lit(0) for c in ("last_log_date", "first_log_date", "registration_init_time")}
    fills |= {c: F.lit(0) for c in ("gender_male", "gender_female", *via_feature_names(master.columns))}
    fills |= {"days_since_last_log": F.lit(max_log_days), "gender_unknown": F.lit(1), "city_freq_rank": F.lit(1)}
    fills |= {c: median.getField(c) for c in ("age", "membership_tenure")}
    types = dict(master.dtypes)

    def filled(name: str) -> Column:
        if name not in fills:
            return F.col(name)
        if name in ("age", "membership_tenure"):
            return F.coalesce(F.col(name).cast("double"), fills[name]).alias(name)
        return F.coalesce(F.col(name), fills[name].cast(types[name])).alias(name)

    return master.select(*[filled(c) for c in master.columns])


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column_name, n_rows, nulls, null_pct) for each column, in one pass."""
    names = list(columns or df.columns)
    numeric = {n for n, t in df.dtypes if t in ("double", "float")}
    missing = {n: (F.isnull(n) | F.isnan(n)) if n in numeric else F.isnull(n) for n in names}
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(missing[n]).alias(n) for n in names])
    return counts.unpivot("n_rows", names, "column_name", "nulls").select(
        "column_name", "n_rows", "nulls", percent(F.col("nulls"), F.col("n_rows")).alias("null_pct")
    )


def feature_null_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nulls per column before and after imputation; ``passed`` says none are left."""
    left = null_counts(before).select("column_name", F.col("nulls").alias("nulls_before"))
    right = null_counts(after).select("column_name", F.col("nulls").alias("nulls_after"))
    return left.join(right, "column_name").withColumn("passed", F.col("nulls_after") == 0)


def missing_feature_flags(master: DataFrame) -> DataFrame:
    """Labelled ids without transactions, logs or member record."""
    return master.agg(
        F.count(F.lit(1)).alias("n_labelled"),
        F.count_if(F.isnull("n_transactions")).alias("n_without_transactions"),
        F.count_if(F.isnull("active_days")).alias("n_without_logs"),
        F.count_if(F.isnull("registration_init_time")).alias("n_without_member"),
    )


def nan_to_null(df: DataFrame) -> DataFrame:
    """Doubles with NaN turned into NULL, for tables that came from elsewhere."""
    kinds = dict(df.dtypes)
    return df.select(*[known(F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])
