"""Segment assignment, profiles and names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import total_of
from ebbtide.operators.distribution import mean_profile

# Columns subscribers are clustered on.
CLUSTER_FEATURES = ("avg_daily_secs", "completion_rate", "skip_rate", "active_days", "days_since_last_log")


def scaling(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """(feature, mean, std): mean and population deviation per column."""
    rows = df if fit_on is None else df.filter(fit_on)
    stats = rows.agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]
    )
    return stats.unpivot([], list(columns), "feature", "s").select("feature", "s.mean", "s.std")


def standardize(df: DataFrame, columns: Sequence[str], fit_on: Column | None = None) -> DataFrame:
    """Add ``z_<column>``: centred and divided by the population deviation (by 1 where it is 0)."""
    rows = df if fit_on is None else df.filter(fit_on)
    stats = rows.agg(
        F.struct(*[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in columns]).alias("s")
    ).scalar()

    def z(c: str) -> Column:
        mean, std = stats.getField(c).getField("mean"), stats.getField(c).getField("std")
        return ((F.col(c) - mean) / F.coalesce(F.nullif(std, F.lit(0.0)), F.lit(1.0))).alias(f"z_{c}")

    return df.select("*", *[z(c) for c in columns])


def assign_centroid(df: DataFrame, columns: Sequence[str], centroids: Sequence[Sequence[float]]) -> DataFrame:
    """Add ``cluster`` (nearest centroid, the lower number on ties) and its squared distance."""
    distances = [
        F.struct(
            total_of([(F.col(c) - F.lit(float(x))) * (F.col(c) - F.lit(float(x))) for c, x in zip(columns, centroid)]).alias("distance"),
            F.lit(i).alias("cluster"),
        )
        for i, centroid in enumerate(centroids)
    ]
    nearest = df.withColumn("_nearest", F.array_min(F.array(*distances)))
    return nearest.select(
        *df.columns,
        F.col("_nearest").getField("cluster").alias("cluster"),
        F.col("_nearest").getField("distance").alias("distance"),
    )


def cluster_profile(df: DataFrame, label: str = "is_churn", columns: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    return mean_profile(df, "cluster", columns, label)


def name_segments(profile: DataFrame) -> DataFrame:
    """(cluster, segment_label) from a profile with one row per cluster.

    Longest silence is Dormant; of the rest the highest completion is Power
    Users; of what is left the longest silence is At-Risk; others are Casual
    Listeners. Lower cluster numbers win ties.
    """
    silent = lambda x: F.struct((-x["days_since_last_log"]).alias("a"), x["cluster"].alias("b"))
    keen = lambda x: F.struct((-x["completion_rate"]).alias("a"), x["cluster"].alias("b"))

    def first_by(clusters: Column, order) -> Column:
        ordered = F.array_sort(F.transform(clusters, lambda x: F.struct(order(x).alias("k"), x["cluster"].alias("cluster"))))
        return F.get(ordered, F.lit(0)).getField("cluster")

    def without(clusters: Column, taken: Column) -> Column:
        return F.filter(clusters, lambda x: ~x["cluster"].eqNullSafe(taken))

    # k clusters: one short array in one row
    row = profile.agg(F.collect_list(F.struct("cluster", "days_since_last_log", "completion_rate")).alias("left0"))
    row = row.withColumn("dormant", first_by(F.col("left0"), silent))
    row = row.withColumn("left1", without(F.col("left0"), F.col("dormant")))
    row = row.withColumn("power", first_by(F.col("left1"), keen))
    row = row.withColumn("left2", without(F.col("left1"), F.col("power")))
    row = row.withColumn("at_risk", first_by(F.col("left2"), silent))
    return row.select(F.explode("left0").alias("c"), "dormant", "power", "at_risk").select(
        F.col("c.cluster").alias("cluster"),
        F.when(F.col("c.cluster") == F.col("dormant"), "Dormant")
        .when(F.col("c.cluster") == F.col("power"), "Power Users")
        .when(F.col("c.cluster") == F.col("at_risk"), "At-Risk")
        .otherwise("Casual Listeners")
        .alias("segment_label"),
    )


def apply_names(clustered: DataFrame, names: Mapping[int, str]) -> DataFrame:
    """Add ``segment_label`` from k fitted names (cluster number to name)."""
    label = F.lit(None).cast("string")
    for cluster, name in names.items():
        label = F.when(F.col("cluster") == cluster, F.lit(name)).otherwise(label)
    return clustered.withColumn("segment_label", label)


def segment_profiles(df: DataFrame, label: str = "is_churn", columns: Sequence[str] = CLUSTER_FEATURES) -> DataFrame:
    """Feature means, size and churn per named segment."""
    return mean_profile(df, "segment_label", columns, label)
