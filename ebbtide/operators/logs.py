"""Listening behaviour per subscriber.

Two definitions are kept. ``log_features_single`` reads all rows and counts
distinct dates. The mergeable one drops corrupt seconds, keeps plain sums and
counts per drop (``log_partial``) and derives ratios only after the drops are
added up, so a new drop never needs the old ones re-read.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import ratio, total_of
from ebbtide.functions.dates import days_before
from ebbtide.operators.transactions import aggregate_labelled

# Play-length counters of a log row.
PLAY_COUNTERS = ("num_25", "num_50", "num_75", "num_985", "num_100")


def _songs():
    return total_of([F.col(c) for c in PLAY_COUNTERS])


def log_features_single(logs: DataFrame, labels: DataFrame) -> DataFrame:
    def per_subscriber(rows: DataFrame) -> DataFrame:
        sums = rows.groupBy("msno").agg(
            F.sum("total_secs").alias("total_secs"),
            F.avg("total_secs").alias("avg_daily_secs"),
            F.max("total_secs").alias("max_daily_secs"),
            F.sum(_songs()).alias("total_songs_played"),
            F.sum("num_100").alias("full_plays"),
            F.sum("num_25").alias("short_plays"),
            F.avg(ratio(F.col("num_unq"), _songs())).alias("unique_songs_ratio"),
            F.countDistinct("date").alias("active_days"),
            F.max("date").alias("last_log_date"),
            F.min("date").alias("first_log_date"),
        )
        return sums.select(
            "msno", "total_secs", "avg_daily_secs", "max_daily_secs", "total_songs_played",
            ratio(F.col("full_plays"), F.col("total_songs_played")).alias("completion_rate"),
            ratio(F.col("short_plays"), F.col("total_songs_played")).alias("skip_rate"),
            "unique_songs_ratio", "active_days", "last_log_date", "first_log_date",
        )

    return aggregate_labelled(logs, labels, per_subscriber)


def log_partial(logs: DataFrame, above: float = 0.0, up_to: float = 90000.0) -> DataFrame:
    """Mergeable state of one drop: one row per subscriber, rows with impossible seconds left out."""
    songs = _songs()
    usable = logs.filter((F.col("total_secs") > above) & (F.col("total_secs") <= up_to))
    return usable.groupBy("msno").agg(
        F.sum(F.col("total_secs").cast("double")).alias("sum_secs"),
        F.count(F.lit(1)).alias("n_rows"),
        F.max(F.col("total_secs").cast("double")).alias("max_secs"),
        F.sum(songs.cast("double")).alias("total_songs"),
        F.sum(F.col("num_100").cast("double")).alias("sum_num100"),
        F.sum(F.col("num_25").cast("double")).alias("sum_num25"),
        F.sum(ratio(F.col("num_unq"), songs)).alias("sum_unq_ratio"),
        F.count_if(songs > 0).alias("n_unq_ratio_rows"),
        F.max("date").alias("last_log_date"),
        F.min("date").alias("first_log_date"),
    )


def merge_log_partials(partials: Iterable[DataFrame]) -> DataFrame:
    """Add up partial states; the result is again a partial state."""
    stacked = reduce(lambda a, b: a.unionByName(b), partials)
    added = ("sum_secs", "n_rows", "total_songs", "sum_num100", "sum_num25", "sum_unq_ratio", "n_unq_ratio_rows")
    return stacked.groupBy("msno").agg(
        *[F.sum(c).alias(c) for c in added],
        F.max("max_secs").alias("max_secs"),
        F.max("last_log_date").alias("last_log_date"),
        F.min("first_log_date").alias("first_log_date"),
    )


def finish_log_features(state: DataFrame, snapshot: str) -> DataFrame:
    return state.select(
        "msno",
        F.col("sum_secs").alias("total_secs"),
        ratio(F.col("sum_secs"), F.col("n_rows")).alias("avg_daily_secs"),
        F.col("max_secs").alias("max_daily_secs"),
        F.col("total_songs").alias("total_songs_played"),
        ratio(F.col("sum_num100"), F.col("total_songs")).alias("completion_rate"),
        ratio(F.col("sum_num25"), F.col("total_songs")).alias("skip_rate"),
        ratio(F.col("sum_unq_ratio"), F.col("n_unq_ratio_rows")).alias("unique_songs_ratio"),
        F.col("n_rows").alias("active_days"),
        "last_log_date",
        "first_log_date",
        days_before(snapshot, F.col("last_log_date")).alias("days_since_last_log"),
    )


def log_features_twopass(
    drops: Iterable[DataFrame], labels: DataFrame, snapshot: str, above: float = 0.0, up_to: float = 90000.0
) -> DataFrame:
    """Partial per drop, merged, reduced to labelled ids, then turned into ratios."""
    state = merge_log_partials([log_partial(d, above, up_to) for d in drops])
    labelled = state.join(labels.select("msno"), "msno", "left_semi")
    return finish_log_features(labelled, snapshot)


def log_coverage(labels: DataFrame, log_features: DataFrame) -> DataFrame:
    """How many labelled subscribers have any usable log."""
    seen = log_features.select("msno", F.lit(1).alias("has_log"))
    counts = labels.select("msno").join(seen, "msno", "left").agg(
        F.count(F.lit(1)).alias("n_labelled"), F.count("has_log").alias("n_with_logs")
    )
    missing = F.col("n_labelled") - F.col("n_with_logs")
    return counts.select(
        "n_labelled",
        "n_with_logs",
        missing.alias("n_without_logs"),
        ratio(F.col("n_with_logs") * 100, F.col("n_labelled")).alias("pct_with_logs"),
        ratio(missing * 100, F.col("n_labelled")).alias("pct_without_logs"),
    )
