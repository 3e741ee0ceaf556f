"""Payment behaviour per subscriber."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.dates import as_day, days_from


def aggregate_labelled(fact: DataFrame, labels: DataFrame, aggregate: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``aggregate(fact)`` per ``msno``, for labelled ids only.

    The map-side combine shrinks the fact, a hot id included, before its only
    shuffle, and the semi join then works on one row per id in the partitioning
    the aggregate already has. Where the ids can be broadcast, Catalyst moves
    the semi join below the aggregate by itself.
    """
    return aggregate(fact).join(labels.select("msno"), "msno", "left_semi")


def _per_subscriber(tx: DataFrame) -> DataFrame:
    listed, paid = F.col("plan_list_price"), F.col("actual_amount_paid")
    discount = (listed - paid).cast("double") / F.nullif(listed.cast("double"), F.lit(0.0))
    grouped = tx.groupBy("msno").agg(
        F.sum(paid).alias("total_paid"),
        F.avg(paid).alias("avg_payment"),
        F.max(paid).alias("max_payment"),
        F.avg(F.when(listed > 0, F.greatest(discount, F.lit(0.0)))).alias("discount_rate"),
        F.count(F.lit(1)).alias("n_transactions"),
        F.avg("payment_plan_days").alias("avg_plan_days"),
        F.avg(F.col("is_auto_renew").cast("double")).alias("auto_renew_rate"),
        F.avg(F.col("is_cancel").cast("double")).alias("cancel_rate"),
        F.min("transaction_date").alias("first_transaction"),
        F.max("transaction_date").alias("last_transaction"),
        F.max("membership_expire_date").alias("last_expire_date"),
        F.countDistinct("payment_method_id").alias("n_payment_methods"),
    )
    return grouped.withColumn(
        "days_as_member", days_from(as_day(F.col("first_transaction")), as_day(F.col("last_transaction")))
    )


def transaction_features(tx: DataFrame, labels: DataFrame, cutoff: int | None = None) -> DataFrame:
    """Thirteen payment columns per labelled subscriber, from rows before ``cutoff`` if one is set."""
    if cutoff is not None:
        tx = tx.filter(F.col("transaction_date") < cutoff)
    return aggregate_labelled(tx, labels, _per_subscriber)
