"""Cohort split, class balance and the leakage audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.functions.columns import flag, normalise_name, ratio, right_closed_bin
from ebbtide.operators.metrics import roc_auc

# Split names, segment names, largest accepted churn spread.
SPLITS = ("train", "val", "test")
SEGMENTS = ("Power Users", "Casual Listeners", "At-Risk", "Dormant")
CHURN_SPREAD_LIMIT_PP = 5.0
# Audited columns and whether a larger value means less churn.
AUDITED = {
    "last_expire_date": False,
    "last_transaction": False,
    "first_transaction": False,
    "auto_renew_rate": True,
    "cancel_rate": False,
    "days_since_last_log": False,
    "days_as_member": True,
}


def temporal_split(df: DataFrame, registered: str, val_from: int, test_from: int) -> DataFrame:
    """Add ``split`` by registration date; unknown dates (0 or NULL) belong to train."""
    date = F.coalesce(F.col(registered), F.lit(0))
    return df.withColumn(
        "split", F.when(date < val_from, SPLITS[0]).when(date < test_from, SPLITS[1]).otherwise(SPLITS[2])
    )


def split_summary(df: DataFrame, label: str = "is_churn") -> DataFrame:
    """Size, share and churn per split, and whether churn differs by more than the limit."""
    per_split = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("churned"))
    # three splits: arrays of three elements, one row
    whole = per_split.agg(
        F.sum("n").alias("total"),
        (F.max(ratio(F.col("churned") * 100, F.col("n"))) - F.min(ratio(F.col("churned") * 100, F.col("n")))).alias("spread"),
        F.collect_list(F.struct("split", "n", "churned")).alias("parts"),
    )
    return whole.select("total", "spread", F.inline("parts")).select(
        "split",
        "n",
        "churned",
        ratio(F.col("n") * 100, F.col("total")).alias("pct_of_rows"),
        ratio(F.col("churned") * 100, F.col("n")).alias("churn_rate_pct"),
        F.col("spread").alias("spread_pp"),
        (F.col("spread") > CHURN_SPREAD_LIMIT_PP).alias("spread_warning"),
    )


def class_balance(df: DataFrame, label: str = "is_churn", by: Sequence[str] = ()) -> DataFrame:
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), F.sum(label).alias("n_minority"))
    majority = F.col("n_total") - F.col("n_minority")
    return counts.select(
        *by,
        "n_total",
        "n_minority",
        majority.alias("n_majority"),
        ratio(majority, F.col("n_minority")).alias("class_weight_ratio"),
        ratio(F.col("n_minority"), F.col("n_total")).alias("overall_churn_rate"),
    )


def cutoff_contrast(df: DataFrame, date: str, cutoff: int, label: str = "is_churn") -> DataFrame:
    """Churn of rows dated up to the cut-off against rows dated after it."""
    side = F.when(F.col(date) <= cutoff, "up_to_cutoff").when(F.col(date) > cutoff, "after_cutoff")
    sided = df.withColumn("side", side).filter(F.col("side").isNotNull())
    return sided.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), (F.avg(label) * 100).alias("churn_rate_pct")
    )


def churn_by_bin(df: DataFrame, column: str, edges: Sequence, labels: Sequence[str], label: str = "is_churn") -> DataFrame:
    binned = df.withColumn("bin", right_closed_bin(F.col(column), edges, labels)).filter(F.col("bin").isNotNull())
    return binned.groupBy("bin").agg(F.count(label).alias("n"), (F.avg(label) * 100).alias("churn_rate_pct"))


def single_feature_auc(df: DataFrame, audited: Mapping[str, bool] | None = None, label: str = "is_churn") -> DataFrame:
    """AUC of each column used alone as score, whichever direction ranks better."""
    audited = AUDITED if audited is None else audited

    def signed(name: str, inverse: bool) -> Column:
        value = F.col(name).cast("double")
        return (-value if inverse else value).alias(name)

    scores = df.select(label, *[signed(c, inv) for c, inv in audited.items()]).unpivot(
        [label], list(audited), "feature", "score"
    )
    auc = roc_auc(scores, label, "score", by=["feature"])
    return auc.select("feature", F.greatest(F.col("auc"), 1 - F.col("auc")).alias("effective_auc"))


def segment_onehot(df: DataFrame, column: str = "segment_label") -> DataFrame:
    """Replace the segment name by one 0/1 column per known segment."""
    ones = [flag(F.col(column) == s).alias(normalise_name(f"segment_{s}")) for s in SEGMENTS]
    return df.select(*[c for c in df.columns if c != column], *ones)
