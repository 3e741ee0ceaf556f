"""Presentation tables: numbers formatted as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _text(pattern: str, value: Column, digits: int) -> Column:
    """Rounded half up first, so the text never depends on a formatter's tie rule; NULL stays NULL."""
    return F.when(value.isNotNull(), F.format_string(pattern, F.round(value, digits)))


def _whole(before: str, value: Column, after: str = "") -> Column:
    """Whole number with thousands separators between two texts; NULL stays NULL."""
    return F.when(value.isNotNull(), F.concat(F.lit(before), F.format_number(F.round(value, 0), 0), F.lit(after)))


def kpi_overview(balance: DataFrame, test_balance: DataFrame, comparison: DataFrame, roi: DataFrame) -> DataFrame:
    """(position, kpi, value) tiles from one-row inputs and a model comparison."""
    tiles = [
        balance.select(F.lit(1).alias("position"), F.lit("Customers Analysed").alias("kpi"), F.format_number("n_total", 0).alias("value")),
        test_balance.select(F.lit(2), F.lit("Test Set Churn Rate"), _text("%.1f%%", F.col("overall_churn_rate") * 100, 1)),
        comparison.agg(F.max("auc").alias("auc")).select(F.lit(3), F.lit("Best Model ROC-AUC"), _text("%.4f", F.col("auc"), 4)),
        roi.select(F.lit(4), F.lit("Campaign Net ROI"), _text("$%.0fk", F.col("net_roi") / 1000, 0)),
    ]
    out = tiles[0]
    for tile in tiles[1:]:
        out = out.union(tile)
    return out


def report_segments(profiles: DataFrame) -> DataFrame:
    return profiles.select(
        F.col("segment_label").alias("segment"),
        F.format_number("n_customers", 0).alias("customers"),
        _text("%.2f", F.col("churn_rate_pct"), 2).alias("churn_rate_pct"),
        _whole("", F.col("avg_daily_secs")).alias("avg_daily_secs"),
        _text("%.2f%%", F.col("completion_rate") * 100, 2).alias("completion_rate"),
        _text("%.2f%%", F.col("skip_rate") * 100, 2).alias("skip_rate"),
        _whole("", F.col("active_days")).alias("active_days"),
        _whole("", F.col("days_since_last_log")).alias("days_since_last_log"),
    )


def report_roi(by_segment: DataFrame) -> DataFrame:
    return by_segment.select(
        "segment",
        F.format_number("n_predicted_churners", 0).alias("predicted_churners"),
        _whole("$", F.col("mean_clv")).alias("mean_clv"),
        _text("%.1f%%", F.col("mean_churn_prob") * 100, 1).alias("mean_churn_prob"),
        _whole("$", F.col("net_roi")).alias("net_roi"),
        _whole("", F.col("roi_pct"), "%").alias("roi_pct"),
    )


def report_threshold(optimal: DataFrame) -> DataFrame:
    """(position, kpi, value) tiles of the chosen threshold."""
    tiles = [
        ("Optimal Threshold", _text("%.2f", F.col("optimal_threshold"), 2)),
        ("F1 @ Optimal", _text("%.4f", F.col("f1"), 4)),
        ("Precision", _text("%.4f", F.col("precision"), 4)),
        ("Recall (Sensitivity)", _text("%.4f", F.col("recall"), 4)),
    ]
    return _tiles(optimal, tiles)


def report_campaign(roi: DataFrame) -> DataFrame:
    """(position, kpi, value) tiles of the whole campaign."""
    tiles = [
        ("Target Segment Size", F.format_number("n_predicted_churners", 0)),
        ("Mean CLV (Target)", _whole("$", F.col("mean_clv"))),
        ("Campaign Cost", _whole("$", F.col("campaign_cost"))),
        ("Net ROI", _text("$%.0fk", F.col("net_roi") / 1000, 0)),
    ]
    return _tiles(roi, tiles)


def _tiles(one_row: DataFrame, tiles: list) -> DataFrame:
    cells = [
        F.struct(F.lit(i).alias("position"), F.lit(kpi).alias("kpi"), text.alias("value"))
        for i, (kpi, text) in enumerate(tiles, start=1)
    ]
    return one_row.select(F.inline(F.array(*cells)))
