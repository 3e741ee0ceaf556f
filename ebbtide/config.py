"""Study parameters. Dates are yyyymmdd integers unless named ``*_snapshot``."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StudyConfig:
    """The published study's dates, ranges and unit costs."""

    log_snapshot: str = "2017-03-31"
    tenure_snapshot: str = "2017-03-31"
    max_log_days: int = 820
    secs_above: float = 0.0
    secs_up_to: float = 90000.0
    label_cutoff: int = 20170331
    val_from: int = 20160101
    test_from: int = 20160701
    expiry_edges: tuple = (
        0, 20160101, 20170101, 20170301, 20170331, 20170401, 20170601, 20180101, 99999999,
    )
    expiry_labels: tuple = (
        "pre-2016", "2016", "Jan-Feb '17", "Mar '17", "Apr '17", "May-Jun '17", "Jul-Dec '17", "2018+",
    )
    fn_cost: int = 120
    fp_cost: int = 15
    default_threshold: float = 0.5
    retention_rate: float = 0.25
    offer_cost: float = 8.0
    high_value_quantile: float = 0.75
    clv_cap_quantile: float = 0.99
    # None uses every transaction; a yyyymmdd date keeps only earlier ones, so
    # that no feature overlaps the window the label is defined on.
    feature_cutoff: int | None = None
    log_cutoff: int | None = None
    # 'all' fits medians and ranks on every row, 'train' only on the train split.
    fit_on: str = "all"


# The same study laid over the generated star-schema tables (see FIXTURES.md).
STAR_SCHEMA = StudyConfig(
    log_snapshot="2024-01-31",
    tenure_snapshot="2001-08-01",
    max_log_days=31,
    label_cutoff=20000101,
    val_from=19980701,
    test_from=19990401,
    expiry_edges=(0, 19960101, 19980101, 19990101, 20000101, 20000701, 20010101, 20010701, 99999999),
    expiry_labels=(
        "pre-1996", "1996-97", "1998", "1999", "H1 2000", "H2 2000", "H1 2001", "later",
    ),
)

# Threshold grid 0.10 .. 0.90, kept as integer steps so no drift creeps in.
THRESHOLD_STEPS = tuple(range(2, 19))
RETENTION_STEPS = tuple(range(2, 9))
OFFER_COSTS = tuple(range(4, 21, 2))
STEP = 0.05
