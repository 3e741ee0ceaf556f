"""Fixed scoring rules over the feature table.

They take the place of fitted models where a result has to be reproducible by
plain SQL; the evaluation, campaign and attribution operators take either.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

MAIN = {
    "intercept": 0.4, "days_since_last_log": 0.01, "cancel_rate": 2.0, "auto_renew_rate": -2.0, "n_transactions": -0.02,
}
ACTIVITY = {"intercept": -2.0, "days_since_last_log": 0.05, "active_days": -0.1, "skip_rate": 1.5}
PAYMENT = {"intercept": 1.0, "n_transactions": -0.05, "cancel_rate": 1.0, "discount_rate": 4.0}
BLEND = {
    "intercept": -1.0, "days_since_last_log": 0.03, "cancel_rate": 1.5, "auto_renew_rate": -1.0, "n_transactions": -0.03,
}
ENSEMBLE = "Rule Ensemble"
MODELS = {"Rule Main": MAIN, "Rule Activity": ACTIVITY, "Rule Payment": PAYMENT, ENSEMBLE: BLEND}

# Cluster centres in standardised units of segments.CLUSTER_FEATURES.
CENTROIDS = (
    (-0.3, -0.3, -0.3, -0.3, 0.3),
    (2.0, 3.0, 0.5, 3.0, -3.0),
    (2.5, 0.5, 3.0, 2.5, -2.5),
    (3.0, 2.0, 2.0, 3.5, -3.0),
)
VALUE_FACTOR = 0.95


def probability(coefficients: Mapping[str, float]) -> Column:
    """Logistic score rounded to six digits."""
    z = F.lit(coefficients["intercept"])
    for name, weight in coefficients.items():
        if name != "intercept":
            z = z + F.col(name) * F.lit(weight)
    return F.round(1.0 / (1.0 + F.exp(-z)), 6)


def weights(coefficients: Mapping[str, float]) -> dict[str, float]:
    return {k: v for k, v in coefficients.items() if k != "intercept"}
