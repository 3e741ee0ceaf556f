"""Spark ML jobs: segments, churn classifiers, value regressors, attributions."""
