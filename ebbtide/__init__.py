"""Ebbtide: subscriber churn, lifetime value and campaign analytics as Spark jobs."""
