"""Incremental ingestion of log drops."""
