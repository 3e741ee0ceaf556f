"""Whole analyses put together from operators, and the query catalogue."""
