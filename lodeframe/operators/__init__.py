"""Joins, aggregates, windows and user-defined relations as DataFrame steps."""
