"""Logical relations, rewrite rules, estimates, and their compilation to DataFrames."""
