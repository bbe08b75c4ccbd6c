"""Lodeframe: a batch analytics engine on Spark SQL."""
