"""The query suite over the driver's tables, with the SQL that each is checked against."""

from lodeframe.queries import operators, tpcds, tpch
from lodeframe.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "operators", "tpcds", "tpch"]
