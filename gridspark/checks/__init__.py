"""Queries over the given tables, one or more per operator, with the SQL they must equal."""

from gridspark.checks import analysis_queries, grid_queries, model_queries  # noqa: F401
from gridspark.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
