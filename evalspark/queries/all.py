"""Imports every query module so that the registry is filled."""

from evalspark.queries import (  # noqa: F401
    file_queries,
    metric_queries,
    sample_queries,
    text_queries,
)
from evalspark.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
