"""Registered queries and the SQL each is checked against."""

from . import anomalies, forecasts, series, properties  # noqa: F401
from .data import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
