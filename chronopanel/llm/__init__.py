"""Operators for training-data pipelines over ``documents`` and ``pages``; nothing else in the library imports them."""

from .queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
