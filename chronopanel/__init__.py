"""Time-series analytics on panels of series, as Spark DataFrame operators."""

from .operators.panel import Panel
from .spec import AnalysisSpec, SeriesSpec

__all__ = ["AnalysisSpec", "Panel", "SeriesSpec"]
