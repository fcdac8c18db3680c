"""What a panel of series looks like, and what to analyse in it."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SeriesSpec:
    """Names the columns of a panel of time series.

    ``keys`` identify a series (none: the table is one series), ``time`` orders it, ``tie``
    breaks equal time stamps, ``target`` is the measured value and ``features`` are the
    covariates.  ``block_rows`` is the most rows one task should order at a time: a longer
    series is cut into blocks of about that size (see ``Panel.over``).
    """

    time: str = "ts"
    target: str = "y"
    keys: tuple[str, ...] = ()
    features: tuple[str, ...] = ()
    tie: tuple[str, ...] = ()
    block_rows: int = 250_000


@dataclass(frozen=True)
class AnalysisSpec:
    """A request: the task and its parameters (see ``plans.analyze``)."""

    task: str = "forecast"  # forecast | anomaly | both | whatif | target | profile
    horizon: int = 24
    filters: tuple = ()
    models: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    explain: bool = False
    report: bool = False
    cv_folds: int = 3
    period: int = 24
    min_votes: int = 3
    changes: dict = field(default_factory=dict)
    target_value: float | None = None
    bounds: dict = field(default_factory=dict)
