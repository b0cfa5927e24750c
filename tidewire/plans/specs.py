"""Node specs: what a node does, without how. All are frozen and checked when made.

Conditions are functions from nothing or a DataFrame to a boolean Column, or Columns. A condition that must be Python is made a Column by a UDF.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from .. import functions as fn

ERRORS = ("raise", "drop")


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


@dataclass(frozen=True)
class Source:
    default_path_id: str = "default"


@dataclass(frozen=True)
class Modules:
    """Modules run in order on each frame; each sees the observations of those before it."""

    modules: tuple = ()
    parallel: bool = False
    join_window_ns: int = 100_000_000

    def __post_init__(self):
        _need(bool(self.modules), "at least one module is needed")


@dataclass(frozen=True)
class Extract:
    """Extractors, then a fusion fed each new observation. Kept for older graphs; Modules does the same."""

    extractors: tuple = ()
    fusion: Any = None
    run_fusion: bool = True
    parallel: bool = False
    join_window_ns: int = 100_000_000

    def modules(self) -> tuple:
        return (*self.extractors, *([self.fusion] if self.fusion is not None and self.run_fusion else []))


@dataclass(frozen=True)
class Filter:
    condition: Any
    on_error: str = "raise"

    def __post_init__(self):
        _need(self.on_error in ERRORS, "on_error is 'raise' or 'drop'")


@dataclass(frozen=True)
class ObservationFilter:
    min_count: int = 1


@dataclass(frozen=True)
class SignalFilter:
    signal: str
    threshold: float
    comparison: str = "gt"

    def __post_init__(self):
        _need(self.comparison in fn.COMPARISONS, f"unknown comparison {self.comparison!r}")
        _need(self.threshold == self.threshold, "a threshold cannot be NaN")


@dataclass(frozen=True)
class Sample:
    """``bucket_ns``: streams are numbered in two levels, by buckets of time, so that a long one is spread over many tasks."""

    every_nth: int = 1
    mode: str = "count"
    bucket_ns: int | None = None

    def __post_init__(self):
        _need(self.every_nth >= 1, "every_nth is 1 or more")
        _need(self.mode in ("count", "modulo"), "mode is 'count' or 'modulo'")


@dataclass(frozen=True)
class RateLimit:
    """By an arrival-time column in batch (default: event time), by the clock in a stream."""

    min_interval_ms: float
    time_column: str = "timestamp_ns"
    bucket_ns: int | None = None

    def __post_init__(self):
        _need(self.min_interval_ms >= 0, "an interval cannot be negative")


@dataclass(frozen=True)
class TimestampSample:
    interval_ns: int
    bucket_ns: int | None = None

    def __post_init__(self):
        _need(self.interval_ns >= 0, "an interval cannot be negative")


@dataclass(frozen=True)
class Branch:
    condition: Any
    if_true: str
    if_false: str
    on_error: str = "raise"


@dataclass(frozen=True)
class FanOut:
    paths: tuple

    def __post_init__(self):
        _need(bool(self.paths), "at least one path is needed")


@dataclass(frozen=True)
class MultiBranch:
    branches: tuple  # of (condition, path)
    default: str | None = None
    on_error: str = "raise"

    def __post_init__(self):
        _need(bool(self.branches), "at least one branch is needed")


@dataclass(frozen=True)
class ConditionalFanOut:
    paths: tuple  # of (path, condition)
    on_error: str = "raise"

    def __post_init__(self):
        _need(bool(self.paths), "at least one path is needed")


@dataclass(frozen=True)
class Join:
    """``exact``: latest row of each path in arrival order; ``frame``: rows of one frame, in one shuffle (see operators.joins for when they agree);
    ``auto``: ``frame`` where the compiler can prove that they agree."""

    input_paths: tuple
    mode: str = "all"
    window_ns: int = 100_000_000
    lateness_ns: int = 0
    merge_observations: bool = True
    merge_results: bool = True
    output_path_id: str = "merged"
    strategy: str = "auto"
    flush: bool = False

    def __post_init__(self):
        _need(bool(self.input_paths), "at least one path is needed")
        _need(self.mode in ("all", "any"), "mode is 'all' or 'any'")
        _need(self.strategy in ("auto", "exact", "frame"), "strategy is 'auto', 'exact' or 'frame'")


@dataclass(frozen=True)
class CascadeFusion:
    """A function from DataFrame to DataFrame with the same columns."""

    fusion_fn: Callable
    on_error: str = "raise"


@dataclass(frozen=True)
class Collector:
    batch_size: int = 0
    timeout_ns: int = 0
    emit_partial: bool = True
    flush: bool = False
    bucket_ns: int | None = None


@dataclass(frozen=True)
class Custom:
    """Any function from DataFrame to DataFrame (one row to none, one or many)."""

    processor: Callable
    input_type: str = "flow"
    output_type: str = "flow"
    on_error: str = "raise"


ALL = (Source, Modules, Extract, Filter, ObservationFilter, SignalFilter, Sample, RateLimit, TimestampSample, Branch, FanOut, MultiBranch, ConditionalFanOut, Join, CascadeFusion, Collector, Custom)


@dataclass
class Node:
    """A named spec in a graph."""

    name: str
    spec: Any
    extra: dict = field(default_factory=dict)
