"""User metrics: a name with a function of the metric inputs, or with sums for the shared pass."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

#: The windows of an as-of second: first second, and the second after the last.
WINDOWS = {
    "previous_bar": ("prev_sec", "bar_sec"),
    "current_bar": ("bar_sec", "at_sec + 1"),
    "since_open": ("open_sec", "live_end"),
    "completed": ("open_sec", "cum_end"),
    "pre_market": ("pre_sec", "pre_end"),
}
_METRICS = {}


@dataclass(frozen=True)
class WindowMetric:
    """A metric that the shared pass over the buckets computes along with its own.

    sums: {name: (Column over bucket columns, a name of WINDOWS)}, added up over the window and a
    basket's members. value(basket, union) -> Column of the metric: both give a sum by its name,
    `basket` of the basket, `union` of all distinct members; the frame's own sums (prev_d, cur_d,
    live_d, cum_d, pre_d) and, of the basket, `members` can be asked for too.
    """

    sums: dict[str, tuple[Column, str]]
    value: Callable[[Callable, Callable], Column]

    def __post_init__(self):
        if unknown := {w for _, w in self.sums.values()} - WINDOWS.keys():
            raise ValueError(f"no windows of an as-of second: {sorted(unknown)}")


def register_metric(name, metric):
    """Add fn(Inputs) -> (session_date, at_sec, basket, <name>), or a WindowMetric, under a name."""
    if name in _METRICS:
        raise ValueError(f"metric {name!r} is registered already")
    _METRICS[name] = metric
    return metric


def metric(name):
    """What is registered under a name."""
    return _METRICS[name]


def compiled(names):
    """{name: WindowMetric} of those names that are computed in the shared pass."""
    return {n: metric(n) for n in names if isinstance(metric(n), WindowMetric)}


def unregister_metric(name):
    """Forget a metric."""
    _METRICS.pop(name, None)
