"""Custom metrics: a number that is aggregated, merged and summarised by expressions of its own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def _add(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


@dataclass(frozen=True)
class Metric:
    """update: the state as an aggregate of a column; merge: one state of an array of states; summary: what is shown of it."""

    update: Callable[[Column], Column]
    merge: Callable[[Column], Column] = _add
    summary: Callable[[Column], Column] = lambda state: state


_METRICS: dict[str, Metric] = {}


def register_metric(name: str, metric: Metric) -> Metric:
    """Metrics registered by name can be named in a plan's rules, by `registered`."""
    if name in _METRICS:
        raise ValueError(f"a metric is named {name} already")
    _METRICS[name] = metric
    return metric


def registered(*names: str) -> dict[str, Metric]:
    return {n: _METRICS[n] for n in names or _METRICS}


def summaries(custom: dict[str, Metric]) -> list[Column]:
    """The summary of each custom metric of a profile row, null where the row has none."""
    return [m.summary(F.try_element_at("custom", F.lit(name))).alias(name) for name, m in custom.items()]


#: Merges of states that do not add up.
MERGE_MIN, MERGE_MAX = F.array_min, F.array_max
