"""Registries of derived columns: functions from Columns to Columns, so that they stay in the plan."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .types import declared_kind

_log = logging.getLogger(__name__)


class Registry:
    def __init__(self):
        self._single: dict[str, tuple[list[str], Callable]] = {}
        self._multiple: dict[str, tuple[list[str], Callable, str]] = {}
        self._typed: dict[str, tuple[str, Callable]] = {}
        self._metrics: dict[str, tuple[str | None, str | None, Callable]] = {}

    def dataset_udf(self, columns: list[str], name: str):
        """fn(*columns) -> Column, stored under `name`; an input column of that name is never replaced."""
        return lambda fn: self._single.__setitem__(name, (columns, fn)) or fn

    def multioutput_udf(self, columns: list[str], prefix: str | None = None):
        """fn(*columns) -> {name: Column}, stored under prefix.name."""
        return lambda fn: self._multiple.__setitem__(prefix or fn.__name__, (columns, fn, f"{prefix}." if prefix else "")) or fn

    def type_udf(self, kind: str, name: str):
        """fn(column) -> Column for every column of a kind, stored under column.name."""
        return lambda fn: self._typed.__setitem__(name, (kind, fn)) or fn

    def metric_udf(self, name: str, column: str | None = None, kind: str | None = None):
        """fn(column) -> Column whose values are profiled as the sub-metric column/udf.name, for a column or all of a kind."""
        if (column is None) == (kind is None):
            raise ValueError("name a column or a kind")
        return lambda fn: self._metrics.__setitem__(name, (column, kind, fn)) or fn

    def python_udf(self, columns: list[str], name: str, returns: str = "double"):
        """A plain Python function of values as a derived column, in Arrow batches; where it raises, the value is null and the error is logged."""

        def add(fn):
            self._single[name] = (columns, lambda *c: guarded(fn, returns, name)(*c))
            return fn

        return add

    def unregister(self, name: str) -> None:
        for d in (self._single, self._multiple, self._typed, self._metrics):
            d.pop(name, None)

    def apply(self, df: DataFrame, drop: list[str] = ()) -> DataFrame:
        """The frame with all derived columns; one whose inputs are missing is left out, one that fails is null."""
        new: dict = {}
        for name, (columns, fn) in self._single.items():
            if name not in df.columns and set(columns) <= set(df.columns):
                new[name] = self._safe(name, fn, *[F.col(f"`{c}`") for c in columns])
        for name, (columns, fn, prefix) in self._multiple.items():
            if set(columns) <= set(df.columns):
                try:
                    new |= {f"{prefix}{k}": v for k, v in fn(*[F.col(f"`{c}`") for c in columns]).items()}
                except Exception:
                    _log.exception("function %s failed", name)
        for name, (kind, fn) in self._typed.items():
            for f in df.schema.fields:
                if declared_kind(f.dataType) == kind:
                    new[f"{f.name}.{name}"] = self._safe(name, fn, F.col(f"`{f.name}`"))
        for name, (column, kind, fn) in self._metrics.items():
            for f in df.schema.fields:
                if f.name == column or kind is not None and declared_kind(f.dataType) == kind:
                    new[f"{f.name}/udf.{name}"] = self._safe(name, fn, F.col(f"`{f.name}`"))
        return df.withColumns(new).drop(*drop) if new else df.drop(*drop)

    def plan(self, preset: str = "no_items", **options):
        """The plan that profiles of this registry's frames get."""
        from ..plans.resolve import Plan

        return Plan(preset, **options)

    def profile(self, df: DataFrame, plan=None, **options) -> DataFrame:
        """The profile of the frame with all derived columns and sub-metrics."""
        from ..operators.profile import profile

        return profile(self.apply(df), plan or self.plan(), **options)

    @staticmethod
    def _safe(name, fn, *columns):
        try:
            return fn(*columns)
        except Exception:
            _log.exception("function %s failed", name)
            return F.lit(None)


def guarded(fn: Callable, returns: str, name: str) -> Callable:
    """A function of Columns that calls fn value by value; a value that makes it raise gives null."""

    import pandas as pd

    def batch(*series):
        def one(*values):
            try:
                return fn(*values)
            except Exception as error:
                _log.debug("function %s failed: %s", name, error)
                return None

        return pd.Series([one(*v) for v in zip(*series)], dtype=object)

    batch.__annotations__ = {"series": pd.Series, "return": pd.Series}
    return F.pandas_udf(batch, returns)


_NAMED: dict[str, Registry] = {}


def registry(name: str = "") -> Registry:
    """The registry of that name, made when first asked for."""
    return _NAMED.setdefault(name, Registry())


def udf_schema(*names: str, include_default: bool = True) -> Registry:
    """One registry with all functions of the named ones."""
    out = Registry()
    for name in ([""] if include_default else []) + list(names):
        own = registry(name)
        for mine, theirs in ((out._single, own._single), (out._multiple, own._multiple), (out._typed, own._typed), (out._metrics, own._metrics)):
            mine.update(theirs)
    return out
