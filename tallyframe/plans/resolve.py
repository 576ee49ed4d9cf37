"""Which metrics a column gets: presets by kind, and rules by name or kind."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

from pyspark.sql import types as T

from ..functions.types import declared_kind

_COMMON = ("counts", "types")
PRESETS = {
    "standard": {"integral": (*_COMMON, "dist", "ints", "card", "items"), "fractional": (*_COMMON, "dist", "card"), "string": (*_COMMON, "unicode", "dist", "card", "items"), "any": _COMMON},
    "no_items": {"integral": (*_COMMON, "dist", "ints", "card"), "fractional": (*_COMMON, "dist", "card"), "string": (*_COMMON, "unicode", "dist", "card"), "any": _COMMON},
    "limited": {"integral": (*_COMMON, "dist", "ints"), "fractional": (*_COMMON, "dist"), "string": _COMMON, "any": _COMMON},
    "histogram": dict.fromkeys(("integral", "fractional", "string", "any"), ("dist",)),
}


@dataclass(frozen=True)
class Config:
    kll_k: int = 1024
    hll_lg_k: int = 12
    max_items: int = 1024
    item_length: int = 128
    items_disabled: bool = False
    track_unicode: bool = False
    numeric_strings: bool = False
    columns_per_aggregate: int = 100


@dataclass(frozen=True)
class Rule:
    """Metrics for a column name or a kind; `exclude` takes them away instead. A name beats a kind."""

    metrics: tuple[str, ...]
    column: str | None = None
    kind: str | None = None
    exclude: bool = False


@dataclass(frozen=True)
class Plan:
    preset: str = "standard"
    rules: tuple[Rule, ...] = ()
    config: Config = field(default_factory=Config)
    kinds: dict = field(default_factory=dict)
    #: Conditions counted for a column: {column: {name: Condition or Predicate}}.
    conditions: dict = field(default_factory=dict)
    #: Custom states: {name: Metric of operators.custom}, applied to the columns whose rules name them.
    custom: dict = field(default_factory=dict)

    def metrics_of(self, f: T.StructField) -> tuple[str, ...]:
        kind = self.kinds.get(f.name, declared_kind(f.dataType))
        named = [r for r in self.rules if r.column == f.name]
        typed = [r for r in self.rules if r.column is None and r.kind == kind]
        adds = [r for r in named if not r.exclude] or [r for r in typed if not r.exclude]
        if len(adds) > 1:
            warnings.warn(f"several rules name the metrics of {f.name}; the last one holds", stacklevel=2)
        out = list(adds[-1].metrics if adds else PRESETS[self.preset][kind] if not self.rules or any(r.exclude for r in self.rules) else ())
        out = [m for m in out if not any(m in r.metrics for r in (*named, *typed) if r.exclude)]
        if self.config.items_disabled:
            out = [m for m in out if m != "items"]
        if not self.config.track_unicode:
            out = [m for m in out if m != "unicode"]
        return tuple(dict.fromkeys(out))

    def resolve(self, schema: T.StructType) -> dict[str, tuple[str, ...]]:
        return {f.name: self.metrics_of(f) for f in schema.fields}


class Resolver:
    """A choice of metrics in code: subclass and say which metrics a column of a kind gets."""

    def resolve(self, name: str, kind: str, config: Config) -> tuple[str, ...]:
        raise NotImplementedError


class PresetResolver(Resolver):
    def __init__(self, preset: str = "standard"):
        self.preset = preset

    def resolve(self, name, kind, config):
        return PRESETS[self.preset][kind]


def plan_of(resolver: Resolver, schema: T.StructType, config: Config | None = None) -> Plan:
    """The plan of a resolver's choices for the columns of a schema."""
    config = config or Config()
    rules = tuple(Rule(tuple(resolver.resolve(f.name, declared_kind(f.dataType), config)), column=f.name) for f in schema.fields)
    return Plan(rules=rules, config=config)
