"""Predicates: a small tree with a fluent form and a prefix text form; both compile to a Column."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The tokens of the text form.
TOKENS = {"~": "matches", "~=": "fullmatch", "%": "search", "==": "eq", "!=": "ne", "<": "lt", "<=": "le", ">": "gt", ">=": "ge", "and": "and", "or": "or", "not": "not"}
_NAMES = {v: k for k, v in TOKENS.items()}
_COMPARE = {"eq": operator.eq, "ne": operator.ne, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


@dataclass(frozen=True)
class Predicate:
    """op None is the empty predicate that chained methods start from."""

    op: str | None = None
    args: tuple = ()
    #: A statistic of a summary row that is asked instead of the value.
    of: str | None = None

    def _then(self, op: str, value: Any) -> Predicate:
        new = Predicate(op, (value,), self.of)
        return new if self.op is None else Predicate("and", (self, new))

    def equals(self, v):
        return self._then("eq", v)

    def not_equal(self, v):
        return self._then("ne", v)

    def less_than(self, v):
        return self._then("lt", v)

    def less_or_equals(self, v):
        return self._then("le", v)

    def greater_than(self, v):
        return self._then("gt", v)

    def greater_or_equals(self, v):
        return self._then("ge", v)

    def matches(self, p: str):
        return self._then("matches", p)

    def fullmatch(self, p: str):
        return self._then("fullmatch", p)

    def search(self, p: str):
        return self._then("search", p)

    def is_(self, fn):
        """fn: Column -> Column."""
        return self._then("udf", fn)

    def and_(self, other: Predicate):
        return Predicate("and", (self, other))

    def or_(self, other: Predicate):
        return Predicate("or", (self, other))

    def not_(self):
        return Predicate("not", (self,))

    def column(self, x: Column, is_string: bool = False) -> Column:
        """The predicate on x; patterns hold for strings only, and null holds for nothing."""
        op, a = self.op, tuple(v.column() if isinstance(v, Ref) else v for v in self.args)
        x = statistic(self.of) if self.of else x
        if op in ("and", "or"):
            left, right = (p.column(x, is_string) for p in a)
            return left & right if op == "and" else left | right
        if op == "not":
            return ~a[0].column(x, is_string)
        if op == "udf":
            return F.coalesce(a[0](x), F.lit(False))
        if op in ("matches", "fullmatch", "search"):
            pattern = {"matches": rf"\A(?:{a[0]})", "fullmatch": rf"\A(?:{a[0]})\z", "search": a[0]}[op]
            return F.coalesce(x.rlike(pattern), F.lit(False)) if is_string else F.lit(False)
        if op is None:
            return F.lit(True)
        return F.coalesce(_COMPARE[op](x, a[0] if isinstance(a[0], Column) else F.lit(a[0])), F.lit(False))

    def serialize(self) -> str:
        if self.op in ("and", "or"):
            return f"{self.op} {self.args[0].serialize()} {self.args[1].serialize()}"
        if self.op == "not":
            return f"not {self.args[0].serialize()}"
        if self.op not in _NAMES:
            raise ValueError("only named relations have a text form")
        v = self.args[0]
        text = '"' + v.replace("\\", "\\\\").replace('"', '\\"') + '"' if isinstance(v, str) else str(v)
        return f"{_NAMES[self.op]} x {text}"


#: Namespaces and components of metric paths, and the names of their statistics in summaries.
PATHS = {
    "counts/n": "n", "counts/null": "null", "counts/nan": "nan", "counts/inf": "inf", "distribution/n": "d_n", "distribution/mean": "mean", "distribution/stddev": "stddev",
    "distribution/min": "min", "distribution/max": "max", "distribution/median": "median", "ints/min": "int_min", "ints/max": "int_max",
    "cardinality/est": "card_est", "cardinality/upper_1": "card_upper", "cardinality/lower_1": "card_lower", "condition_count/total": "cond_total",
}


def statistic_name(path: str) -> str:
    """The summary's name of a path like distribution/mean; types/ and distribution/q_ keep their last part; a plain name is itself."""
    return PATHS.get(path, path.split("/", 1)[1] if path.startswith(("types/", "distribution/q_")) else path)


def statistic(path: str) -> Column:
    if path.startswith("condition_count/") and path not in PATHS:
        return F.try_element_at("cond", F.lit(path.split("/", 1)[1]))
    return F.col(f"`{statistic_name(path)}`")


@dataclass(frozen=True)
class Ref:
    """A statistic of the same column's summary row, written ::namespace/component."""

    path: str

    def column(self) -> Column:
        return statistic(self.path)

    def __str__(self) -> str:
        return f"::{self.path}"


def require(component: str) -> Predicate:
    """The start of a predicate on a statistic of a summary row."""
    return Predicate(of=component)


@dataclass(frozen=True)
class Condition:
    """A relation that values are counted by. Failing values are logged, or raise an error, and are given to each action(namespace, name, value)."""

    relation: Any
    log_on_failure: bool = False
    throw_on_failure: bool = False
    actions: tuple = ()


def as_predicate(p) -> Predicate:
    """A predicate of a Condition, a text form, a function of a Column, or a predicate itself."""
    if isinstance(p, Condition):
        p = p.relation
    return p if isinstance(p, Predicate) else parse(p) if isinstance(p, str) else Predicate("udf", (p,))


def relation(op: str, value) -> Predicate:
    """A relation by its name, as predicates have it."""
    return Predicate(TOKENS.get(op, {"less": "lt", "leq": "le", "greater": "gt", "geq": "ge", "equal": "eq", "neq": "ne", "match": "matches"}.get(op, op)), (value,))


def and_relations(a: Predicate, b: Predicate) -> Predicate:
    return a.and_(b)


def or_relations(a: Predicate, b: Predicate) -> Predicate:
    return a.or_(b)


def not_relation(a: Predicate) -> Predicate:
    return a.not_()


_LEX = re.compile(r'\s*("(?:[^"\\]|\\.)*"|[^\s"]+)')


def tokens_of(text: str) -> list[str]:
    return _LEX.findall(text)


def literal(token: str):
    if token.startswith("::"):
        return Ref(token[2:])
    if token.startswith('"'):
        return re.sub(r"\\(.)", r"\1", token[1:-1])
    return float(token) if re.search(r"[.eE]|inf|nan", token) else int(token)


def parse(text: str) -> Predicate:
    tokens = tokens_of(text)

    def read() -> Predicate:
        op = TOKENS[tokens.pop(0)]
        if op in ("and", "or"):
            left = read()
            return Predicate(op, (left, read()))
        if op == "not":
            return Predicate(op, (read(),))
        if tokens.pop(0) != "x":
            raise ValueError("a relation names its value x")
        return Predicate(op, (literal(tokens.pop(0)),))

    out = read()
    if tokens:
        raise ValueError(f"left over: {tokens}")
    return out


def parse_expression(text: str, lookup) -> Column:
    """The prefix form over statistics: numbers, strings, :column:metric references, + - * ** / // % and relations."""
    tokens = tokens_of(text)
    arithmetic = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "**": F.pow, "//": lambda a, b: F.floor(a / b), "%": F.pmod}

    def read() -> Column:
        t = tokens.pop(0)
        if t in arithmetic:
            left = read()
            return arithmetic[t](left, read())
        if t in ("and", "or"):
            left = read()
            right = read()
            return left & right if t == "and" else left | right
        if t == "not":
            return ~read()
        if t in TOKENS and TOKENS[t] in _COMPARE:
            left = read()
            return _COMPARE[TOKENS[t]](left, read())
        if t.startswith(":"):
            _, column, metric = t.split(":", 2)
            return lookup(column, statistic_name(metric))
        return F.lit(literal(t))

    out = read()
    if tokens:
        raise ValueError(f"left over: {tokens}")
    return out


def condition_counts(df, column: str, conditions: dict[str, Predicate]):
    """One row: total of non-null values and how many meet each condition, in one pass."""
    from ..functions.types import kind_of

    x, text = F.col(column), kind_of(df.schema[column].dataType) == "string"
    return df.agg(F.count(x).alias("total"), *[F.count_if(x.isNotNull() & p.column(x, text)).alias(name) for name, p in conditions.items()])


def failures(df, column: str, conditions: dict, id_col: str | None = None, samples: int = 10):
    """(condition, total, failed, samples): values that fail each condition, and up to `samples` of their ids (or of themselves).

    One aggregate for all conditions. The sample is the values of least hash in twice as many classes of the hash.
    """
    from ..functions.types import kind_of

    x, text = F.col(f"`{column}`"), kind_of(df.schema[column].dataType) == "string"
    value = (F.col(f"`{id_col}`") if id_col else x).cast("string")
    h, rows, classes = F.xxhash64(value), [], 2 * samples
    for name, p in conditions.items():
        bad = ~F.coalesce(as_predicate(p).column(x, text), F.lit(False))
        least = [F.min(F.when(bad & (F.pmod(h, F.lit(classes)) == i), F.struct(h.alias("h"), value.alias("v")))) for i in range(classes)]
        held = F.transform(F.slice(F.array_sort(F.array_compact(F.array(*least))), 1, samples), lambda s: s["v"])
        rows.append(F.struct(F.lit(name).alias("condition"), F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("failed"), held.alias("samples")))
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def run_actions(df, column: str, conditions: dict, id_col: str | None = None) -> None:
    """Gives every failing value (with its row's id, where there is one) to the actions of its condition, on the executors.

    Conditions that log or raise do so afterwards, on the driver.
    """
    import logging

    from ..functions.types import kind_of

    x, text = F.col(f"`{column}`"), kind_of(df.schema[column].dataType) == "string"
    failing = {name: x.isNotNull() & ~F.coalesce(as_predicate(c).column(x, text), F.lit(False)) for name, c in conditions.items()}
    acted = {name: c.actions for name, c in conditions.items() if isinstance(c, Condition) and c.actions}
    if acted:
        tags = F.array_compact(F.array(*[F.when(failing[name], F.lit(name)) for name in acted]))
        rows = df.select(F.explode(tags).alias("name"), x.alias("value"), (F.col(f"`{id_col}`") if id_col else F.lit(None)).alias("id"))

        def each(part):
            for r in part:
                for action in acted[r.name]:
                    action("condition_count", r.name, r.value) if id_col is None else action("condition_count", r.name, r.value, r.id)

        rows.foreachPartition(each)
    told = {n: c for n, c in conditions.items() if isinstance(c, Condition) and (c.log_on_failure or c.throw_on_failure)}
    if told:
        failed = df.agg(*[F.count_if(failing[n]).alias(n) for n in told]).first().asDict()
        logged = [n for n, c in told.items() if c.log_on_failure and failed[n]]
        thrown = [n for n, c in told.items() if c.throw_on_failure and failed[n]]
        if logged:
            logging.getLogger(__name__).warning("conditions %s failed", ", ".join(logged))
        if thrown:
            raise ValueError(f"conditions {', '.join(thrown)} failed")


_VALIDATORS: dict[str, dict[str, Condition]] = {}


def condition_validator(columns, name: str | None = None, actions: tuple = ()):
    """Registers a function of a Column as a condition of the named columns; `validators_of` gives them back."""

    def add(fn):
        for c in [columns] if isinstance(columns, str) else columns:
            _VALIDATORS.setdefault(c, {})[name or fn.__name__] = Condition(fn, actions=tuple(actions))
        return fn

    return add


def validators_of(column: str) -> dict[str, Condition]:
    return dict(_VALIDATORS.get(column, {}))
