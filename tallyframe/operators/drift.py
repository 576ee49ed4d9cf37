"""Drift between two profiles or two frames: Kolmogorov-Smirnov, chi-square and Hellinger."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import as_number
from .summary import _parts, below, bins, grid

#: Upper ends of the categories' score ranges.
P_VALUE = {"DRIFT": 0.05, "POSSIBLE_DRIFT": 0.15, "NO_DRIFT": 1.0}
HELLINGER = {"NO_DRIFT": 0.15, "POSSIBLE_DRIFT": 0.4, "DRIFT": 1.0}


def category(value: float, thresholds: dict[str, float] = P_VALUE) -> str:
    """The category whose range holds the value; an edge belongs to the range below it."""
    return next(name for name, top in sorted(thresholds.items(), key=lambda x: x[1]) if value <= top)


def ks_statistic(target: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """One row (d): the largest distance of the two distribution functions, exact, from counts of values."""
    from pyspark.sql import Window as W

    x = F.col(column).cast("double").alias("x")
    both = target.select(x, F.lit(1).alias("t"), F.lit(0).alias("r")).union(reference.select(x, F.lit(0).alias("t"), F.lit(1).alias("r"))).where("x IS NOT NULL AND NOT isnan(x)")
    counts = both.groupBy("x").agg(F.sum("t").alias("t"), F.sum("r").alias("r")).repartitionByRange(_parts(target), "x").withColumn("part", F.spark_partition_id())
    order = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = counts.groupBy("part").agg(F.sum("t").alias("pt"), F.sum("r").alias("pr"))
    before = parts.select("part", F.coalesce(F.sum("pt").over(order), F.lit(0)).alias("bt"), F.coalesce(F.sum("pr").over(order), F.lit(0)).alias("br"))
    total = parts.agg(F.sum("pt").alias("nt"), F.sum("pr").alias("nr"))
    w = W.partitionBy("part").orderBy("x")
    upto = counts.withColumns({"ut": F.sum("t").over(w), "ur": F.sum("r").over(w)}).join(before, "part").crossJoin(F.broadcast(total))
    # null where a side has no values
    return upto.agg(F.max(F.abs(F.try_divide(F.col("ut") + F.col("bt"), "nt") - F.try_divide(F.col("ur") + F.col("br"), "nr"))).alias("d"))


def ks_from_sketches(target, reference, points: int = 100) -> float:
    """The statistic from two lists of (quantile value, rank) pairs, walked in step."""
    grid = sorted({v for v, _ in target} | {v for v, _ in reference})

    def rank(pairs, v):
        return max((r for x, r in pairs if x <= v), default=0.0)

    return max((abs(rank(target, v) - rank(reference, v)) for v in grid), default=0.0)


def ks_survival(d: float, n: int) -> float:
    """P(D_n >= d) of the two-sided statistic of n values: exact by a matrix power up to 140 values, beyond by the limit law with correction terms."""
    import numpy as np

    if d <= 0 or n < 1:
        return 1.0
    if d >= 1:
        return 0.0
    if n <= 140:
        k = int(n * d) + 1
        h, m = k - n * d, 2 * k - 1
        i, j = np.indices((m, m))
        a = np.where(i - j + 1 >= 0, 1.0, 0.0)
        power = h ** np.arange(1, m + 1)
        a[:, 0] -= power
        a[-1, :] -= power[::-1]
        a[-1, 0] += max(0.0, 2 * h - 1) ** m
        fact = np.array([math.lgamma(max(1, x) + 1) if x > 0 else 0.0 for x in (i - j + 1).ravel()]).reshape(m, m)
        a = a * np.exp(-fact)
        q, scale, base, e, todo = np.eye(m), 0, a, 0, n
        while todo:
            if todo & 1:
                q, scale = q @ base, scale + e
            base, e, todo = base @ base, 2 * e, todo >> 1
            if base.max() > 1e140:
                base, e = base * 1e-140, e + 140
            if q.max() > 1e140:
                q, scale = q * 1e-140, scale + 140
        value = q[k - 1, k - 1]
        if value <= 0:
            return 1.0
        return float(min(1.0, max(0.0, 1 - math.exp(math.log(value) + scale * math.log(10) + math.lgamma(n + 1) - n * math.log(n)))))
    root = math.sqrt(n)
    x = d * root + 1 / (6 * root) + (d * root - 1) / (4 * n)
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))))


def ks_p_value(d: float, n: int, m: int) -> float:
    return ks_survival(d, max(1, round(n * m / (n + m))))


def chi_square_survival(x: float, dof: float) -> float:
    """The upper tail of the chi-square law: a series below the mean, a continued fraction beyond."""
    if math.isinf(x):
        return 0.0
    if x <= 0:
        return 1.0
    a, x = dof / 2, x / 2
    head = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * head)
    b, c = x + 1 - a, 1e300
    f = d = 1 / b
    for i in range(1, 10_000):
        g = -i * (i - a)
        b += 2
        d = 1 / (g * d + b or 1e-300)
        c = b + g / c or 1e-300
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return min(1.0, f * head)


def chi_square(target: DataFrame, reference: DataFrame, column: str) -> DataFrame:
    """One row (statistic, dof): expected counts are whole shares of the reference; an unexpected item gives infinity."""
    def count(df, name):
        return df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias(name))

    joined = count(target, "t").join(count(reference, "r"), "value", "full").fillna(0, ["t", "r"])
    sizes = F.broadcast(target.agg(F.count(F.lit(1)).alias("nt"))).crossJoin(F.broadcast(reference.agg(F.count(F.lit(1)).alias("nr"))))
    rows = joined.crossJoin(sizes).withColumn("expected", F.floor(F.col("r") / F.col("nr") * F.col("nt")))
    term = F.when(F.col("expected") == 0, F.lit(float("inf"))).otherwise(F.pow(F.col("t") - F.col("expected"), 2) / F.col("expected"))
    return rows.agg(F.sum(term).alias("statistic"), F.greatest(F.count("*") - 1, F.lit(1)).alias("dof"))


def chi_square_p_value(statistic: float, dof: int) -> float:
    return chi_square_survival(statistic, dof)


def hellinger(target: DataFrame, reference: DataFrame, column: str, max_buckets: int = 30) -> DataFrame:
    """One row (distance) over bins that both share; NaN counts as missing; null where a side has no values."""
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    both = target.select(x.alias("x"), F.lit(0).alias("side")).union(reference.select(x.alias("x"), F.lit(1).alias("side"))).where("x IS NOT NULL")
    n, low, high = both.agg(F.count("x"), F.min("x"), F.max("x")).first()
    if not n:
        return target.sparkSession.createDataFrame([(None,)], "distance double")
    start, width, count = bins(n, low, high, max_buckets)
    place = F.least(F.floor((F.col("x") - F.lit(start)) / F.lit(width)), F.lit(count - 1))
    shares = both.groupBy(place.alias("bin")).agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") == 1).alias("b"))
    total = F.broadcast(shares.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))
    share = lambda v, all_: F.when(F.col(all_) > 0, F.sqrt(F.col(v) / F.col(all_)))
    gap = share("a", "na") - share("b", "nb")
    return shares.crossJoin(total).agg(F.sqrt(F.sum(gap * gap) / 2).alias("distance"))


def _sketch_ks() -> Column:
    """The largest distance of two columns' distribution functions at the hundred quantiles of both."""
    values = F.filter(F.concat("tg", "rg"), lambda v, i: i % 10 == 5)
    return F.array_max(F.transform(values, lambda v: F.abs(below(F.col("tg"), v) - below(F.col("rg"), v))))


def _sketch_hellinger(max_buckets: int) -> Column:
    n, low, high = F.col("t.d_n") + F.col("r.d_n"), F.least("t.min", "r.min"), F.greatest("t.max", "r.max")
    one = low == high
    count = F.when(one, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(max_buckets), F.ceil(n / 4).cast("int"))))
    width = F.when(one, F.greatest(F.abs(low) * 1e-7, F.lit(1e-7))).otherwise((high + F.abs(high) * 1e-7 - low) / count)
    share = lambda g, i: below(F.col(g), low + (i + 1) * width) - below(F.col(g), low + i * width)
    gaps = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.pow(F.sqrt(share("tg", i)) - F.sqrt(share("rg", i)), F.lit(2)))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, v: s + v) / 2)


def _sketch_chi_square() -> Column:
    """(statistic, dof) from two columns' frequent items."""
    items = lambda side: F.expr(f"approx_top_k_estimate({side}.items, 1024)")
    names = F.array_distinct(F.concat(F.transform(items("t"), lambda i: i["item"]), F.transform(items("r"), lambda i: i["item"])))
    count = lambda side, name: F.coalesce(F.get(F.filter(items(side), lambda i: i["item"] == name), F.lit(0))["count"], F.lit(0).cast("long"))

    def term(name):
        expected = F.floor(count("r", name) / F.col("r.n") * F.col("t.n"))
        return F.when(expected == 0, F.lit(float("inf"))).otherwise(F.pow(count("t", name) - expected, F.lit(2)) / expected)

    return F.struct(F.aggregate(F.transform(names, term), F.lit(0.0), lambda s, v: s + v).alias("statistic"), F.greatest(F.size(names) - 1, F.lit(1)).alias("dof"))


def _exact_ks(frames: tuple[DataFrame, DataFrame], algorithms: dict[str, str]) -> DataFrame | None:
    """(column, exact): the statistics of the columns that are numbers in both frames, from their rows."""
    numeric = [{f.name for f in df.schema.fields if as_number(F.col(f"`{f.name}`"), f.dataType) is not None} for df in frames]
    parts = [ks_statistic(*frames, f"`{c}`").select(F.lit(c).alias("column"), F.col("d").alias("exact")) for c in sorted(numeric[0] & numeric[1]) if algorithms.get(c, "ks") == "ks"]
    return reduce(DataFrame.unionByName, parts) if parts else None


def drift_scores(target: DataFrame, reference: DataFrame, algorithms: dict[str, str] | None = None, thresholds: dict[str, dict[str, float]] | None = None, max_buckets: int = 30, frames: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(column, algorithm, statistic, dof, p_value, category) of every column that both profiles have, from their states.

    algorithms: ks, chi-square or hellinger for a column; by default ks where both have numbers, else chi-square where
    both have items; a column that cannot be compared so has nulls. Sub-metrics are columns like all others.
    thresholds: upper ends of categories by algorithm. Both sides are a row for each column. frames: what the two
    profiles were made of; its numeric columns' Kolmogorov-Smirnov statistics are then counted from all rows, because
    sketches err by some thousandths of rank, which decides a category from about a hundred thousand rows on.
    """
    import warnings

    algorithms = algorithms or {}
    names = {r[0] for r in target.select("column").union(reference.select("column")).distinct().collect()} if algorithms else set()
    for column in set(algorithms) - names:
        warnings.warn(f"column {column} is in neither profile", stacklevel=2)
    joined = target.alias("t").join(reference.alias("r"), F.col("t.column") == F.col("r.column"))
    numbers = (F.coalesce(F.col("t.d_n"), F.lit(0)) > 0) & (F.coalesce(F.col("r.d_n"), F.lit(0)) > 0) & F.col("t.kll").isNotNull() & F.col("r.kll").isNotNull()
    items = F.col("t.items").isNotNull() & F.col("r.items").isNotNull() & (F.col("r.n") > 0)
    chosen = F.coalesce(*[F.when(F.col("t.column") == c, F.lit(a)) for c, a in algorithms.items()], F.when(numbers, F.lit("ks")), F.when(items, F.lit("chi-square")))
    rows, exact = joined.withColumn("algorithm", chosen), F.lit(None).cast("double")
    if frames and (counted := _exact_ks(frames, algorithms)) is not None:
        rows, exact = rows.join(F.broadcast(counted.alias("e")), F.col("t.column") == F.col("e.column"), "left"), F.col("e.exact")  # a row for each column
    chi = F.when((F.col("algorithm") == "chi-square") & items, _sketch_chi_square())
    sketch = lambda side: F.when(F.col("algorithm").isin("ks", "hellinger") & numbers, grid(f"{side}.kll"))
    rows = rows.withColumns({"chi": chi, "tg": sketch("t"), "rg": sketch("r")}).select(
        F.col("t.column").alias("column"), "algorithm", "chi.dof", (F.col("t.d_n") * F.col("r.d_n") / F.greatest(F.col("t.d_n") + F.col("r.d_n"), F.lit(1))).alias("size"),
        F.when((F.col("algorithm") == "ks") & numbers, F.coalesce(exact, _sketch_ks())).when((F.col("algorithm") == "hellinger") & numbers, _sketch_hellinger(max_buckets)).otherwise(F.col("chi.statistic")).alias("statistic"),
    )
    rows = rows.withColumn("p_value", _p_values(F.col("algorithm"), F.col("statistic"), F.col("dof"), F.col("size")))
    limits = {"ks": P_VALUE, "chi-square": P_VALUE, "hellinger": HELLINGER, **(thresholds or {})}
    categories = F.lit(None).cast("string")
    for algorithm, tops in limits.items():
        value = F.col("statistic") if algorithm == "hellinger" else F.col("p_value")
        own = F.coalesce(*[F.when(value <= top, F.lit(name)) for name, top in sorted(tops.items(), key=lambda x: x[1])])
        categories = F.when(F.col("algorithm") == algorithm, own).otherwise(categories)
    return rows.select("column", F.when(F.col("statistic").isNotNull(), F.col("algorithm")).alias("algorithm"), "statistic", "dof", "p_value", categories.alias("category"))


def _p_values(algorithm: Column, statistic: Column, dof: Column, size: Column) -> Column:
    """p-values of a row for each column of a profile."""
    import pandas as pd

    def values(a, s, k, n):
        def one(a, s, k, n):
            if s is None or s != s:
                return None
            return ks_survival(s, max(1, round(n))) if a == "ks" else chi_square_survival(s, k) if a == "chi-square" else None

        return pd.Series([one(*x) for x in zip(a, s, k, n)], dtype="float64")

    values.__annotations__ = {**dict.fromkeys("askn", pd.Series), "return": pd.Series}
    return F.pandas_udf(values, "double")(algorithm, statistic, dof, size)


#: The older name.
calculate_drift_values = drift_scores
