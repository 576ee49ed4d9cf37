"""What profiles say: flat summaries, descriptive statistics, histograms, and exact twins of the sketches."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.types import as_number
from .profile import STATES

QUANTILES = {"q_01": 0.01, "q_05": 0.05, "q_10": 0.1, "q_25": 0.25, "median": 0.5, "q_75": 0.75, "q_90": 0.9, "q_95": 0.95, "q_99": 0.99}


def quantile(q: float, kll: str = "kll", n: str = "d_n", inclusive: bool = False) -> Column:
    """A quantile from a sketch; by default the item at place floor(q * n), counted from 0.

    The sketch gives the first item whose rank reaches the one asked for, so a rank just above q gives that item.
    """
    rank = float(q) if inclusive else min(1.0, q + 1e-7)
    return F.when(F.col(n) > 0, F.kll_sketch_get_quantile_double(kll, F.lit(rank)))


def stddev(m2: str = "m2", n: str = "d_n") -> Column:
    return F.when(F.col(n) > 1, F.sqrt(F.col(m2) / (F.col(n) - 1))).when(F.col(n) == 1, 0.0)


def cardinality(sigma: int = 3, lg_k: int = 12, merged: bool = False) -> list[Column]:
    """Estimate and bounds; the bounds follow from the sketch's relative standard error."""
    error = (1.04 if merged else 0.833) / math.sqrt(2**lg_k)
    est = F.hll_sketch_estimate("hll").cast("double")
    return [est.alias("card_est"), (est * (1 + sigma * error)).alias("card_upper"), (est * (1 - sigma * error)).alias("card_lower")]


def summarize(profiles: DataFrame) -> DataFrame:
    """One row per profile row with all statistics as plain columns."""
    keys = [c for c in profiles.columns if c not in STATES]
    plain = [c for c in STATES if c not in ("kll", "hll", "items", "custom")]
    items = F.expr("CASE WHEN items IS NOT NULL THEN approx_top_k_estimate(items, 128) END")
    return profiles.select(*keys, *plain, stddev().alias("stddev"), *[quantile(q).alias(name) for name, q in QUANTILES.items()], *cardinality(), items.alias("frequent_items"))


def descriptive(profiles: DataFrame) -> DataFrame:
    """Standard deviation, variance, coefficient of variation, sum, range and missing share of each column."""
    keys = [c for c in profiles.columns if c not in STATES]
    sd = stddev()
    return profiles.select(*keys, sd.alias("stddev"), (sd * sd).alias("variance"), F.when(F.col("mean") != 0, sd / F.col("mean")).alias("cv"), ((F.col("n") - F.col("null")) * F.col("mean")).alias("sum"), (F.col("max") - F.col("min")).alias("range"), (F.col("null") / F.when(F.col("n") > 0, F.col("n"))).alias("missing_share"))


def overall(profiles: DataFrame) -> DataFrame:
    return profiles.agg(F.max("n").alias("observations"), F.sum("null").alias("missing_cells"), (F.sum("null") / F.sum("n")).alias("missing_share"))


def _parts(df: DataFrame) -> int:
    """A fixed number of ranges, so that two branches that read one exchange number its partitions alike."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def exact_quantiles(df: DataFrame, column: str, probabilities: dict[str, float], inclusive: bool = False) -> DataFrame:
    """Quantiles from counts of distinct values: the item at place floor(q * n), or the inclusive rule."""
    from pyspark.sql import Window as W

    counts = df.where(F.col(column).isNotNull() & ~F.isnan(F.col(column).cast("double"))).groupBy(F.col(column).cast("double").alias("x")).agg(F.count("*").alias("k"))
    # ranges of values are counted first, so the running count needs no single task over all values
    ranged = counts.repartitionByRange(_parts(df), "x").withColumn("part", F.spark_partition_id())
    before = ranged.groupBy("part").agg(F.sum("k").alias("part_n")).withColumn("offset", F.coalesce(F.sum("part_n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    total = before.agg(F.sum("part_n").alias("n"))
    upto = F.sum("k").over(W.partitionBy("part").orderBy("x"))
    placed = ranged.withColumn("within", upto).join(before, "part").crossJoin(F.broadcast(total)).withColumn("upto", F.col("within") + F.col("offset"))
    out = []
    for name, q in probabilities.items():
        place = F.greatest(F.ceil(F.lit(q) * F.col("n")), F.lit(1)) if inclusive else F.least(F.floor(F.lit(q) * F.col("n")) + 1, F.col("n"))
        out.append(F.min(F.when(F.col("upto") >= place, F.col("x"))).alias(name))
    return placed.agg(*out)


#: How far from a quantile's rank its neighbours are asked from a sketch: above the error of a sketch of the default size.
SLACK = 0.005


def refined_quantiles(profiles: DataFrame, df: DataFrame, column: str, probabilities: dict[str, float]) -> DataFrame:
    """One row: the item at place floor(q * n) for each quantile, exact at any size, from a profile of the frame and its rows.

    The sketch's neighbours of each rank cut the values into intervals; all rows are counted by interval, and only the
    values of intervals that hold a place are ranked, a task for each. A sketch that errs makes these wider, not wrong.
    """
    from pyspark.sql import Window as W

    ranks = sorted({min(1.0, max(0.0, q + s)) for q in probabilities.values() for s in (-SLACK, SLACK)})
    asked = F.kll_sketch_get_quantile_double(F.col("kll"), F.array(*map(F.lit, ranks)))
    # sketches are random, so both passes read the cuts of one; a row of two numbers for each quantile comes to the driver
    found = profiles.where((F.col("column") == column) & (F.col("d_n") > 0)).select(asked).first()
    cuts = sorted(set(found[0])) if found else []
    x = as_number(F.col(f"`{column}`"), df.schema[column].dataType)
    part = sum(((F.col("x") > c).cast("int") for c in cuts), F.lit(0))
    rows = df.select(x.alias("x")).where("x IS NOT NULL").withColumn("part", part)
    sizes = rows.groupBy("part").agg(F.count("*").alias("k"))  # a row for each interval
    before = sizes.withColumns({"offset": F.sum("k").over(W.orderBy("part")) - F.col("k"), "n": F.sum("k").over(W.partitionBy(F.lit(0)))})
    places = F.array(*[F.struct(F.lit(name).alias("name"), F.least(F.floor(F.lit(float(q)) * F.col("n")), F.col("n") - 1).alias("place")) for name, q in probabilities.items()])
    chosen = before.select("part", "offset", "k", F.inline(places)).where("place >= offset AND place < offset + k").drop("k")
    values = rows.join(F.broadcast(chosen.select("part").distinct()), "part", "left_semi").groupBy("part", "x").agg(F.count("*").alias("k"))
    placed = values.withColumn("upto", F.sum("k").over(W.partitionBy("part").orderBy("x"))).join(F.broadcast(chosen), "part")
    return placed.agg(*[F.min(F.when((F.col("name") == name) & (F.col("offset") + F.col("upto") > F.col("place")), F.col("x"))).alias(name) for name in probabilities])


def exact_top(df: DataFrame, column: str, k: int | None = None) -> DataFrame:
    """Values by how often they occur, ties by value."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("est")).orderBy(F.desc("est"), "value")
    return out.limit(k) if k else out


def bins(n: int, low: float, high: float, max_buckets: int = 30) -> tuple[float, float, int]:
    """Start, width and number of bins: a quarter of the count, at least 2 and at most 30."""
    if n < 2 or low == high:
        return low, abs(low) * 1e-7 or 1e-7, 1
    end = high + abs(high) * 1e-7
    count = max(2, min(max_buckets, math.ceil(n / 4)))
    width = max((end - low) / count, 1.1754943508222875e-38)
    return low, width, count


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(bin, start, end, count) of all bins, empty ones included."""
    x = F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))
    n, low, high = df.agg(F.count(x), F.min(x), F.max(x)).first()
    if not n:
        return df.sparkSession.createDataFrame([], "bin int, start double, end double, count long")
    start, width, count = bins(n, low, high)
    place = F.least(F.floor((x - F.lit(start)) / F.lit(width)), F.lit(count - 1)).cast("int")
    found = df.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count("*").alias("k"))
    every = df.sparkSession.range(count).select(F.col("id").cast("int").alias("bin"))
    return every.join(found, "bin", "left").select("bin", (F.lit(start) + F.col("bin") * width).alias("start"), (F.lit(start) + (F.col("bin") + 1) * width).alias("end"), F.coalesce("k", F.lit(0)).cast("long").alias("count"))


#: Ranks of the quantiles that stand for a sketch where a point to ask for is only known row by row.
GRID = [(i + 0.5) / 1000 for i in range(1000)]


def grid(kll: str = "kll") -> Column:
    """Quantiles of a sketch in small steps of rank."""
    return F.kll_sketch_get_quantile_double(F.col(kll), F.array(*map(F.lit, GRID)))


def below(quantiles: Column, point: Column) -> Column:
    """The share of a sketch's values below a point, from its quantiles, to a thousandth."""
    return F.size(F.filter(quantiles, lambda q: q < point)) / float(len(GRID))


def cdf(points: list[float] | Column, kll: str = "kll") -> Column:
    """The share of values below each point: from the sketch for fixed points, to a thousandth for points of the row."""
    if isinstance(points, Column):
        return F.transform(points, lambda p: below(grid(kll), p))
    return F.array(*[F.kll_sketch_get_rank_double(F.col(kll), F.lit(math.nextafter(float(p), -math.inf))) for p in points])


def pmf(points: list[float] | Column, kll: str = "kll") -> Column:
    """The shares of values below the first point, between neighbours, and from the last on."""
    upto = cdf(points, kll)
    return F.zip_with(F.concat(upto, F.array(F.lit(1.0))), F.concat(F.array(F.lit(0.0)), upto), lambda a, b: a - b)


def quantile_statistics(profiles: DataFrame) -> DataFrame:
    """Five quantiles and the interquartile range of each column."""
    keys = [c for c in profiles.columns if c not in STATES]
    named = {"p5": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95}
    return profiles.select(*keys, *[quantile(q).alias(n) for n, q in named.items()], (quantile(0.75) - quantile(0.25)).alias("iqr"))


def feature_statistics(profiles: DataFrame) -> DataFrame:
    """Totals, missing values, distinct share, extremes, whether a column is unique, and whether it is all null."""
    keys = [c for c in profiles.columns if c not in STATES]
    est, upper, lower = cardinality(3)
    valid = F.col("n") - F.col("null")
    return profiles.select(
        *keys, F.col("n").alias("total"), F.col("null").alias("missing"), est, (est / F.when(valid > 0, valid)).alias("unique_share"), "min", "max", (F.col("max") - F.col("min")).alias("range"),
        valid.between(lower, upper).alias("probably_unique"), (valid == 0).alias("only_null"),
    )


def top_items(profiles: DataFrame, n: int = 10) -> DataFrame:
    """(keys, items): the n most frequent items of each column, each as value:count."""
    keys = [c for c in profiles.columns if c not in STATES]
    items = F.expr(f"CASE WHEN items IS NOT NULL THEN slice(approx_top_k_estimate(items, {max(n, 1)}), 1, {n}) END")
    return profiles.select(*keys, F.transform(items, lambda i: F.concat_ws(":", i["item"], i["count"])).alias("items"))


def _bins(max_buckets: int) -> tuple[Column, Column]:
    """Number and width of a profile's bins."""
    one = (F.col("d_n") < 2) | (F.col("min") == F.col("max"))
    end = F.col("max") + F.abs("max") * 1e-7
    count = F.when(one, 1).otherwise(F.greatest(F.lit(2), F.least(F.lit(max_buckets), F.ceil(F.col("d_n") / 4).cast("int"))))
    return count, F.when(one, F.greatest(F.abs("min") * 1e-7, F.lit(1.1754943508222875e-38))).otherwise((end - F.col("min")) / count)


def counted_histogram(profiles: DataFrame, df: DataFrame, max_buckets: int = 30) -> DataFrame:
    """`sketch_histogram` of a profile of the whole frame, with the rows of each bin counted: exact at any size."""
    sketched = sketch_histogram(profiles, max_buckets)
    count, width = _bins(max_buckets)
    plan = profiles.where("d_n > 0").select("column", F.col("min").alias("low"), width.alias("width"), count.alias("bins"))
    found = []
    for f in df.schema.fields:
        if (x := as_number(F.col(f"`{f.name}`"), f.dataType)) is None:
            continue
        own = F.broadcast(plan.where(F.col("column") == f.name))  # one row
        place = F.least(F.floor((F.col("x") - F.col("low")) / F.col("width")), F.col("bins") - 1).cast("int")
        found.append(df.select(x.alias("x")).where("x IS NOT NULL").crossJoin(own).groupBy("column", place.alias("bin")).agg(F.count("*").alias("k")))
    if not found:
        return sketched
    by_bin = reduce(DataFrame.unionByName, found).groupBy("column").agg(F.map_from_entries(F.collect_list(F.struct("bin", "k"))).alias("rows"))  # at most max_buckets entries
    counted = F.transform("counts", lambda _, i: F.coalesce(F.try_element_at("rows", i), F.lit(0).cast("long")))
    return sketched.join(F.broadcast(by_bin), "column", "left").select(*[c for c in sketched.columns if c != "counts"], F.when(F.col("rows").isNull(), F.col("counts")).otherwise(counted).alias("counts"))


def sketch_histogram(profiles: DataFrame, max_buckets: int = 30) -> DataFrame:
    """(keys, edges, counts) of each numeric column, from its sketch: bins as `histogram` has them."""
    keys = [c for c in profiles.columns if c not in STATES]
    count, width = _bins(max_buckets)
    rows = profiles.where("d_n > 0").select(*keys, "kll", "d_n", F.transform(F.sequence(F.lit(0), count), lambda i: F.col("min") + i * width).alias("edges"))
    rows = rows.withColumn("grid", grid()).drop("kll")
    upto = F.transform("edges", lambda e: below(F.col("grid"), e))
    shares = F.zip_with(F.slice(upto, F.lit(2), F.size(upto) - 1), F.slice(upto, F.lit(1), F.size(upto) - 1), lambda b, a: b - a)
    return rows.select(*keys, "edges", F.transform(shares, lambda s: F.round(s * F.col("d_n")).cast("long")).alias("counts"))


def to_json(profiles: DataFrame, reference: DataFrame | None = None, drift_options: dict | None = None) -> DataFrame:
    """One row (profile): the summary of a profile by column as JSON, with drift from a reference where one is given."""
    flat = summarize(profiles).drop("cond")
    flat = flat.withColumn("frequent_items", F.to_json("frequent_items"))
    hist = sketch_histogram(profiles.select("column", *STATES))
    rows = flat.join(hist, "column", "left")
    if reference is not None:
        from .drift import drift_scores

        rows = rows.join(drift_scores(profiles, reference, **(drift_options or {})).select("column", F.struct("algorithm", "statistic", "p_value", "category").alias("drift_from_ref")), "column", "left")
    name = F.col("column")
    body = F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, F.to_json(F.struct(*[c for c in rows.columns if c != "column"]))))))
    return rows.agg(F.to_json(F.struct(body.alias("columns"), F.struct(F.max("n").alias("observations"), F.sum("null").alias("missing_cells")).alias("properties"))).alias("profile"))
