"""Profiles: one wide aggregate of mergeable states, turned into one row per group and column.

All states of all columns travel in one aggregation buffer per group, so a profile costs one scan and one
shuffle of a row per task and group. Rows are never unpivoted before they are aggregated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.predicates import as_predicate
from ..functions.types import KINDS, as_item, as_number, is_nan, kind_of
from ..plans.resolve import Plan

COUNTS = ("n", "null", "nan", "inf", "true")
STATES = [*COUNTS, *KINDS, "int_min", "int_max", "d_n", "mean", "m2", "min", "max", "kll", "hll", "items", "cond_total", "cond", "custom"]
MAX_PARTITIONS = 10


def _items_type(spark) -> str:
    return spark.sql("SELECT approx_top_k_accumulate('a', 1024) AS s").schema[0].dataType.simpleString()


def _states(f: T.StructField, metrics: tuple[str, ...], plan: Plan, items_type: str) -> list[Column]:
    """The aggregate states of a column, in the order of STATES; those of metrics it lacks are null."""
    c, dtype, kind, cfg = F.col(f"`{f.name}`"), f.dataType, kind_of(f.dataType), plan.config
    none = lambda t: F.lit(None).cast(t)
    nan = is_nan(c, dtype)
    missing = c.isNull() | nan
    fraction = isinstance(dtype, (T.FloatType, T.DoubleType))
    if "counts" in metrics:
        infinite = F.count_if(F.abs(c) == float("inf")) if fraction else F.lit(0).cast("long")
        out = [F.count(F.lit(1)), F.count_if(missing), F.count_if(nan) if fraction else F.lit(0).cast("long"), infinite, F.count_if(c) if kind == "boolean" else F.lit(0).cast("long")]
    else:
        out = [none("long")] * 5
    out += [(F.count_if(~missing) if k == kind else F.lit(0).cast("long")) if "types" in metrics else none("long") for k in KINDS]
    whole = kind in ("integral", "boolean") and "ints" in metrics
    out += [F.min(c.cast("long")) if whole else none("long"), F.max(c.cast("long")) if whole else none("long")]
    x = as_number(c, dtype, cfg.numeric_strings) if "dist" in metrics else None
    if x is None:
        out += [F.lit(0).cast("long") if "dist" in metrics else none("long"), *[none("double")] * 4, none("binary")]
    else:
        n = F.count(x)
        out += [n, F.avg(x), F.coalesce(F.var_samp(x) * (n - 1), F.when(n > 0, F.lit(0.0))), F.min(x), F.max(x), F.kll_sketch_agg_double(x, cfg.kll_k)]
    if "card" in metrics:
        h = c.cast("int") if kind == "boolean" else c.cast("long") if kind == "integral" else c.cast("string")
        if kind == "fractional":
            h = F.when(~nan, (c + F.lit(0).cast(dtype)).cast("string"))
        out.append(F.hll_sketch_agg(h, cfg.hll_lg_k))
    else:
        out.append(none("binary"))
    item = as_item(c, dtype, cfg.item_length) if "items" in metrics else None
    if item is None:
        out.append(none(items_type))
    else:
        quoted = f"`{f.name}`"
        out.append(F.expr(f"approx_top_k_accumulate({_item_sql(quoted, dtype, cfg.item_length)}, {cfg.max_items}) FILTER (WHERE {_item_sql(quoted, dtype, cfg.item_length)} IS NOT NULL)"))
    out += _conditions(c, kind, plan.conditions.get(f.name))
    custom = [x for name, m in plan.custom.items() if name in metrics for x in (F.lit(name), m.update(c).cast("double"))]
    out.append(F.create_map(*custom) if custom else none("map<string,double>"))
    return out


def _conditions(c: Column, kind: str, conditions: dict | None) -> list[Column]:
    """How many values were asked, and how many meet each condition."""
    if not conditions:
        return [F.lit(None).cast("long"), F.lit(None).cast("map<string,bigint>")]
    if "total" in conditions:
        raise ValueError("a condition cannot be named 'total'")
    met = [x for name, p in conditions.items() for x in (F.lit(name), F.count_if(c.isNotNull() & F.coalesce(as_predicate(p).column(c, kind == "string"), F.lit(False))))]
    return [F.count(c), F.create_map(*met)]


def _item_sql(c: str, dtype: T.DataType, limit: int) -> str:
    kind = kind_of(dtype)
    if kind == "boolean":
        return f"(CASE WHEN {c} THEN 'True' WHEN NOT {c} THEN 'False' END)"
    if kind == "string":
        return f"substring({c}, 1, {limit})"
    return f"CAST(nullif({c}, CAST('NaN' AS DOUBLE)) AS STRING)" if isinstance(dtype, (T.FloatType, T.DoubleType)) else f"CAST({c} AS STRING)"


def profile(df: DataFrame, plan: Plan | None = None, by: list[str] | dict[str, Column] | None = None, columns: list[str] | None = None, window: tuple[Column, Callable] | None = None) -> DataFrame:
    """One row per group and column: the group's keys as strings, `column`, and the states.

    by: columns (or named expressions) to segment by. A group of a single null key is left out; with several
    keys null is a value. columns: profile these only. window: a time window, which stays one while it is grouped by
    (so that a stream's watermark closes it), and the function that names it in the key `bucket`.
    """
    plan = plan or Plan()
    by = {k: F.col(f"`{k}`") for k in by} if isinstance(by, (list, tuple)) else by or {}
    if clash := set(by) & {*STATES, "column"}:
        raise ValueError(f"name the keys {sorted(clash)} otherwise: by={{'new_name': Column}}")
    df, columns = _with_derived(_vectors_to_arrays(df), plan, columns)
    keyed = df.withColumns({f"__key_{k}": v.cast("string") for k, v in by.items()})
    if len(by) == 1 and not window:
        (key,) = by
        keyed = keyed.where(F.col(f"`__key_{key}`").isNotNull())
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    resolved = {f.name: plan.metrics_of(f) for f in fields}
    items_type = _items_type(df.sparkSession)
    size, parts = plan.config.columns_per_aggregate, []
    for i in range(0, len(fields), size):
        aggs = []
        for f in fields[i : i + size]:
            states = _states(f, resolved[f.name], plan, items_type)
            aggs.append(F.struct(F.lit(f.name).alias("column"), *[s.alias(name) for s, name in zip(states, STATES)]).alias(f"c{len(aggs)}"))
        wide = keyed.groupBy(*([window[0].alias("__window")] if window else []), *[f"`__key_{k}`" for k in by]).agg(*aggs)
        bucket = [window[1](F.col("__window")).cast("string").alias("bucket")] if window else []
        rows = wide.select(*bucket, *[F.col(f"`__key_{k}`").alias(k) for k in by], F.inline(F.array(*[f"c{j}" for j in range(len(aggs))])))
        # a global aggregate of no rows still gives a row; a batch without rows leaves no profile
        parts.append(rows if by or window else rows.where("coalesce(n, d_n, 1) > 0"))
    return reduce(DataFrame.unionByName, parts)


def _with_derived(df: DataFrame, plan: Plan, columns: list[str] | None) -> tuple[DataFrame, list[str] | None]:
    """Adds the columns whose profiles are sub-metrics of others: named parent/sub.name."""
    wanted = [f for f in df.schema.fields if columns is None or f.name in columns]
    text = [f.name for f in wanted if "unicode" in plan.metrics_of(f) and kind_of(f.dataType) == "string"]
    if not text:
        return df, columns
    from .special import unicode_columns

    new = {f"{name}/unicode_range.{sub}": c for name in text for sub, c in unicode_columns(F.col(f"`{name}`")).items()}
    return df.withColumns(new), None if columns is None else [*columns, *new]


def sub_metrics(profile: DataFrame) -> DataFrame:
    """The profile with each column's parent, its sub-metric's namespace and name apart (null for plain columns)."""
    parts = F.split("column", "/", 2)
    sub = F.when(F.size(parts) > 1, parts[1])
    return profile.withColumns({"parent": parts[0], "namespace": F.substring_index(sub, ".", 1), "sub": F.when(sub.isNotNull(), F.regexp_replace(sub, r"^[^.]*\.", ""))})


def profile_sets(df: DataFrame, partitions: dict[str, list[str]], plan: Plan | None = None, where: dict | None = None) -> DataFrame:
    """Profiles of several segmentations in one pass: (partition, segment, segment_id, column, states).

    where: a filter for each, as text, Column or function of the frame. A segment of a single null key is left out.
    Every row is sent once for each segmentation that takes it, before rows are aggregated within their task.
    """
    if len(partitions) > MAX_PARTITIONS:
        raise ValueError(f"at most {MAX_PARTITIONS} segmentations at once")
    sets = []
    for name, keys in partitions.items():
        take = (where or {}).get(name, F.lit(True))
        take = F.expr(take) if isinstance(take, str) else take(df) if callable(take) and not isinstance(take, Column) else take
        if len(keys) == 1:
            take = take & F.col(f"`{keys[0]}`").isNotNull()
        sets.append(F.when(take, F.struct(F.lit(name).alias("partition"), F.array(*[F.col(f"`{k}`").cast("string") for k in keys]).alias("segment"))))
    exploded = df.withColumn("__set", F.explode(F.array_compact(F.array(*sets))))
    # arrays are keys by their own text, null apart from the word
    key = F.to_json(F.struct(F.col("__set.segment").alias("s")), {"ignoreNullFields": "false"})
    p = profile(exploded, plan, {"partition": F.col("__set.partition"), "__segment": key}, df.columns)
    segment = F.from_json("__segment", "struct<s:array<string>>")["s"]
    return p.select("partition", segment.alias("segment"), F.sha2("__segment", 512).alias("segment_id"), "column", *STATES)


def partitions_union(*partitions: dict[str, list[str]]) -> dict[str, list[str]]:
    """Several sets of segmentations as one, each once."""
    out: dict[str, list[str]] = {}
    for p in partitions:
        for name, keys in p.items():
            if out.setdefault(name, keys) != keys:
                raise ValueError(f"two segmentations are named {name}")
    return out


def dataset_profile(df: DataFrame, plan: Plan | None = None, dataset_ts=None, creation_ts=None, metadata: dict[str, str] | None = None, **options) -> DataFrame:
    """A profile that carries when its data and it itself were made, and metadata."""
    p = profile(df, plan, **options)
    tags = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv]).cast("map<string,string>")
    when = lambda t: F.lit(t).cast("timestamp") if t is not None else F.current_timestamp()
    return p.withColumns({"dataset_ts": when(dataset_ts), "creation_ts": when(creation_ts), "metadata": tags})


def merge_dataset(*profiles: DataFrame) -> DataFrame:
    """Dataset profiles merged: the earliest timestamps hold, and of equal metadata keys the value of the last profile."""
    extra = ["dataset_ts", "creation_ts", "metadata"]
    tagged = reduce(DataFrame.unionByName, [p.withColumn("__order", F.lit(i)) for i, p in enumerate(profiles)])
    keys = [c for c in tagged.columns if c not in (*STATES, *extra, "__order")]
    own = tagged.select("__order", "dataset_ts", "creation_ts", F.array_sort(F.map_entries("metadata")).alias("tags")).distinct()
    entries = own.select("__order", F.explode("tags").alias("e")).groupBy("e.key").agg(F.max_by("e.value", "__order").alias("value"))
    tags = entries.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"))  # a row for each key
    times = own.agg(F.min("dataset_ts").alias("dataset_ts"), F.min("creation_ts").alias("creation_ts"))
    merged = merge(tagged.drop(*extra), [k for k in keys if k != "column"], order="__order")
    return merged.crossJoin(F.broadcast(times.crossJoin(tags)))  # one row


def rows_frame(spark, rows, schema=None) -> DataFrame:
    """A frame of one row (a dict), several rows, or named lists, arrays and scalars as columns."""
    if isinstance(rows, dict):
        if any(isinstance(v, (list, tuple, set, range)) or hasattr(v, "tolist") for v in rows.values()):
            lists = {k: v.tolist() if hasattr(v, "tolist") else list(v) if not isinstance(v, (str, bytes)) and hasattr(v, "__iter__") else [v] for k, v in rows.items()}
            lists = {k: v if isinstance(v, list) else [v] for k, v in lists.items()}
            n = max(map(len, lists.values()), default=0)
            rows = [{k: v[i] if i < len(v) else None for k, v in lists.items()} for i in range(n)]
        else:
            rows = [rows]
    return spark.createDataFrame(list(rows), schema) if schema else spark.createDataFrame(list(rows))


def _vectors_to_arrays(df: DataFrame) -> DataFrame:
    vectors = [f.name for f in df.schema.fields if f.dataType.typeName() == "vector" or type(f.dataType).__name__ == "VectorUDT"]
    if not vectors:
        return df
    from pyspark.ml.functions import vector_to_array

    return df.withColumns({v: vector_to_array(F.col(f"`{v}`")) for v in vectors})


def profile_many(frames: dict[str, DataFrame], plan: Plan | None = None) -> DataFrame:
    """Profiles of several named frames: (alias, column, states)."""
    return reduce(DataFrame.unionByName, [profile(f, plan).select(F.lit(a).alias("alias"), "column", *STATES) for a, f in frames.items()])


def merge(profiles: DataFrame, keys: list[str] | None = None, order: str | None = None, custom: dict | None = None) -> DataFrame:
    """Profiles with equal keys and column merged: a full outer merge by column, without a join.

    order: a column that tells which profile comes first: where sets of conditions differ, the first one's counts stay
    and the others' are left out. custom: how states of custom metrics merge ({name: Metric}; by default they add up).
    """
    keys = [c for c in profiles.columns if c not in (*STATES, order)] if keys is None else [*keys, "column"]
    rank = F.col(order) if order else F.lit(0)
    counts = [F.sum(c).alias(c) for c in (*COUNTS, *KINDS)]
    total = F.sum("d_n")
    # weighted mean, then the squared deviations between the parts are added to those within
    pairs = F.collect_list(F.when(F.col("d_n") > 0, F.struct(F.col("d_n").cast("double").alias("n"), "mean", "m2")))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))

    def add(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        d = b["mean"] - a["mean"]
        return F.struct(n.alias("n"), ((a["n"] * a["mean"] + b["n"] * b["mean"]) / n).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * b["n"] / n).alias("m2"))

    out = profiles.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(
        *counts, F.min("int_min").alias("int_min"), F.max("int_max").alias("int_max"), total.alias("d_n"), F.aggregate(pairs, zero, add).alias("__m"),
        F.collect_list(F.when(F.col("cond_total").isNotNull(), F.struct(rank.alias("r"), F.array_sort(F.map_keys("cond")).alias("names"), F.col("cond_total").alias("total"), F.col("cond").alias("met")))).alias("__c"),
        F.collect_list("custom").alias("__u"),
        F.min("min").alias("min"), F.max("max").alias("max"), F.kll_merge_agg_double("kll").alias("kll"), F.hll_union_agg("hll", True).alias("hll"),
    )
    # Spark cannot combine missing item states, so rows that have one are combined apart
    items = profiles.where("items IS NOT NULL").groupBy(*[F.col(f"`{k}`").alias(f"__{k}") for k in keys]).agg(F.expr("approx_top_k_combine(items, 1024)").alias("items"))
    same = [F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`")) for k in keys]
    out = out.join(items, same, "left")
    some = F.col("d_n") > 0
    first = F.array_min(F.transform("__c", lambda c: F.struct(c["r"], c["names"])))["names"]
    same = F.filter("__c", lambda c: c["names"] == first)
    total = lambda pick: F.aggregate(F.transform(same, pick), F.lit(0).cast("long"), lambda a, v: a + v)
    met = F.map_from_arrays(first, F.transform(first, lambda name: total(lambda c: F.element_at(c["met"], name))))
    some_c = F.size("__c") > 0
    out = out.withColumns({"cond_total": F.when(some_c, total(lambda c: c["total"])), "cond": F.when(some_c, met)})
    out = out.withColumn("custom", _merged_custom(F.col("__u"), custom or {}))
    return out.withColumns({"mean": F.when(some, F.col("__m.mean")), "m2": F.when(some, F.col("__m.m2"))}).select(*[F.col(f"`{k}`") for k in keys], *STATES)


def _merged_custom(states: Column, custom: dict) -> Column:
    """Maps of custom states merged name by name; names that only one has stay."""
    names = F.array_distinct(F.flatten(F.transform(states, F.map_keys)))

    def one(name: Column) -> Column:
        values = F.filter(F.transform(states, lambda m: F.try_element_at(m, name)), lambda v: v.isNotNull())
        out = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
        for key, metric in custom.items():
            out = F.when(name == key, metric.merge(values)).otherwise(out)
        return out

    return F.when(F.size(states) > 0, F.map_from_arrays(names, F.transform(names, one)))
