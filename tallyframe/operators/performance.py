"""Model performance: confusion matrices, regression errors, ranking, and accuracy estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _label(c: Column) -> Column:
    text = c.cast("string")
    return F.when(text.isNull() | (text == "NaN"), "None").otherwise(text)


def confusion_matrix(df: DataFrame, prediction: str, target: str, score: str | None = None, by: list[str] = ()) -> DataFrame:
    """(by, prediction, target, n, mean_score) of every cell; null and NaN are the label None."""
    value = F.col(score).cast("double") if score else F.lit(1.0)
    cells = df.groupBy(*by, _label(F.col(prediction)).alias("prediction"), _label(F.col(target)).alias("target"))
    spread = [F.min(value).alias("min_score"), F.max(value).alias("max_score"), F.coalesce(F.var_samp(value) * (F.count(value) - 1), F.lit(0.0)).alias("m2_score"), F.kll_sketch_agg_double(value).alias("kll_score")]
    return cells.agg(F.count("*").alias("n"), F.avg(value).alias("mean_score"), *spread)


def labels(matrix: DataFrame) -> DataFrame:
    """(label, place) of a matrix's labels in order, None last."""
    from pyspark.sql import Window as W

    every = matrix.select(F.explode(F.array("prediction", "target")).alias("label")).distinct()
    return every.withColumn("place", F.row_number().over(W.orderBy(F.col("label") == "None", "label")) - 1)  # as many rows as labels


def classification_counts(matrix: DataFrame) -> DataFrame:
    """(label, tp, fp, fn, precision, recall) of each label of a matrix."""
    hit = F.col("prediction") == F.col("target")
    a = matrix.groupBy(F.col("prediction").alias("label")).agg(F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("fp"))
    b = matrix.groupBy(F.col("target").alias("label")).agg(F.sum(F.when(~hit, F.col("n")).otherwise(0)).alias("fn"))
    j = a.join(b, "label", "full").fillna(0, ["tp", "fp", "fn"])
    return j.select("label", "tp", "fp", "fn", (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"))


def log_classification(df: DataFrame, prediction: str, target: str, score: str | None = None, by: list[str] = (), log_full_data: bool = False, plan=None) -> dict[str, DataFrame]:
    """{performance: the matrix, by segment; profile: of all columns if the full data are asked for}."""
    out = {"performance": confusion_matrix(df, prediction, target, score, list(by))}
    return out | {"profile": _full(df, by, plan)} if log_full_data else out


def log_regression(df: DataFrame, prediction: str, target: str, by: list[str] = (), log_full_data: bool = False, plan=None) -> dict[str, DataFrame]:
    out = {"performance": regression(df, prediction, target, list(by))}
    return out | {"profile": _full(df, by, plan)} if log_full_data else out


def _full(df, by, plan):
    from .profile import profile

    return profile(df, plan, {f"segment_{k}": F.col(f"`{k}`") for k in by})


def attach(profile: DataFrame, metrics: DataFrame, name: str) -> DataFrame:
    """The profile's rows with `dataset_metrics` null, and a row of no column that carries the metrics' rows as JSON, one for each of their rows."""
    own = metrics.drop(*[c for c, t in metrics.dtypes if t == "binary"])
    body = own.select(F.lit(name).alias("metric"), F.to_json(F.struct(*own.columns)).alias("dataset_metrics"))
    return profile.withColumns({"metric": F.lit(None).cast("string"), "dataset_metrics": F.lit(None).cast("string")}).unionByName(body, allowMissingColumns=True)


def merge_confusion(*matrices: DataFrame) -> DataFrame:
    from functools import reduce

    every = reduce(DataFrame.unionByName, [m.select("prediction", "target", "n", "mean_score") for m in matrices])
    return every.groupBy("prediction", "target").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("mean_score")) / F.sum("n")).alias("mean_score"))


def regression(df: DataFrame, prediction: str, target: str, by: list[str] = ()) -> DataFrame:
    d = F.col(prediction).cast("double") - F.col(target).cast("double")
    return df.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.abs(d)).alias("mae"), F.avg(d * d).alias("mse"), F.sqrt(F.avg(d * d)).alias("rmse"))


def ranking_from_relevance(df: DataFrame, relevance: str, k: int, ideal: str | None = None) -> DataFrame:
    """Ranking measures of each row's relevance list (best first) up to k."""
    rel = F.transform(F.col(relevance), lambda r: F.coalesce(r.cast("double"), F.lit(0.0)))
    top = F.slice(rel, 1, k)
    best = F.slice(F.reverse(F.array_sort(F.transform(F.col(ideal), lambda r: r.cast("double")) if ideal else rel)), 1, k)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    hits = total(F.transform(top, lambda r: F.when(r > 0, 1.0).otherwise(0.0)))
    relevant = total(F.transform(rel, lambda r: F.when(r > 0, 1.0).otherwise(0.0)))
    gain = lambda a: total(F.transform(a, lambda r, i: r / F.log2(i + 2)))
    first = F.array_position(F.transform(top, lambda r: r > 0), True)
    precision_at = F.transform(top, lambda r, i: F.when(r > 0, total(F.transform(F.slice(top, F.lit(1), i + 1), lambda v: F.when(v > 0, 1.0).otherwise(0.0))) / (i + 1)).otherwise(0.0))
    return df.withColumns(
        {
            "precision": hits / k, "recall": F.when(relevant > 0, hits / relevant), "reciprocal_rank": F.when(first > 0, 1.0 / first).otherwise(0.0),
            "average_precision": F.when(hits > 0, total(precision_at) / hits).otherwise(0.0), "ndcg": F.when(gain(best) > 0, gain(top) / gain(best)).otherwise(1.0), "sum_gain": total(top),
            "top_rank": F.when(F.array_position(F.transform(rel, lambda r: r > 0), True) > 0, F.array_position(F.transform(rel, lambda r: r > 0), True)),
        }
    )


def ranking_from_lists(df: DataFrame, predictions: str, target: str, k: int) -> DataFrame:
    """As above, where a prediction is relevant if the row's target (a value or a list) holds it."""
    is_list = df.schema[target].dataType.typeName() == "array"
    hit = (lambda p: F.array_contains(F.col(target), p)) if is_list else (lambda p: p == F.col(target))
    relevance = F.transform(F.col(predictions), lambda p: F.when(hit(p), 1).otherwise(0))
    # the ideal order also has what should have been predicted and was not
    missed = F.size(F.array_except(F.col(target) if is_list else F.array(target), F.col(predictions)))
    df = df.withColumns({"relevance": relevance, "__ideal": F.concat(relevance, F.array_repeat(F.lit(1), F.greatest(missed, F.lit(0))))})
    return ranking_from_relevance(df, "relevance", k, "__ideal").drop("__ideal")


def ranking_from_ranks(df: DataFrame, ranks: str, relevance: str, k: int) -> DataFrame:
    """As above, where the i-th rank is the predicted place of the i-th item, and the i-th relevance its own."""
    pairs = F.array_sort(F.zip_with(F.col(ranks), F.col(relevance), lambda r, t: F.struct(r.alias("r"), t.cast("double").alias("t"))))
    return ranking_from_relevance(df.withColumn("relevance", F.transform(pairs, lambda p: p["t"])), "relevance", k)


def ranking_from_scores(df: DataFrame, scores: str, relevance: str, k: int) -> DataFrame:
    """As above, where items are ranked by descending score, ties by their place."""
    pairs = F.array_sort(F.transform(F.arrays_zip(F.col(scores).alias("s"), F.col(relevance).alias("t")), lambda p, i: F.struct((-p["s"].cast("double")).alias("s"), i.alias("i"), p["t"].cast("double").alias("t"))))
    return ranking_from_relevance(df.withColumn("relevance", F.transform(pairs, lambda p: p["t"])), "relevance", k)


RANKING = ("precision", "recall", "reciprocal_rank", "average_precision", "ndcg", "sum_gain", "top_rank")


def log_ranking(df: DataFrame, prediction: str | None = None, target: str | None = None, score: str | None = None, k: int | None = None, plan=None) -> DataFrame:
    """The profile of the ranking measures of all rows, named measure_k_<k>.

    Predicted items and relevant items (strings), predicted ranks and relevances, scores and relevances, or relevances
    in predicted order alone. Values that are no lists count as lists of one. k: by default the longest list's size.
    """
    if score is not None and prediction is not None:
        raise ValueError("give scores or predictions")
    if target is None and prediction is None or score is not None and target is None:
        raise ValueError("a target is needed")
    for c in filter(None, (prediction, target, score)):
        if df.schema[c].dataType.typeName() != "array":
            df = df.withColumn(c, F.array(c))
    longest = df.agg(F.max(F.size(F.col(prediction or target)))).first()[0] or 1
    if k is not None and k < 1:
        raise ValueError("k must be positive")
    k = min(k or longest, longest)
    if score is not None:
        out = ranking_from_scores(df, score, target, k)
    elif prediction is None or target is None:
        out = ranking_from_relevance(df, prediction or target, k)
    elif df.schema[prediction].dataType.elementType.typeName() == "string":
        out = ranking_from_lists(df, prediction, target, k)
    else:
        out = ranking_from_ranks(df, prediction, target, k)
    from .profile import profile

    return profile(out.select(*[F.col(m).cast("double").alias(m if m == "top_rank" else f"{m}_k_{k}") for m in RANKING]), plan)


def estimate_accuracy(reference: DataFrame, target: DataFrame, segment: str, prediction: str, label: str) -> DataFrame:
    """One row (accuracy): the reference's accuracy by segment, weighted by the target's shares; a missing share is 0."""
    known = reference.groupBy(F.col(segment).cast("string").alias("segment")).agg(F.avg(F.when(_label(F.col(prediction)) == _label(F.col(label)), 1.0).otherwise(0.0)).alias("accuracy"))
    sizes = target.groupBy(F.col(segment).cast("string").alias("segment")).agg(F.count("*").alias("n"))
    joined = known.join(sizes, "segment", "left").fillna(0, ["n"])
    return joined.agg((F.sum(F.col("accuracy") * F.col("n")) / F.sum("n")).alias("accuracy"))
