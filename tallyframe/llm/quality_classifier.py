"""Quality classifier with hierarchical empirical Bayes.

A logistic model of a document's form gives evidence for each document. The evidence (for labelled rows the
label) is summed by host and by path in grouped aggregations; each host's rate is shrunk towards the global
one and each path's towards its host's, as far as the rates' own spread says (moment estimates of Beta
priors), and the path's posterior, without the document's own part of it, shifts the document's log odds.

Here the table has no address, so a document's source is its host and (source, language) its path.

Defined results: null or empty text has zero features; a null host or language is a group of its own; repeated
rows keep their rows; a document with several labels counts with their mean; without labels of both kinds
all evidence is one half; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, chunks, read
from .quality_rules import base_counts

#: Labelled rows, about, that the logistic model is fitted on: a random sample.
FIT_ROWS = 20_000
_CLASS = np.zeros(256, np.int64)
for _name, _i in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b".,;:!?\"'()-", 3), (b"|", 4), (b"#*$%&<>", 5), (b"\n", 6), (b"!", 7)):
    _CLASS[list(_name)] = _i


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, raw, at in chunks(batch.column(1)):
            n = hi - lo
            c = base_counts(raw, at)
            rows = np.repeat(np.arange(n), np.diff(at))
            kinds = np.bincount(rows * 8 + _CLASS[raw], minlength=8 * n).reshape(n, 8)
            words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
            lines = kinds[:, 6] + 1
            x = np.stack([np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, *(kinds[:, k] / chars for k in (1, 2, 3, 4, 5, 7)), np.log1p(words / lines)], axis=1)
            flat = pa.array(x.ravel())
            offsets = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)[: n + 1])
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, n) for i in (0, 2, 3)), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "host", "lang", "x"])


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept on raw features of a ridge logistic model, by Newton steps."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)
    ridge = np.diag([penalty] * x.shape[1] + [1e-6])
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + ridge, z.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(q / (1 - q))


def _spread(groups: DataFrame, rate: Column, target: Column) -> Column:
    """Prior strength by moments: how many documents the prior counts for."""
    between = F.sum(F.col("n") * F.pow(rate - target, 2)) / F.greatest(F.sum("n"), F.lit(1))
    within = F.sum(target * (1 - target)) / F.greatest(F.count("*"), F.lit(1))
    noise = F.sum(target * (1 - target)) / F.greatest(F.sum("n"), F.lit(1))
    return F.greatest(F.lit(1.0), F.least(F.lit(1e4), within / F.greatest(between - noise, F.lit(1e-6)) - 1))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang", label_col: str = "quality", threshold: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: evidence, host and path posteriors, score and verdict."""
    id_type = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("lang"))
    features = checkpoint(given.mapInArrow(_features, f"doc_id {id_type}, host string, lang string, x array<double>"))
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    joined = checkpoint(features.join(known, "doc_id", "left"))
    labelled = joined.where("label IS NOT NULL")
    share = min(1.0, fit_rows / max(1, labelled.count()))
    sample = labelled.select("x", "label").sample(share, seed=7).limit(2 * fit_rows).toPandas()  # about fit_rows; the limit bounds what reaches the driver
    if sample["label"].nunique() > 1:
        weights, intercept = fit(np.array(sample["x"].tolist()), sample["label"].to_numpy())
    else:
        weights, intercept = [], 0.0
    terms = F.lit(float(intercept))
    for i, w in enumerate(weights):
        terms = terms + F.lit(float(w)) * F.col("x")[i]
    rows = joined.withColumn("logit", terms).withColumn("evidence", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("logit"))))))
    rows = rows.withColumns({"host": F.coalesce("host", F.lit("")), "lang": F.coalesce("lang", F.lit(""))}).drop("x")
    rows = checkpoint(rows)
    value = F.coalesce("label", "evidence")
    paths = checkpoint(rows.groupBy("host", "lang").agg(F.count("*").alias("n"), F.sum(value).alias("good")))
    total = paths.agg((F.sum("good") / F.sum("n")).alias("mean"))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).crossJoin(total)  # one row
    strength = hosts.agg(_spread(hosts, F.col("good") / F.col("n"), F.col("mean")).alias("k"))
    hosts = hosts.crossJoin(strength).select("host", "mean", F.col("k").alias("host_k"), F.col("n").alias("host_n"), F.col("good").alias("host_good"), ((F.col("k") * F.col("mean") + F.col("good")) / (F.col("k") + F.col("n"))).alias("whole_rate"))
    nested = paths.join(hosts, "host")
    strength = nested.agg(_spread(nested, F.col("good") / F.col("n"), F.col("whole_rate")).alias("k"))
    nested = nested.crossJoin(strength.withColumnRenamed("k", "path_k"))
    # a document does not testify for itself: its own value is taken out of its host's and its path's sums
    own = F.coalesce("label", "evidence")
    out = rows.join(_small(nested), ["host", "lang"])
    host_rate = (F.col("host_k") * F.col("mean") + F.col("host_good") - own) / (F.col("host_k") + F.col("host_n") - 1)
    out = out.withColumn("host_rate", host_rate)
    out = out.withColumn("path_rate", (F.col("path_k") * F.col("host_rate") + F.col("good") - own) / (F.col("path_k") + F.col("n") - 1))
    score = 1 / (1 + F.exp(-(F.col("logit") + _logit(F.col("path_rate")) - _logit(F.col("mean")))))
    return out.select("doc_id", "host", "lang", "evidence", "host_rate", "path_rate", score.alias("score"), (score >= threshold).alias("kept"))


def _small(paths: DataFrame, limit: int = 100_000) -> DataFrame:
    """A table with a row for each path: broadcast, so that a hot host is no hot key, while it has at most `limit` rows."""
    return F.broadcast(paths) if paths.count() <= limit else paths


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return out.select("doc_id", F.round("evidence", 6).alias("evidence"), F.round("host_rate", 6).alias("host_rate"), F.round("path_rate", 6).alias("path_rate"), F.round("score", 6).alias("score"), "kept")
