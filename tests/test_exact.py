"""Queries of sketches against their SQL where the sketches no longer hold all values."""

import math

import pytest
from pyspark.sql import functions as F

from tallyframe import queries as q
from tallyframe.operators import constraints, drift, summary
from tallyframe.operators.profile import profile


def differences(spark, name, folder, *tables):
    """Rows that only the query or only its SQL gives."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(q.oracle_sql()[name])
    cols = [c[0] for c in want.description]
    got = {tuple(r[c] for c in cols) for r in q.queries()[name](spark, str(folder)).collect()}
    return got ^ set(want.fetchall())


def test_drift_category_of_all_rows(spark, tmp_path):
    # the two sides differ in four thousandths of the rows, between the quantiles at which sketches are compared
    n, year = 300_000, F.when(F.col("side") == 0, "1994-01-01").otherwise("1995-01-01")
    rank = F.col("id") / n
    price = F.when(rank.between(0.0085, 0.0125), F.when(F.col("side") == 0, 8.5).otherwise(12.5)).otherwise(rank * 1000)
    items = [F.concat(F.lit("v"), (F.col("id") % k).cast("string")).alias(c) for c, k in (("o_orderstatus", 3), ("o_orderpriority", 5))]
    rows = spark.range(n).crossJoin(spark.range(2).withColumnRenamed("id", "side")).select(year.cast("date").alias("o_orderdate"), price.alias("o_totalprice"), *items)
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    assert not differences(spark, "drift_all_columns", tmp_path, "orders")


def test_exact_drift_statistic(spark):
    a, b = (spark.range(30_000).select((F.col("id") * k % 30_011).cast("double").alias("x"), F.col("id").cast("string").alias("s")) for k in (1, 7))
    r = {r.column: r for r in drift.drift_scores(profile(a), profile(b), frames=(a, b)).collect()}
    assert r["x"].statistic == drift.ks_statistic(a, b, "x").first()[0] and r["s"].algorithm == "chi-square"
    none = a.where("false").union(spark.createDataFrame([(None, "1")], a.schema))
    assert [(r.column, r.algorithm) for r in drift.drift_scores(profile(a), profile(none), frames=(a, none)).where("column = 'x'").collect()] == [("x", None)]
    assert math.isclose(drift.drift_scores(profile(a), profile(a), frames=(a, a)).where("column = 'x'").first().p_value, 1.0)


def suppliers(spark, folder, rows=6000):
    spark.range(rows).select((F.col("id") * 7919 % 6007).cast("double").alias("s_acctbal")).write.parquet(f"{folder}/supplier.parquet")


def test_quantiles_beyond_the_sketch(spark, tmp_path):
    suppliers(spark, tmp_path)
    assert not differences(spark, "quantiles_kll", tmp_path, "supplier")
    # a sketch of other values cuts badly, and the quantiles are those of the rows all the same
    df, other = spark.range(5000).select(F.col("id").alias("x")), spark.range(4).select((F.col("id") * 900).alias("x"))
    wanted = {"a": 0.0, "b": 0.5, "c": 1.0}
    assert tuple(summary.refined_quantiles(profile(other), df, "x", wanted).first()) == (0, 2500, 4999)
    odd = spark.createDataFrame([(None,), (float("nan"),), (2.0,), (2.0,), (2.0,)], "x double")
    assert tuple(summary.refined_quantiles(profile(odd), odd, "x", wanted).first()) == (2, 2, 2)
    none = odd.where("false")
    assert tuple(summary.refined_quantiles(profile(none), none, "x", wanted).first()) == (None, None, None)


def test_histogram_beyond_the_sketch(spark, tmp_path):
    suppliers(spark, tmp_path)
    assert not differences(spark, "sketch_histogram", tmp_path, "supplier")
    df = spark.range(5000).select("id", F.when(F.col("id") > 0, 7.0).alias("same"), F.lit(None).cast("double").alias("none"), F.lit("s").alias("text"))
    got = {r["column"]: r.counts for r in summary.counted_histogram(profile(df), df).collect()}
    assert sum(got["id"]) == 5000 and max(got["id"]) - min(got["id"]) <= 1 and got["same"] == [4999] and set(got) == {"id", "same"}


def test_suggestions_count_distinct_values(spark, tmp_path):
    # 289 of 301 values: above the share that is probably unique, below what three errors of a sketch allow
    keys, segment = (F.col("id") % 289).alias("c_custkey"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("c_mktsegment")
    spark.range(301).select(keys, (F.col("id") / 2).alias("c_acctbal"), segment).write.parquet(f"{tmp_path}/customer.parquet")
    assert not differences(spark, "suggest_constraints", tmp_path, "customer")
    nan = spark.createDataFrame([(float("nan"), None), (1.0, None), (1.0, None)], "x double, none string")
    assert ("x", "is probably unique") not in {tuple(r) for r in constraints.suggest(profile(nan), nan).collect()}
