import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import predicates as P
from tallyframe.functions.udfs import Registry, registry, udf_schema
from tallyframe.operators import constraints as C
from tallyframe.operators import custom, drift, performance, special, summary
from tallyframe.operators.profile import dataset_profile, merge, merge_dataset, partitions_union, profile, profile_sets, rows_frame, sub_metrics
from tallyframe.plans.resolve import Config, Plan, PresetResolver, Rule, plan_of
from tallyframe.sources import store as S
from tallyframe.streaming.rolling import RollingLogger

STRINGS = ["abc", "123", "kwatz", "314159", "abc123"]


@pytest.fixture(scope="module")
def base(spark):
    return spark.createDataFrame([("cat", 4, 4.3), ("hawk", 2, 1.8), ("snake", 0, None), ("cat", 4, 4.1)], "animal string, legs long, weight double")


@pytest.fixture(scope="module")
def strings(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(STRINGS)], "id long, s string")


def conditions(**more):
    return {"s": {"alpha": P.Predicate().matches("[a-zA-Z]+"), "digit": P.Condition(P.Predicate().matches("[0-9]+")), **more}}


def counted(p):
    r = p.where("column = 's'").first()
    return r.cond_total, r.cond


def test_conditions_in_profiles(strings):
    one = profile(strings, Plan("limited", conditions=conditions(kwatz=P.Predicate().equals("kwatz"))))
    assert counted(one) == (5, {"alpha": 3, "digit": 2, "kwatz": 1})
    assert counted(merge(one.unionByName(one))) == (10, {"alpha": 6, "digit": 4, "kwatz": 2})
    # sets that differ: the first stays
    other = profile(strings, Plan("limited", conditions=conditions()))
    both = S.merge_results(other, one)
    assert counted(both) == (5, {"alpha": 3, "digit": 2}) and both.where("column = 's'").first().n == 10
    with pytest.raises(ValueError):
        profile(strings, Plan(conditions={"s": {"total": P.Predicate().equals("x")}}))


def test_actions_on_failing_values(spark, strings, tmp_path):
    path = str(tmp_path)

    def note(namespace, name, value, row):
        with open(f"{path}/{name}-{row}-{value}", "w") as f:
            f.write(namespace)

    digit = P.Condition(P.Predicate().matches("[0-9]+"), actions=(note,))
    P.run_actions(strings, "s", {"digit": digit}, "id")
    assert sorted(x.name for x in tmp_path.iterdir()) == ["digit-0-abc", "digit-2-kwatz", "digit-4-abc123"]
    with pytest.raises(ValueError, match="digit"):
        P.run_actions(strings, "s", {"digit": P.Condition(P.Predicate().matches("[0-9]+"), throw_on_failure=True)})
    P.run_actions(strings, "s", {"all": P.Condition(lambda c: c.isNotNull(), throw_on_failure=True, log_on_failure=True)})

    @P.condition_validator(["s"], "short")
    def short(c):
        return F.length(c) < 4

    got = P.failures(strings, "s", P.validators_of("s"), "id").first()
    assert (got.condition, got.total, got.failed) == ("short", 5, 3) and got.samples and set(got.samples) <= {"2", "3", "4"}
    many = spark.range(1000).select(F.col("id").cast("string").alias("s"))
    assert len(P.failures(many, "s", {"none": lambda c: F.lit(False)}).first().samples) == 10


def test_relations_and_paths(base):
    p = P.relation("match", "c.*")
    assert [r[0] for r in base.where(P.or_relations(p, P.not_relation(P.relation("==", "hawk"))).column(F.col("animal"), True)).select("animal").orderBy("animal").collect()] == ["cat", "cat", "snake"]
    flat = C._with_statistics(profile(base))
    asked = P.require("distribution/mean").greater_than(P.Ref("distribution/stddev"))
    assert [r.column for r in flat.where(asked.column(F.lit(None))).collect()] == ["legs", "weight"]
    assert P.parse("> x ::distribution/min").args == (P.Ref("distribution/min"),)
    assert C.prefix_constraint(profile(base), "== :legs:distribution/mean 2.5").first()[0] is True
    assert C.prefix_constraint(profile(base), "== - ** :legs:counts/n 2 // 7 2 13").first()[0] is True


def test_constraints_of_all_sorts(base):
    p = profile(base, Plan(conditions={"legs": {"even": lambda c: c % 2 == 0, "odd": lambda c: c % 2 == 1}}))
    with pytest.raises(ValueError):
        C.report(p, [C.is_non_negative("absent")])
    suggested = C.suggest_constraints(p, exclude=["weight"])
    names = {c.name for c in suggested}
    assert {"legs meets condition even", "legs never meets condition odd", "legs is non negative", "animal has no missing values"} <= names and not any(n.startswith("weight") for n in names)
    assert C.validate(p, suggested)
    built = C.ConstraintsBuilder(p).add_constraint(C.Constraint("means", ("legs", "weight"), F.col("mean") > 3)).build()
    assert not built.validate() and [r.failed for r in built.report().collect()] == [1]
    with pytest.raises(ValueError):
        C.ConstraintsBuilder(p).add_constraints([C.is_non_negative("legs")] * 2)
    smaller = C.ComparisonConstraint("shrunk", "legs", F.col("t.mean") < F.col("r.mean"))
    gone = C.ComparisonConstraint("gone", "absent", F.col("t.n") > 0, required=False)
    assert {r.constraint: r.passed for r in C.compare(p, p, [smaller, gone]).collect()} == {"shrunk": 0, "gone": 1}
    assert '"mean":2.5' in C.report(p, [C.is_non_negative("legs")], with_summary=True).first().summary


def test_drift_of_all_columns(spark, base):
    other = spark.createDataFrame([("cat", 13, 4.9), ("hawk", 34, 13.3), ("snake", 99, None), ("cat", 123, 232.3)], base.schema)
    got = {r.column: r for r in drift.drift_scores(profile(base), profile(other)).collect()}
    assert {c: (r.algorithm, r.category) for c, r in got.items()} == {"animal": ("chi-square", "NO_DRIFT"), "legs": ("ks", "DRIFT"), "weight": ("ks", "DRIFT")}
    with pytest.warns(UserWarning):
        chosen = {r.column: r for r in drift.calculate_drift_values(profile(base), profile(other), {"legs": "hellinger", "nobody": "ks"}).collect()}
    assert chosen["legs"].algorithm == "hellinger" and chosen["legs"].p_value is None and chosen["legs"].category == "DRIFT"
    big, off = spark.range(20000).select((F.col("id") * 1.0).alias("x")), spark.range(20000).select((F.col("id") * 1.0 + 1000).alias("x"))
    r = drift.drift_scores(profile(big), profile(off)).first()
    assert math.isclose(r.statistic, drift.ks_statistic(big, off, "x").first()[0], abs_tol=0.01)


def test_survival_functions_match_the_library(spark):
    lib = spark._jvm.org.apache.commons.math3
    for n, d in ((3, 0.5), (20, 0.2), (100, 0.1), (140, 0.08)):
        assert math.isclose(drift.ks_survival(d, n), 1 - lib.stat.inference.KolmogorovSmirnovTest().cdf(d, n), abs_tol=1e-9)
    assert math.isclose(drift.ks_survival(0.05, 1000), 1 - lib.stat.inference.KolmogorovSmirnovTest().cdf(0.05, 1000), abs_tol=2e-5)
    for x, k in ((1.0, 1), (5.0, 3), (30.0, 10), (0.1, 5), (100.0, 100)):
        assert math.isclose(drift.chi_square_survival(x, k), 1 - lib.distribution.ChiSquaredDistribution(float(k)).cumulativeProbability(x), rel_tol=1e-9)
    assert drift.ks_survival(0, 5) == 1 and drift.ks_survival(1, 5) == 0 and drift.chi_square_survival(math.inf, 3) == 0


def test_nan_and_empty_sides(spark):
    frame = lambda v: spark.createDataFrame([(x,) for x in v], "x double")
    nan = float("nan")
    assert drift.hellinger(frame([]), frame([]), "x").first()[0] is None
    assert drift.hellinger(frame([1.0]), frame([]), "x").first()[0] is None
    assert drift.hellinger(frame([1.0, nan]), frame([2.0]), "x").first()[0] == 1.0
    assert [r["count"] for r in summary.histogram(frame([1.0, nan, None]), "x").collect()] == [1]
    assert summary.histogram(frame([nan]), "x").count() == 0


def test_unicode_sub_metrics(spark):
    df = spark.createDataFrame([(s,) for s in ["1", "12", "123", "1234a", "abc", "abc123", "@@@", "é"]], "s string")
    p = {r["sub"]: r for r in sub_metrics(profile(df, Plan(config=Config(track_unicode=True)))).where("namespace = 'unicode_range'").collect()}
    assert p["digits"]["mean"] == 13 / 8 and p["latin-lower"]["max"] == 3 and p["string_length"].n == 8 and p["extended-latin"]["max"] == 1
    upper = special.unicode_counts(df.union(spark.createDataFrame([("wxYZ",)], "s string")), "s", lower=False).agg(F.sum("latin-upper")).first()[0]
    assert upper == 2
    # decomposed, an accent is no letter of the basic range
    row = special.unicode_counts(df.where("s = 'é'"), "s", normalize=True).first()
    assert row["basic-latin"] == 1 and row["UNKNOWN"] == 1


def test_ranking_fixtures(spark):
    lists = spark.createDataFrame([(["cat", "pig", "elephant"], "cat"), (["horse", "donkey", "robin"], "dog"), (["cow", "pig", "giraffe"], "pig"), (["pig", "dolphin", "elephant"], "elephant")], "p array<string>, t string")
    got = {r.column: r["mean"] for r in performance.log_ranking(lists, "p", "t", k=3).collect()}
    assert math.isclose(got["ndcg_k_3"], 0.53273, abs_tol=1e-5) and math.isclose(got["average_precision_k_3"], 0.45833, abs_tol=1e-5)
    assert got["precision_k_3"] == 0.25 and got["recall_k_3"] == 1 and math.isclose(got["reciprocal_rank_k_3"], 0.45833, abs_tol=1e-5) and got["sum_gain_k_3"] == 0.75 and got["top_rank"] == 2
    only = spark.createDataFrame([([1, 0, 1],), ([0, 0, 0],), ([1, 1, 0],), ([0, 1, 0],)], "t array<int>")
    got = {r.column: r["mean"] for r in performance.log_ranking(only, target="t", k=2).collect()}
    assert math.isclose(got["recall_k_2"], 0.83333, abs_tol=1e-5) and got["average_precision_k_2"] == 0.625
    ranks = spark.createDataFrame([([2, 3, 1], [1.0, 0.0, 1.0], [0.5, 0.1, 0.9])], "r array<int>, t array<double>, s array<double>")
    a, b = performance.ranking_from_ranks(ranks, "r", "t", 2).first(), performance.ranking_from_scores(ranks, "s", "t", 2).first()
    assert a.relevance == b.relevance == [1.0, 1.0, 0.0] and a.top_rank == 1 and a.precision == 1


def test_confusion_of_nulls_and_labels(spark):
    nan = float("nan")
    df = spark.createDataFrame(list(zip([0.0, 1.0, 0.0, 1.0, None, 1.0, nan], [0.0, 0.0, 1.0, 1.0, 0.0, nan, None])), "t double, p double")
    m = performance.confusion_matrix(df, "p", "t")
    assert m.count() == 7 and [r.label for r in performance.labels(m).orderBy("place").collect()] == ["0.0", "1.0", "None"]
    out = performance.log_classification(df, "p", "t", log_full_data=True)
    assert out["profile"].count() == 2 and performance.merge_confusion(m, m).agg(F.sum("n")).first()[0] == 14
    reg = performance.log_regression(df.where("t = t AND p = p"), "p", "t")["performance"]
    attached = performance.attach(profile(df, Plan("limited")), reg, "regression")
    assert attached.where("column IS NULL").first().metric == "regression" and attached.count() == 3


def test_rows_datasets_and_bytes(spark, base):
    assert rows_frame(spark, {"a": 1, "b": "x"}).count() == 1
    lists = rows_frame(spark, {"a": [1, 2, 3], "b": range(2), "c": 5})
    assert [tuple(r) for r in lists.collect()] == [(1, 0, 5), (2, 1, None), (3, None, None)]
    first = dataset_profile(base, Plan("limited"), dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 5), {"a": "1", "b": "1"})
    second = dataset_profile(base, Plan("limited"), dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 6), {"b": "2"})
    r = merge_dataset(first, second).where("column = 'legs'").first()
    assert (r.n, r.dataset_ts.day, r.creation_ts.day, r.metadata) == (8, 1, 5, {"a": "1", "b": "2"})
    again = S.from_bytes(spark, S.to_bytes(profile(base)))
    assert merge(again.unionByName(profile(base))).where("column = 'weight'").first()["n"] == 8
    segmented = {"x": profile(base, Plan("limited"))}
    assert S.merge_results(segmented, segmented)["x"].first().n == 8
    with pytest.raises(ValueError):
        S.merge_results(segmented, profile(base))


def test_store_and_writers(spark, base, tmp_path):
    store = S.ProfileStore(spark, str(tmp_path / "s"))
    plan = Plan("limited", conditions={"legs": {"even": lambda c: c % 2 == 0}})
    for day, tag in ((1, "x"), (1, "y"), (2, "z")):
        store.write(profile(base, plan), "d", dt.date(2024, 1, day), S.metadata({"tag": tag}, "n"))
    store.write(profile(base, plan), "hidden", dt.date(2024, 1, 1), exclude=("cond",))
    assert store.read_metadata("d").first().metadata["tag"] == "x"
    small = store.compact("d", str(tmp_path / "c"))
    assert small.rows("d").count() == 6 and small.read("d").where("column = 'legs'").first().cond == {"even": 12}
    assert store.read("hidden").where("cond IS NOT NULL").count() == 0 and store.list() == ["d", "hidden"]
    taken = []
    S.register_writer("mine", lambda **o: S.CallbackWriter(callback=lambda p, dest: taken.append((dest, p.count()))))
    S.writer("mine").write(profile(base), "here")
    assert taken == [("here", 3)]
    path = S.writer("report", base_dir=str(tmp_path), reference=profile(base)).write(profile(base), "report")
    assert 'drift_from_ref' in spark.read.text(path).first()[0]
    with pytest.raises(ValueError):
        S.writer("nowhere")


def test_functions_and_resolvers(spark, base):
    r = registry("zoo")
    r.python_udf(["legs"], "inverse")(lambda x: 1 / x)
    r.metric_udf("len", kind="string")(lambda c: F.length(c))
    out = udf_schema("zoo").apply(base)
    assert [x.inverse for x in out.orderBy("legs").collect()] == [None, 0.5, 0.25, 0.25]
    p = {x.column: x for x in udf_schema("zoo").profile(base).collect()}
    assert p["animal/udf.len"]["mean"] == 3.75 and p["inverse"].null == 1
    r.unregister("inverse")
    assert "inverse" not in udf_schema("zoo").apply(base).columns
    with pytest.raises(ValueError):
        Registry().metric_udf("x")

    class Few(PresetResolver):
        def resolve(self, name, kind, config):
            return ("counts",) if name == "legs" else super().resolve(name, kind, config)

    plan = plan_of(Few("limited"), base.schema)
    assert plan.resolve(base.schema) == {"animal": ("counts", "types"), "legs": ("counts",), "weight": ("counts", "types", "dist")}
    custom.register_metric("evens", custom.Metric(lambda c: F.count_if(c % 2 == 0)))
    with pytest.raises(ValueError):
        custom.register_metric("evens", custom.Metric(F.max))
    got = profile(base, Plan(rules=(Rule(("evens",), column="legs"),), custom=custom.registered("evens")), columns=["legs"]).first()
    assert got.custom == {"evens": 4.0}
    numbers = spark.createDataFrame([("1",), ("2.5",), ("x",), (None,)], "s string")
    assert profile(numbers, Plan(config=Config(numeric_strings=True))).first()["mean"] == 1.75


def test_segmentations_in_one_pass(base):
    sets = partitions_union({"a": ["animal"]}, {"b": ["animal", "legs"], "a": ["animal"]})
    p = profile_sets(base, sets, Plan("limited"), {"a": lambda df: df["legs"] > 0})
    got = {(r.partition, tuple(r.segment)): r.n for r in p.where("column = 'weight'").collect()}
    assert got == {("a", ("cat",)): 2, ("a", ("hawk",)): 1, ("b", ("cat", "4")): 2, ("b", ("hawk", "2")): 1, ("b", ("snake", "0")): 1}
    assert p.select("segment_id").distinct().count() == 5 and len(p.first().segment_id) == 128
    assert p._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") + p._jdf.queryExecution().optimizedPlan().toString().count("LocalRelation") == 1
    with pytest.raises(ValueError):
        partitions_union({"a": ["x"]}, {"a": ["y"]})
    with pytest.raises(ValueError):
        profile(base.withColumnRenamed("animal", "n"), by=["n"])


def test_text_and_embeddings(spark):
    texts = ["alpha beta gamma", "alpha beta", "beta gamma alpha", "delta epsilon"]
    df = spark.createDataFrame([(t,) for t in texts] * 5 + [(None,), ("",)], "t string")
    lsi = special.Lsi(64, 2).update(df, "t").update(df, "t")
    got = {r.t: r.lsi_residual for r in lsi.residuals(df, "t").collect()}
    assert got["alpha beta gamma"] < 0.2 and got[None] is None and got[""] is None
    strange = lsi.residuals(spark.createDataFrame([("zeta eta theta",)], "t string"), "t").first().lsi_residual
    assert strange > 0.8
    assert special.text_profile(df, "t", lsi).count() == 3
    vec = spark.createDataFrame([(0, [0.1] * 3), (0, [0.6] * 3), (1, [2.0] * 3)], "label int, v array<double>")
    assert special.class_centroids(vec, "v", "label") == {"0": pytest.approx([0.35] * 3), "1": [2.0] * 3}
    out = special.embedding_distances(vec, "v", {"A": [1.0] * 3, "B": [0.01] * 3}, "cosine").collect()
    assert all(abs(r.A_distance) < 1e-9 for r in out)
    assert len(special.reference_vectors(vec, "v", 2, components=1)[0]) == 3
    assert special.embedding_profile_columns(vec, "v", {"A": [1.0] * 3}).columns == ["v/embedding.A_distance", "v/embedding.closest"]


def test_streams_with_late_rows(spark, tmp_path):
    def rows(name, days):
        data = spark.createDataFrame([(dt.datetime(2024, 1, d, 12), float(d)) for d in days], "ts timestamp, x double")
        data.coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    def run(late, name):
        taken = []
        stream = spark.readStream.schema("ts timestamp, x double").parquet(str(tmp_path / name))
        take = lambda p, i: taken.extend((int(r.bucket[8:10]), r.n) for r in p.select("bucket", "n").collect())
        logger = RollingLogger(stream, "ts", "1 day", str(tmp_path / f"ck-{late}"), take, watermark="1 hour", late=late, plan=Plan("limited"))
        logger.query.awaitTermination()
        assert not logger.status()["active"]
        return sorted(taken)

    for late in ("drop", "merge"):
        rows(late, [1, 1, 9])
        assert run(late, late) == [(1, 2), (9, 1)]
        rows(late, [1, 9, 10])  # the row of the first day is late
        assert run(late, late) == ([(9, 2), (10, 1)] if late == "drop" else [(1, 1), (9, 1), (10, 1)])
    with pytest.raises(ValueError):
        RollingLogger(None, "ts", "1 day", "x", None, every_minutes=1)


def test_callbacks_are_tried_again(spark, tmp_path):
    spark.range(3).select(F.lit("2024-01-01").cast("timestamp").alias("ts"), "id").write.parquet(str(tmp_path / "in"))
    calls = []

    def callback(p, i):
        calls.append(i)
        if len(calls) < 3:
            raise OSError("no space")

    stream = spark.readStream.schema("ts timestamp, id long").parquet(str(tmp_path / "in"))
    RollingLogger(stream, "ts", "1 hour", str(tmp_path / "ck"), callback, plan=Plan("limited")).query.awaitTermination()
    assert len(calls) == 3
