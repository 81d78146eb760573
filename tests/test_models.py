"""Model invariants (R queries) and plan-shape checks."""

from __future__ import annotations

import random

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from cartwise.ml import models as ml

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


def test_kmeans_best_of_starts_and_nearest_assignment(spark):
    r = random.Random(3)
    pts = [(r.gauss(cx, 0.1), r.gauss(cy, 0.1)) for cx, cy in
           [(0, 0), (5, 5), (0, 5), (5, 0), (10, 10)] for _ in range(20)]
    df = spark.createDataFrame(pts, "x double, y double")
    centres = ml.fit_kmeans(df, ("x", "y"), k=5, starts=3)
    assert len(centres) == 5 and centres == sorted(centres)
    out = ml.assign_nearest(df, centres, ("x", "y"), "c").collect()
    for row in out:
        d = [(row.x - cx) ** 2 + (row.y - cy) ** 2 for cx, cy in centres]
        assert row.c == d.index(min(d))
    cost = sum(min((row.x - cx) ** 2 + (row.y - cy) ** 2 for cx, cy in centres)
               for row in out)
    for i, (cx, cy) in enumerate(centres):  # converged: centre = mean of members
        members = [(row.x, row.y) for row in out if row.c == i]
        assert members
        assert abs(sum(m[0] for m in members) / len(members) - cx) < 1e-6
        assert abs(sum(m[1] for m in members) / len(members) - cy) < 1e-6
    single = ml.fit_kmeans(df, ("x", "y"), k=5, starts=1, seed=99)
    cost1 = sum(min((x - cx) ** 2 + (y - cy) ** 2 for cx, cy in single) for x, y in pts)
    assert cost <= cost1 + 1e-9


def test_assign_nearest_null(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert ml.assign_nearest(df, [(0.0, 0.0)], ("x", "y"), "c").first().c is None


def test_stratified_folds_are_balanced(spark):
    df = spark.createDataFrame([(i, i % 10) for i in range(500)], "k int, label int")
    out = ml.stratified_folds(df, "k")
    sizes = {r["fold"]: r["n"] for r in out.groupBy("fold").count()
             .withColumnRenamed("count", "n").collect()}
    assert sizes == {f: 100 for f in range(5)}
    per = out.groupBy("label", "fold").count().collect()
    assert all(r["count"] == 10 for r in per)


def test_classifier_beats_majority_on_separable(spark):
    rows = [(i, Vectors.dense([float(i % 3 == c) for c in range(3)] + [1.0]), float(i % 3))
            for i in range(90)]
    df = spark.createDataFrame(rows, ["k", "features", "label"])
    model = ml.train_classifier(df, 1.0)
    acc = ml.accuracy(model.transform(df)).first().accuracy
    assert acc > 0.9


def test_cv_scores_and_roundtrip(spark):
    import __spark_entry__ as e

    q = e.queries()
    cv = q["cv_scores"](spark, SF01).collect()
    assert len(cv) == 30 and all(r.scored for r in cv)
    assert sum(r.n_test for r in cv) == 6 * 27
    rt = q["model_roundtrip"](spark, SF01).collect()
    assert rt and all(r.same for r in rt)
    pc = q["predict_category"](spark, SF01).collect()
    assert len(pc) == 5
    rb = q["recommend_batch"](spark, SF01).collect()
    assert len(rb) >= 1


def test_geo_clusters_cover_all_zips(spark):
    import __spark_entry__ as e

    rows = e.queries()["geo_clusters"](spark, SF01).collect()
    assert len(rows) == 10 and all(r.nearest for r in rows)
    from cartwise.plans import pipeline as pl
    from cartwise.plans.queries_core import tables
    zips = pl.zip_clusters(spark, tables(spark, SF01)).collect()
    assert {r.location_cluster for r in zips} == set(range(5))


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    import __spark_entry__ as e

    q = e.queries()
    top = _plan(q["top_products"](spark, SF001))
    assert "WindowGroupLimit" in top
    wide = _plan(q["complete_data"](spark, SF001))
    assert "BroadcastHashJoin" in wide
    for name in ("complete_data", "recommend", "next_purchase", "closest_customers"):
        p = _plan(q[name](spark, SF001))
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
        assert "EvalPython" not in p, name


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() >= 0
    assert df.columns == e.entry(spark).columns
    assert F is not None


def test_rank_by_digest_matches_window(spark):
    from pyspark.sql import Window

    r = random.Random(5)
    data = [(r.choice(["hot"] * 8 + ["a", "b", None]), i) for i in range(3000)]
    df = spark.createDataFrame(data, "g string, i int").repartition(13)
    digest = F.md5(F.col("i").cast("string"))
    w = Window.partitionBy("g").orderBy(digest, "i")
    want = {row.i: row.rn for row in df.withColumn("rn", F.row_number().over(w)).collect()}
    for digits in (1, 3):
        got = ml.rank_by_digest(df, "g", digest, ["i"], digits=digits).collect()
        assert {row.i: row._rn for row in got} == want and len(got) == len(data)


@pytest.mark.parametrize("aqe,partitions", [("true", "8"), ("true", "200"), ("false", "8")])
def test_folds_keep_every_row_of_a_large_table(spark, aqe, partitions):
    """A million wide rows, three classes and NULL labels, over many partitions."""
    from pyspark.sql import Window

    n = 1_000_000
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled",
                                          "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.range(n).select(
            F.col("id").alias("k"),
            F.when(F.col("id") % 50 > 0, (F.hash("id") % 3).cast("int")).alias("label"),
            F.array(*[(F.col("id") * j).cast("double") for j in range(12)]).alias("features"))
        out = ml.stratified_folds(df, "k")
        digest = F.md5(F.concat_ws(":", F.lit("42"), F.lit("0"), F.col("k").cast("string")))
        plain = df.select("k", "label").withColumn(
            "rn", F.row_number().over(Window.partitionBy("label").orderBy(digest, "k")))
        sizes = [(r.label, r["count"]) for r in df.groupBy("label").count()
                 .orderBy(F.col("label").asc_nulls_first()).collect()]
        offset, case = 0, F.lit(None).cast("long")
        for label, size in sizes:
            case = F.when(F.col("label").eqNullSafe(F.lit(label)), offset).otherwise(case)
            offset += size
        want = plain.select(F.col("k").alias("wk"), ((case + F.col("rn") - 1) % 5).alias("wf"))
        got = out.select("k", "fold", F.size("features").alias("n")).join(
            want, F.col("k") == F.col("wk")).agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("k").alias("d"),
            F.sum((F.col("fold") != F.col("wf")).cast("int")).alias("bad")).first()
        assert (got["n"], got["d"], got["bad"]) == (n, n, 0)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_cross_validation_with_the_majority_label(spark):
    """The accuracy of a fold is the share of the other folds' most frequent label."""
    rows = [(i, 0.0 if i % 3 else 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, f"key long, {ml.LABEL} double").withColumn(
        ml.FEATURES, F.lit(1.0))
    out = ml.cross_validate(df, "key", grid=(1.0,), fit=ml.train_majority).collect()
    assert len(out) == ml.CV_FOLDS and sum(r.n_test for r in out) == 60
    folds = ml.stratified_folds(df, "key").collect()
    for r in out:
        test = [x[ml.LABEL] for x in folds if x.fold == r.fold]
        assert r.accuracy == sum(x == 0.0 for x in test) / len(test)
    tie = df.limit(0).unionByName(df.where("key < 2"))
    assert ml.train_majority(tie).label == 0.0
    assert ml.train_majority(df.limit(0)).label is None
