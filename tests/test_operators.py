"""Operator tests on hand-made rows (FIXTURES.md section 4)."""

from __future__ import annotations

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from cartwise.functions import scalar as fx
from cartwise.operators import aggregates as agg
from cartwise.operators import filters, joins
from cartwise.operators import sequences as seq
from cartwise.plans import recommend as rec


def rows(df, *cols):
    cols = cols or df.columns
    return sorted((tuple(r[c] for c in cols) for r in df.collect()),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


def test_null_safe_full_join(spark):
    left = spark.createDataFrame([(1, "l"), (None, "ln")], "k int, a string")
    right = spark.createDataFrame([(None, "rn"), (2, "r")], "k int, b string")
    out = joins.full_outer(left, right, "k", null_safe=True)
    assert rows(out, "k", "a", "b") == rows(spark.createDataFrame(
        [(1, "l", None), (2, None, "r"), (None, "ln", "rn")], "k int, a string, b string"))
    plain = joins.full_outer(left, right, "k")
    assert plain.count() == 4  # NULL keys never match under SQL semantics


def test_natural_join_requires_shared_column(spark):
    a = spark.createDataFrame([(1,)], "x int")
    b = spark.createDataFrame([(1,)], "y int")
    with pytest.raises(ValueError):
        joins.natural_full_outer(a, b)


def test_full_outer_with_dimension_matches_plain(spark):
    big = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (5, "d")], "k int, v string")
    small = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k int, w string")
    a = joins.full_outer_with_dimension(big, small, "k")
    b = joins.full_outer(big, small, "k")
    assert rows(a, "k", "v", "w") == rows(b, "k", "v", "w")
    assert rows(b, "k", "v", "w") == rows(big.join(small, "k", "full"), "k", "v", "w")


def test_full_outer_reads_each_input_once_and_spreads_null_keys(spark, tmp_path):
    for name, col in (("a", "x"), ("b", "y"), ("c", "z")):
        spark.range(4000).select(F.when(F.col("id") < 9, F.col("id")).alias("k"),
                                 F.col("id").alias(col)).write.parquet(f"{tmp_path}/{name}")
    a, b, c = (spark.read.parquet(f"{tmp_path}/{n}") for n in "abc")
    out = joins.natural_full_outer(joins.natural_full_outer(a, b), c)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 3
    assert out.count() == 9 + 3 * 3991
    salts = joins._null_salt(a, ["k"], 1).where("k IS NULL").select("__salt").distinct().count()
    assert salts == 3991


def test_top_within_any_depth(spark):
    from pyspark.sql import Window

    from cartwise.operators.ranking import top_within

    df = spark.range(9000).select((F.col("id") % 3).alias("g"), F.hash("id").alias("v"), "id")
    df = df.withColumn("n", F.col("g") * 700 + 5)
    order = [F.col("v"), F.col("id")]
    plain = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    for n in (10, 1001, F.col("n")):
        got = top_within(df, ["g"], order, n, ["id"], out="r")
        assert rows(got, "id", "r") == rows(plain.where(F.col("r") <= n), "id", "r")


def test_not_this_customer_keeps_null(spark):
    d = spark.createDataFrame([("a",), ("b",), (None,)], "customer_unique_id string")
    assert rows(rec.not_this_customer(d, "a")) == [("b",), (None,)]
    d2 = spark.createDataFrame([("a",), (None,)], "customer_unique_id string")
    assert rows(rec.not_this_customer(d2, F.lit(None).cast("string"))) == [("a",), (None,)]
    keys = spark.createDataFrame([("a",)], "customer_unique_id string")
    assert rows(filters.exclude_keys(d, keys, "customer_unique_id")) == [("b",), (None,)]


def test_membership_null_matches_null(spark):
    d = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    keys = spark.createDataFrame([("a",), (None,)], "c string")
    assert rows(filters.keep_keys(d, keys, "c")) == [("a",), (None,)]


WIDE = ("customer_id long, customer_unique_id long, order_id long, product_id long, "
        "order_purchase_timestamp timestamp_ntz, product_category_name string, "
        "review_score double")
T0 = dt.datetime(2020, 1, 1)


def test_cohort_fan_out_and_two_products(spark):
    data = spark.createDataFrame([
        (1, 1, 10, 100, T0, "k", 1.0), (1, 1, 10, 100, T0, "k", 1.0),   # fan-out
        (2, 2, 20, 100, T0, "k", 1.0), (2, 2, 20, 101, T0, "k", 1.0),   # two products
    ], WIDE)
    assert rows(seq.cohort_customers(data, 2)) == [(2,)]


def test_next_purchase_tie_uses_total_order(spark):
    data = spark.createDataFrame([
        (1, 1, 10, 200, T0, "p2cat", 2.0), (1, 1, 10, 100, T0, "p1cat", 1.0)], WIDE)
    out = seq.next_purchase(data, seq.EXPLORATION_SPEC).collect()[0]
    assert out["product_category_name"] == "p1cat"
    assert out["next_product_category"] == "p2cat"


def test_training_rows_require_two(spark):
    data = spark.createDataFrame([(1, 1, 10, 100, T0, "k", 1.0)], WIDE)
    with pytest.raises(ValueError):
        seq.training_rows(data, 1, seq.EXPLORATION_SPEC)


def _preds(spark, items):
    return spark.createDataFrame(
        items, "customer_unique_id string, predicted_category string, "
               "pred_lat double, pred_lng double")


def test_sole_buyer_exclusion(spark):
    data = spark.createDataFrame([
        ("u", "p1", "k", 5.0), ("u", "p2", "k", 1.0), ("v", "p2", "k", 1.0)],
        "customer_unique_id string, product_id string, product_category_name string, "
        "review_score double")
    ranked = rec.ranked_category_products(data, agg.avg_score_per_product(data))
    preds = _preds(spark, [("u", "k", 0.0, 0.0), ("v", "k", 0.0, 0.0)])
    top = rec.top_products_for(preds, ranked, 5)
    got = rows(top, "customer_unique_id", "product_id")
    assert got == [("u", "p2"), ("v", "p1"), ("v", "p2")]


def test_sole_buyer_with_null_buyer_is_kept(spark):
    data = spark.createDataFrame([("u", "p1", "k", 5.0), (None, "p1", "k", 4.0)],
                                 "customer_unique_id string, product_id string, "
                                 "product_category_name string, review_score double")
    ranked = rec.ranked_category_products(data, agg.avg_score_per_product(data))
    top = rec.top_products_for(_preds(spark, [("u", "k", 0.0, 0.0)]), ranked, 5)
    assert rows(top, "customer_unique_id", "product_id") == [("u", "p1")]


PURCH = ("customer_unique_id string, product_id string, customer_geolocation_lat double, "
         "customer_geolocation_lng double, price double, freight_value double, "
         "order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz")


def test_nearest_rows_average_all_rows_of_customer(spark):
    t1 = T0 + dt.timedelta(days=2)
    data = spark.createDataFrame([
        ("a", "p", 1.0, 0.0, 10.0, 1.0, T0, t1),
        ("a", "p", 5.0, 0.0, 30.0, 1.0, T0, t1),
        ("b", "p", 2.0, 0.0, 99.0, 1.0, T0, t1)], PURCH)
    pairs = spark.createDataFrame([("u", "p", 0.0, 0.0)],
                                  "customer_unique_id string, product_id string, "
                                  "pred_lat double, pred_lng double")
    out = rec.expected_values(pairs, data, 1).collect()[0]
    assert out["estimated_price"] == 20.0
    assert out["estimated_delivery_time"] == 2


def test_nearest_null_distance_last(spark):
    data = spark.createDataFrame([
        ("a", "p", 3.0, 0.0, 10.0, 1.0, T0, T0),
        ("b", "p", None, None, 20.0, 1.0, T0, T0)], PURCH)
    pairs = spark.createDataFrame([("u", "p", 0.0, 0.0)],
                                  "customer_unique_id string, product_id string, "
                                  "pred_lat double, pred_lng double")
    near2 = rec.nearest_customers(pairs, data, 2)
    assert rows(near2, "_c") == [("a",), ("b",)]
    near1 = rec.nearest_customers(pairs, data, 1)
    assert rows(near1, "_c") == [("a",)]


def test_delivery_mean_floors_negative(spark):
    data = spark.createDataFrame([
        ("a", "p", 0.0, 0.0, 1.0, 1.0, T0, T0 - dt.timedelta(hours=12))], PURCH)
    out = agg.purchase_estimates(data, ["product_id"]).collect()[0]
    assert out["estimated_delivery_time"] == -1


def test_no_delivered_rows_give_null(spark):
    data = spark.createDataFrame([("a", "p", 0.0, 0.0, 1.0, 1.0, T0, None)], PURCH)
    assert agg.purchase_estimates(data, ["product_id"]).collect()[0][
        "estimated_delivery_time"] is None


def test_population_scaler(spark):
    from cartwise.ml import features as fe

    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,)], "x double")
    st = fe.fit_population_scaler(df, ["x"])
    got = [r["x_scaled"] for r in st.transform(df).orderBy("x").collect()]
    mean, std = 7 / 3, 1.247219128924647
    assert [round(g, 6) for g in got] == [round((v - mean) / std, 6) for v in (1, 2, 4)]
    const = spark.createDataFrame([(5.0,), (5.0,), (5.0,)], "x double")
    st = fe.fit_population_scaler(const, ["x"])
    assert [r["x_scaled"] for r in st.transform(const).collect()] == [0.0, 0.0, 0.0]


def test_one_hot_unseen_and_null(spark):
    from pyspark.ml.functions import vector_to_array

    from cartwise.ml import features as fe

    spec = seq.FeatureSpec(numerical=(), categorical=("c",), target=("t",))
    fit = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "y")], "c string, t string")
    f, _ = fe.fit_encoders(fit, spec)
    new = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, None)], "id int, c string")
    out = f.transform(new).select("id", vector_to_array("c_onehot").alias("v"))
    got = {r["id"]: [int(x) for x in r["v"]] for r in out.collect()}
    # slots in sorted order: __null__, a, b
    assert got == {1: [0, 1, 0], 2: [0, 0, 0], 3: [1, 0, 0]}


def test_scalar_text_functions(spark):
    df = spark.createDataFrame([("abcdefgh",), ("abc",)], "s string")
    assert rows(df.select(fx.id_prefix(F.col("s")).alias("p"))) == [("abc",), ("abcde",)]
    w = spark.createDataFrame([("abcdefg",)], "s string").select(
        fx.fixed_width(F.lit("L"), F.col("s"), 1, 5).alias("x")).first()["x"]
    assert w == "Labcdefg"  # padding never cuts
    c = spark.range(1).select(fx.centered(F.lit("ab"), 7, "#").alias("x")).first()["x"]
    assert c == f"{'ab':#^7}"
    import random

    r = random.Random(1)
    xs = [0.125, 0.375, 2.675, 1.005, 0.0, -0.0, -1.5, -0.125, 99.995, 0.994999, 0.995, 1e-12,
          123456789.125, None]
    xs += [r.randrange(10 ** 7) / 1000 for _ in range(3000)]
    xs += [r.random() * 10 ** r.randrange(6) for _ in range(3000)]
    n = spark.createDataFrame([(x,) for x in xs], "x double").select(
        "x", fx.two_decimals(F.col("x")).alias("t"))
    bad = [(q["x"], q["t"]) for q in n.collect()
           if q["t"] != ("nan" if q["x"] is None else f"{q['x']:.2f}")]
    assert bad == []


def test_days_floor_and_parse(spark):
    df = spark.createDataFrame([("2020-01-02 00:00:00", "2020-01-01 12:00:00")],
                               "a string, b string")
    out = df.select(fx.days_floor(fx.seconds_between(
        fx.parse_timestamp(F.col("a")), fx.parse_timestamp(F.col("b")))).alias("d")).first()
    assert out["d"] == -1


def test_csv_quirks(spark, tmp_path):
    from cartwise.sources import files

    p = tmp_path / "t.csv"
    p.write_text('id,txt\n1,"line one\nline two"\n2,"say ""hi"""\n3,NA\n4,\n')
    df = files.read_csv(spark, str(p), "id int, txt string", null_value="NA")
    got = {r["id"]: r["txt"] for r in df.collect()}
    assert got[1] == "line one\nline two"
    assert got[2] == 'say "hi"'
    assert got[3] is None and got[4] is None


def test_first_last_label_nulls_last(spark):
    df = spark.createDataFrame([("u", 2, "b"), ("u", 1, "a"), ("u", None, "z")],
                               "k string, o int, v string")
    got = seq.first_last_label(df, "k", "v", ["o"]).first()["pair"]
    assert got == "order_1: a, order_2: z"


def test_value_counts_and_histogram(spark):
    df = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "v string")
    assert rows(agg.value_counts(df, "v", 1)) == [("x", 2)]
    counts = spark.createDataFrame([(2,), (2,), (9,)], "n int")
    assert rows(agg.histogram(counts, "n", 2, 8)) == [(2, 2)]


def test_sample_is_deterministic(spark):
    from cartwise.operators.ranking import sample_rows

    df = spark.range(100).withColumnRenamed("id", "k")
    a = [r["k"] for r in sample_rows(df, ["k"], 10).collect()]
    b = [r["k"] for r in sample_rows(df.repartition(7), ["k"], 10).collect()]
    assert a == b and len(set(a)) == 10
    assert not math.isnan(sum(a))


def test_cohort_is_found_without_moving_the_rows(spark):
    """The cohort's keys are few and known to be: the rows aren't dealt by customer."""
    from cartwise.operators import sequences as seq

    data = spark.createDataFrame(
        [(f"c{k // 3}", f"c{k // 3}", k, k % 5) for k in range(300)]
        + [("x", "x", 1, 1), (None, None, 2, 2)],
        "customer_unique_id string, customer_id string, order_id long, product_id long")
    rows = seq.cohort_rows(data, 3)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    assert rows.count() == 300


def test_csv_parts_are_compressed_and_short(spark, tmp_path, monkeypatch):
    from cartwise.sources import files

    monkeypatch.setattr(files, "PART_ROWS", 10)
    df = spark.createDataFrame([(k, f'a "b"\n{k}') for k in range(25)], "k long, t string")
    files.write_csv(df.coalesce(1), str(tmp_path / "t.csv"))
    assert len(list((tmp_path / "t.csv").glob("*.csv.gz"))) == 3
    got = files.read_csv(spark, str(tmp_path / "t.csv"), df.schema).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, df.collect()))
