"""The set-based recommendation (S5, S6 rewrites) against a direct,
per-customer pandas rendering of the same semantics on random tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import random

import pandas as pd
import pytest

from cartwise.plans import recommend as rec

SCHEMA = ("customer_unique_id string, product_id string, product_category_name string, "
          "review_score double, customer_geolocation_lat double, "
          "customer_geolocation_lng double, price double, freight_value double, "
          "order_purchase_timestamp timestamp_ntz, order_delivered_customer_date timestamp_ntz")
T0 = dt.datetime(2021, 3, 1)
ZIPS = [(0.0, 0.0), (1.0, 0.5), (0.5, 1.0), (2.0, 2.0), (None, None)]


def random_rows(seed: int, n: int = 60):
    r = random.Random(seed)
    custs = [f"c{i}" for i in range(6)] + [None]
    home = {c: r.choice(ZIPS) for c in custs}
    rows = []
    for _ in range(n):
        c = r.choice(custs)
        p = f"p{r.randrange(8)}"
        cat = {"p0": "k0", "p1": "k0", "p2": "k0", "p3": "k0", "p4": "k1", "p5": "k1",
               "p6": "k1", "p7": None}[p]
        lat, lng = home[c] if r.random() < 0.9 else r.choice(ZIPS)
        score = r.choice([1.0, 2.0, 5.0, None])
        price = r.choice([10.0, 10.01, 20.5, None])
        fr = r.choice([1.0, 2.25, None])
        buy = T0 + dt.timedelta(days=r.randrange(5))
        dlv = None if r.random() < 0.2 else buy + dt.timedelta(hours=r.randrange(-20, 100))
        rows.append((c, p, cat, score, lat, lng, price, fr, buy, dlv))
    return rows


def md5_key(seed, u, p):
    return hashlib.md5(f"{seed}:{u}:{p}".encode()).hexdigest()


def _nl(x):
    return (x is None or (isinstance(x, float) and math.isnan(x)), x if x == x else None)


def brute(pdf: pd.DataFrame, preds, product_number, estimation_n, seed):
    scores = pdf[pdf.product_id.notna()].groupby("product_id").review_score.mean()
    out = {}
    for u, cat, lat0, lng0 in preds:
        rest = pdf[~(pdf.customer_unique_id == u).fillna(False)] if u is not None else pdf
        prods = rest[rest.product_category_name == cat].product_id.dropna().unique()
        cand = sorted(prods, key=lambda p: (pd.isna(scores[p]),
                                            -scores[p] if not pd.isna(scores[p]) else 0, p))
        top = cand[:estimation_n]
        drawn = sorted(top, key=lambda p: (md5_key(seed, u, p), p))[:product_number]
        for p in drawn:
            rp = rest[rest.product_id == p]
            recs = []
            for _, row in rp.iterrows():
                la, ln = row.customer_geolocation_lat, row.customer_geolocation_lng
                d = None if (pd.isna(la) or pd.isna(lat0)) else abs(la - lat0) + abs(ln - lng0)
                recs.append((d, row.customer_unique_id, la, ln))
            recs.sort(key=lambda t: (_nl(t[0]), _nl(t[1]), _nl(t[2]), _nl(t[3])))
            chosen = {t[1] if not pd.isna(t[1]) else None for t in recs[:estimation_n]}
            sel = rp[rp.customer_unique_id.apply(
                lambda c: (None if pd.isna(c) else c) in chosen)]
            secs = (sel.order_delivered_customer_date - sel.order_purchase_timestamp
                    ).dt.total_seconds()
            days = None if secs.dropna().empty else math.floor(secs.mean() / 86400)
            out[(u, p)] = (scores[p], sel.price.mean(), sel.freight_value.mean(), days)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5, 6])
def test_recommend_matches_literal_semantics(spark, seed):
    data = random_rows(seed)
    df = spark.createDataFrame(data, SCHEMA)
    pdf = df.toPandas()
    r = random.Random(seed * 7)
    preds = [(f"c{i}", r.choice(["k0", "k1", None]), *r.choice(ZIPS)) for i in range(6)]
    preds.append((None, "k0", 0.0, 0.0)) if seed % 2 else None
    pdf_preds = spark.createDataFrame(preds, "customer_unique_id string, predicted_category "
                                             "string, pred_lat double, pred_lng double")
    pn, en = 2, 3
    got = {(row.customer_unique_id, row.product_id):
           (row.review_score, row.estimated_price, row.shipping_price,
            row.estimated_delivery_time)
           for row in rec.recommend(df, pdf_preds.where("customer_unique_id IS NOT NULL"),
                                    pn, en, seed=42).collect()}
    want = brute(pdf, [p for p in preds if p[0] is not None], pn, en, 42)
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        for a, b in zip(g, w):
            if b is None or (isinstance(b, float) and math.isnan(b)):
                assert a is None, (k, g, w)
            else:
                assert a == pytest.approx(b, rel=1e-12), (k, g, w)


def test_search_does_not_grow_with_customers_at_one_place(spark):
    """3000 customers at one place, one product: one search, not 3000."""
    from pyspark.sql import functions as F

    n = 3000
    units = spark.range(n).select(
        F.lit("p").alias("product_id"), F.concat(F.lit("c"), "id").alias("customer_unique_id"),
        F.col("id").cast("double").alias("customer_geolocation_lat"),
        F.lit(0.0).alias("customer_geolocation_lng"), F.lit(1).cast("long").alias("_rows"))
    pairs = spark.range(n).select(
        F.concat(F.lit("c"), "id").alias("customer_unique_id"), F.lit("p").alias("product_id"),
        F.lit(0.0).alias("pred_lat"), F.lit(0.0).alias("pred_lng"))
    keyed = pairs.select("customer_unique_id", "product_id",
                         F.struct(F.col("pred_lat").alias("lat"),
                                  F.col("pred_lng").alias("lng")).alias("_place"))
    assert rec.places_near(keyed, units, 5).count() == 6      # 5 and the one that may be own
    out = rec.nearest_customers(pairs, None, 5, units)
    per = {r.customer_unique_id: r["count"] for r in
           out.groupBy("customer_unique_id").count().collect()}
    assert len(per) == n and set(per.values()) == {5}
    own = out.where("customer_unique_id = _c").count()
    assert own == 0


def test_report_plan_has_group_limits_and_no_python(spark):
    import __spark_entry__ as entry

    df = entry.queries()["report_lines"](spark, "/root/testdata/sf0.001")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Pandas" not in text and "Arrow" not in text
    data = spark.range(100_000).selectExpr("id % 10 AS a", "id AS b")
    from cartwise.operators.ranking import top_within
    plan = top_within(data, ["a"], [data["b"]], 1000, ["b"])
    assert "WindowGroupLimit" in plan._jdf.queryExecution().executedPlan().toString()


def test_generated_ranks_are_neither_shuffled_nor_broadcast(spark):
    """60 customers of a ranking of 400: the 24000 rows stay where they are made."""
    from pyspark.sql import functions as F

    ranked = spark.range(400).select(
        F.lit("k").alias("product_category_name"), F.col("id").alias("product_id"),
        F.lit(3.0).alias("review_score"), F.lit(None).cast("long").alias("sole_buyer"),
        (F.col("id") + 1).cast("int").alias("cat_rank"))
    preds = spark.range(60).select(
        F.col("id").alias("customer_unique_id"), F.lit("k").alias("predicted_category"),
        F.lit(0.0).alias("pred_lat"), F.lit(0.0).alias("pred_lng"))
    drawn = rec.draw_products(rec.top_products_for(preds, ranked, 300), 3)
    rows = drawn.collect()
    assert len(rows) == 180 and {r.n_available for r in rows} == {300}
    lines = drawn._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    above = []
    for line in lines.splitlines():
        if "Generate explode" in line:
            break
        above.append(line)
    else:
        raise AssertionError("no generator in the plan")
    assert not any("Exchange" in line for line in above), lines


def test_a_long_ranking_is_joined_by_shuffle(spark, monkeypatch):
    from pyspark.sql import functions as F

    ranked = spark.range(40).select(
        F.lit("k").alias("product_category_name"), F.col("id").alias("product_id"),
        F.lit(3.0).alias("review_score"), F.lit(None).cast("long").alias("sole_buyer"),
        (F.col("id") + 1).cast("int").alias("cat_rank"))
    preds = spark.range(7).select(
        F.col("id").alias("customer_unique_id"), F.lit("k").alias("predicted_category"),
        F.lit(0.0).alias("pred_lat"), F.lit(0.0).alias("pred_lng"))
    want = sorted(map(tuple, rec.top_products_for(preds, ranked, 30).collect()))
    monkeypatch.setattr(rec, "SHORT_RANKING", 10)
    assert sorted(map(tuple, rec.top_products_for(preds, ranked, 30).collect())) == want
    assert len(want) == 210
