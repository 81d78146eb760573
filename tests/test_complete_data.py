"""The re-planned wide table equals the literal full outer chain on random
retail tables with NULL keys, orphans on every side and duplicate keys."""

from __future__ import annotations

import random

import pytest

from cartwise.plans import prepare

SCHEMAS = {
    "customers": "customer_id long, customer_unique_id long, customer_zip_code_prefix int",
    "orders": "order_id long, customer_id long, order_purchase_timestamp string",
    "order_items": "order_id long, order_item_id int, product_id long, seller_id long, "
                   "price double",
    "order_payments": "order_id long, payment_sequential int",
    "order_reviews": "order_id long, review_score double",
    "products": "product_id long, product_category_name string",
    "sellers": "seller_id long, seller_zip_code_prefix int",
    "product_translation": "product_category_name string, "
                           "product_category_name_english string",
}


def maybe(r, v, p=0.1):
    return None if r.random() < p else v


def random_tables(spark, seed):
    r = random.Random(seed)
    cust = [(c, c + 100, r.randrange(3)) for c in range(8)] + [(None, 999, 1)]
    orders = [(o, maybe(r, r.randrange(11)), f"t{r.randrange(4)}") for o in range(12)]
    orders.append((None, 3, "t0"))
    items = [(maybe(r, r.randrange(15)), i, maybe(r, r.randrange(9)), maybe(r, r.randrange(5)),
              float(r.randrange(100))) for i in range(30)]
    pays = [(maybe(r, r.randrange(15)), s) for s in (1, 2) for _ in range(6)]
    revs = [(maybe(r, r.randrange(15)), float(r.randrange(1, 6))) for _ in range(8)]
    prods = [(p, maybe(r, f"cat{p % 3}")) for p in range(7)] + [(None, "cat0")]
    sellers = [(s, r.randrange(3)) for s in range(4)] + [(None, 2)]
    tr = [("cat0", "c0"), ("cat1", "c1"), ("orphan", "o")]
    rows = {"customers": cust, "orders": orders, "order_items": items,
            "order_payments": pays, "order_reviews": revs, "products": prods,
            "sellers": sellers, "product_translation": tr}
    return {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}


def canon(df):
    cols = sorted(df.columns)
    return sorted((tuple(row[c] for c in cols) for row in df.collect()),
                  key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("seed", [11, 12, 13])
def test_fast_chain_equals_literal_chain(spark, seed):
    """Plain Spark USING full joins in the reference order are the oracle."""
    t = random_tables(spark, seed)
    fast = prepare.complete_data(t, translate=True)
    # literal chain + literal translation under SQL NULL semantics
    lit = t["customers"].join(t["orders"], "customer_id", "full")
    for name in ("order_items", "order_payments", "order_reviews"):
        lit = lit.join(t[name], "order_id", "full")
    lit = lit.join(t["products"], "product_id", "full")
    lit = lit.join(t["sellers"], "seller_id", "full")
    lit = lit.join(t["product_translation"], "product_category_name", "full")
    lit = lit.drop("product_category_name").withColumnRenamed(
        "product_category_name_english", "product_category_name")
    assert sorted(fast.columns) == sorted(lit.columns)
    assert canon(fast) == canon(lit)


@pytest.mark.parametrize("seed", [21, 22])
def test_full_outer_null_bypass_equals_plain_join(spark, seed):
    from cartwise.operators import joins

    r = random.Random(seed)
    a = spark.createDataFrame([(maybe(r, r.randrange(5), 0.3), i) for i in range(20)],
                              "k long, a int")
    b = spark.createDataFrame([(maybe(r, r.randrange(5), 0.3), i) for i in range(15)],
                              "k long, b int")
    assert canon(joins.full_outer(a, b, "k")) == canon(a.join(b, "k", "full"))


def test_prepared_follows_its_source(spark, tmp_path):
    """A table is prepared once, and anew after its source has changed."""
    src = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(src)
    built = []

    def get():
        def build():
            built.append(1)
            return spark.read.parquet(src)
        return prepare.prepared(spark, "probe", src, build).count()

    assert (get(), get(), len(built)) == (3, 3, 1)
    spark.range(2).write.mode("append").parquet(src)
    assert (get(), get(), len(built)) == (5, 5, 2)


def rows_shuffled(df) -> int:
    """Rows written by all exchanges of the plan that ran; one that is reused counts once."""
    def walk(node):
        if node.getClass().getSimpleName() == "ReusedExchangeExec":
            return 0
        found = node.metrics().get("shuffleRecordsWritten")
        total = found.get().value() if found.isDefined() else 0
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        kids = node.children()
        return total + sum(walk(kids.apply(i)) for i in range(kids.size()))

    df.collect()
    return walk(df._jdf.queryExecution().executedPlan())


def test_wide_rows_are_not_shuffled_by_zip_or_category(spark):
    """Items are shuffled by product, seller and order, once each; the wide rows never."""
    n = 1000
    rows = {
        "customers": [(1, 1, 0)], "orders": [(o, 1, "t") for o in range(10)],
        "order_items": [(i % 11, i, i % 7, 1, 1.0) for i in range(n)],
        "order_payments": [(o, 1) for o in range(10)], "order_reviews": [(1, 1.0)],
        "products": [(p, f"cat{p % 3}") for p in range(7)], "sellers": [(1, 0)],
        "product_translation": [("cat0", "c0"), ("cat1", "c1")]}
    t = {k: spark.createDataFrame(v, SCHEMAS[k]) for k, v in rows.items()}
    zips = spark.createDataFrame([(0, 1.0, 2.0)], "geolocation_zip_code_prefix int, "
                                 "geolocation_lat double, geolocation_lng double")
    # stored tables of this size are broadcast; nothing is as a shuffle has shown its size
    conf = {"spark.sql.autoBroadcastJoinThreshold": "100k",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        wide = prepare.complete_data(t, zips)
        # besides: the items' keys, for products and sellers that nothing refers to
        assert 3 * n <= rows_shuffled(wide) < 3 * n + n // 2
        assert wide.count() == n
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
