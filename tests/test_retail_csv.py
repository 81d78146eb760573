"""The nine CSV files: headers, types by name, missing words, line ends."""

from __future__ import annotations

import datetime as dt
import re

import pytest

from cartwise.sources import retail_csv


def write(folder, name, text):
    (folder / name).write_text(text, encoding="utf-8")


def test_load_csv_tables(spark, tmp_path):
    write(tmp_path, "x_customers.csv", "customer_id,customer_unique_id,customer_zip_code_prefix,"
          "customer_city\n\"a\",\"u\",\"01001\",São Paulo\nb,NA,nan,\"NULL\"\n")
    write(tmp_path, "x_geolocation.csv", "geolocation_zip_code_prefix,geolocation_lat,"
          "geolocation_lng,geolocation_state\n1001,-23.5,-46.6,SP\n")
    write(tmp_path, "x_order_items.csv", "order_id,order_item_id,product_id,seller_id,price,"
          "freight_value\no1,1,p1,s1,58.90,13.29\n")
    write(tmp_path, "x_order_payments.csv", "order_id,payment_sequential\no1,1\n")
    write(tmp_path, "x_order_reviews.csv", "review_id,order_id,review_score,message\n"
          "r1,o1,4,\"two\nlines, \"\"quoted\"\"\"\nr2,o1,,\n")
    write(tmp_path, "x_orders.csv", "order_id,customer_id,order_purchase_timestamp,"
          "order_delivered_customer_date\no1,a,2017-10-02 10:56:33,\n")
    write(tmp_path, "x_products.csv", "product_id,product_category_name\np1,perfumaria\np2,\n")
    write(tmp_path, "x_sellers.csv", "seller_id,seller_zip_code_prefix\ns1,13023\n")
    write(tmp_path, "names.csv", "product_category_name,product_category_name_english\n"
          "perfumaria,perfumery\n")
    t = retail_csv.load_csv_tables(spark, str(tmp_path), prefix="x_",
                                   names={"product_translation": "names.csv"})
    assert set(t) == set(retail_csv.TABLES)
    got = {r.customer_id: r for r in t["customers"].collect()}
    assert got["a"].customer_zip_code_prefix == 1001 and got["a"].customer_city == "São Paulo"
    assert tuple(got["b"]) == ("b", None, None, None)
    r = {x.review_id: x for x in t["order_reviews"].collect()}
    assert r["r1"].message == 'two\nlines, "quoted"' and r["r1"].review_score == 4.0
    assert r["r2"].review_score is None
    o = t["orders"].first()
    assert o.order_purchase_timestamp == dt.datetime(2017, 10, 2, 10, 56, 33)
    assert o.order_delivered_customer_date is None
    from cartwise.operators import aggregates as agg
    from cartwise.plans.prepare import complete_data
    wide = complete_data(t, agg.geo_average(t["geolocation"])).collect()
    # two reviews of the order, the customer without one, the product without an item
    assert len(wide) == 4
    assert {x.product_category_name for x in wide} == {"perfumery", None}


def test_malformed_value_raises(spark, tmp_path):
    write(tmp_path, "s.csv", "seller_id,seller_zip_code_prefix\ns1,abc\n")
    with pytest.raises(Exception):
        retail_csv.read_table(spark, str(tmp_path / "s.csv")).collect()


def written_tables(spark, folder):
    orders = [(o, o % 23, dt.datetime(2020, 1, 1 + o % 28)) for o in range(300)]
    t = {
        "customers": spark.createDataFrame(
            [(c, c, c % 3) for c in range(25)],
            "customer_id long, customer_unique_id long, customer_zip_code_prefix int"),
        "geolocation": spark.createDataFrame(
            [(z, float(z), -float(z)) for z in range(3)],
            "geolocation_zip_code_prefix int, geolocation_lat double, geolocation_lng double"),
        "order_items": spark.createDataFrame(
            [(o, i, (o + i) % 7, i % 2, 1.5 * o) for o in range(310) for i in (1, 2)],
            "order_id long, order_item_id int, product_id long, seller_id long, price double"),
        "order_payments": spark.createDataFrame([(o, 1) for o in range(305)],
                                                "order_id long, payment_sequential int"),
        "order_reviews": spark.createDataFrame([(o, 3.0) for o in range(0, 300, 2)],
                                               "order_id long, review_score double"),
        "orders": spark.createDataFrame(
            orders, "order_id long, customer_id long, order_purchase_timestamp timestamp_ntz"),
        "products": spark.createDataFrame([(p, f"c{p % 3}" if p else None) for p in range(8)],
                                          "product_id long, product_category_name string"),
        "sellers": spark.createDataFrame([(0, 1), (2, 2)],
                                         "seller_id long, seller_zip_code_prefix int"),
        "product_translation": spark.createDataFrame(
            [("c0", "e0"), ("c2", "e2"), ("c9", "e9")],
            "product_category_name string, product_category_name_english string"),
    }
    retail_csv.write_csv_tables(t, str(folder))
    return t


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def broadcast_keys(df):
    """First keys of the plan's broadcast joins."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"BroadcastHashJoin \[(\w+)#", text))


def test_broadcasts_by_counted_bytes(spark, tmp_path, monkeypatch):
    """A few compressed bytes may be millions of rows: facts are never broadcast,
    dimensions only if their rows are few."""
    from cartwise.operators import aggregates as agg
    from cartwise.plans.prepare import complete_data

    types = dict.fromkeys(("customer_id", "customer_unique_id", "order_id", "product_id",
                           "seller_id"), "bigint")
    plain = written_tables(spark, tmp_path)
    want = rows(complete_data(plain, agg.geo_average(plain["geolocation"])))

    def loaded():
        t = retail_csv.load_csv_tables(spark, str(tmp_path), types=types)
        return complete_data(t, agg.geo_average(t["geolocation"]))

    small = loaded()
    keys = broadcast_keys(small)
    assert "order_id" not in keys and {"customer_id", "product_id", "seller_id"} <= keys
    assert rows(small) == want
    monkeypatch.setattr(retail_csv, "BROADCAST_BYTES", 100)   # only the two sellers fit
    large = loaded()
    keys = broadcast_keys(large)
    assert not keys & {"order_id", "customer_id", "product_id"} and "seller_id" in keys
    assert rows(large) == want


def test_bytes_in_memory(spark):
    df = spark.createDataFrame([(1, "abc"), (2, None), (3, "é")], "a long, b string")
    row = retail_csv.ROW_BYTES + 2 * retail_csv.COLUMN_BYTES
    assert retail_csv.bytes_in_memory(df).first()[0] == 3 * row + 5
    assert retail_csv.bytes_in_memory(df.limit(0)).first()[0] == 0
