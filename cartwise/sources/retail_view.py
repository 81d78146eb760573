"""Retail schema over the driver's TPC-H-like tables.

The engine works on nine logical retail tables (customers, orders, order
items, payments, reviews, products, sellers, geolocation and category
translation).  The driver ships TPC-H-like parquet tables instead; this
module binds one to the other.  The same binding exists twice: as Spark
DataFrames (``retail_tables``) and as DuckDB CTE text (``RETAIL_CTES``)
so that every oracle query can start from identical logical tables.

Every logical table is a projection of a driver table, so its size grows
with the data; nothing here is collected or made up on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values of the binding (FIXTURES.md section 3) -------------------
# Brands that get no English translation (exercises NULL categories).
UNTRANSLATED_BRANDS = ("Brand#2", "Brand#4")
# A translation row that no product uses (exercises the outer join).
ORPHAN_TRANSLATION = ("Orphan", "orphan")
# Every order has payment 1; orders whose key is a multiple of this also
# have payment 2 (exercises the fan-out of the order-level joins).
SECOND_PAYMENT_EVERY = 50
# Orders with this status have no review (exercises NULL scores).
UNREVIEWED_STATUS = "P"
# ---------------------------------------------------------------------------

DRIVER_TABLES = ("customer", "orders", "lineitem", "part", "supplier", "embeddings")


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def review_score_expr(order_key: Column) -> Column:
    return (F.lit(1) + (order_key * 7) % 5).cast("double")


def retail_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Lazily bound logical tables; column pruning reaches the scans."""
    t = lambda n: read_driver_table(spark, sf_dir, n)
    customer, orders, lineitem = t("customer"), t("orders"), t("lineitem")
    part, supplier, emb = t("part"), t("supplier"), t("embeddings")

    customers = customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_custkey").alias("customer_unique_id"),
        F.col("c_nationkey").alias("customer_zip_code_prefix"),
    )
    orders_v = orders.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").alias("order_purchase_timestamp"),
    )
    items = lineitem.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
        F.col("l_shipdate").alias("order_delivered_customer_date"),
    )
    payments = orders.select(
        F.col("o_orderkey").alias("order_id"), F.lit(1).alias("payment_sequential")
    ).unionAll(
        orders.where(F.col("o_orderkey") % SECOND_PAYMENT_EVERY == 0).select(
            F.col("o_orderkey").alias("order_id"), F.lit(2).alias("payment_sequential")
        )
    )
    reviews = orders.where(F.col("o_orderstatus") != UNREVIEWED_STATUS).select(
        F.col("o_orderkey").alias("order_id"),
        review_score_expr(F.col("o_orderkey")).alias("review_score"),
    )
    products = part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_brand").alias("product_category_name"),
    )
    sellers = supplier.select(
        F.col("s_suppkey").alias("seller_id"),
        F.col("s_nationkey").alias("seller_zip_code_prefix"),
    )
    geolocation = emb.select(
        F.col("label").alias("geolocation_zip_code_prefix"),
        F.col("embedding")[0].cast("double").alias("geolocation_lat"),
        F.col("embedding")[1].cast("double").alias("geolocation_lng"),
    )
    translation = (
        part.where(~F.col("p_brand").isin(*UNTRANSLATED_BRANDS))
        .select(F.col("p_brand").alias("product_category_name"))
        .distinct()
        .select(
            "product_category_name",
            F.lower(F.replace("product_category_name", F.lit("#"), F.lit("_")))
            .alias("product_category_name_english"),
        )
        .unionAll(
            spark.createDataFrame(
                [ORPHAN_TRANSLATION],
                "product_category_name string, product_category_name_english string")
        )
    )
    return {
        "customers": customers,
        "orders": orders_v,
        "order_items": items,
        "order_payments": payments,
        "order_reviews": reviews,
        "products": products,
        "sellers": sellers,
        "geolocation": geolocation,
        "product_translation": translation,
    }


_untranslated = ", ".join(f"'{b}'" for b in UNTRANSLATED_BRANDS)

# DuckDB text of the same binding (arrays are 1-based there).
RETAIL_CTES = f"""
r_customers AS (
  SELECT c_custkey AS customer_id, c_custkey AS customer_unique_id,
         c_nationkey AS customer_zip_code_prefix FROM customer),
r_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         o_orderdate AS order_purchase_timestamp FROM orders),
r_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
         l_suppkey AS seller_id, l_extendedprice AS price,
         l_extendedprice * l_tax AS freight_value,
         l_shipdate AS order_delivered_customer_date FROM lineitem),
r_payments AS (
  SELECT o_orderkey AS order_id, 1 AS payment_sequential FROM orders
  UNION ALL
  SELECT o_orderkey AS order_id, 2 AS payment_sequential FROM orders
  WHERE o_orderkey % {SECOND_PAYMENT_EVERY} = 0),
r_reviews AS (
  SELECT o_orderkey AS order_id, CAST(1 + (o_orderkey * 7) % 5 AS DOUBLE) AS review_score
  FROM orders WHERE o_orderstatus <> '{UNREVIEWED_STATUS}'),
r_products AS (
  SELECT p_partkey AS product_id, p_brand AS product_category_name FROM part),
r_sellers AS (
  SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix FROM supplier),
r_geolocation AS (
  SELECT label AS geolocation_zip_code_prefix,
         CAST(embedding[1] AS DOUBLE) AS geolocation_lat,
         CAST(embedding[2] AS DOUBLE) AS geolocation_lng FROM embeddings),
r_translation AS (
  SELECT product_category_name,
         lower(replace(product_category_name, '#', '_')) AS product_category_name_english
  FROM (SELECT DISTINCT p_brand AS product_category_name FROM part
        WHERE p_brand NOT IN ({_untranslated}))
  UNION ALL
  SELECT '{ORPHAN_TRANSLATION[0]}', '{ORPHAN_TRANSLATION[1]}')
"""
