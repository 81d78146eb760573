"""Registered queries: projections, filters, joins, notebook analyses,
scalar functions (B*, C1-C9, D1/D7-D11, E3, G*, I12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.functions import scalar as fx
from cartwise.operators import aggregates as agg
from cartwise.operators import filters, joins
from cartwise.operators import sequences as seq
from cartwise.plans import explore
from cartwise.plans import oracle_sql as osql
from cartwise.plans.catalog import register
from cartwise.plans.queries_core import tables, wide
from cartwise.plans.queries_flow import COHORT_CTES, COHORT_N

# Parameters of the registered queries.
FILTER_CATEGORY = "brand_13"
# The notebook looks at people with two orders; hardly any driver customer has
# so few, 184 at sf0.01 have ten.
PAIR_ORDERS = 10


# --- B1-B3 -------------------------------------------------------------------
@register("project_rename_drop", osql.with_ctes(body="""
SELECT order_id, product_category_name_english AS product_category_name
FROM (SELECT i.order_id, tr.product_category_name_english
      FROM r_items i
      JOIN r_products p ON p.product_id = i.product_id
      LEFT JOIN r_translation tr ON tr.product_category_name = p.product_category_name)"""))
def q_project_rename_drop(spark: SparkSession, sf: str) -> DataFrame:
    """B1-B3 as in the notebook: project the item keys, join the product
    category, drop the original name, rename the translation into its place."""
    t = tables(spark, sf)
    items = t["order_items"].select("order_id", "product_id")
    x = items.join(t["products"], "product_id").join(
        t["product_translation"], "product_category_name", "left")
    x = x.drop("product_category_name", "product_id")
    return filters.rename(x, {"product_category_name_english": "product_category_name"})


# --- B4 + G4 -----------------------------------------------------------------
@register("derived_columns", osql.with_complete(body="""
SELECT customer_unique_id, order_id, order_item_id, product_id, seller_id, payment_sequential,
       abs(customer_geolocation_lat - seller_geolocation_lat)
         + abs(customer_geolocation_lng - seller_geolocation_lng) AS customer_seller_distance
FROM r_complete"""))
def q_derived_columns(spark: SparkSession, sf: str) -> DataFrame:
    d = wide(spark, sf)
    return d.select("customer_unique_id", "order_id", "order_item_id", "product_id",
                    "seller_id", "payment_sequential",
                    fx.l1_distance(F.col("customer_geolocation_lat"),
                                   F.col("customer_geolocation_lng"),
                                   F.col("seller_geolocation_lat"),
                                   F.col("seller_geolocation_lng"))
                    .alias("customer_seller_distance"))


# --- G2 + G3 -----------------------------------------------------------------
@register("delivery_days", osql.with_complete(body="""
SELECT order_id, order_item_id, product_id, seller_id, payment_sequential,
       date_diff('second', order_purchase_timestamp, order_delivered_customer_date)
         AS delivery_seconds,
       CAST(floor(date_diff('second', order_purchase_timestamp,
                            order_delivered_customer_date) / 86400) AS BIGINT) AS delivery_days
FROM r_complete"""))
def q_delivery_days(spark: SparkSession, sf: str) -> DataFrame:
    d = wide(spark, sf)
    secs = fx.seconds_between(F.col("order_purchase_timestamp"),
                              F.col("order_delivered_customer_date"))
    return d.select("order_id", "order_item_id", "product_id", "seller_id",
                    "payment_sequential", secs.alias("delivery_seconds"),
                    fx.days_floor(secs).cast("bigint").alias("delivery_days"))


# --- B5 ----------------------------------------------------------------------
@register("filter_category", osql.with_complete(
    body=f"SELECT * FROM r_complete WHERE product_category_name = '{FILTER_CATEGORY}'"))
def q_filter_category(spark: SparkSession, sf: str) -> DataFrame:
    return filters.equals(wide(spark, sf), "product_category_name", FILTER_CATEGORY)


# --- B6 + D12 ----------------------------------------------------------------
PERSON_ORDERS_CTE = """
person_orders AS (
  SELECT customer_unique_id, count(order_id) AS order_id,
         count(customer_id) AS customer_id,
         count(order_purchase_timestamp) AS order_purchase_timestamp
  FROM r_orders FULL JOIN (SELECT customer_id, customer_unique_id FROM r_customers)
       USING (customer_id)
  WHERE customer_unique_id IS NOT NULL GROUP BY customer_unique_id)"""


@register("repeat_customers", osql.with_ctes(PERSON_ORDERS_CTE, body="""
SELECT customer_unique_id, order_id AS n_orders FROM person_orders WHERE order_id > 1"""))
def q_repeat_customers(spark: SparkSession, sf: str) -> DataFrame:
    counts = filters.greater_than(explore.orders_per_person(tables(spark, sf)), "order_id", 1)
    return counts.select("customer_unique_id", F.col("order_id").alias("n_orders"))


# --- D1 ----------------------------------------------------------------------
@register("count_per_customer", osql.with_ctes(PERSON_ORDERS_CTE,
                                               body="SELECT * FROM person_orders"))
def q_count_per_customer(spark: SparkSession, sf: str) -> DataFrame:
    return explore.orders_per_person(tables(spark, sf))


# --- B7 (set form) -----------------------------------------------------------
@register("exclude_customer", osql.with_complete(*COHORT_CTES[:3], body="""
SELECT * FROM r_complete
WHERE NOT coalesce(customer_unique_id IN (SELECT customer_unique_id FROM cohort2), false)"""))
def q_exclude_customer(spark: SparkSession, sf: str) -> DataFrame:
    d = wide(spark, sf)
    return filters.exclude_keys(d, seq.cohort_customers(d, COHORT_N), "customer_unique_id")


# --- B8 ----------------------------------------------------------------------
@register("semi_join_cohort", osql.with_complete(PERSON_ORDERS_CTE, body=f"""
SELECT * FROM r_complete d WHERE EXISTS (
  SELECT 1 FROM person_orders p WHERE p.order_id = {PAIR_ORDERS}
  AND p.customer_unique_id IS NOT DISTINCT FROM d.customer_unique_id)"""))
def q_semi_join_cohort(spark: SparkSession, sf: str) -> DataFrame:
    people = explore.people_with_orders(tables(spark, sf), PAIR_ORDERS)
    return filters.keep_keys(wide(spark, sf), people, "customer_unique_id")


# --- B9 ----------------------------------------------------------------------
@register("fill_unknown", osql.with_complete(body="""
SELECT customer_unique_id, order_id, order_item_id, product_id, payment_sequential,
       coalesce(product_category_name, 'unknown') AS product_category_name
FROM r_complete"""))
def q_fill_unknown(spark: SparkSession, sf: str) -> DataFrame:
    d = wide(spark, sf).select("customer_unique_id", "order_id", "order_item_id",
                               "product_id", "payment_sequential", "product_category_name")
    return filters.fill_unknown(d, ["product_category_name"])


# --- C1 ----------------------------------------------------------------------
@register("full_outer_customers_orders", osql.with_ctes(body="""
SELECT * FROM r_orders FULL JOIN (SELECT customer_id, customer_unique_id FROM r_customers)
USING (customer_id)"""))
def q_full_outer_customers_orders(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return joins.full_outer(t["orders"], t["customers"].select("customer_id",
                                                               "customer_unique_id"),
                            "customer_id")


# --- C2 ----------------------------------------------------------------------
@register("natural_full_outer", osql.with_ctes(body="""
SELECT * FROM r_customers FULL JOIN r_orders USING (customer_id)
NATURAL FULL JOIN r_items"""))
def q_natural_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    co = joins.full_outer(t["customers"], t["orders"], "customer_id")
    return joins.natural_full_outer(co, t["order_items"])


# --- C3 ----------------------------------------------------------------------
@register("null_safe_full_outer", osql.with_ctes(body="""
SELECT coalesce(l.product_id, r.product_id) AS product_id, l.order_id, l.price,
       r.product_category_name_english
FROM (SELECT order_id, product_id, price FROM r_orders FULL JOIN r_items USING (order_id)) l
FULL JOIN (SELECT product_id, product_category_name_english
           FROM r_products FULL JOIN r_translation USING (product_category_name)) r
  ON l.product_id IS NOT DISTINCT FROM r.product_id"""))
def q_null_safe_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    left = joins.full_outer(t["orders"], t["order_items"], "order_id").select(
        "order_id", "product_id", "price")
    right = joins.full_outer(t["products"], t["product_translation"],
                             "product_category_name").select(
        "product_id", "product_category_name_english")
    return joins.full_outer(left, right, "product_id", null_safe=True)


# --- C4 + B9 -----------------------------------------------------------------
LEFT_CHAIN_CTE = """
chain AS (
  SELECT c.customer_id, c.customer_unique_id, o.order_id, o.order_purchase_timestamp,
         i.product_id, coalesce(p.product_category_name, 'unknown') AS product_category_name
  FROM r_customers c
  LEFT JOIN r_orders o ON o.customer_id = c.customer_id
  LEFT JOIN r_items i ON i.order_id = o.order_id
  LEFT JOIN (SELECT pr.product_id, tr.product_category_name_english AS product_category_name
             FROM r_products pr LEFT JOIN r_translation tr
               ON pr.product_category_name = tr.product_category_name) p
    ON p.product_id = i.product_id)"""


@register("left_join_chain", osql.with_ctes(LEFT_CHAIN_CTE, body="SELECT * FROM chain"))
def q_left_join_chain(spark: SparkSession, sf: str) -> DataFrame:
    return explore.purchase_categories(tables(spark, sf))


# --- C5/C6 -------------------------------------------------------------------
@register("join_coordinates", osql.with_ctes(osql.GEO_AVG_CTE, body="""
SELECT c.*, g.geolocation_lat AS customer_geolocation_lat,
       g.geolocation_lng AS customer_geolocation_lng
FROM r_customers c LEFT JOIN r_geo_avg g
  ON c.customer_zip_code_prefix = g.geolocation_zip_code_prefix"""))
def q_join_coordinates(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return joins.join_coordinates(t["customers"], agg.geo_average(t["geolocation"]),
                                  "customer_zip_code_prefix", "customer")


# --- C8 / C9 -----------------------------------------------------------------
@register("translate_outer", osql.with_ctes(body="""
SELECT product_id, product_category_name_english AS product_category_name
FROM r_products FULL JOIN r_translation USING (product_category_name)"""))
def q_translate_outer(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return joins.translate_categories(t["products"], t["product_translation"], how="full")


@register("translate_left", osql.with_ctes(body="""
SELECT pr.product_id, tr.product_category_name_english AS product_category_name
FROM r_products pr LEFT JOIN r_translation tr
  ON pr.product_category_name = tr.product_category_name"""))
def q_translate_left(spark: SparkSession, sf: str) -> DataFrame:
    return explore.translated_products(tables(spark, sf))


# --- D7 ----------------------------------------------------------------------
@register("orders_by_seller", osql.with_complete(body="""
SELECT seller_id, count(order_id) AS n_orders FROM r_complete
WHERE seller_id IS NOT NULL GROUP BY seller_id"""))
def q_orders_by_seller(spark: SparkSession, sf: str) -> DataFrame:
    return agg.orders_by_seller(wide(spark, sf))


# --- D8 ----------------------------------------------------------------------
PAIR_ORDER_SQL = ("order_purchase_timestamp ASC NULLS LAST, order_id ASC NULLS LAST, "
                  "product_id ASC NULLS LAST, product_category_name ASC NULLS LAST")


@register("category_list", osql.with_ctes(PERSON_ORDERS_CTE, LEFT_CHAIN_CTE, body=f"""
SELECT customer_unique_id,
       string_agg(product_category_name, ', ' ORDER BY {PAIR_ORDER_SQL})
         AS product_category_name
FROM chain
WHERE customer_unique_id IN (SELECT customer_unique_id FROM person_orders
                             WHERE order_id = {PAIR_ORDERS})
GROUP BY customer_unique_id"""))
def q_category_list(spark: SparkSession, sf: str) -> DataFrame:
    """D8 for people with an exact number of orders, so each joined string
    covers a bounded group."""
    t = tables(spark, sf)
    rows = explore.purchase_categories(t, explore.people_with_orders(t, PAIR_ORDERS))
    return explore.category_lists(rows)


# --- G6 ----------------------------------------------------------------------
@register("list_ends", osql.with_ctes(PERSON_ORDERS_CTE, LEFT_CHAIN_CTE, body=f"""
SELECT customer_unique_id,
       list(product_category_name ORDER BY {PAIR_ORDER_SQL})[1] AS first_category,
       list(product_category_name ORDER BY {PAIR_ORDER_SQL})[-1] AS last_category
FROM chain
WHERE customer_unique_id IN (SELECT customer_unique_id FROM person_orders
                             WHERE order_id = {PAIR_ORDERS})
GROUP BY customer_unique_id"""))
def q_list_ends(spark: SparkSession, sf: str) -> DataFrame:
    """First and last element of each person's joined category list."""
    t = tables(spark, sf)
    rows = explore.purchase_categories(t, explore.people_with_orders(t, PAIR_ORDERS))
    joined = F.col("product_category_name")
    return explore.category_lists(rows).select(
        "customer_unique_id", fx.first_part(joined).alias("first_category"),
        fx.last_part(joined).alias("last_category"))


# --- E3 / D9 / I12 -----------------------------------------------------------
PAIR_CTE = f"""
pairs AS (
  SELECT customer_unique_id,
         'order_1: ' || list(product_category_name ORDER BY {PAIR_ORDER_SQL})[1]
         || ', order_2: ' || list(product_category_name ORDER BY {PAIR_ORDER_SQL})[-1] AS pair
  FROM chain
  WHERE customer_unique_id IN (SELECT customer_unique_id FROM person_orders
                               WHERE order_id = {PAIR_ORDERS})
  GROUP BY customer_unique_id)"""


@register("first_last_pair", osql.with_ctes(PERSON_ORDERS_CTE, LEFT_CHAIN_CTE, PAIR_CTE,
                                            body="SELECT * FROM pairs"))
def q_first_last_pair(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    rows = explore.purchase_categories(t, explore.people_with_orders(t, PAIR_ORDERS))
    return explore.category_pairs(rows)


@register("pair_counts", osql.with_ctes(PERSON_ORDERS_CTE, LEFT_CHAIN_CTE, PAIR_CTE, body="""
SELECT pair, count(*) AS count FROM pairs GROUP BY pair HAVING count(*) > 1"""))
def q_pair_counts(spark: SparkSession, sf: str) -> DataFrame:
    return explore.pair_counts(tables(spark, sf), PAIR_ORDERS, 1)


# --- D10 ---------------------------------------------------------------------
@register("orders_histogram", osql.with_ctes(PERSON_ORDERS_CTE, body="""
SELECT order_id AS n_orders, count(*) AS n_keys FROM person_orders
WHERE order_id > 1 GROUP BY order_id"""))
def q_orders_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return explore.orders_histogram(tables(spark, sf))


# --- D11 ---------------------------------------------------------------------
@register("distinct_products", osql.with_complete(
    body="SELECT DISTINCT product_id FROM r_complete"))
def q_distinct_products(spark: SparkSession, sf: str) -> DataFrame:
    return agg.distinct_values(wide(spark, sf), "product_id")


# --- G1 ----------------------------------------------------------------------
@register("parse_timestamps", osql.with_ctes(body="""
SELECT order_id, strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S') AS purchase_text,
       strptime(strftime(order_purchase_timestamp, '%Y-%m-%d %H:%M:%S'),
                '%Y-%m-%d %H:%M:%S') AS order_purchase_timestamp
FROM r_orders"""))
def q_parse_timestamps(spark: SparkSession, sf: str) -> DataFrame:
    o = tables(spark, sf)["orders"].select(
        "order_id", F.date_format("order_purchase_timestamp", fx.TIMESTAMP_FORMAT)
        .alias("purchase_text"))
    return o.select("order_id", "purchase_text",
                    fx.parse_timestamp(F.col("purchase_text")).alias("order_purchase_timestamp"))


# --- G5 ----------------------------------------------------------------------
@register("trim_ids", osql.with_ctes(body="""
SELECT customer_unique_id, substring(CAST(customer_unique_id AS VARCHAR), 1, 5) AS short_id
FROM r_customers"""))
def q_trim_ids(spark: SparkSession, sf: str) -> DataFrame:
    c = tables(spark, sf)["customers"]
    return c.select("customer_unique_id",
                    fx.id_prefix(F.col("customer_unique_id")).alias("short_id"))
