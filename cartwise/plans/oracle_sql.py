"""Shared DuckDB CTE text for oracle queries (literal reference semantics)."""

from __future__ import annotations

from cartwise.functions.scalar import MONEY_SCALE
from cartwise.operators.aggregates import COORD_DECIMALS
from cartwise.sources.retail_view import RETAIL_CTES

GEO_AVG_CTE = f"""
r_geo_avg AS (
  SELECT geolocation_zip_code_prefix,
         round(avg(geolocation_lat), {COORD_DECIMALS}) AS geolocation_lat,
         round(avg(geolocation_lng), {COORD_DECIMALS}) AS geolocation_lng
  FROM r_geolocation WHERE geolocation_zip_code_prefix IS NOT NULL
  GROUP BY geolocation_zip_code_prefix)
"""

# The literal chain of full outer joins (merged USING keys).
CHAIN_CTE = """
r_chain AS (
  SELECT * FROM r_customers
  FULL JOIN r_orders USING (customer_id)
  FULL JOIN r_items USING (order_id)
  FULL JOIN r_payments USING (order_id)
  FULL JOIN r_reviews USING (order_id)
  FULL JOIN r_products USING (product_id)
  FULL JOIN r_sellers USING (seller_id))
"""

WIDE_SELECT = """
  ch.customer_id, ch.customer_unique_id, ch.customer_zip_code_prefix, ch.order_id,
  ch.order_purchase_timestamp, ch.order_item_id, ch.product_id, ch.seller_id, ch.price,
  ch.freight_value, ch.order_delivered_customer_date, ch.payment_sequential,
  ch.review_score, ch.seller_zip_code_prefix,
  gc.geolocation_lat AS customer_geolocation_lat,
  gc.geolocation_lng AS customer_geolocation_lng,
  gs.geolocation_lat AS seller_geolocation_lat,
  gs.geolocation_lng AS seller_geolocation_lng
"""

COMPLETE_CTE = f"""
r_complete AS (
  SELECT {WIDE_SELECT},
         tr.product_category_name_english AS product_category_name
  FROM r_chain ch
  LEFT JOIN r_geo_avg gc ON ch.customer_zip_code_prefix = gc.geolocation_zip_code_prefix
  LEFT JOIN r_geo_avg gs ON ch.seller_zip_code_prefix = gs.geolocation_zip_code_prefix
  FULL JOIN r_translation tr ON ch.product_category_name = tr.product_category_name)
"""

# Total order of wide rows, same columns as prepare.TOTAL_ORDER_COLUMNS.
TOTAL_ORDER_SQL = (
    "order_purchase_timestamp ASC NULLS LAST, order_id ASC NULLS LAST, "
    "order_item_id ASC NULLS LAST, product_id ASC NULLS LAST, seller_id ASC NULLS LAST, "
    "price ASC NULLS LAST, freight_value ASC NULLS LAST, "
    "order_delivered_customer_date ASC NULLS LAST, payment_sequential ASC NULLS LAST, "
    "review_score ASC NULLS LAST, product_category_name ASC NULLS LAST, "
    "customer_id ASC NULLS LAST, customer_unique_id ASC NULLS LAST"
)


def with_ctes(*ctes: str, body: str) -> str:
    """``WITH <retail binding>, <ctes...> <body>``."""
    parts = [RETAIL_CTES.strip()] + [c.strip() for c in ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def with_complete(*ctes: str, body: str) -> str:
    return with_ctes(GEO_AVG_CTE, CHAIN_CTE, COMPLETE_CTE, *ctes, body=body)


def amount_sql(x: str) -> str:
    """DuckDB text of an amount of money as a decimal; its ``avg`` is exact."""
    return f"CAST({x} AS DECIMAL(18, {MONEY_SCALE}))"
