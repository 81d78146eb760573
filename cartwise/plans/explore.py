"""Exploratory analyses of the notebook (I12, D10, E3), as Spark jobs.

Orders per person, the category pair of customers with exactly two
orders, and how often each pair occurs.  The drawings of the notebook are
not built; these frames are the data behind them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from cartwise.operators import aggregates as agg
from cartwise.operators import filters
from cartwise.operators.joins import full_outer_with_dimension, translate_categories
from cartwise.operators.sequences import first_last_label

CU = "customer_unique_id"
# Order of a customer's purchases in the pair label.
PURCHASE_ORDER = ("order_purchase_timestamp", "order_id", "product_id",
                  "product_category_name")


def orders_with_person(t: dict[str, DataFrame]) -> DataFrame:
    """orders FULL JOIN customers[customer_id, customer_unique_id]."""
    people = t["customers"].select("customer_id", CU)
    return full_outer_with_dimension(t["orders"], people, "customer_id")


def orders_per_person(t: dict[str, DataFrame]) -> DataFrame:
    """D1 on orders: per person, non-NULL counts of every column."""
    return agg.count_per_key(orders_with_person(t), CU)


def people_with_orders(t: dict[str, DataFrame], n: int) -> DataFrame:
    """D2 (unit = order): people with exactly ``n`` orders."""
    return agg.keys_with_count(orders_with_person(t), n, CU, "order_id")


def translated_products(t: dict[str, DataFrame]) -> DataFrame:
    """Products LEFT JOIN translation, English name replacing the
    original category."""
    return translate_categories(t["products"], t["product_translation"], how="left")


def purchase_categories(t: dict[str, DataFrame], people: DataFrame | None = None
                        ) -> DataFrame:
    """C4 chain for the given people (all if None): customers -> orders ->
    items -> products, a missing category read as ``unknown`` (B8, C4, B9)."""
    cust = t["customers"] if people is None else filters.keep_keys(t["customers"], people, CU)
    cust = cust.select("customer_id", CU)
    x = cust.join(t["orders"].select("order_id", "customer_id",
                                     "order_purchase_timestamp"), "customer_id", "left")
    x = x.join(t["order_items"].select("order_id", "product_id"), "order_id", "left")
    x = x.join(translated_products(t).select("product_id", "product_category_name"),
               "product_id", "left")
    return filters.fill_unknown(x, ["product_category_name"])


def category_lists(rows: DataFrame) -> DataFrame:
    """Per person, the categories joined with ', ' in purchase order."""
    return agg.joined_values(rows, CU, "product_category_name", PURCHASE_ORDER)


def category_pairs(rows: DataFrame) -> DataFrame:
    """Per person, ``order_1: <first>, order_2: <last>``."""
    return first_last_label(rows, CU, "product_category_name", PURCHASE_ORDER)


def pair_counts(t: dict[str, DataFrame], n_orders: int = 2, more_than: int = 1) -> DataFrame:
    """I12 + D9: how often each first/last category pair occurs among people
    with exactly ``n_orders`` orders, kept above ``more_than``."""
    rows = purchase_categories(t, people_with_orders(t, n_orders))
    return agg.value_counts(category_pairs(rows), "pair", more_than)


def orders_histogram(t: dict[str, DataFrame], low: int | None = None,
                     high: int | None = None) -> DataFrame:
    """Number of people per order count, for all repeat buyers; ``low``
    and ``high`` cut a visible range."""
    counts = filters.greater_than(orders_per_person(t), "order_id", 1)
    return agg.histogram(counts, "order_id", low, high).withColumnRenamed(
        "order_id", "n_orders")
