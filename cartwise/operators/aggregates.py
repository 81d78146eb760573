"""Aggregations and distinct.

All are hash aggregates with map-side partial aggregation; nothing is
collected.  Group keys that are NULL are dropped where pandas ``groupby``
drops them (D1-D7).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.functions.scalar import (days_floor, exact_mean, nulls_last_key,
                                       seconds_between, stable_mean)

# Mean coordinates per zip are kept to 1e-12 degrees.
COORD_DECIMALS = 12


def count_per_key(data: DataFrame, key: str,
                  columns: Sequence[str] | None = None) -> DataFrame:
    """Per key, the count of non-NULL values of every other column."""
    cols = [c for c in (columns or data.columns) if c != key]
    return (data.where(F.col(key).isNotNull())
            .groupBy(key).agg(*[F.count(c).alias(c) for c in cols]))


def keys_with_count(data: DataFrame, n: int, key: str = "customer_unique_id",
                    counted: str = "customer_id") -> DataFrame:
    """Keys whose count of non-NULL ``counted`` values is exactly ``n``."""
    return (data.where(F.col(key).isNotNull()).groupBy(key)
            .agg(F.count(counted).alias("_n")).where(F.col("_n") == n).select(key))


def geo_average(geolocation: DataFrame, zip_column: str = "geolocation_zip_code_prefix",
                value_columns: Sequence[str] = ("geolocation_lat", "geolocation_lng"),
                decimals: int = COORD_DECIMALS) -> DataFrame:
    """D3: mean coordinates per zip prefix (one row per zip), whatever the order of
    the rows."""
    return (geolocation.where(F.col(zip_column).isNotNull()).groupBy(zip_column)
            .agg(*[F.round(stable_mean(F.col(c)), decimals).alias(c) for c in value_columns]))


def avg_score_per_product(data: DataFrame, product: str = "product_id",
                          score: str = "review_score") -> DataFrame:
    """Mean review score per product over the joined rows (weighted by
    fan-out); a product without any score keeps a NULL mean."""
    return (data.where(F.col(product).isNotNull()).groupBy(product)
            .agg(F.avg(score).alias(score)))


def purchase_estimates(rows: DataFrame, group_by: Sequence[str],
                       price: str = "price", freight: str = "freight_value",
                       purchased: str = "order_purchase_timestamp",
                       delivered: str = "order_delivered_customer_date") -> DataFrame:
    """D5 + D6 per group: mean price, mean freight and the floored mean delivery time
    in days (NULL parts skipped, NULL if none).  Amounts are summed exactly."""
    return rows.groupBy(*group_by).agg(
        exact_mean(F.col(price)).alias("estimated_price"),
        exact_mean(F.col(freight)).alias("shipping_price"),
        days_floor(F.avg(seconds_between(F.col(purchased), F.col(delivered))))
        .alias("estimated_delivery_time"),
    )


def orders_by_seller(data: DataFrame, seller: str = "seller_id",
                     order: str = "order_id") -> DataFrame:
    """Per seller, the count of rows with an order id."""
    return (data.where(F.col(seller).isNotNull()).groupBy(seller)
            .agg(F.count(order).alias("n_orders")))


def joined_values(data: DataFrame, key: str, value: str, order_by: Sequence[str],
                  sep: str = ", ", alias: str | None = None) -> DataFrame:
    """Per key, the values joined with ``sep``, ordered by the
    ``order_by`` columns (ascending, NULLs last)."""
    order = ", ".join(f"`{c}` ASC NULLS LAST" for c in order_by)
    sep_sql = sep.replace("'", "''")
    expr = F.expr(f"listagg(`{value}`, '{sep_sql}') WITHIN GROUP (ORDER BY {order})")
    return data.groupBy(key).agg(expr.alias(alias or value))


def value_counts(data: DataFrame, column: str, more_than: int | None = None) -> DataFrame:
    """Frequency per distinct non-NULL value, optionally kept above a
    threshold.  Order is a presentation concern: sort by ``count`` desc."""
    out = data.where(F.col(column).isNotNull()).groupBy(column).agg(
        F.count(F.lit(1)).alias("count"))
    if more_than is not None:
        out = out.where(F.col("count") > more_than)
    return out


def histogram(counts: DataFrame, column: str, low: int | None = None,
              high: int | None = None) -> DataFrame:
    """Number of keys per count value, within [low, high]."""
    out = counts
    if low is not None:
        out = out.where(F.col(column) >= low)
    if high is not None:
        out = out.where(F.col(column) <= high)
    return out.groupBy(column).agg(F.count(F.lit(1)).alias("n_keys"))


def distinct_values(data: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """Distinct values; NULL counts as a value."""
    cols = [columns] if isinstance(columns, str) else list(columns)
    return data.select(*cols).distinct()


def first_per_subset(data: DataFrame, subset: Sequence[str],
                     order_columns: Sequence[str]) -> DataFrame:
    """De-duplicate on ``subset`` keeping the first row by ``order_columns``
    (ascending, NULLs last) and then by the other columns (NULLs first); NULL equals
    NULL within the subset.

    The rows are structs that sort in that order, and the least of a group is an
    aggregate: every task sends one row a group, so a hot group never meets whole.
    Columns must be of types that can be compared (no maps)."""
    order = [c for c in order_columns if c in data.columns and c not in subset]
    rest = [c for c in data.columns if c not in order and c not in subset]
    row = F.struct(*([nulls_last_key(order).alias("o")] if order else []),
                   *[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)])
    if not order and not rest:
        return data.select(*subset).distinct().select(*data.columns)
    least = data.groupBy(*subset).agg(F.min(row).alias("_row"))
    at = {c: F.col(f"_row.o._v{i}") for i, c in enumerate(order)}
    at |= {c: F.col(f"_row.r{i}") for i, c in enumerate(rest)}
    return least.select(*[at[c].alias(c) if c in at else F.col(c) for c in data.columns])
