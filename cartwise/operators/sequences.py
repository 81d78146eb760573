"""Window and sequence operators.

Every window ends its ORDER BY with a total order of visible columns
(S1), so results never depend on row order.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.functions.scalar import nulls_last_key
from cartwise.plans.prepare import total_order
from cartwise.session import stored


@dataclass(frozen=True)
class FeatureSpec:
    """Column roles of the classifier table."""

    numerical: tuple[str, ...]
    categorical: tuple[str, ...]
    target: tuple[str, ...]

    def columns(self) -> list[str]:
        """Roles flattened in declared order: numerical, categorical, target."""
        return [*self.numerical, *self.categorical, *self.target]

    def features(self) -> list[str]:
        return [*self.numerical, *self.categorical]


# The column roles of the pipeline's classifier table, and the
# shorter set of the exploratory predictor table.
PIPELINE_SPEC = FeatureSpec(
    numerical=("review_score",),
    categorical=("customer_location_cluster", "seller_location_cluster",
                 "product_category_name"),
    target=("next_product_category",),
)
EXPLORATION_SPEC = FeatureSpec(
    numerical=("review_score",),
    categorical=("product_category_name",),
    target=("next_product_category",),
)

CUSTOMER = "customer_unique_id"
CATEGORY = "product_category_name"


def cohort_customers(data: DataFrame, n: int, customer: str = CUSTOMER,
                     counted: str = "customer_id",
                     subset: Sequence[str] = ("order_id", "product_id"),
                     unit: str = "row") -> DataFrame:
    """E4 (S3): customers with exactly ``n`` purchases.

    ``unit='row'``: n joined rows before *and* after removing duplicate
    (customer, order, product) rows -- one aggregate with a plain and a
    distinct count (``struct`` so NULL members still count as a value).
    ``unit='order'``: n distinct orders.

    The keys are written, so that joins with them see their size: the rows of
    ``data`` are read where they lie instead of being shuffled.
    """
    d = data.where(F.col(customer).isNotNull())
    if unit == "row":
        # cheap partial-aggregated count first; the distinct check then only
        # reads the rows of customers that have exactly n rows
        rows_n = stored(d.groupBy(customer).agg(F.count(counted).alias("_rows"))
                        .where(F.col("_rows") == n).select(customer), "n-rows")
        stats = (d.join(rows_n, customer, "left_semi").groupBy(customer)
                 .agg(F.count_distinct(F.struct(*subset)).alias("_distinct")))
        keep = F.col("_distinct") == n
    elif unit == "order":
        stats = d.groupBy(customer).agg(F.count_distinct("order_id").alias("_orders"))
        keep = F.col("_orders") == n
    else:
        raise ValueError(unit)
    return stored(stats.where(keep).select(customer), "cohort")


def cohort_rows(data: DataFrame, n: int, customer: str = CUSTOMER,
                unit: str = "row") -> DataFrame:
    """The rows of the cohort customers (semi join; the customer list
    is written, so the planner broadcasts it when small)."""
    return data.join(cohort_customers(data, n, customer, unit=unit), customer, "left_semi")


def next_purchase(rows: DataFrame, spec: FeatureSpec = PIPELINE_SPEC,
                  customer: str = CUSTOMER, category: str = CATEGORY,
                  order: Sequence[Column] | None = None,
                  extra: Sequence[str] = ()) -> DataFrame:
    """Per customer, the feature columns of the first purchase in
    time order and, as target, the category of the second.  ``extra``
    columns of the first purchase are passed through."""
    w = Window.partitionBy(customer).orderBy(*(order or total_order(available=rows.columns)))
    target = spec.target[0]
    x = (rows.withColumn("_rn", F.row_number().over(w))
         .withColumn(target, F.lead(category, 1).over(w)))
    return x.where(F.col("_rn") == 1).select(customer, *spec.features(), target, *extra)


def training_rows(data: DataFrame, n: int, spec: FeatureSpec = PIPELINE_SPEC,
                  unit: str = "row") -> DataFrame:
    """I1 without the encoders: D2 -> E4 -> E1."""
    if n < 2:
        raise ValueError("n must be at least 2: the target is the second purchase")
    return next_purchase(cohort_rows(data, n, unit=unit), spec)


def first_last_label(data: DataFrame, key: str, value: str,
                     order_columns: Sequence[str]) -> DataFrame:
    """E3 + G7: ``order_1: <first>, order_2: <last>`` per key, taking the
    ends of the value sequence in ``order_columns`` order (ascending, NULLs
    last) -- array ends instead of splitting a joined string (S18)."""
    k = nulls_last_key(order_columns)
    out = data.groupBy(key).agg(F.min_by(value, k).alias("_first"),
                                F.max_by(value, k).alias("_last"))
    return out.select(key, F.concat(F.lit("order_1: "), F.col("_first"),
                                    F.lit(", order_2: "), F.col("_last")).alias("pair"))
