"""Registered queries: relational core (sources, joins, aggregates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.operators import aggregates as agg
from cartwise.operators.ranking import top_n_per_group
from cartwise.plans import oracle_sql as osql
from cartwise.plans.catalog import register
from cartwise.plans.prepare import complete_data, prepared
from cartwise.sources.retail_view import retail_tables


def tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return retail_tables(spark, sf)


def build_wide(spark: SparkSession, sf: str) -> DataFrame:
    t = tables(spark, sf)
    return complete_data(t, agg.geo_average(t["geolocation"]))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """The prepared wide table (written once per application, then read)."""
    return prepared(spark, "complete_data", sf,
                    lambda: build_wide(spark, sf))


# --- C10 -------------------------------------------------------------------
@register("complete_data", osql.with_complete(body="SELECT * FROM r_complete"))
def q_complete_data(spark: SparkSession, sf: str) -> DataFrame:
    return build_wide(spark, sf)


# --- D3 --------------------------------------------------------------------
@register("geo_average", osql.with_ctes(osql.GEO_AVG_CTE, body="SELECT * FROM r_geo_avg"))
def q_geo_average(spark: SparkSession, sf: str) -> DataFrame:
    return agg.geo_average(tables(spark, sf)["geolocation"])


# --- D4 --------------------------------------------------------------------
@register("avg_score_per_product", osql.with_complete(body="""
SELECT product_id, avg(review_score) AS review_score
FROM r_complete WHERE product_id IS NOT NULL GROUP BY product_id"""))
def q_avg_score_per_product(spark: SparkSession, sf: str) -> DataFrame:
    return agg.avg_score_per_product(wide(spark, sf))


# --- F3 (per category, over the whole table) --------------------------------
TOP_N = 5


def category_top_products(data: DataFrame, n: int) -> DataFrame:
    scores = agg.avg_score_per_product(data)
    cat_products = (data.where(F.col("product_category_name").isNotNull()
                               & F.col("product_id").isNotNull())
                    .select("product_category_name", "product_id").distinct())
    ranked = cat_products.join(scores, "product_id")
    return top_n_per_group(
        ranked, ["product_category_name"],
        [F.col("review_score").desc_nulls_last(), F.col("product_id").asc()], n)


@register("top_products", osql.with_complete(body=f"""
SELECT product_category_name, product_id, review_score, rank FROM (
  SELECT cp.product_category_name, cp.product_id, s.review_score,
         CAST(row_number() OVER (PARTITION BY cp.product_category_name
                                 ORDER BY s.review_score DESC NULLS LAST, cp.product_id)
              AS INTEGER) AS rank
  FROM (SELECT DISTINCT product_category_name, product_id FROM r_complete
        WHERE product_category_name IS NOT NULL AND product_id IS NOT NULL) cp
  JOIN (SELECT product_id, avg(review_score) AS review_score FROM r_complete
        WHERE product_id IS NOT NULL GROUP BY product_id) s
    ON cp.product_id = s.product_id)
WHERE rank <= {TOP_N}"""))
def q_top_products(spark: SparkSession, sf: str) -> DataFrame:
    return category_top_products(wide(spark, sf), TOP_N)
