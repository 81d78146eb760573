"""Registered queries: sources and sinks (A1-A4)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cartwise.plans import oracle_sql as osql
from cartwise.plans.catalog import register
from cartwise.operators import aggregates as agg
from cartwise.plans.prepare import complete_data
from cartwise.ml import models as ml
from cartwise.operators.ordering import sorted_positions
from cartwise.plans import pipeline as pl
from cartwise.plans.queries_core import build_wide, tables, wide
from cartwise.plans.queries_flow import COHORT_CTES
from cartwise.session import scratch_path
from cartwise.sources import files
from cartwise.sources.retail_csv import load_csv_tables, write_csv_tables

DRIVER_FILES = ("benchmark conversations customer documents embeddings events labels "
                "lineitem nation orders pages part region supplier").split()


# --- A1 ----------------------------------------------------------------------
@register("csv_roundtrip", osql.with_complete(body="SELECT * FROM r_complete"))
def q_csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The wide table written as CSV and read back with its schema."""
    df = build_wide(spark, sf)
    path = scratch_path(spark, f"csv-{uuid.uuid4().hex[:12]}")
    files.write_csv(df, path)
    return files.read_csv(spark, path, df.schema)


# Identifiers of the driver's tables are numbers.
DRIVER_IDS = dict.fromkeys(("customer_id", "customer_unique_id", "order_id", "product_id",
                            "seller_id"), "bigint")


@register("csv_tables", osql.with_complete(body="SELECT * FROM r_complete"))
def q_csv_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The nine tables written as CSV files, loaded, and joined."""
    folder = scratch_path(spark, f"csv-tables-{uuid.uuid4().hex[:12]}")
    write_csv_tables(tables(spark, sf), folder)
    t = load_csv_tables(spark, folder, types=DRIVER_IDS)
    return complete_data(t, agg.geo_average(t["geolocation"]))


# --- A2 ----------------------------------------------------------------------
@register("load_tables", "\nUNION ALL\n".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in DRIVER_FILES))
def q_load_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Every file of the data folder as a table, with its row count."""
    return files.table_sizes(files.load_folder(spark, sf))


# --- A3 / A4 -----------------------------------------------------------------
@register("parquet_roundtrip", osql.with_complete(body="SELECT * FROM r_complete"))
def q_parquet_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, f"parquet-{uuid.uuid4().hex[:12]}")
    files.write_parquet(build_wide(spark, sf), path)
    return files.read_parquet(spark, path)


# --- F1 ----------------------------------------------------------------------
SORTED_COLUMNS = ("order_purchase_timestamp", "order_id", "order_item_id", "product_id",
                  "seller_id", "price", "freight_value", "order_delivered_customer_date",
                  "payment_sequential", "review_score", "product_category_name",
                  "customer_id", "customer_unique_id")


@register("sorted_purchases", osql.with_complete(body=f"""
SELECT {", ".join(SORTED_COLUMNS)}, row_number() OVER (ORDER BY {osql.TOTAL_ORDER_SQL}) AS position
FROM r_complete"""))
def q_sorted_purchases(spark: SparkSession, sf: str) -> DataFrame:
    """Every row of the wide table with its position in the order of purchase."""
    return sorted_positions(wide(spark, sf).select(*SORTED_COLUMNS), SORTED_COLUMNS)


# --- I11 ---------------------------------------------------------------------
JOBS_SAMPLE = 5
_SAMPLE_SQL = ("md5(concat_ws(':', '42', "
               + ", ".join(f"CAST({k} AS VARCHAR)" for k in pl.ROW_KEYS) + ")), "
               + ", ".join(f"{k} ASC NULLS LAST" for k in pl.ROW_KEYS))


@register("three_jobs", osql.with_complete(*COHORT_CTES[:5], f"""
usable_rows AS (
  SELECT * FROM r_complete WHERE customer_unique_id IS NOT NULL AND review_score IS NOT NULL)""",
                                           body=f"""
SELECT 'avg_score_per_product' AS saved, count(DISTINCT product_id) AS n_rows FROM r_complete
UNION ALL SELECT 'complete_data', count(*) FROM r_complete
UNION ALL SELECT 'cv_scores', {ml.CV_FOLDS * ml.CV_REPEATS * len(ml.INVERSE_REG_GRID)}
UNION ALL SELECT 'predictor_table', count(*) FROM firsts
UNION ALL SELECT 'report', count(DISTINCT customer_unique_id) FROM (
  SELECT customer_unique_id FROM usable_rows ORDER BY {_SAMPLE_SQL} LIMIT {JOBS_SAMPLE})
UNION ALL SELECT 'unlabeled_data', count(*) FROM usable_rows
UNION ALL SELECT 'zip_clusters', count(*) FROM r_geo_avg"""))
def q_three_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """The three jobs, each from what the one before it saved; rows of each saved
    table as its manifest gives it (of the report: its customers)."""
    out_dir = scratch_path(spark, f"jobs-{uuid.uuid4().hex[:12]}")
    pl.run(spark, sf, out_dir, sample_size=JOBS_SAMPLE, product_number=3)
    paths = pl.outputs(spark, out_dir)
    saved = {name: spark.read.parquet(paths[name]) for name in (
        "avg_score_per_product", "complete_data", "cv_scores", "predictor_table",
        "unlabeled_data", "zip_clusters")}
    saved["report"] = spark.read.parquet(paths["report"]).select("customer_unique_id").distinct()
    return files.table_sizes(saved).withColumnRenamed("table_name", "saved")
