"""Registered queries: cohort, next purchase and recommendation flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.operators import aggregates as agg
from cartwise.operators import sequences as seq
from cartwise.operators.ranking import sample_rows, sample_per_group
from cartwise.plans import oracle_sql as osql
from cartwise.plans import recommend as rec
from cartwise.plans.catalog import register
from cartwise.plans.prepare import TOTAL_ORDER_COLUMNS, total_order
from cartwise.plans.queries_core import category_top_products, wide
from cartwise.session import stored

# Parameters of the registered queries.  With the retail binding a
# customer has about 40 joined rows, so the cohort uses n = 37 rows
# (SURVEY 7.2); product_number and estimation_n are the defaults of the
# batch recommendation.
COHORT_N = 37
PRODUCT_NUMBER = 3
ESTIMATION_N = 5
SAMPLE_SIZE = 1000
SEED = 42

T = osql.TOTAL_ORDER_SQL

COHORT_CTES = (f"""
cohort1 AS (
  SELECT customer_unique_id FROM r_complete WHERE customer_unique_id IS NOT NULL
  GROUP BY customer_unique_id HAVING count(customer_id) = {COHORT_N})""", f"""
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY customer_unique_id, order_id, product_id
                                 ORDER BY {T}) AS rn
    FROM r_complete
    WHERE customer_unique_id IN (SELECT customer_unique_id FROM cohort1))
  WHERE rn = 1)""", f"""
cohort2 AS (
  SELECT customer_unique_id FROM dedup
  GROUP BY customer_unique_id HAVING count(customer_id) = {COHORT_N})""", """
cohort_rows AS (
  SELECT * FROM dedup WHERE customer_unique_id IN (SELECT customer_unique_id FROM cohort2))""",
                f"""
firsts AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT customer_unique_id, review_score, product_category_name,
           customer_geolocation_lat, customer_geolocation_lng,
           row_number() OVER w AS rn,
           lead(product_category_name) OVER w AS next_product_category
    FROM cohort_rows
    WINDOW w AS (PARTITION BY customer_unique_id ORDER BY {T}))
  WHERE rn = 1)""", """
preds AS (
  SELECT customer_unique_id AS u, next_product_category AS cat,
         customer_geolocation_lat AS lat0, customer_geolocation_lng AS lng0 FROM firsts)""")

SCORES_CTE = """
scores AS (
  SELECT product_id, avg(review_score) AS review_score FROM r_complete
  WHERE product_id IS NOT NULL GROUP BY product_id)"""

# Literal I8: exclude u's rows, category products, top-n, md5 draw.
def drawn_ctes(estimation_n: int, product_number: int) -> tuple[str, ...]:
    return (SCORES_CTE, """
cat_products AS (
  SELECT DISTINCT p.u, d.product_id FROM preds p
  JOIN r_complete d ON d.product_category_name = p.cat
  WHERE d.product_id IS NOT NULL AND NOT coalesce(d.customer_unique_id = p.u, false))""",
            f"""
top AS (
  SELECT * FROM (
    SELECT c.u, c.product_id, s.review_score,
           row_number() OVER (PARTITION BY c.u
                              ORDER BY s.review_score DESC NULLS LAST, c.product_id) AS r
    FROM cat_products c JOIN scores s ON s.product_id = c.product_id)
  WHERE r <= {estimation_n})""", """
navail AS (SELECT u, count(*) AS n_available FROM top GROUP BY u)""", f"""
drawn AS (
  SELECT * FROM (
    SELECT t.*, row_number() OVER (
      PARTITION BY u ORDER BY md5(concat_ws(':', '{SEED}', CAST(u AS VARCHAR),
                                            CAST(product_id AS VARCHAR))), product_id) AS dr
    FROM top t)
  WHERE dr <= {product_number})""")


# Literal F6 / I7: the n nearest rows, their customers, estimates.
def near_ctes(n_nearest: int) -> tuple[str, ...]:
    return (f"""
near AS (
  SELECT * FROM (
    SELECT dw.u, dw.product_id, d.customer_unique_id AS c,
           row_number() OVER (
             PARTITION BY dw.u, dw.product_id
             ORDER BY abs(d.customer_geolocation_lat - p.lat0)
                      + abs(d.customer_geolocation_lng - p.lng0) ASC NULLS LAST,
                      d.customer_unique_id ASC NULLS LAST,
                      d.customer_geolocation_lat ASC NULLS LAST,
                      d.customer_geolocation_lng ASC NULLS LAST) AS nr
    FROM drawn dw JOIN preds p ON p.u = dw.u
    JOIN r_complete d ON d.product_id = dw.product_id
                     AND NOT coalesce(d.customer_unique_id = dw.u, false))
  WHERE nr <= {n_nearest})""", """
chosen AS (SELECT DISTINCT u, product_id, c FROM near)""", f"""
est AS (
  SELECT ch.u, ch.product_id,
         avg({osql.amount_sql("d.price")}) AS estimated_price,
         avg({osql.amount_sql("d.freight_value")}) AS shipping_price,
         CAST(floor(avg(date_diff('second', d.order_purchase_timestamp,
                                  d.order_delivered_customer_date)) / 86400) AS BIGINT)
           AS estimated_delivery_time
  FROM chosen ch JOIN r_complete d
    ON d.product_id = ch.product_id AND d.customer_unique_id IS NOT DISTINCT FROM ch.c
  GROUP BY ch.u, ch.product_id)""")


DRAWN_CTES = drawn_ctes(ESTIMATION_N, PRODUCT_NUMBER)
NEAR_CTES = near_ctes(ESTIMATION_N)


def cohort_predictions(data: DataFrame, n: int = COHORT_N) -> DataFrame:
    """Prediction rows for the oracle-checkable flow: every cohort customer
    with its own next category as the predicted one (SURVEY 7.3)."""
    first = seq.next_purchase(seq.cohort_rows(data, n), seq.EXPLORATION_SPEC,
                              extra=(rec.LAT, rec.LNG))
    return first.select(rec.CUSTOMER,
                        F.col("next_product_category").alias("predicted_category"),
                        F.col(rec.LAT).alias("pred_lat"), F.col(rec.LNG).alias("pred_lng"))


def drawn_pairs(data: DataFrame) -> DataFrame:
    return rec.drawn_products(data, cohort_predictions(data), PRODUCT_NUMBER,
                              ESTIMATION_N, seed=SEED)


# --- D2 --------------------------------------------------------------------
@register("customers_with_n", osql.with_complete(COHORT_CTES[0], body="SELECT * FROM cohort1"))
def q_customers_with_n(spark: SparkSession, sf: str) -> DataFrame:
    return agg.keys_with_count(wide(spark, sf), COHORT_N)


# --- D13 -------------------------------------------------------------------
@register("dedupe_purchases", osql.with_complete(body=f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY customer_unique_id, order_id, product_id
                               ORDER BY {T}) AS rn FROM r_complete)
WHERE rn = 1"""))
def q_dedupe_purchases(spark: SparkSession, sf: str) -> DataFrame:
    return agg.first_per_subset(wide(spark, sf), ["customer_unique_id", "order_id",
                                                  "product_id"], TOTAL_ORDER_COLUMNS)


# --- E4 --------------------------------------------------------------------
@register("n_purchase_cohort", osql.with_complete(*COHORT_CTES[:4],
                                                  body="SELECT * FROM cohort_rows"))
def q_n_purchase_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return seq.cohort_rows(wide(spark, sf), COHORT_N)


# --- E4 with unit = order (S2: the notebook counts orders) -------------------
ORDER_COHORT_N = 10


@register("n_order_cohort", osql.with_complete(body=f"""
SELECT * FROM r_complete WHERE customer_unique_id IN (
  SELECT customer_unique_id FROM r_complete WHERE customer_unique_id IS NOT NULL
  GROUP BY customer_unique_id HAVING count(DISTINCT order_id) = {ORDER_COHORT_N})"""))
def q_n_order_cohort(spark: SparkSession, sf: str) -> DataFrame:
    return seq.cohort_rows(wide(spark, sf), ORDER_COHORT_N, unit="order")


# --- E1 / E2 ---------------------------------------------------------------
@register("next_purchase", osql.with_complete(*COHORT_CTES[:5], body="""
SELECT customer_unique_id, review_score, product_category_name, next_product_category
FROM firsts"""))
def q_next_purchase(spark: SparkSession, sf: str) -> DataFrame:
    return seq.training_rows(wide(spark, sf), COHORT_N, seq.EXPLORATION_SPEC)


# --- I4 --------------------------------------------------------------------
@register("products_in_category", osql.with_complete(body="""
SELECT DISTINCT product_category_name, product_id FROM r_complete
WHERE product_category_name IS NOT NULL"""))
def q_products_in_category(spark: SparkSession, sf: str) -> DataFrame:
    d = wide(spark, sf)
    return d.where(F.col("product_category_name").isNotNull()).select(
        "product_category_name", "product_id").distinct()


# --- I5 --------------------------------------------------------------------
@register("same_purchase", osql.with_complete(body="""
SELECT * FROM r_complete WHERE product_id IN (
  SELECT product_id FROM (
    SELECT cp.product_category_name, cp.product_id,
           row_number() OVER (PARTITION BY cp.product_category_name
                              ORDER BY s.review_score DESC NULLS LAST, cp.product_id) AS rank
    FROM (SELECT DISTINCT product_category_name, product_id FROM r_complete
          WHERE product_category_name IS NOT NULL AND product_id IS NOT NULL) cp
    JOIN (SELECT product_id, avg(review_score) AS review_score FROM r_complete
          WHERE product_id IS NOT NULL GROUP BY product_id) s
      ON cp.product_id = s.product_id)
  WHERE rank <= 5)"""))
def q_same_purchase(spark: SparkSession, sf: str) -> DataFrame:
    d = wide(spark, sf)
    keys = category_top_products(d, 5).select("product_id")
    return d.join(keys, "product_id", "left_semi")


# --- D5 / D6 over the cohort's purchases ------------------------------------
@register("estimate_price", osql.with_complete(*COHORT_CTES[:4], body=f"""
SELECT product_id,
       avg({osql.amount_sql("price")}) AS estimated_price,
       avg({osql.amount_sql("freight_value")}) AS shipping_price
FROM r_complete WHERE customer_unique_id IN (SELECT customer_unique_id FROM cohort2)
GROUP BY product_id"""))
def q_estimate_price(spark: SparkSession, sf: str) -> DataFrame:
    d = wide(spark, sf)
    rows = d.join(seq.cohort_customers(d, COHORT_N), "customer_unique_id", "left_semi")
    return agg.purchase_estimates(rows, ["product_id"]).select(
        "product_id", "estimated_price", "shipping_price")


@register("estimate_shipping", osql.with_complete(*COHORT_CTES[:4], body="""
SELECT product_id,
       CAST(floor(avg(date_diff('second', order_purchase_timestamp,
                                order_delivered_customer_date)) / 86400) AS BIGINT)
         AS estimated_delivery_time
FROM r_complete WHERE customer_unique_id IN (SELECT customer_unique_id FROM cohort2)
GROUP BY product_id"""))
def q_estimate_shipping(spark: SparkSession, sf: str) -> DataFrame:
    d = wide(spark, sf)
    rows = d.join(seq.cohort_customers(d, COHORT_N), "customer_unique_id", "left_semi")
    return agg.purchase_estimates(rows, ["product_id"]).select(
        "product_id", F.col("estimated_delivery_time").cast("bigint"))


# --- F4 / F5 -----------------------------------------------------------------
SAMPLE_KEYS = ("customer_unique_id", "order_id", "order_item_id", "product_id",
               "seller_id", "payment_sequential")


@register("sample_rows", osql.with_complete(body=f"""
SELECT * FROM r_complete
ORDER BY md5(concat_ws(':', '{SEED}', {", ".join(f"CAST({k} AS VARCHAR)" for k in SAMPLE_KEYS)})),
         {", ".join(f"{k} ASC NULLS LAST" for k in SAMPLE_KEYS)}, {T}
LIMIT {SAMPLE_SIZE}"""))
def q_sample_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = wide(spark, sf)
    return sample_rows(d, list(SAMPLE_KEYS), SAMPLE_SIZE, SEED, tie_break=total_order())


@register("sample_products", osql.with_complete(body=f"""
SELECT product_category_name, product_id, review_score FROM (
  SELECT *, row_number() OVER (
    PARTITION BY product_category_name
    ORDER BY md5(concat_ws(':', '{SEED}', product_category_name, CAST(product_id AS VARCHAR))),
             product_id) AS sample_rank
  FROM (
    SELECT cp.product_category_name, cp.product_id, s.review_score,
           row_number() OVER (PARTITION BY cp.product_category_name
                              ORDER BY s.review_score DESC NULLS LAST, cp.product_id) AS rank
    FROM (SELECT DISTINCT product_category_name, product_id FROM r_complete
          WHERE product_category_name IS NOT NULL AND product_id IS NOT NULL) cp
    JOIN (SELECT product_id, avg(review_score) AS review_score FROM r_complete
          WHERE product_id IS NOT NULL GROUP BY product_id) s
      ON cp.product_id = s.product_id)
  WHERE rank <= {ESTIMATION_N})
WHERE sample_rank <= {PRODUCT_NUMBER}"""))
def q_sample_products(spark: SparkSession, sf: str) -> DataFrame:
    top = category_top_products(wide(spark, sf), ESTIMATION_N)
    return sample_per_group(top, ["product_category_name"], ["product_id"],
                            PRODUCT_NUMBER, SEED).select(
        "product_category_name", "product_id", "review_score")


# --- F6 ----------------------------------------------------------------------
@register("closest_customers", osql.with_complete(*COHORT_CTES, *DRAWN_CTES, *NEAR_CTES,
                                                  body="""
SELECT u AS customer_unique_id, product_id, c AS nearest_customer FROM chosen"""))
def q_closest_customers(spark: SparkSession, sf: str) -> DataFrame:
    d = wide(spark, sf)
    pairs = drawn_pairs(d).select(rec.CUSTOMER, rec.PRODUCT, "pred_lat", "pred_lng")
    return rec.nearest_customers(pairs, d, ESTIMATION_N).select(
        rec.CUSTOMER, rec.PRODUCT, F.col("_c").alias("nearest_customer"))


# --- I7 ----------------------------------------------------------------------
@register("expected_values", osql.with_complete(*COHORT_CTES, *DRAWN_CTES, *NEAR_CTES,
                                                body=f"""
SELECT u AS customer_unique_id, product_id,
       estimated_price, shipping_price, estimated_delivery_time FROM est"""))
def q_expected_values(spark: SparkSession, sf: str) -> DataFrame:
    d = wide(spark, sf)
    pairs = drawn_pairs(d).select(rec.CUSTOMER, rec.PRODUCT, "pred_lat", "pred_lng")
    return rec.expected_values(pairs, d, ESTIMATION_N)


# --- I8 ----------------------------------------------------------------------
RECOMMEND_SQL = osql.with_complete(*COHORT_CTES, *DRAWN_CTES, *NEAR_CTES, body=f"""
SELECT dw.u AS customer_unique_id, p.cat AS predicted_category, dw.product_id,
       dw.review_score, e.estimated_price, e.shipping_price,
       e.estimated_delivery_time, n.n_available
FROM drawn dw JOIN preds p ON p.u = dw.u JOIN navail n ON n.u = dw.u
LEFT JOIN est e ON e.u = dw.u AND e.product_id = dw.product_id""")


@register("recommend", RECOMMEND_SQL)
def q_recommend(spark: SparkSession, sf: str) -> DataFrame:
    d = wide(spark, sf)
    return rec.recommend(d, cohort_predictions(d), PRODUCT_NUMBER, ESTIMATION_N, seed=SEED)


# --- I10 / G8 ----------------------------------------------------------------
REPORT_ESTIMATION_N = 1000  # the print path estimates from 1000 rows (S7)


def _line(label: str, value: str) -> str:
    return f"printf('%-35s%15s', '{label}', {value})"


# Columns of the sampled row that the verbose report lists here: numbers and texts
# that both engines print alike.
DETAILS = ("order_id", "order_item_id", "product_id", "seller_id", "payment_sequential",
           "product_category_name", "customer_id", "customer_unique_id")


def report_sql(details: tuple[str, ...] = ()) -> str:
    """The report's lines; with ``details`` a block of them before the first banner."""
    verbose = "" if not details else f"'', '{rec.DETAILS_TITLE}', " + "".join(
        _line(c, f"coalesce(CAST(f.{c} AS VARCHAR), 'nan')") + ", " for c in details)
    first = len(rec.HEADER_LABELS) + 2 + (len(details) + 2 if details else 0)
    return osql.with_complete(
        *COHORT_CTES, *drawn_ctes(REPORT_ESTIMATION_N, PRODUCT_NUMBER),
        *near_ctes(REPORT_ESTIMATION_N), f"""
rows_first AS (
  SELECT * FROM (
    SELECT *, row_number() OVER w AS rn, lead(product_category_name) OVER w AS next_product_category
    FROM cohort_rows WINDOW w AS (PARTITION BY customer_unique_id ORDER BY {T}))
  WHERE rn = 1)""", """
np AS (SELECT u, count(*) AS n FROM drawn GROUP BY u)""", f"""
head AS (
  SELECT f.customer_unique_id, coalesce(np.n, 0) AS n, [
    {_line(rec.HEADER_LABELS[0], "substring(CAST(f.customer_unique_id AS VARCHAR), 1, 5)")},
    {_line(rec.HEADER_LABELS[1], "coalesce(f.product_category_name, 'nan')")},
    {_line(rec.HEADER_LABELS[2], "coalesce(f.next_product_category, 'nan')")},
    {verbose}'', format('{{:#^50}}', '{rec.BANNER_TITLE}')] AS lines
  FROM rows_first f LEFT JOIN np ON np.u = f.customer_unique_id)""", f"""
prod AS (
  SELECT dw.u AS customer_unique_id, dw.dr, [
    {_line(rec.PRODUCT_LABELS[0], "substring(CAST(dw.product_id AS VARCHAR), 1, 5)")},
    {_line(rec.PRODUCT_LABELS[1], "coalesce(printf('%.2f', e.estimated_price), 'nan') || ' + ' "
           "|| coalesce(printf('%.2f', e.shipping_price), 'nan') || 'R$'")},
    {_line(rec.PRODUCT_LABELS[2], "coalesce(CAST(e.estimated_delivery_time AS VARCHAR), 'nan')"
           " || ' days'")},
    {_line(rec.PRODUCT_LABELS[3], "coalesce(printf('%.2f', dw.review_score), 'nan')")}] AS lines
  FROM drawn dw LEFT JOIN est e ON e.u = dw.u AND e.product_id = dw.product_id)""",
        body=f"""
SELECT customer_unique_id, CAST(k - 1 AS INTEGER) AS line_no, lines[k] AS line
FROM head, range(1, {first + 1}) t(k)
UNION ALL
SELECT customer_unique_id, CAST({first} + 4 * (dr - 1) + k - 1 AS INTEGER) AS line_no,
       lines[k] AS line
FROM prod, range(1, 5) t(k)
UNION ALL
SELECT customer_unique_id, CAST({first} + 4 * n + k - 1 AS INTEGER) AS line_no,
       CASE WHEN k = 1 THEN repeat('#', 50) ELSE '' END AS line
FROM head, range(1, 4) t(k)""")


def _report(spark: SparkSession, sf: str, details: tuple[str, ...] = ()) -> DataFrame:
    d = wide(spark, sf)
    more = tuple(c for c in details if c not in (rec.CUSTOMER, rec.CATEGORY))
    first = stored(seq.next_purchase(seq.cohort_rows(d, COHORT_N), seq.EXPLORATION_SPEC,
                                     extra=(rec.LAT, rec.LNG, *more)), "report-customers")
    preds = first.select(rec.CUSTOMER,
                         F.col("next_product_category").alias("predicted_category"),
                         F.col(rec.LAT).alias("pred_lat"), F.col(rec.LNG).alias("pred_lng"))
    recs = rec.recommend(d, preds, PRODUCT_NUMBER, REPORT_ESTIMATION_N, seed=SEED,
                         keep_rank=True)
    customers = first.select(rec.CUSTOMER,
                             F.col("product_category_name").alias("previous_category"),
                             F.col("next_product_category").alias("predicted_category"),
                             *([F.struct(*details).alias("details")] if details else []))
    return rec.report_lines(recs, customers, verbose=bool(details))


@register("report_lines", report_sql())
def q_report_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf)


@register("report_lines_verbose", report_sql(DETAILS))
def q_report_lines_verbose(spark: SparkSession, sf: str) -> DataFrame:
    """The report with a line for each column of the customer's row."""
    return _report(spark, sf, DETAILS)
