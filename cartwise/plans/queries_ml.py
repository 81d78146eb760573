"""Registered queries: feature encoding and models.

The encoder queries use the exploratory column set (score; category -> next
category), whose inputs are all SQL-derivable; ``training_table_full`` has the
pipeline's whole set with a fixed centre table.  A fitted model's numbers have
no SQL text; its queries return what any right fit must satisfy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.ml import features as fe
from cartwise.ml import models as ml
from cartwise.operators import aggregates as agg
from cartwise.operators import sequences as seq
from cartwise.plans import oracle_sql as osql
from cartwise.plans import pipeline as pl
from cartwise.plans.catalog import register
from cartwise.plans.prepare import complete_data, prepared
from cartwise.plans.queries_core import tables, wide
from cartwise.plans.queries_flow import COHORT_CTES, COHORT_N, SEED

SPEC = seq.EXPLORATION_SPEC
CU = "customer_unique_id"
SCALE_DECIMALS = 9


def ml_train(spark: SparkSession, sf: str) -> DataFrame:
    """The exploratory training table (written once: fits and encoders read it again)."""
    return prepared(spark, f"exploration_table_{COHORT_N}", sf,
                    lambda: seq.training_rows(wide(spark, sf), COHORT_N, SPEC))


def fitted(spark: SparkSession, sf: str):
    train = ml_train(spark, sf)
    f, lab = fe.fit_encoders(train, SPEC)
    return train, f, lab


ENC_CTES = (*COHORT_CTES[:5], """
stats AS (SELECT avg(review_score) AS m, stddev_pop(review_score) AS s FROM firsts)""", """
cats AS (
  SELECT c, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS slot FROM (
    SELECT DISTINCT coalesce(product_category_name, '__null__') AS c FROM firsts))""", """
labs AS (
  SELECT c, CAST(dense_rank() OVER (ORDER BY c) - 1 AS INTEGER) AS label FROM (
    SELECT DISTINCT coalesce(next_product_category, '__null__') AS c FROM firsts))""", f"""
enc AS (
  SELECT f.customer_unique_id,
         round((f.review_score - st.m) / coalesce(nullif(st.s, 0), 1), {SCALE_DECIMALS})
           AS review_score_scaled,
         ca.slot AS category_slot, lb.label
  FROM firsts f CROSS JOIN stats st
  LEFT JOIN cats ca ON ca.c = coalesce(f.product_category_name, '__null__')
  LEFT JOIN labs lb ON lb.c = coalesce(f.next_product_category, '__null__'))""", """
dense AS (
  SELECT e.customer_unique_id, CAST(s.slot AS INTEGER) AS slot,
         CASE WHEN s.slot = 0 THEN e.review_score_scaled
              WHEN s.slot - 1 = e.category_slot THEN 1.0 ELSE 0.0 END AS value
  FROM enc e CROSS JOIN (SELECT range AS slot FROM range(0, (SELECT count(*) + 1 FROM cats))) s)""")


def _round(c: str) -> F.Column:
    return F.round(F.col(c), SCALE_DECIMALS)


# --- H1 ----------------------------------------------------------------------
@register("standard_scale", osql.with_complete(*ENC_CTES[:6], body=f"""
SELECT customer_unique_id,
       round((review_score - m) / coalesce(nullif(s, 0), 1), {SCALE_DECIMALS})
         AS review_score_scaled
FROM firsts CROSS JOIN stats"""))
def q_standard_scale(spark: SparkSession, sf: str) -> DataFrame:
    train = ml_train(spark, sf)
    scaler = fe.fit_population_scaler(train, ["review_score"])
    return scaler.transform(train).select(CU, _round("review_score_scaled")
                                          .alias("review_score_scaled"))


# --- H2 ----------------------------------------------------------------------
@register("one_hot", osql.with_complete(*ENC_CTES[:9], body="""
SELECT customer_unique_id, category_slot AS slot FROM enc WHERE category_slot IS NOT NULL"""))
def q_one_hot(spark: SparkSession, sf: str) -> DataFrame:
    train, f, _ = fitted(spark, sf)
    from pyspark.ml.functions import vector_to_array

    col = f"product_category_name{fe.ONE_HOT}"
    out = f.transform(train).select(
        CU, F.posexplode(vector_to_array(col)).alias("slot", "value"))
    return out.where(F.col("value") != 0).select(CU, F.col("slot").cast("int"))


# --- H3 ----------------------------------------------------------------------
@register("label_encode", osql.with_complete(*ENC_CTES[:9],
                                             body="SELECT customer_unique_id, label FROM enc"))
def q_label_encode(spark: SparkSession, sf: str) -> DataFrame:
    train, f, lab = fitted(spark, sf)
    return lab.transform(train).select(CU, F.col(fe.LABEL).cast("int"))


# --- H5 / H6 -----------------------------------------------------------------
@register("assemble_features", osql.with_complete(*ENC_CTES, body="SELECT * FROM dense"))
def q_assemble_features(spark: SparkSession, sf: str) -> DataFrame:
    train, f, _ = fitted(spark, sf)
    long = fe.slots(f.transform(train), [CU])
    return long.select(CU, F.col("slot").cast("int"), _round("value").alias("value"))


# --- I1: feature matrix with the label in the last column --------------------
@register("training_table", osql.with_complete(*ENC_CTES, body="""
SELECT * FROM dense
UNION ALL
SELECT customer_unique_id, CAST((SELECT count(*) + 1 FROM cats) AS INTEGER) AS slot,
       CAST(label AS DOUBLE) AS value FROM enc"""))
def q_training_table(spark: SparkSession, sf: str) -> DataFrame:
    train, f, lab = fitted(spark, sf)
    enc = fe.encode(train, f, lab)
    size = fe.vector_size(f, SPEC)
    feats = fe.slots(enc, [CU]).select(CU, F.col("slot").cast("int"),
                                       _round("value").alias("value"))
    labels = enc.select(CU, F.lit(size).alias("slot"), F.col(fe.LABEL).alias("value"))
    return feats.unionByName(labels)


# --- I2 ----------------------------------------------------------------------
@register("unlabeled_features", osql.with_complete(*ENC_CTES[:9], body=f"""
SELECT d.customer_unique_id, d.order_id, d.order_item_id, d.product_id, d.seller_id,
       d.payment_sequential,
       round((d.review_score - st.m) / coalesce(nullif(st.s, 0), 1), {SCALE_DECIMALS})
         AS review_score_scaled,
       ca.slot AS category_slot
FROM r_complete d CROSS JOIN stats st
LEFT JOIN cats ca ON ca.c = coalesce(d.product_category_name, '__null__')"""))
def q_unlabeled_features(spark: SparkSession, sf: str) -> DataFrame:
    _, f, _ = fitted(spark, sf)
    d = wide(spark, sf)
    out = f.transform(d)
    idx = f"product_category_name{fe.INDEX}"
    n_seen = len(f.stages[2].labels)
    return out.select(CU, "order_id", "order_item_id", "product_id", "seller_id",
                      "payment_sequential", _round("review_score_scaled")
                      .alias("review_score_scaled"),
                      F.when(F.col(idx) < n_seen, F.col(idx).cast("int"))
                      .alias("category_slot"))


# --- H10 ---------------------------------------------------------------------
@register("stratified_folds", osql.with_complete(*ENC_CTES[:9], body=f"""
SELECT customer_unique_id, label,
       CAST((off + rn - 1) % {ml.CV_FOLDS} AS INTEGER) AS fold
FROM (SELECT customer_unique_id, label,
             row_number() OVER (PARTITION BY label ORDER BY
               md5(concat_ws(':', '{ml.CV_SEED}', '0', CAST(customer_unique_id AS VARCHAR))),
               customer_unique_id) AS rn
      FROM enc) r
JOIN (SELECT label, coalesce(sum(size) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING
                                             AND 1 PRECEDING), 0) AS off
      FROM (SELECT label, count(*) AS size FROM enc GROUP BY label)) o USING (label)"""))
def q_stratified_folds(spark: SparkSession, sf: str) -> DataFrame:
    train, f, lab = fitted(spark, sf)
    enc = lab.transform(train).withColumn(fe.LABEL, F.col(fe.LABEL).cast("int"))
    return ml.stratified_folds(enc.select(CU, fe.LABEL), CU).select(CU, fe.LABEL, "fold")


# --- H13 ---------------------------------------------------------------------
@register("accuracy", osql.with_complete(*COHORT_CTES[:5], body="""
SELECT avg(CASE WHEN product_category_name IS NOT DISTINCT FROM next_product_category
           THEN 1.0 ELSE 0.0 END) AS accuracy FROM firsts"""))
def q_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy of the 'same category again' prediction on the cohort."""
    train = ml_train(spark, sf)
    return ml.accuracy(train, "product_category_name", "next_product_category")


# --- H7b ---------------------------------------------------------------------
# The centres are a fixed table of k rows: the means of the k lowest zips.
FIXED_CENTRES_CTE = f"""
centres AS (
  SELECT row_number() OVER (ORDER BY geolocation_zip_code_prefix) - 1 AS cluster,
         geolocation_lat, geolocation_lng
  FROM r_geo_avg ORDER BY geolocation_zip_code_prefix LIMIT {ml.KMEANS_K})"""


def fixed_centres(spark: SparkSession, sf: str) -> list[tuple[float, float]]:
    """The k rows of the fixed centre table, in cluster order."""
    zips = agg.geo_average(tables(spark, sf)["geolocation"])
    return [(r["geolocation_lat"], r["geolocation_lng"]) for r in
            zips.orderBy("geolocation_zip_code_prefix").limit(ml.KMEANS_K).collect()]


@register("assign_cluster", osql.with_ctes(osql.GEO_AVG_CTE, FIXED_CENTRES_CTE, body="""
SELECT vec_id, CAST(cluster AS INTEGER) AS location_cluster FROM (
  SELECT e.vec_id, c.cluster,
         row_number() OVER (PARTITION BY e.vec_id ORDER BY
           (CAST(e.embedding[1] AS DOUBLE) - c.geolocation_lat)
             * (CAST(e.embedding[1] AS DOUBLE) - c.geolocation_lat)
           + (CAST(e.embedding[2] AS DOUBLE) - c.geolocation_lng)
             * (CAST(e.embedding[2] AS DOUBLE) - c.geolocation_lng),
           c.cluster) AS r
  FROM embeddings e CROSS JOIN centres c)
WHERE r = 1"""))
def q_assign_cluster(spark: SparkSession, sf: str) -> DataFrame:
    """Every raw geolocation point to the nearest of k centres."""
    coords = ("geolocation_lat", "geolocation_lng")
    emb = spark.read.parquet(f"{sf.rstrip('/')}/embeddings.parquet").select(
        "vec_id", F.col("embedding")[0].cast("double").alias("geolocation_lat"),
        F.col("embedding")[1].cast("double").alias("geolocation_lng"))
    return ml.assign_nearest(emb, fixed_centres(spark, sf), coords, "location_cluster").select(
        "vec_id", "location_cluster")


# --- H7a: what a fitted clustering must satisfy ------------------------------
@register("geo_clusters", osql.with_ctes(osql.GEO_AVG_CTE, body="""
SELECT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng, true AS nearest
FROM r_geo_avg"""))
def q_geo_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Every zip belongs to the cluster whose members' mean is nearest: the
    fixed point that k-means ends at."""
    coords = ("geolocation_lat", "geolocation_lng")
    zips = pl.zip_clusters(spark, tables(spark, sf))
    means = zips.groupBy("location_cluster").agg(*[F.avg(c).alias(c) for c in coords])
    centres = [tuple(r[c] for c in coords) for r in
               means.orderBy("location_cluster").collect()]        # the k clusters
    return ml.assign_nearest(zips, centres, coords, "_near").select(
        "geolocation_zip_code_prefix", *coords,
        (F.col("_near") == F.col("location_cluster")).alias("nearest"))


@register("raw_geo_clusters", osql.with_ctes(body="""
SELECT vec_id, true AS nearest FROM embeddings"""))
def q_raw_geo_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """k-means on the raw points instead of the zips' means: every point belongs to the
    cluster whose members' mean is nearest."""
    coords = ("lat", "lng")
    points = spark.read.parquet(f"{sf.rstrip('/')}/embeddings.parquet").select(
        "vec_id", F.col("embedding")[0].cast("double").alias("lat"),
        F.col("embedding")[1].cast("double").alias("lng"))
    own = ml.assign_nearest(points, ml.fit_kmeans(points, coords), coords, "_cluster")
    means = own.groupBy("_cluster").agg(*[F.avg(c).alias(c) for c in coords])
    centres = [(r["lat"], r["lng"]) for r in means.orderBy("_cluster").collect()]  # k rows
    return ml.assign_nearest(own, centres, coords, "_near").select(
        "vec_id", (F.col("_near") == F.col("_cluster")).alias("nearest"))


# --- C7, I1, I2 with a fixed centre table -----------------------------------
CLUSTERS_CTE = """
zip_clusters AS (
  SELECT geolocation_zip_code_prefix, geolocation_lat, geolocation_lng,
         CAST(cluster AS INTEGER) AS location_cluster FROM (
    SELECT g.*, c.cluster, row_number() OVER (
      PARTITION BY g.geolocation_zip_code_prefix ORDER BY
        (g.geolocation_lat - c.geolocation_lat) * (g.geolocation_lat - c.geolocation_lat)
        + (g.geolocation_lng - c.geolocation_lng) * (g.geolocation_lng - c.geolocation_lng),
        c.cluster) AS r
    FROM r_geo_avg g CROSS JOIN centres c)
  WHERE r = 1)"""


def fixed_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """The zip table with the cluster of the nearest fixed centre."""
    return ml.assign_nearest(agg.geo_average(tables(spark, sf)["geolocation"]),
                             fixed_centres(spark, sf), ("geolocation_lat", "geolocation_lng"),
                             "location_cluster")


@register("join_location", osql.with_ctes(osql.GEO_AVG_CTE, FIXED_CENTRES_CTE, CLUSTERS_CTE,
                                          body="""
SELECT c.customer_id, c.customer_unique_id, c.customer_zip_code_prefix,
       z.geolocation_lat AS customer_geolocation_lat,
       z.geolocation_lng AS customer_geolocation_lng,
       z.location_cluster AS customer_location_cluster
FROM r_customers c
LEFT JOIN zip_clusters z ON z.geolocation_zip_code_prefix = c.customer_zip_code_prefix"""))
def q_join_location(spark: SparkSession, sf: str) -> DataFrame:
    return pl.join_location(tables(spark, sf)["customers"], fixed_clusters(spark, sf),
                            "customer_zip_code_prefix", "customer")


def wide_with_fixed_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(spark, "complete_data_fixed", sf,
                    lambda: complete_data(tables(spark, sf), fixed_clusters(spark, sf)))


FULL_ROWS_CTES = (FIXED_CENTRES_CTE, CLUSTERS_CTE, """
placed AS (
  SELECT d.*, zc.location_cluster AS customer_location_cluster,
         zs.location_cluster AS seller_location_cluster
  FROM r_complete d
  LEFT JOIN zip_clusters zc ON zc.geolocation_zip_code_prefix = d.customer_zip_code_prefix
  LEFT JOIN zip_clusters zs ON zs.geolocation_zip_code_prefix = d.seller_zip_code_prefix)""")


@register("training_table_full", osql.with_complete(
    *FULL_ROWS_CTES, COHORT_CTES[0], COHORT_CTES[1].replace("FROM r_complete", "FROM placed"),
    *COHORT_CTES[2:4], f"""
full_firsts AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT customer_unique_id, review_score, customer_location_cluster,
           seller_location_cluster, product_category_name, row_number() OVER w AS rn,
           lead(product_category_name) OVER w AS next_product_category
    FROM cohort_rows
    WINDOW w AS (PARTITION BY customer_unique_id ORDER BY {osql.TOTAL_ORDER_SQL}))
  WHERE rn = 1)""", body="SELECT * FROM full_firsts"))
def q_training_table_full(spark: SparkSession, sf: str) -> DataFrame:
    """I1 with the pipeline's whole column set."""
    return seq.training_rows(wide_with_fixed_clusters(spark, sf), COHORT_N, seq.PIPELINE_SPEC)


@register("left_out_rows", osql.with_complete(body="""
SELECT count(*) AS n_rows,
       count(*) FILTER (WHERE customer_unique_id IS NULL) AS n_unknown_customer,
       count(*) FILTER (WHERE customer_unique_id IS NOT NULL AND review_score IS NULL)
         AS n_missing_numeric
FROM r_complete"""))
def q_left_out_rows(spark: SparkSession, sf: str) -> DataFrame:
    """How many rows no prediction can be made for."""
    return pl.left_out_rows(wide(spark, sf), seq.PIPELINE_SPEC)


# --- H8: what a fitted classifier must satisfy -------------------------------
USABLE_LABELS_CTE = """
usable AS (SELECT * FROM firsts WHERE review_score IS NOT NULL)"""
GRADIENT_TOLERANCE = 1e-3


@register("train_classifier", osql.with_complete(*COHORT_CTES[:5], USABLE_LABELS_CTE, body="""
SELECT category, CAST(row_number() OVER (ORDER BY category) - 1 AS INTEGER) AS class,
       true AS at_optimum
FROM (SELECT DISTINCT coalesce(next_product_category, '__null__') AS category FROM usable)"""))
def q_train_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Per class: the gradient of the regularised mean loss vanishes."""
    return pl.gradient_norms(spark, pl.model_artifacts(spark, sf)).select(
        "category", "class", (F.col("gradient_norm") < GRADIENT_TOLERANCE).alias("at_optimum"))


# --- H11 ---------------------------------------------------------------------
@register("cv_scores", osql.with_complete(*COHORT_CTES[:5], USABLE_LABELS_CTE, body=f"""
SELECT c.inverse_reg, 0 AS repeat, CAST(f.fold AS INTEGER) AS fold,
       (n.n // {ml.CV_FOLDS}) + CASE WHEN f.fold < n.n % {ml.CV_FOLDS} THEN 1 ELSE 0 END
         AS n_test, true AS scored
FROM (SELECT unnest([{", ".join(f"CAST({c!r} AS DOUBLE)" for c in ml.INVERSE_REG_GRID)}])
        AS inverse_reg) c,
     (SELECT unnest(range({ml.CV_FOLDS})) AS fold) f,
     (SELECT count(*) AS n FROM usable) n"""))
def q_cv_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Rows tested per (C, repeat, fold); the accuracy is a share, or missing
    where no row was tested."""
    art = pl.model_artifacts(spark, sf)
    return ml.cross_validate(art.train_encoded, CU).select(
        "inverse_reg", "repeat", "fold", "n_test",
        F.when(F.col("n_test") > 0, F.coalesce(F.col("accuracy").between(0, 1), F.lit(False)))
        .otherwise(F.col("accuracy").isNull()).alias("scored"))


@register("cv_baseline", osql.with_complete(*COHORT_CTES[:5], USABLE_LABELS_CTE, """
labelled AS (
  SELECT customer_unique_id,
         dense_rank() OVER (ORDER BY coalesce(next_product_category, '__null__')) - 1 AS label
  FROM usable)""", f"""
folded AS (
  SELECT label, CAST((off + rn - 1) % {ml.CV_FOLDS} AS INTEGER) AS fold
  FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY
                 md5(concat_ws(':', '{ml.CV_SEED}', '0', CAST(customer_unique_id AS VARCHAR))),
                 customer_unique_id) AS rn
        FROM labelled) r
  JOIN (SELECT label, coalesce(sum(size) OVER (ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING
                                               AND 1 PRECEDING), 0) AS off
        FROM (SELECT label, count(*) AS size FROM labelled GROUP BY label)) o USING (label))""",
                                            """
majority AS (
  SELECT fold, label FROM (
    SELECT f.fold, l.label,
           row_number() OVER (PARTITION BY f.fold ORDER BY count(*) DESC, l.label) AS rn
    FROM (SELECT DISTINCT fold FROM folded) f JOIN folded l ON l.fold <> f.fold
    GROUP BY f.fold, l.label)
  WHERE rn = 1)""", body="""
SELECT 0 AS repeat, t.fold, count(*) AS n_test,
       avg(CASE WHEN t.label = m.label THEN 1.0 ELSE 0.0 END) AS accuracy
FROM folded t JOIN majority m ON m.fold = t.fold GROUP BY t.fold"""))
def q_cv_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy per fold of the most frequent category of the other folds: what the
    classifier's has to be seen against, by the same cross-validation."""
    art = pl.model_artifacts(spark, sf)
    out = ml.cross_validate(art.train_encoded, CU, grid=(1.0,), fit=ml.train_majority)
    return out.where("n_test > 0").select("repeat", "fold", "n_test", "accuracy")


# --- I6 / H9 / H4 ------------------------------------------------------------
SAMPLE = 5


@register("predict_category", osql.with_complete(body=f"""
SELECT customer_unique_id, order_id, product_id,
       CAST(row_number() OVER (ORDER BY {{key}}) AS INTEGER) AS sample_pos, true AS most_likely
FROM r_complete WHERE customer_unique_id IS NOT NULL AND review_score IS NOT NULL
ORDER BY {{key}} LIMIT {SAMPLE}""".format(key=(
    f"md5(concat_ws(':', '{SEED}', "
    + ", ".join(f"CAST({k} AS VARCHAR)" for k in pl.ROW_KEYS) + ")), "
    + ", ".join(f"{k} ASC NULLS LAST" for k in pl.ROW_KEYS)))))
def q_predict_category(spark: SparkSession, sf: str) -> DataFrame:
    """The sampled rows; the decoded category is the class of the highest
    linear score, computed from the coefficients."""
    art = pl.model_artifacts(spark, sf)
    return pl.check_predictions(spark, art, SAMPLE, SEED).select(
        "customer_unique_id", "order_id", "product_id", "sample_pos", "most_likely")


# --- I9 ----------------------------------------------------------------------
@register("recommend_batch")
def q_recommend_batch(spark: SparkSession, sf: str) -> DataFrame:
    art = pl.model_artifacts(spark, sf)
    return pl.recommend_sample(art, sample_size=2, product_number=3, estimation_n=5,
                               seed=SEED)


BATCH = 2


@register("recommend_batch_check", osql.with_complete(body=f"""
SELECT customer_unique_id, CAST(max(sample_pos) AS INTEGER) AS sample_pos, true AS as_single
FROM (SELECT customer_unique_id, row_number() OVER (ORDER BY {{key}}) AS sample_pos
      FROM r_complete WHERE customer_unique_id IS NOT NULL AND review_score IS NOT NULL
      ORDER BY {{key}} LIMIT {BATCH})
GROUP BY customer_unique_id""".format(key=(
    f"md5(concat_ws(':', '{SEED}', "
    + ", ".join(f"CAST({k} AS VARCHAR)" for k in pl.ROW_KEYS) + ")), "
    + ", ".join(f"{k} ASC NULLS LAST" for k in pl.ROW_KEYS)))))
def q_recommend_batch_check(spark: SparkSession, sf: str) -> DataFrame:
    """The customers of the batch, each with its last sampled row; whether the batch
    gave it what ``recommend`` gives it alone, for the category of the highest linear
    score."""
    art = pl.model_artifacts(spark, sf)
    return pl.check_batch(spark, art, BATCH, product_number=3, estimation_n=5, seed=SEED)


# --- A5 ----------------------------------------------------------------------
@register("model_roundtrip", osql.with_complete(*COHORT_CTES[:5], USABLE_LABELS_CTE, body="""
SELECT customer_unique_id, true AS same FROM usable"""))
def q_model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Saved and loaded models predict as the ones in memory do."""
    art = pl.model_artifacts(spark, sf)
    path = pl.save_models(spark, art, sf)
    return pl.roundtrip_predictions(spark, art, path).select("customer_unique_id", "same")
