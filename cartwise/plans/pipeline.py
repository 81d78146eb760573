"""The whole engine as three Spark jobs (I11): prepare, model, recommend.

    prepare  : retail tables -> zip clusters -> wide table -> predictor table
               -> fitted encoders; also the features of all unlabelled rows,
               the score per product and the column roles
    model    : cross-validation over the C grid, final fit with C = 1 (S12)
    recommend: sample rows -> encode -> predict the next category -> decode
               -> recommend products -> report lines

Each job reads what the one before it wrote below one output folder (Parquet,
``pyspark.ml`` writers, JSON), so each can run alone in a session of its own.  A job's
outputs appear together, by a manifest written last (``sources.versions``).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartwise.ml import features as fe
from cartwise.ml import models as ml
from cartwise.operators import aggregates as agg
from cartwise.operators import joins
from cartwise.operators import sequences as seq
from cartwise.operators.ranking import sample_key, sample_rows
from cartwise.plans import recommend as rec
from cartwise.plans.prepare import complete_data, prepared
from cartwise.session import scratch_path, stored
from cartwise.sources import versions
from cartwise.sources.files import version
from cartwise.sources.retail_view import retail_tables

CU = "customer_unique_id"
# Rows of the wide table that identify a purchase row for sampling.
ROW_KEYS = ("customer_unique_id", "order_id", "order_item_id", "product_id",
            "seller_id", "payment_sequential")
# With the retail binding a customer has about 40 joined rows: cohort n.
DEFAULT_N_PURCHASE = 37
ROLES = "role string, k int, column string"


def zip_clusters(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
    """H7: zip averages with their k-means cluster (written once)."""
    src = t["geolocation"]
    key = ",".join(src.inputFiles())
    return prepared(spark, "zip_clusters", key,
                    lambda: ml.cluster_zips(agg.geo_average(src)))


def join_location(data: DataFrame, clusters: DataFrame, left_on: str, role: str
                  ) -> DataFrame:
    """Add ``<role>_location_cluster`` (and coordinates) by zip."""
    return joins.join_coordinates(data, clusters, left_on, role,
                                  cluster_column="location_cluster")


def wide_clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide table with coordinates and clusters (written once)."""
    def build():
        t = retail_tables(spark, sf_dir)
        return complete_data(t, zip_clusters(spark, t))
    return prepared(spark, "complete_data_clustered", sf_dir, build)


@dataclass
class Artifacts:
    data: DataFrame
    train: DataFrame
    features: PipelineModel
    labels: PipelineModel
    model: LogisticRegressionModel
    train_encoded: DataFrame
    spec: seq.FeatureSpec


_ARTIFACTS: dict[tuple, Artifacts] = {}


def model_artifacts(spark: SparkSession, sf_dir: str, n: int = DEFAULT_N_PURCHASE,
                    spec: seq.FeatureSpec = seq.PIPELINE_SPEC) -> Artifacts:
    """prepare + model for one data directory (once per application).

    Training rows with a missing numeric feature are left out: the model
    cannot take them (S10)."""
    key = (spark.sparkContext.applicationId, sf_dir, version(spark, sf_dir), n)
    if key in _ARTIFACTS:
        return _ARTIFACTS[key]
    data = wide_clustered(spark, sf_dir)
    train = prepared(spark, f"predictor_table_{n}", sf_dir,
                     lambda: seq.training_rows(data, n, spec))
    usable = usable_training(train, spec)
    features, labels = fe.fit_encoders(usable, spec)
    enc = stored(fe.encode(usable, features, labels).select(CU, fe.FEATURES, fe.LABEL),
                 "classifier_data")
    model = ml.train_classifier(enc, 1.0)
    art = Artifacts(data, usable, features, labels, model, enc, spec)
    _ARTIFACTS[key] = art
    return art


def coefficients(spark: SparkSession, art: Artifacts) -> DataFrame:
    """H8 result as rows: (class, slot, coefficient); slot -1 = intercept."""
    names = fe.label_names(art.labels)
    mat = art.model.coefficientMatrix.toArray()
    icp = art.model.interceptVector.toArray()
    rows = []
    for k in range(mat.shape[0]):
        rows.append((k, names[k], -1, float(icp[k])))
        rows += [(k, names[k], j, float(mat[k, j])) for j in range(mat.shape[1])]
    return spark.createDataFrame(rows, "class int, category string, slot int, "
                                       "coefficient double")


def gradient_norms(spark: SparkSession, art: Artifacts) -> DataFrame:
    """H8 check: (class, category, gradient_norm) of the training objective,
    the mean softmax loss plus the L2 term, at the fitted coefficients."""
    names = fe.label_names(art.labels)
    weights = art.model.coefficientMatrix.toArray()
    reg = 1.0 / art.train_encoded.count()               # C = 1
    scored = art.model.transform(art.train_encoded).select(
        fe.LABEL, vector_to_array(fe.FEATURES).alias("x"),
        vector_to_array("probability").alias("p"))
    per_class = scored.select(fe.LABEL, "x", F.posexplode("p").alias("class", "p"))
    miss = F.col("p") - F.when(F.col(fe.LABEL) == F.col("class"), 1.0).otherwise(0.0)
    slots = per_class.select("class", miss.alias("miss"), F.posexplode("x").alias("slot", "x"))
    loss = slots.groupBy("class", "slot").agg(F.avg(F.col("miss") * F.col("x")).alias("g"))
    table = spark.createDataFrame([(k, names[k], j, float(weights[k, j]))
                                   for k in range(weights.shape[0])
                                   for j in range(weights.shape[1])],
                                  "class int, category string, slot int, w double")
    full = loss.join(table, ["class", "slot"]).withColumn("d", F.col("g") + reg * F.col("w"))
    return full.groupBy("class", "category").agg(
        F.sqrt(F.sum(F.col("d") * F.col("d"))).alias("gradient_norm"))


def likeliest_category(art: Artifacts) -> F.Column:
    """The category of the highest linear score of an encoded row, from the
    coefficients alone."""
    names = fe.label_names(art.labels)
    weights, bias = art.model.coefficientMatrix.toArray(), art.model.interceptVector.toArray()
    x = vector_to_array(fe.FEATURES)
    scores = [F.struct((F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in row]),
                                               lambda a, b: a * b),
                                    F.lit(float(b)), lambda a, v: a + v)).alias("s"),
                       F.lit(-k).alias("k"), F.lit(names[k]).alias("c"))
              for k, (row, b) in enumerate(zip(weights, bias))]
    return F.array_max(F.array(*scores))["c"]


def check_predictions(spark: SparkSession, art: Artifacts, sample_size: int, seed) -> DataFrame:
    """I6 check: the sample with ``most_likely``, whether the predicted category
    is that of the highest linear score."""
    pred = fe.encode(predict_category_sample(art, sample_size, seed), art.features)
    return pred.withColumn("most_likely", likeliest_category(art) == F.coalesce(
        F.col("predicted_category"), F.lit("__null__")))


def check_batch(spark: SparkSession, art: Artifacts, sample_size: int, product_number: int,
                estimation_n: int, seed) -> DataFrame:
    """I9 check: per customer of the batch, ``sample_pos`` of its last sampled row and
    ``as_single``, whether its rows are those of a recommendation for it alone with
    the likeliest category.  ``sample_size`` recommendations are made: keep it small."""
    sample = sample_purchases(usable_rows(art.data, art.spec), sample_size, seed)
    coded = fe.encode(sample, art.features).withColumn("_c", likeliest_category(art))
    category = F.when(F.col("_c") != "__null__", F.col("_c"))
    rows = coded.select(CU, "sample_pos", category.alias("predicted_category"),
                        F.col(rec.LAT).alias("pred_lat"),
                        F.col(rec.LNG).alias("pred_lng")).collect()
    last = {r[CU]: r for r in sorted(rows, key=lambda r: r["sample_pos"])}
    batch = stored(recommend_sample(art, sample_size, product_number, estimation_n, seed),
                   "batch")
    schema = sample.select(CU, "sample_pos").schema
    out = []
    for customer, r in last.items():
        one = spark.createDataFrame([(customer, r["predicted_category"], r["pred_lat"],
                                      r["pred_lng"])],
                                    f"{CU} {schema[CU].dataType.simpleString()}, "
                                    "predicted_category string, pred_lat double, pred_lng double")
        alone = stored(rec.recommend(art.data, one, product_number, estimation_n, seed=seed),
                       "alone")
        mine = batch.where(F.col(CU) == F.lit(customer)).select(*alone.columns)
        differ = mine.exceptAll(alone).count() + alone.exceptAll(mine).count()
        out.append((customer, r["sample_pos"], differ == 0))
    return spark.createDataFrame(out, f"{CU} {schema[CU].dataType.simpleString()}, "
                                      "sample_pos int, as_single boolean")


def usable_training(train: DataFrame, spec: seq.FeatureSpec) -> DataFrame:
    """Training rows without a missing numeric feature."""
    return train.where(" AND ".join(f"`{c}` IS NOT NULL" for c in spec.numerical))


def left_out_rows(data: DataFrame, spec: seq.FeatureSpec) -> DataFrame:
    """Rows that can't be scored: all rows, those of an unknown customer,
    those of a known one with a missing numeric feature."""
    known = F.col(CU).isNotNull()
    missing = F.lit(False)
    for c in spec.numerical:
        missing = missing | F.col(c).isNull()
    return data.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.count(F.when(~known, 1)).alias("n_unknown_customer"),
                    F.count(F.when(known & missing, 1)).alias("n_missing_numeric"))


def usable_rows(data: DataFrame, spec: seq.FeatureSpec) -> DataFrame:
    """Rows the model can score: known customer, no missing numeric."""
    cond = F.col(CU).isNotNull()
    for c in spec.numerical:
        cond = cond & F.col(c).isNotNull()
    return data.where(cond)


def sample_purchases(data: DataFrame, k: int, seed) -> DataFrame:
    """``k`` rows in md5(seed, row key) order, numbered."""
    order = [sample_key(seed, *[F.col(c) for c in ROW_KEYS]),
             *[F.col(c).asc_nulls_last() for c in ROW_KEYS]]
    return sample_rows(data, ROW_KEYS, k, seed).withColumn(
        "sample_pos", F.row_number().over(Window.orderBy(*order)))


def predict_category_sample(art: Artifacts, sample_size: int = 5, seed=42) -> DataFrame:
    """Sample rows, encode them, predict and decode the next category."""
    sample = sample_purchases(usable_rows(art.data, art.spec), sample_size, seed)
    scored = art.model.transform(fe.encode(sample, art.features))
    out = fe.decode_labels(scored, art.labels, "prediction", "predicted_category")
    keep = [c for c in art.data.columns] + ["sample_pos", "predicted_category"]
    return out.select(*keep)


def recommend_sample(art: Artifacts, sample_size: int = 2, product_number: int = 3,
                     estimation_n: int = 5, seed=42) -> DataFrame:
    """Recommendations for a sample; a customer sampled twice keeps the
    prediction of its last sampled row."""
    pred = predict_category_sample(art, sample_size, seed)
    w = Window.partitionBy(CU).orderBy(F.col("sample_pos").desc())
    last = pred.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    preds = last.select(CU, "predicted_category",
                        F.col(rec.LAT).alias("pred_lat"), F.col(rec.LNG).alias("pred_lng"))
    return rec.recommend(art.data, preds, product_number, estimation_n, seed=seed)


def save_models(spark: SparkSession, art: Artifacts, tag: str) -> str:
    """A5: write encoders and classifier with the ``pyspark.ml`` writers."""
    import uuid

    base = scratch_path(spark, f"models-{uuid.uuid4().hex[:12]}")
    art.features.write().overwrite().save(base + "/features")
    art.labels.write().overwrite().save(base + "/labels")
    art.model.write().overwrite().save(base + "/classifier")
    return base


def roundtrip_predictions(spark: SparkSession, art: Artifacts, base: str) -> DataFrame:
    """A5: predictions of the reloaded models next to the original ones."""
    feats = PipelineModel.load(base + "/features")
    model = LogisticRegressionModel.load(base + "/classifier")
    a = art.model.transform(fe.encode(art.train, art.features)).select(
        CU, F.col("prediction").alias("original"))
    b = model.transform(fe.encode(art.train, feats)).select(
        CU, F.col("prediction").alias("reloaded"))
    return a.join(b, CU).withColumn("same", F.col("original") == F.col("reloaded"))


# --- I11: the whole program --------------------------------------------------
def report_for_sample(art: Artifacts, sample_size: int, product_number: int,
                      estimation_n: int = 1000, seed=42, verbose: bool = False) -> DataFrame:
    """I10 on a model prediction: sampled customers, their sampled row's
    category as the previous one, recommendations estimated from
    ``estimation_n`` rows as the print path does (S7).  ``verbose`` adds the
    sampled row's columns."""
    pred = predict_category_sample(art, sample_size, seed)
    w = Window.partitionBy(CU).orderBy(F.col("sample_pos").desc())
    last = pred.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    preds = last.select(CU, "predicted_category",
                        F.col(rec.LAT).alias("pred_lat"), F.col(rec.LNG).alias("pred_lng"))
    recs = rec.recommend(art.data, preds, product_number, estimation_n, seed=seed,
                         keep_rank=True)
    customers = last.select(CU, F.col("product_category_name").alias("previous_category"),
                            "predicted_category",
                            *([F.struct(*art.data.columns).alias("details")] if verbose else []))
    return rec.report_lines(recs, customers, verbose)


def best_inverse_reg(cv: DataFrame) -> float:
    """S12 option: the C with the highest mean fold accuracy (ties: larger C)."""
    row = (cv.groupBy("inverse_reg").agg(F.avg("accuracy").alias("_acc"))
           .orderBy(F.col("_acc").desc_nulls_last(), F.col("inverse_reg").desc()).first())
    return float(row["inverse_reg"])


STEPS = ("prepare", "model", "recommend")


def _put(df: DataFrame, run_dir: str, name: str) -> str:
    path = f"{run_dir}/{name}"
    df.write.parquet(path)
    return path


def _inputs_key(spark: SparkSession, t: dict[str, DataFrame], *settings) -> str:
    """A text that changes with the tables' files and the settings; empty if a table
    isn't read from files."""
    folders = set()
    for df in t.values():
        found = df.inputFiles()
        if not found:
            return ""
        folders |= {f.rsplit("/", 1)[0] for f in found}
    state = ";".join(version(spark, f) for f in sorted(folders))
    return hashlib.sha256(repr((sorted(folders), state, settings)).encode()).hexdigest()


def prepare(spark: SparkSession, t: dict[str, DataFrame], out_dir: str,
            n: int = DEFAULT_N_PURCHASE, spec: seq.FeatureSpec = seq.PIPELINE_SPEC
            ) -> dict[str, str]:
    """Job 1: everything that the later jobs read, from the retail tables.  Returns
    the written paths; with unchanged files and settings those of the run before."""
    key = _inputs_key(spark, t, n, spec)
    done = versions.latest(spark, out_dir, "prepare")
    if done and key and done["key"] == key:
        return done["paths"]
    run = versions.new_run(out_dir)
    out = {}
    out["zip_clusters"] = _put(ml.cluster_zips(agg.geo_average(t["geolocation"])), run,
                               "zip_clusters")
    clusters = spark.read.parquet(out["zip_clusters"])
    out["complete_data"] = _put(complete_data(t, clusters), run, "complete_data")
    data = spark.read.parquet(out["complete_data"])
    out["predictor_table"] = _put(seq.training_rows(data, n, spec), run, "predictor_table")
    usable = usable_training(spark.read.parquet(out["predictor_table"]), spec)
    features, labels = fe.fit_encoders(usable, spec)
    out["encoders"] = f"{run}/encoders"
    features.write().save(out["encoders"] + "/features")
    labels.write().save(out["encoders"] + "/labels")
    encoded = fe.encode(usable, features, labels).select(CU, fe.FEATURES, fe.LABEL)
    out["classifier_data"] = _put(fe.slots(encoded, [CU, fe.LABEL]), run, "classifier_data")
    unlabeled = fe.encode(usable_rows(data, spec), features).select(*ROW_KEYS, fe.FEATURES)
    out["unlabeled_data"] = _put(unlabeled, run, "unlabeled_data")
    out["avg_score_per_product"] = _put(agg.avg_score_per_product(data), run,
                                        "avg_score_per_product")
    roles = [(role, k, c) for role, columns in vars(spec).items() for k, c in enumerate(columns)]
    out["columns"] = f"{run}/columns"
    spark.createDataFrame(roles, ROLES).write.json(out["columns"])
    versions.publish(spark, out_dir, "prepare", run, out, key)
    return out


def _prepared_parts(spark: SparkSession, paths: dict[str, str]):
    """(column roles, feature encoder, label encoder) that ``prepare`` saved."""
    roles: dict[str, tuple[str, ...]] = {"numerical": (), "categorical": (), "target": ()}
    for r in spark.read.schema(ROLES).json(paths["columns"]).orderBy("role", "k").collect():
        roles[r["role"]] += (r["column"],)
    return (seq.FeatureSpec(**roles), PipelineModel.load(paths["encoders"] + "/features"),
            PipelineModel.load(paths["encoders"] + "/labels"))


def model(spark: SparkSession, out_dir: str, select_best: bool = False) -> dict[str, str]:
    """Job 2: cross-validation and the final fit, on what the newest finished
    ``prepare`` wrote.

    The reference reports cross-validation but always trains with C = 1
    (S12); ``select_best=True`` trains with the best C of the grid instead."""
    source = versions.needed(spark, out_dir, "prepare")
    key = f"{source['run']} {select_best}"
    done = versions.latest(spark, out_dir, "model")
    if done and done["key"] == key:
        return done["paths"]
    run = versions.new_run(out_dir)
    spec, features, labels = _prepared_parts(spark, source["paths"])
    usable = usable_training(spark.read.parquet(source["paths"]["predictor_table"]), spec)
    enc = fe.encode(usable, features, labels).select(CU, fe.FEATURES, fe.LABEL).persist()
    try:
        out = {"cv_scores": _put(ml.cross_validate(enc, CU), run, "cv_scores")}
        c = best_inverse_reg(spark.read.parquet(out["cv_scores"])) if select_best else 1.0
        out["classifier"] = f"{run}/classifier"
        ml.train_classifier(enc, c).write().save(out["classifier"])
    finally:
        enc.unpersist()
    # what it was trained on goes with it: a later prepare doesn't change the pair
    versions.publish(spark, out_dir, "model", run, out, key, source["paths"])
    return out


def load_artifacts(spark: SparkSession, out_dir: str) -> Artifacts:
    """The newest finished ``model`` and the ``prepare`` it was trained on, for
    predictions in a new session."""
    trained = versions.needed(spark, out_dir, "model")
    paths = trained["inputs"]
    spec, features, labels = _prepared_parts(spark, paths)
    usable = usable_training(spark.read.parquet(paths["predictor_table"]), spec)
    return Artifacts(spark.read.parquet(paths["complete_data"]), usable, features, labels,
                     LogisticRegressionModel.load(trained["paths"]["classifier"]),
                     fe.encode(usable, features, labels).select(CU, fe.FEATURES, fe.LABEL), spec)


def recommend(spark: SparkSession, out_dir: str, sample_size: int = 5, product_number: int = 5,
              seed=42, verbose: bool = False) -> dict[str, str]:
    """Job 3: the report for a sample, from saved files only."""
    trained = versions.needed(spark, out_dir, "model")
    key = f"{trained['run']} {sample_size} {product_number} {seed!r} {verbose}"
    done = versions.latest(spark, out_dir, "recommend")
    if done and done["key"] == key:
        return done["paths"]
    run = versions.new_run(out_dir)
    art = load_artifacts(spark, out_dir)
    report = report_for_sample(art, sample_size, product_number, seed=seed, verbose=verbose)
    out = {"report": _put(report, run, "report")}
    versions.publish(spark, out_dir, "recommend", run, out, key, trained["paths"])
    return out


def outputs(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """The paths of every step's newest finished run below ``out_dir``."""
    out: dict[str, str] = {}
    for step in STEPS:
        out |= (versions.latest(spark, out_dir, step) or {"paths": {}})["paths"]
    return out


def run(spark: SparkSession, tables: str | dict[str, DataFrame], out_dir: str,
        sample_size: int = 5, product_number: int = 5, n: int = DEFAULT_N_PURCHASE, seed=42,
        select_best: bool = False, verbose: bool = False) -> dict[str, str]:
    """prepare -> model -> recommend below ``out_dir`` (a shared folder on a
    cluster).  ``tables``: the retail tables, or the folder of the driver's
    tables.  Returns the written paths; steps that are done for the same inputs
    and settings are skipped."""
    t = retail_tables(spark, tables) if isinstance(tables, str) else tables
    out = dict(prepare(spark, t, out_dir, n))
    out |= model(spark, out_dir, select_best)
    return out | recommend(spark, out_dir, sample_size, product_number, seed, verbose)
