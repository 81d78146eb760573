"""Models on ``pyspark.ml``.

* H7a k-means, several seeds, the lowest training cost wins; clusters are
  renumbered by (lat, lng) of their centre so ids are stable (S17).
* H7b nearest-centre assignment for the k centres of a model.
* H8 multinomial logistic regression, L2 with strength ``C`` as in the
  reference: sklearn minimises ``C * sum(loss) + |w|^2 / 2`` while Spark
  minimises ``mean(loss) + regParam * |w|^2 / 2``, so ``regParam = 1/(C n)``
  with ``n`` the training rows of that fit (S13).
* H10 stratified folds: per class, rows in md5(seed:repeat:key) order are
  dealt round-robin, continuing where the previous class stopped, so folds
  differ in size by at most one and every class is spread evenly.
* H11 grid of C x folds; fits run as concurrent Spark jobs.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartwise.ml.features import FEATURES, LABEL

# Fixed values from the reference configuration: folds, repeats, seed and
# the inverse regularisation strengths of the grid; k-means clusters.
CV_FOLDS = 5
CV_REPEATS = 1
CV_SEED = 42
INVERSE_REG_GRID = (1.0, 1e-1, 1e-2, 1e-3, 1e-4, 1e-5)
KMEANS_K = 5
KMEANS_STARTS = 10
ROWS_PER_FIT_PARTITION = 250_000
# hex digits of a digest that name a bucket: 4096 buckets a class
BUCKET_DIGITS = 3


def _dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt to as many partitions as its rows need in an iterative fit;
    a shuffle, so that the stage before it keeps its own parallelism."""
    return df.repartition(max(1, -(-rows // ROWS_PER_FIT_PARTITION)))


# --- H7 ----------------------------------------------------------------------
def fit_kmeans(points: DataFrame, coords: Sequence[str], k: int = KMEANS_K,
               starts: int = KMEANS_STARTS, seed: int = CV_SEED, max_iter: int = 300):
    """Best of ``starts`` k-means runs (k-means|| init, distinct seeds).
    Returns the centres sorted by coordinates as a list of tuples."""
    vec = VectorAssembler(inputCols=list(coords), outputCol="_xy").transform(
        points.where(" AND ".join(f"`{c}` IS NOT NULL" for c in coords)))
    vec = vec.select("_xy")
    vec = _dealt(vec, vec.count()).persist()

    def fit(i):
        model = KMeans(k=k, seed=seed + i, maxIter=max_iter, featuresCol="_xy",
                       tol=1e-9).fit(vec)
        return model.summary.trainingCost, i, model

    try:
        # independent starts run as concurrent Spark jobs
        with ThreadPoolExecutor(max_workers=min(starts, 8)) as pool:
            results = list(pool.map(fit, range(starts)))
    finally:
        vec.unpersist()
    best = min(results, key=lambda r: (r[0], r[1]))
    return sorted(tuple(float(x) for x in c) for c in best[2].clusterCenters())


def assign_nearest(points: DataFrame, centres: Sequence[tuple[float, ...]],
                   coords: Sequence[str], out: str) -> DataFrame:
    """Id of the nearest centre (squared Euclidean; ties to the lower
    id); NULL coordinates give NULL.  ``centres`` are the k centres of a
    model, inlined as literals -- no join."""
    cands = []
    for i, c in enumerate(centres):
        d = None
        for col, v in zip(coords, c):
            term = (F.col(col) - F.lit(float(v))) * (F.col(col) - F.lit(float(v)))
            d = term if d is None else d + term
        cands.append(F.struct(d.alias("d"), F.lit(i).alias("id")))
    best = F.array_min(F.array(*cands))
    any_null = None
    for col in coords:
        n = F.col(col).isNull()
        any_null = n if any_null is None else any_null | n
    return points.withColumn(out, F.when(~any_null, best["id"]))


def cluster_zips(zips: DataFrame, coords=("geolocation_lat", "geolocation_lng"),
                 k: int = KMEANS_K, starts: int = KMEANS_STARTS, seed: int = CV_SEED
                 ) -> DataFrame:
    """H7a + H7b on the zip table: adds ``location_cluster``."""
    centres = fit_kmeans(zips, coords, k, starts, seed)
    return assign_nearest(zips, centres, coords, "location_cluster")


# --- H10 ---------------------------------------------------------------------
def _bucketed(df: DataFrame, group: str, digest: Column, digits: int) -> DataFrame:
    """Adds ``_g`` (the group as a struct, so that NULL equals NULL in joins),
    ``_h`` (the hex digest) and ``_b`` (its first ``digits`` digits)."""
    return (df.withColumn("_g", F.struct(F.col(group).alias("g"))).withColumn("_h", digest)
            .withColumn("_b", F.substring("_h", 1, digits)))


def _bucket_shifts(x: DataFrame) -> DataFrame:
    """(_g, _b, _shift, _size): rows of the group in lower buckets, and in all.
    At most 16 ** digits rows a group."""
    counts = x.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = (Window.partitionBy("_g").orderBy("_b")
              .rowsBetween(Window.unboundedPreceding, -1))
    return counts.select("_g", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0))
                         .alias("_shift"), "_n")


def rank_by_digest(df: DataFrame, group: str, digest: Column, ties: Sequence = (),
                   out: str = "_rn", digits: int = BUCKET_DIGITS) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY digest, ties)`` without
    putting a whole group in one task.

    A digest's first hex digits are evenly spread and in the digest's own
    order: rows are ranked inside (group, bucket) and shifted by the group's
    rows in lower buckets.  The bucket is a function of the row, so the result
    is the same for any number of digits, partitions or attempts.  A NULL
    group is a group.  The wide rows are shuffled once.
    """
    x = _bucketed(df, group, digest, digits)
    local = Window.partitionBy("_g", "_b").orderBy("_h", *ties)
    ranked = x.withColumn("_lrn", F.row_number().over(local))
    return (ranked.join(_bucket_shifts(x).drop("_n"), ["_g", "_b"])
            .withColumn(out, F.col("_shift") + F.col("_lrn"))
            .drop("_g", "_b", "_h", "_lrn", "_shift"))


def stratified_folds(df: DataFrame, key: str, label: str = LABEL, k: int = CV_FOLDS,
                     seed: int = CV_SEED, repeat: int = 0, out: str = "fold",
                     digits: int = BUCKET_DIGITS) -> DataFrame:
    """Fold number in 0..k-1, stratified by ``label`` (NULL is a class).

    The rank and the rows of lower classes come from one table of counts by
    (class, digest bucket); the rows themselves are shuffled once.
    """
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(repeat)),
                               F.col(key).cast("string")))
    x = _bucketed(df, label, digest, digits)
    shifts = _bucket_shifts(x)
    sizes = shifts.groupBy("_g").agg(F.sum("_n").alias("_size"))
    # one row a class
    offsets = sizes.select("_g", F.coalesce(F.sum("_size").over(
        Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("_offset"))
    start = (shifts.join(offsets, "_g")
             .select("_g", "_b", (F.col("_shift") + F.col("_offset")).alias("_start")))
    local = Window.partitionBy("_g", "_b").orderBy("_h", key)
    return (x.withColumn("_lrn", F.row_number().over(local)).join(start, ["_g", "_b"])
            .withColumn(out, ((F.col("_start") + F.col("_lrn") - 1) % k).cast("int"))
            .drop("_g", "_b", "_h", "_lrn", "_start"))


# --- H8 / H9 / H13 -----------------------------------------------------------
def train_classifier(train: DataFrame, inverse_reg: float = 1.0, max_iter: int = 100,
                     n_rows: int | None = None, tol: float = 1e-4) -> LogisticRegressionModel:
    """H8: multinomial logistic regression with sklearn's ``C`` (and its
    default iteration limit and tolerance)."""
    n = n_rows if n_rows is not None else train.count()
    lr = LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, family="multinomial",
                            regParam=1.0 / (inverse_reg * max(n, 1)), elasticNetParam=0.0,
                            standardization=False, maxIter=max_iter, fitIntercept=True,
                            tol=tol)
    return lr.fit(train)


def accuracy(pred: DataFrame, prediction: str = "prediction", label: str = LABEL
             ) -> DataFrame:
    """Share of rows whose prediction equals the label."""
    hit = F.when(F.col(prediction).eqNullSafe(F.col(label)), 1.0).otherwise(0.0)
    return pred.agg(F.avg(hit).alias("accuracy"))


@dataclass(frozen=True)
class MajorityModel:
    """The same label for every row: the yardstick of an accuracy."""

    label: float | None

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.label).cast("double"))


def train_majority(train: DataFrame, inverse_reg: float = 1.0, n_rows: int | None = None
                   ) -> MajorityModel:
    """The most frequent label (ties: the smallest); the arguments after the table are
    those of ``train_classifier`` and have no effect."""
    row = (train.groupBy(LABEL).agg(F.count(F.lit(1)).alias("_n"))
           .orderBy(F.col("_n").desc(), F.col(LABEL).asc_nulls_last()).first())
    return MajorityModel(None if row is None else row[LABEL])


def cross_validate(train: DataFrame, key: str, grid: Sequence[float] = INVERSE_REG_GRID,
                   k: int = CV_FOLDS, repeats: int = CV_REPEATS, seed: int = CV_SEED,
                   parallelism: int | None = None, fit=None) -> DataFrame:
    """Test rows and accuracy per (C, repeat, fold).  The training table is
    persisted once; the fits are independent Spark jobs run concurrently.  ``fit`` is
    what trains on the other folds (``train_classifier``; ``train_majority`` gives
    the share of right answers without any feature)."""
    fit = fit or train_classifier
    spark = train.sparkSession
    folded = None
    for r in range(repeats):
        f = stratified_folds(train, key, k=k, seed=seed, repeat=r).withColumn(
            "repeat", F.lit(r))
        folded = f if folded is None else folded.unionByName(f)
    folded = folded.select(key, FEATURES, LABEL, "repeat", "fold").persist()
    source = folded
    sizes = {(row["repeat"], row["fold"]): row["n"] for row in
             folded.groupBy("repeat", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {r: sum(n for (rr, _), n in sizes.items() if rr == r) for r in range(repeats)}
    # every L-BFGS iteration is a job over all partitions: as many as the rows need
    folded = _dealt(source, sum(sizes.values())).persist()
    folded.count()
    source.unpersist()

    def run(task):
        c, r, fold = task
        tr = folded.where((F.col("repeat") == r) & (F.col("fold") != fold))
        te = folded.where((F.col("repeat") == r) & (F.col("fold") == fold))
        model = fit(tr, c, n_rows=total[r] - sizes.get((r, fold), 0))
        acc = accuracy(model.transform(te)).first()["accuracy"]
        return (float(c), r, fold, int(sizes.get((r, fold), 0)),
                float(acc) if acc is not None else None)

    tasks = [(c, r, f) for c in grid for r in range(repeats) for f in range(k)]
    if parallelism is None:  # fits are mostly scheduling-bound: overlap them
        parallelism = min(len(tasks), max(4, 2 * spark.sparkContext.defaultParallelism))
    try:
        with ThreadPoolExecutor(max_workers=parallelism) as pool:
            rows = list(pool.map(run, tasks))
    finally:
        folded.unpersist()
    return spark.createDataFrame(rows, "inverse_reg double, repeat int, fold int, "
                                       "n_test long, accuracy double")
