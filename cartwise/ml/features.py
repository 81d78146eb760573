"""Feature encoding as a ``pyspark.ml`` pipeline.

* H1 standardises numeric columns with the *population* standard deviation
  (``ml.feature.StandardScaler`` uses the sample one).  Fitting is one
  aggregate that returns two numbers per column; the fitted scaler is a
  ``SQLTransformer`` with those numbers in its statement, so it is saved and
  loaded with the rest of the ``PipelineModel``.  A zero deviation divides
  by one; NULL stays NULL.
* H2 one-hot: NULL becomes the category ``__null__``; ``StringIndexer``
  sorts categories (``alphabetAsc``) and keeps an extra slot for unseen
  ones, which ``OneHotEncoder(dropLast=True)`` drops, so an unseen category
  encodes as all zeros and every seen one keeps its slot.
* H3 label encoding: ``StringIndexer`` in sorted order, fitted on all rows
  before any fold split.
* H5 ``VectorAssembler``: numeric part first, then the one-hot blocks.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartwise.operators.sequences import FeatureSpec

# The category that stands for a missing value, and the
# column-name suffixes of the encoded columns.
NULL_CATEGORY = "__null__"
SCALED = "_scaled"
TEXT = "_text"
INDEX = "_index"
ONE_HOT = "_onehot"
FEATURES = "features"
LABEL = "label"


def fit_population_scaler(data: DataFrame, columns: list[str]) -> SQLTransformer:
    """H1 fit: mean and population std per column, as a SQL stage."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    row = data.agg(*aggs).first()
    exprs = []
    for c in columns:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        m = 0.0 if m is None else float(m)
        s = 1.0 if (s is None or s == 0.0) else float(s)
        exprs.append(f"(CAST(`{c}` AS DOUBLE) - ({m!r})) / ({s!r}) AS `{c}{SCALED}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")


def category_text(columns: list[str]) -> SQLTransformer:
    """NULL -> ``__null__``, everything cast to text (cluster ids are numbers)."""
    exprs = [f"coalesce(CAST(`{c}` AS STRING), '{NULL_CATEGORY}') AS `{c}{TEXT}`"
             for c in columns]
    return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")


def encoder_stages(spec: FeatureSpec) -> list:
    """The unfitted H2/H5 stages for ``spec`` (scaler is fitted separately)."""
    cats = list(spec.categorical)
    stages = [category_text(cats)] if cats else []
    for c in cats:
        stages.append(StringIndexer(inputCol=f"{c}{TEXT}", outputCol=f"{c}{INDEX}",
                                    stringOrderType="alphabetAsc", handleInvalid="keep"))
    if cats:
        stages.append(OneHotEncoder(inputCols=[f"{c}{INDEX}" for c in cats],
                                    outputCols=[f"{c}{ONE_HOT}" for c in cats],
                                    dropLast=True))
    stages.append(VectorAssembler(
        inputCols=[f"{c}{SCALED}" for c in spec.numerical] + [f"{c}{ONE_HOT}" for c in cats],
        outputCol=FEATURES, handleInvalid="keep"))
    return stages


def label_stages(spec: FeatureSpec) -> list:
    t = spec.target[0]
    return [category_text([t]),
            StringIndexer(inputCol=f"{t}{TEXT}", outputCol=LABEL,
                          stringOrderType="alphabetAsc")]


def fit_encoders(train: DataFrame, spec: FeatureSpec) -> tuple[PipelineModel, PipelineModel]:
    """H6: fit the feature encoders and the label encoder on the training
    table.  Returns (features model, label model)."""
    stages = encoder_stages(spec)
    if spec.numerical:
        stages = [fit_population_scaler(train, list(spec.numerical)), *stages]
    features = Pipeline(stages=stages).fit(train)
    labels = Pipeline(stages=label_stages(spec)).fit(train)
    return features, labels


def vector_size(features: PipelineModel, spec: FeatureSpec) -> int:
    """Length of the assembled vector: numeric columns plus one slot per
    category seen in fit."""
    from pyspark.ml.feature import StringIndexerModel

    seen = [len(st.labels) for st in features.stages if isinstance(st, StringIndexerModel)]
    return len(spec.numerical) + sum(seen)


def label_names(labels: PipelineModel) -> list[str]:
    """Class index -> category text (H4 lookup)."""
    return list(labels.stages[-1].labels)


def decode_labels(df: DataFrame, labels: PipelineModel, index_col: str,
                  out_col: str) -> DataFrame:
    """H4: class index -> category (``__null__`` back to NULL)."""
    from pyspark.ml.feature import IndexToString

    conv = IndexToString(inputCol=index_col, outputCol=out_col, labels=label_names(labels))
    out = conv.transform(df)
    return out.withColumn(out_col, F.when(F.col(out_col) != NULL_CATEGORY, F.col(out_col)))


def encode(df: DataFrame, features: PipelineModel, labels: PipelineModel | None = None
           ) -> DataFrame:
    """Apply fitted encoders (and the label encoder when given)."""
    out = features.transform(df)
    return labels.transform(out) if labels is not None else out


def slots(df: DataFrame, keys: list[str], vector: str = FEATURES) -> DataFrame:
    """Vector column in long format (keys..., slot, value) for checking."""
    from pyspark.ml.functions import vector_to_array

    return df.select(*keys, F.posexplode(vector_to_array(vector)).alias("slot", "value"))
