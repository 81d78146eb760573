"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

MOST_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): label is the smallest node of the node's component, for
    every node that an edge names.  Null ends are left out.

    Each round hooks every label to its smallest neighbour, follows the hooks
    twice, and keeps the edges between labels that still differ.  Rounds write
    their tables to the shared folder; nothing is collected but a row count.
    A hub's edges are pre-aggregated, and its joins can be split by the engine.
    """
    spark = edges.sparkSession
    pair = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).dropna()
    live = written(spark, pair.filter("x <> y").select(
        F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), "edges")
    labels = None
    for _ in range(MOST_ROUNDS):
        if live.isEmpty():
            break
        hook = first = written(spark, live.groupBy("x").agg(F.min("y").alias("y")), "hooks")
        for _ in range(2):
            on = hook.select(F.col("x").alias("y"), F.col("y").alias("z"))
            hook = hook.join(on, "y", "left").select("x", F.coalesce("z", "y").alias("y"))
        hook = written(spark, hook, "hooks")
        if labels is None:
            nodes = live.select("x").union(live.select("y")).distinct()
            labels = nodes.select(F.col("x").alias("node"), F.col("x").alias("label"))
        old = labels, live, first, hook
        labels = written(spark, _follow(labels, "label", hook), "labels")
        moved = _follow(_follow(live, "x", hook), "y", hook).filter("x <> y")
        live = written(spark, moved.select(F.greatest("x", "y").alias("x"),
                                           F.least("x", "y").alias("y")).distinct(), "edges")
        discard(spark, *old)
    else:
        raise RuntimeError(f"components need more than {MOST_ROUNDS} rounds")
    if labels is None:
        return live.select(F.col("x").alias("node"), F.col("y").alias("label"))
    return labels


def _follow(df: DataFrame, col: str, hook: DataFrame) -> DataFrame:
    to = hook.select(F.col("x").alias(col), F.col("y").alias("__to"))
    return (df.join(to, col, "left").withColumn(col, F.coalesce("__to", col))
            .select(*df.columns))
