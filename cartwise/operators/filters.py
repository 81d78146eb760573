"""Projections, filters and predicates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename by mapping; other columns unchanged."""
    return df.withColumnsRenamed(mapping)


def equals(df: DataFrame, column: str, value) -> DataFrame:
    """Rows where ``column == value``; NULL never equals."""
    return df.where(F.col(column) == F.lit(value))


def greater_than(df: DataFrame, column: str, value) -> DataFrame:
    """Rows where ``column > value``."""
    return df.where(F.col(column) > F.lit(value))


def exclude_keys(df: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """B7 in set form: drop the rows whose ``column`` equals one of ``keys``;
    rows with a NULL ``column`` are kept, and a NULL key removes nothing
    (anti join: NULL never matches)."""
    k = keys.select(F.col(column).alias("_k")).where(F.col("_k").isNotNull()).distinct()
    return df.join(k, df[column] == k["_k"], "left_anti")


def keep_keys(df: DataFrame, keys: DataFrame, column: str, null_matches: bool = True
              ) -> DataFrame:
    """Membership filter (semi join); like ``isin``, a NULL key in the
    list matches rows with a NULL value.  The key list is an aggregate, so
    the planner broadcasts it when small."""
    k = keys.select(F.col(column).alias("_k")).distinct()
    cond = df[column].eqNullSafe(k["_k"]) if null_matches else df[column] == k["_k"]
    return df.join(k, cond, "left_semi")


def fill_unknown(df: DataFrame, columns: Sequence[str], value: str = "unknown") -> DataFrame:
    """Replace NULL by a constant."""
    return df.fillna(value, subset=list(columns))
