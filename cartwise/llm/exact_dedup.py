"""Exact dedup by content sort.

Texts are equal when they are identical after deleting blanks, tabs and line
ends.  Sampled splitters range-partition the normalised texts, an external
sort puts equal ones next to each other, and full comparisons of neighbours
(the window's partition boundary) find the runs.

The splitters hold only a 48-character prefix, a hash and a salt, so the
driver never sees whole texts; the salt (from the id) spreads the copies of a
hot text over many ranges.  Runs of one text in several ranges are then put
together by digest: at most ``salts`` rows a text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WHITE = r"[\x20\x09-\x0D]+"
PREFIX_CHARS = 48


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                salts: int = 256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the one with the most code points before normalisation
    stays, then the smallest id (a null id counts as the smallest).  A null
    text counts as empty; all empty or white texts are one group.  Rows that
    repeat id and text are members of the group each, and one of them is
    kept.  Other columns of ``df`` are not read.  An empty table gives an
    empty result.
    """
    return _grouped(df, id_col, text_col, salts).drop("run_n")


def _grouped(df: DataFrame, id_col: str, text_col: str, salts: int = 256) -> DataFrame:
    """``exact_dedup`` with the code points of the best row of a row's run, which of
    a kept row are its own."""
    spark = df.sparkSession
    text = F.coalesce(F.col("t"), F.lit(""))
    rows = (df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
            .select("doc_id", F.char_length(text).cast("long").alias("n"),
                    F.regexp_replace(text, WHITE, "").alias("norm"))
            .select("doc_id", "n", "norm",
                    F.substring("norm", 1, PREFIX_CHARS).alias("prefix"),
                    F.xxhash64("norm").alias("h"),
                    F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int").alias("salt")))
    # the window's partition columns contain the range columns: no second shuffle
    run = Window.partitionBy("prefix", "h", "salt", "norm")
    best_first = run.orderBy(F.col("n").desc(), F.col("doc_id").asc_nulls_first())
    runs = (rows.repartitionByRange("prefix", "h", "salt")
            .select("doc_id", "n", "salt", "norm",
                    F.row_number().over(best_first).alias("rn"),
                    F.first("doc_id").over(best_first).alias("run_id"),
                    F.first("n").over(best_first).alias("run_n"),
                    F.count(F.lit(1)).over(run).alias("run_size"))
            .select("doc_id", "salt", "rn", "run_id", "run_n", "run_size",
                    F.unhex(F.sha2("norm", 256)).alias("sha")))
    runs = written(spark, runs, "content-runs")
    groups = (runs.filter("rn = 1")
              .groupBy("sha")
              .agg(F.min(F.struct((-F.col("run_n")).alias("m"),
                                  F.col("run_id").alias("id"),
                                  F.col("salt").alias("s"))).alias("best"),
                   F.sum("run_size").alias("group_size"),
                   F.collect_list("salt").alias("salt_list"))
              .select("sha", "best", "group_size", F.explode("salt_list").alias("salt")))
    return (runs.join(groups, ["sha", "salt"])
            .select("doc_id", F.col("best.id").alias("keep_id"), "group_size",
                    ((F.col("rn") == 1) & (F.col("salt") == F.col("best.s"))).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256"), "run_n"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns, whatever their names: of
    equal texts the longest before normalisation, then the smallest id, then any."""
    kept = (_grouped(df, id_col, text_col).filter("kept")
            .select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("sha"), "run_n"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    # the row as a struct beside what is compared: no name can clash
    tagged = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"),
                       F.sha2(F.regexp_replace(text, WHITE, ""), 256).alias("sha"),
                       F.char_length(text).cast("long").alias("run_n"))
    same = (tagged["id"].eqNullSafe(kept["id"]) & (tagged["sha"] == kept["sha"])
            & (tagged["run_n"] == kept["run_n"]))
    return (tagged.join(kept, same, "left_semi").dropDuplicates(["id", "sha"])
            .select("row.*"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
