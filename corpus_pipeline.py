"""The corpus pipeline: documents in, token ids of the documents that stay out.

Each stage works on all rows that the one before it kept.  It is expressed in
Spark, not SQL: two of its stages fit models, so there is no oracle text; the
tests hold every stage against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cartwise.llm import decontam, exact_dedup, jaccard_join, piece_fst, quality
from cartwise.llm.common import discard, made, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier doesn't reject."""
    return quality.keep_good(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that chains of near copies connect."""
    return jaccard_join.keep_one(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what stays, and whether they decode to the text."""
    return piece_fst.encode_texts(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("exact_dedup", exact_copies),
    ("jaccard_join", near_copies),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece", piece_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = made()
        out = stage(spark, docs, sf_dir)
        inside = [p for p in made() if p not in before]
        done = written(spark, out, f"stage-{name}")
        discard(spark, docs, *inside)       # the written stage needs them no more
        docs = done
    return docs


ORACLE_SQL = None
