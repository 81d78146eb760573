"""Sort, top-n and sampling.

Top-n per group is ``row_number() <= n``, which Spark plans as a
``WindowGroupLimit`` before and after the shuffle: every task keeps only
its n best rows per group, so a hot group never ships more than n rows
per task.  Sampling is a deterministic pseudo-random order: md5 of a seed
and the row key, so repeated runs and the SQL oracle agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_SEED = 42
# Spark plans a group limit for ranks up to this (its default threshold).
GROUP_LIMIT = 1000
SALTS = 32


def top_n_per_group(data: DataFrame, group: Sequence[str], order: Sequence[Column],
                    n: int, rank_col: str = "rank") -> DataFrame:
    """F3/F6 building block: the first ``n`` rows per group in ``order``."""
    w = Window.partitionBy(*group).orderBy(*order)
    return data.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def top_within(data: DataFrame, group: Sequence[str], order: Sequence[Column],
               n: int | Column, salt_on: Sequence[str], out: str = "rank") -> DataFrame:
    """The first ``n`` rows per group in ``order``, for any depth.

    Up to the engine's own limit (GROUP_LIMIT) a plain rank is planned with a
    ``WindowGroupLimit``.  For a deeper or a per-group depth the rows are cut
    in SALTS parts of each group first, dealt by a hash of ``salt_on``: a hot
    group sorts in as many tasks, and SALTS * n of its rows at most meet in
    the last step.
    """
    if isinstance(n, int) and n <= GROUP_LIMIT:
        return top_n_per_group(data, group, order, n, out)
    salted = data.withColumn("__salt", F.pmod(F.xxhash64(*salt_on), F.lit(SALTS)))
    part = Window.partitionBy(*group, "__salt").orderBy(*order)
    some = (salted.withColumn("__part", F.row_number().over(part))
            .where(F.col("__part") <= n).drop("__salt", "__part"))
    return (some.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
            .where(F.col(out) <= n))


def sample_key(seed: int | str, *keys: Column) -> Column:
    """md5 of ``seed:key1:key2...``; the same text in DuckDB."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def sample_per_group(data: DataFrame, group: Sequence[str], keys: Sequence[str], k: int,
                     seed: int | str = DEFAULT_SEED, rank_col: str = "sample_rank"
                     ) -> DataFrame:
    """``k`` rows per group without replacement, in md5(seed, key)
    order; a group with fewer rows keeps what it has (S9)."""
    order = [sample_key(seed, *[F.col(g) for g in group], *[F.col(x) for x in keys]),
             *[F.col(x).asc_nulls_last() for x in keys]]
    return top_n_per_group(data, group, order, k, rank_col)


# Hex digits of the digest by which rows are counted, first coarsely, then within
# the bucket that the k-th row falls in: 16 ** 3 counts each time.
COARSE, FINE = 3, 6


def _reaching(counts: DataFrame, k: Column) -> Column:
    """(bucket, rows before it) of the first bucket with which ``k`` rows are reached,
    NULL if there are fewer rows.  ``counts`` has 16 ** COARSE rows at most."""
    so_far = F.sum("n").over(Window.orderBy("b").rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    reached = counts.withColumn("_to", so_far).where(F.col("_to") >= k)
    return reached.agg(F.min(F.struct(F.col("b"), (F.col("_to") - F.col("n")).alias("before")))
                       .alias("r")).select("r").scalar()


def up_to_kth_digest(data: DataFrame, digest: Column, k: int) -> DataFrame:
    """The rows of ``data`` whose digest (hex text, evenly spread) can be among the
    ``k`` least: about ``k`` and those of one bucket of 16 ** 6, however many tasks
    read them.  All rows if there are no more than ``k``."""
    bucket = lambda n: F.substring(digest, 1, n)
    counted = lambda d, n: d.groupBy(bucket(n).alias("b")).agg(
        F.count(F.lit(1)).alias("n"))
    coarse = _reaching(counted(data, COARSE), F.lit(k))
    fine = _reaching(counted(data.where(bucket(COARSE) == coarse["b"]), FINE),
                     F.lit(k) - coarse["before"])
    return data.where(F.coalesce(bucket(FINE) <= fine["b"], F.lit(True)))


def sample_rows(data: DataFrame, keys: Sequence[str], k: int,
                seed: int | str = DEFAULT_SEED,
                tie_break: Sequence[Column] = ()) -> DataFrame:
    """F4/F5 on a whole table: ``k`` rows without replacement, the first in md5 order,
    then by ``keys`` and ``tie_break``.

    Counts of digest buckets give the bucket in which the k-th row falls; only rows
    up to it are sorted, so not ``k`` rows of every task meet but about ``k`` in all
    (and rows whose keys equal the k-th row's, which share its digest)."""
    digest = sample_key(seed, *[F.col(x) for x in keys])
    order = [digest, *[F.col(x).asc_nulls_last() for x in keys], *tie_break]
    return up_to_kth_digest(data, digest, k).orderBy(*order).limit(k)
