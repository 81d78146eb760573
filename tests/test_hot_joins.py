"""Full outer joins whose hot keys, NULL among them, are cut in parts."""
from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cartwise.operators import joins


def random_side(r, name, n, keys):
    """Hot values, missing parts, orphans, and rows that are equal."""
    row = lambda i: (*[r.choice([1, 1, 1, 2, 3, None, name, 40 + r.randrange(30)])
                       if r.random() < 0.8 else 1 for _ in range(keys)], r.randrange(n // 2))
    return [tuple(str(x) if x is not None else None for x in row(i)[:-1]) + (row(i)[-1],)
            for i in range(n)]


def plain(left, right, keys, null_safe):
    """All pairs in Python."""
    same = lambda a, b: all(x == y and (null_safe or x is not None)
                            for x, y in zip(a[:keys], b[:keys]))
    out, met = [], set()
    for a in left:
        hits = [j for j, b in enumerate(right) if same(a, b)]
        met |= set(hits)
        out += [(*a, right[j][-1]) for j in hits] or [(*a, None)]
    out += [(*b[:keys], None, b[-1]) for j, b in enumerate(right) if j not in met]
    return out


known = lambda rows: sorted(map(str, map(tuple, rows)))


@pytest.mark.parametrize("null_safe", [False, True])
@pytest.mark.parametrize("keys", [1, 2])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cut_join_equals_all_pairs(spark, null_safe, keys, seed):
    r = random.Random(seed)
    left, right = random_side(r, "a", 120, keys), random_side(r, "b", 50, keys)
    if seed == 3:
        right = [x for x in right if x[0] != "1"]           # hot on one side only
    names = [f"k{i}" for i in range(keys)]
    kind = ", ".join(f"{k} string" for k in names)
    a = spark.createDataFrame(left, f"{kind}, x long")
    b = spark.createDataFrame(right, f"{kind}, y long")
    want = known(plain(left, right, keys, null_safe))
    for hot_rows in (5, 30, None):
        out = joins.full_outer(a, b, names, null_safe, hot_rows)
        assert out.columns == [*names, "x", "y"]
        assert known(out.collect()) == want
    assert known(joins.natural_full_outer(a, b, null_safe, 5).collect()) == want
    none = joins.full_outer(a, b.limit(0), names, null_safe, 5)
    assert none.where("y IS NULL").count() == none.count() == len(left)


def spread(df):
    """Rows of each task."""
    rows = df.groupBy(F.spark_partition_id()).count().collect()
    return sorted((r["count"] for r in rows), reverse=True)


@pytest.mark.parametrize("null_safe,key", [(False, "7"), (True, None)])
def test_a_hot_key_spreads_over_all_tasks(spark, as_planned, null_safe, key):
    """A million left rows and some right rows of one key (or of NULL, which meets
    NULL): no task gets much more than its share, and nothing is lost or doubled."""
    n = 1_000_000
    left = spark.range(n).select(F.lit(key).cast("string").alias("k"), F.col("id").alias("x"))
    left = left.unionByName(spark.range(1000).select(F.concat(F.lit("l"), "id").alias("k"),
                                                     (-F.col("id")).alias("x")))
    right = spark.range(5).select(F.lit(key).cast("string").alias("k"), F.col("id").alias("y"))
    right = right.unionByName(spark.range(1000).select(
        F.concat(F.when(F.col("id") < 500, "l").otherwise("r"), "id").alias("k"),
        F.col("id").alias("y")))
    out = joins.full_outer(left, right, "k", null_safe, hot_rows=20_000).persist()
    try:
        got = out.agg(F.count("*"), F.count_if(F.col("x").isNull()),
                      F.count_if(F.col("y").isNull()), F.sum("y")).first()
        assert got[0] == 5 * n + 1000 + 500 and got[1] == 500 and got[2] == 500
        assert out.where(F.col("k").eqNullSafe(F.lit(key))).select("x", "y").distinct().count() == 5 * n
        tasks = spread(out)
        assert len(tasks) == 8 and tasks[0] < 2 * sum(tasks) / 8
    finally:
        out.unpersist()


@pytest.fixture
def as_planned(spark):
    """Small partitions aren't merged."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, before)


def test_null_keys_of_one_side_only(spark, as_planned):
    """10**5 NULL keys on one side: they match nothing and spread."""
    left = spark.range(100_000).select(F.when(F.col("id") < 0, F.col("id")).alias("k"),
                                       F.col("id").alias("x"))
    right = spark.range(10).select(F.col("id").alias("k"), F.col("id").alias("y"))
    for null_safe in (False, True):
        out = joins.full_outer(left, right, "k", null_safe, hot_rows=2000)
        assert out.count() == 100_010 and out.where("x IS NOT NULL AND y IS NOT NULL").count() == 0
        assert spread(out)[0] < 25_000


def test_few_rows_make_no_parts(spark):
    a = spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("x"))
    text = joins.full_outer(a, a.withColumnRenamed("x", "y"), "k")._jdf.queryExecution().toString()
    assert "explode" not in text.lower() and "BroadcastNestedLoopJoin" not in text
