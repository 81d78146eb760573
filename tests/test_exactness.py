"""Exact means, samples by digest buckets, first rows without a window, and global
positions: against plain Python, whatever the partitions."""
from __future__ import annotations

import hashlib
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from cartwise.functions import scalar as fx
from cartwise.operators import aggregates as agg
from cartwise.operators import ranking
from cartwise.operators.ordering import sorted_positions


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_means_do_not_depend_on_the_order_of_rows(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.choice([None, round(r.uniform(0, 1e6), r.choice([2, 4])), 0.1]),
             r.uniform(-180, 180) if r.random() < 0.9 else None) for _ in range(5000)]
    df = spark.createDataFrame(rows, "g string, price double, lat double")
    got = set()
    for shuffled in (df, df.repartition(7), df.repartition(3, "price"), df.orderBy("lat").coalesce(1),
                     df.orderBy(F.col("price").desc()).repartition(13)):
        out = shuffled.groupBy("g").agg(fx.exact_mean(F.col("price")).alias("p"),
                                        fx.stable_mean(F.col("lat")).alias("l"))
        got.add(tuple(sorted((x.g, x.p.hex(), x.l.hex()) for x in out.collect())))
    assert len(got) == 1
    for g, p, lat in next(iter(got)):
        prices = [Decimal(str(x)) for k, x, _ in rows if k == g and x is not None]
        assert float.fromhex(p) == float(sum(prices) / len(prices))
        lats = [x for k, _, x in rows if k == g and x is not None]
        assert float.fromhex(lat) == pytest.approx(float(sum(map(Decimal, lats)) / len(lats)), abs=1e-13)
    none = df.where("price IS NULL").agg(fx.exact_mean(F.col("price")).alias("p"),
                                         fx.stable_mean(F.col("price")).alias("l")).first()
    assert none.p is None and none.l is None


def test_sample_reads_little_more_than_k(spark):
    n, k = 60_000, 500
    df = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    digest = lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest()
    want = sorted(range(n), key=digest)[:k]
    for d in (df, df.repartition(5)):
        assert [r.k for r in ranking.sample_rows(d, ["k"], k).collect()] == want
    kept = ranking.up_to_kth_digest(df, ranking.sample_key(42, F.col("k")), k).count()
    assert k <= kept <= k + 5
    for some in (0, 1, n, n + 10):
        assert ranking.sample_rows(df, ["k"], some).count() == min(some, n)
    assert ranking.sample_rows(df.limit(0), ["k"], 5).count() == 0


def test_sample_of_rows_with_one_key(spark):
    """A third of the rows share a key (and so a digest): ties are broken by columns."""
    rows = [(1 if i % 3 == 0 else i, i) for i in range(3000)] + [(None, -i) for i in range(1, 40)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(6)
    order = [F.col("v").asc()]
    text = lambda k: "42" if k is None else f"42:{k}"
    want = sorted(rows, key=lambda r: (hashlib.md5(text(r[0]).encode()).hexdigest(),
                                       r[0] is None, r[0] or 0, r[1]))
    for k in (10, 700, 2500):
        got = [tuple(r) for r in ranking.sample_rows(df, ["k"], k, tie_break=order).collect()]
        assert got == want[:k]


def test_first_row_of_hot_groups_without_a_window(spark):
    r = random.Random(3)
    rows = [(r.choice(["h", "h", "h", None, "x", "y"]), r.choice([None, 1, 1, 2]),
             r.choice([None, 1.5, 2.5]), r.choice(["p", "q", None]), [i % 3]) for i in range(4000)]
    df = spark.createDataFrame(rows, "a string, b int, t double, w string, z array<int>")
    out = agg.first_per_subset(df, ["a", "b"], ["t", "w"])
    assert out.columns == df.columns
    last = lambda v: (v is None, v if v is not None else 0)
    text = lambda v: (v is None, v or "")
    want = {}
    for row in rows:
        key = (last(row[2]), text(row[3]), row[4])
        if row[:2] not in want or key < want[row[:2]][0]:
            want[row[:2]] = (key, row)
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(x) for _, x in want.values())
    plan = plan_text(out)
    assert "Window" not in plan and "partial_min" in plan
    same = agg.first_per_subset(df.select("a", "b"), ["a", "b"], ["t"])
    assert same.count() == len(want)


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_positions_of_a_sorted_table(spark, parts):
    r = random.Random(7)
    rows = [(r.choice([None, None, None, 1, 2, r.randrange(100)]), r.choice([None, "a", "b"]), i)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "t int, w string, i int").repartition(5)
    out = sorted_positions(df, ["t", "w", "i"], parts=parts)
    assert out.columns == ["t", "w", "i", "position"]
    got = sorted(out.collect(), key=lambda x: x.position)
    last = lambda v, zero: (v is None, zero if v is None else v)
    want = sorted(rows, key=lambda x: (last(x[0], 0), last(x[1], ""), x[2]))
    assert [tuple(x)[:3] for x in got] == want
    assert [x.position for x in got] == list(range(1, 3001))
    # ties by the row itself: positions are 1..n, each value's rows together
    tied = sorted(sorted_positions(df, ["t"], parts=parts).collect(), key=lambda x: x.position)
    assert [x.position for x in tied] == list(range(1, 3001))
    assert [x.t for x in tied] == [x[0] for x in sorted(rows, key=lambda x: last(x[0], 0))]
    assert sorted_positions(df.limit(0), ["t"], parts=parts).count() == 0


def test_a_hot_value_is_sorted_in_many_parts(spark):
    """Rows without a value are a third: no part gets them all, and no window sees
    the table."""
    n = 30_000
    df = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("t"), "id")
    out = sorted_positions(df, ["t"], parts=12)
    files = spark.read.parquet(*out.inputFiles())
    per = files.where("t IS NULL").groupBy(F.input_file_name()).count().collect()
    assert len(per) >= 3 and max(r["count"] for r in per) < n / 4
    assert out.where("t IS NULL").agg(F.min("position")).first()[0] == n - n // 3 + 1
