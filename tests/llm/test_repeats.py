"""Rows that repeat, and columns that clash, in what a filter keeps."""
import pytest
from pyspark.sql import functions as F

from cartwise.llm import exact_dedup, jaccard_join, sharding

TEXT = "one two three four five six seven eight nine ten eleven twelve"


def test_one_of_repeated_rows_is_kept(spark):
    rows = [(1, TEXT, "a"), (1, TEXT, "b"), (2, TEXT + " x", "c"), (2, TEXT + " x", "d"),
            (None, None, "e"), (None, None, "f"), (3, "", "g"), (4, "other words", "h")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = jaccard_join.join_classes(df, threshold=0.5).collect()
    assert len(out) == len(rows)
    words = [r for r in out if r.doc_id in (1, 2)]
    assert sum(r.kept for r in words) == 1 and {r.class_id for r in words} == {1}
    assert {r.n_links for r in words} == {3}
    stay = jaccard_join.keep_one(df, threshold=0.5)
    assert stay.columns == df.columns
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in stay.collect())
    assert ids == [(False, 1), (False, 3), (False, 4), (True, 0), (True, 0)]


def test_many_copies_of_a_representative_are_sent_once(spark, monkeypatch):
    """A third of all rows repeat one row: a group compares one of them."""
    copies = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(TEXT).alias("text"))
    others = spark.range(10, 40).select(F.col("id").alias("doc_id"), F.concat(
        F.lit(TEXT + " "), F.col("id").cast("string")).alias("text"))
    df = copies.unionByName(others)
    out = jaccard_join.join_classes(df)
    r = {x.doc_id: x for x in out.dropDuplicates(["doc_id"]).collect()}
    assert r[5].n_links == 3000 - 1 + 30 and r[10].n_links == 3000 + 29
    assert out.filter("kept").count() == 1
    assert [x.doc_id for x in jaccard_join.keep_one(df).collect()] == [5]


def test_exact_keeps_the_longest_and_every_column(spark):
    rows = [(1, "a b", "x"), (1, "a  b ", "y"), (1, "a b", "z"), (2, "ab", "w"), (3, None, "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __sha string") \
        .withColumns({"row": F.lit("r"), "sha": F.lit("s"), "id": F.lit(1), "run_n": F.lit(2)})
    out = exact_dedup.keep_one(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id, r.text, r["__sha"], r.row, r.sha) for r in out.collect())
    assert got == [(1, "a  b ", "y", "r", "s"), (3, None, "n", "r", "s")]


def test_shards_keep_all_columns(spark, tmp_path):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("t").alias("slot"),
                                 F.lit("p").alias("part"), F.lit("r").alias("row"))
    path = str(tmp_path / "s")
    sharding.write_shards(df, path)
    back = spark.read.parquet(path)
    assert set(back.columns) == {*df.columns, "shard"} and back.count() == 500
    want = {r.doc_id: r.shard for r in sharding.assign_shards(df).collect()}
    assert {r.doc_id: r.shard for r in back.collect()} == want
    clash = df.withColumn("shard", F.lit("mine"))
    with pytest.raises(ValueError):
        sharding.write_shards(clash, path + "2")
    sharding.write_shards(clash, path + "3", folder="to")
    assert spark.read.parquet(path + "3").where("shard = 'mine'").count() == 500
