"""The shuffle path of benchmark decontamination: equal rows, no text in an exchange."""
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from cartwise.llm import decontam
from cartwise.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_rows_equal_sql(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    for t in ("documents", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duckdb.sql(ORACLES["op10_benchmark_decontamination"])
    got = QUERIES["op10_benchmark_decontamination"](spark, SF)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_null_ids_against_sql(spark):
    """Items with and without an id share windows; some have none but null ids."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    texts = [r.text for r in docs.where("text IS NOT NULL").select("text").collect()]
    cut = lambda t, a: " ".join(t.split()[a:a + 20])
    items = [(None if i % 3 == 0 else i, cut(texts[i], i % 5)) for i in range(40)]
    items += [(100 + i, cut(texts[i], i % 5)) for i in range(0, 40, 6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toPandas())
    con.register("benchmark", bench.toPandas().astype({"item_id": "Int64"}))
    want = con.sql(decontam.ORACLE)
    got = decontam.benchmark_hits(docs, bench)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("many", [50, 3000])
def test_long_document_and_common_passage(spark, monkeypatch, many):
    """A document of 20,000 words, a window that very many documents have, and a bit
    set so small that it lets through most shingles."""
    import random
    r = random.Random(many)
    word = lambda: "w%d" % r.randint(0, 3000)
    passage = " ".join(word() for _ in range(13))
    long = [word() for _ in range(20_000)]
    long[5000:5013] = passage.split()
    rows = [(0, " ".join(long)), (1, "short"), (2, None)]
    rows += [(10 + i, f"{word()} {passage} {word()} {i}") for i in range(many)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = [(1, passage), (2, " ".join(long[-14:])), (3, "short"), (4, " ".join(long[:200]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(map(tuple, decontam.benchmark_hits(docs, bench).collect()))
    assert len(want) == len(rows) and sum(x[5] for x in want) == many + 1
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(decontam, "MOST_BITS", 1 << 15)
    assert sorted(map(tuple, decontam.benchmark_hits(docs, bench).collect())) == want


def test_bit_set_holds_all_and_few_others(spark):
    inside = spark.range(3000).select(F.xxhash64("id").alias("h"))
    others = spark.range(10_000, 60_000).select(F.xxhash64("id").alias("h"))
    bit_set = decontam._bit_set(inside)
    assert bit_set[1] == 1 << 18
    assert decontam._maybe_in(inside, bit_set).count() == 3000
    assert decontam._maybe_in(others, bit_set).count() < 50_000 * 3000 * 1.5 / (1 << 18)


def test_no_text_is_shuffled(spark, monkeypatch):
    """No exchange of the plan has a document's words, and no side but the bit set,
    whose size is bounded, is broadcast without being measured."""
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    out = decontam.benchmark_hits(docs, bench)
    text = out._jdf.queryExecution().executedPlan().toString()
    below, found = re.split(r"\n", text), 0
    for i, line in enumerate(below):
        if "Exchange hashpartitioning" in line:
            found += 1
            fields = below[i + 1]
            assert not re.search(r"(\[|, )(ws|text|t)#\d+(,|\])", fields), fields
    assert found and "BroadcastNestedLoopJoin" not in text and "Python" not in text
