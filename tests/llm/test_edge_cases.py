"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing
columns: every operator gives a row per input row, with a defined result."""

from __future__ import annotations

import hashlib

import pytest

from cartwise.llm import (decontam, exact_dedup, html_extract, jaccard_join, langid, piece_fst,
                          pii, quality, sharding, token_count)

PER_ROW = {
    "langid": langid.identify, "jaccard": jaccard_join.join_classes,
    "tokens": token_count.count_tokens, "pii": pii.find_pii, "shards": sharding.assign_shards,
    "exact": exact_dedup.exact_dedup, "quality": quality.quality_scores,
    "pieces": piece_fst.encode_texts,
}


def bench(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string, doc_id string, h string")


@pytest.fixture(scope="module")
def results(frame):
    return {k: f(frame).collect() for k, f in PER_ROW.items()}


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_a_row_for_each_row(results, frame, name):
    want = sorted((r.doc_id is None, r.doc_id) for r in frame.select("doc_id").collect()
                  if r.doc_id is not None)
    got = sorted((r.doc_id is None, r.doc_id) for r in results[name] if r.doc_id is not None)
    assert got == want
    assert sum(r.doc_id is None for r in results[name]) == 2


@pytest.mark.parametrize("name", sorted(PER_ROW))
def test_empty_table(nothing, name):
    out = PER_ROW[name](nothing)
    assert out.columns[0] == "doc_id" and out.count() == 0


def by_id(rows):
    return {r.doc_id: r for r in rows if r.doc_id is not None}


def test_langid_und(results):
    r = by_id(results["langid"])
    assert all((r[i].lang_pred, r[i].score) == ("und", 0.0) for i in (3, 4, 5, 8, 10))
    assert r[1].lang_pred == "en" and 0 <= r[1].score <= 1
    assert r[9].lang_pred != "und"


def test_exact_ties_and_repeats(results):
    r = [x for x in results["exact"] if x.doc_id in (1, 2)]
    assert {x.keep_id for x in r} == {2} and {x.group_size for x in r} == {3}
    assert sum(x.kept for x in r) == 1 and not by_id(r)[1].kept
    white = [x for x in results["exact"] if x.text_sha256 == hashlib.sha256(b"").hexdigest()]
    # the white text of doc 5 has the most characters
    assert len(white) == 4 and {x.keep_id for x in white} == {5}


def test_exact_keep_one(frame):
    out = exact_dedup.keep_one(frame)
    assert out.columns == frame.columns
    assert sorted((r.doc_id or 0) for r in out.collect()) == [0, 2, 5, 6, 7, 8, 9, 10, 11]


def test_jaccard_rows(results):
    r = by_id(results["jaccard"])
    assert r[1].class_id == 1 and r[2].class_id == 1 and r[1].n_links == 2 == r[2].n_links
    assert r[6].class_id == r[7].class_id == 6 and r[6].n_links == 1
    for i in (3, 4, 5):                                   # no words: alone
        assert (r[i].class_id, r[i].n_links, r[i].kept) == (i, 0, True)


def test_jaccard_keep_one(frame):
    out = jaccard_join.keep_one(frame)
    assert out.columns == frame.columns
    assert 7 not in {r.doc_id for r in out.collect()}


def test_tokens(results):
    r = by_id(results["tokens"])
    assert (r[3].n_bytes, r[3].n_tokens, r[4].n_tokens) == (0, 0, 0)
    assert r[6].over_limit and not r[1].over_limit


def test_pieces(results):
    r = by_id(results["pieces"])
    assert all(x.same for x in results["pieces"]) and r[3].ids == [] == r[4].ids
    counts = by_id(results["tokens"])
    assert all(r[i].n_tokens == counts[i].n_tokens for i in r)


def test_quality_of_nothing(results):
    r = by_id(results["quality"])
    assert all(r[i].score == 0.0 and not r[i].keep for i in (3, 4, 5))


def test_pii_of_nothing(results):
    r = by_id(results["pii"])
    assert all(r[i].spans == "" and r[i].base_sha256 == hashlib.sha256(b"").hexdigest()
               for i in (3, 4, 5))


def test_shards(results):
    assert all(0 <= r.slot < sharding.SLOTS and 0 <= r.shard < sharding.SHARDS
               for r in results["shards"])


@pytest.mark.parametrize("most", [decontam.BROADCAST_BYTES, 0])
def test_decontam(spark, frame, nothing, monkeypatch, most):
    """By broadcast and by shuffle.  Windows of an item without an id hit words; the
    ids are of the others."""
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", most)
    text = "QUICK brown fox jumps over a lazy dog and runs away the quick"
    b = bench(spark, [(7, text, "x", "y"), (8, None, "x", "y"), (9, "...", "x", "y"),
                      (None, "é", "x", "y"), (10, "😀", "x", "y"), (7, text, "x", "y"),
                      (12, "braune Fuchs", "x", "y")])
    out = decontam.benchmark_hits(frame, b).collect()
    assert len(out) == frame.count()
    r = by_id(out)
    assert r[6].n_hit == r[6].n_words - 11 and r[6].n_items == 1 and r[6].contaminated
    assert r[6].items_sha256 == hashlib.sha256(b"7").hexdigest()
    assert r[10].n_hit == 2 == r[10].n_words
    assert (r[9].n_hit, r[9].n_items, r[9].contaminated) == (1, 0, True)
    assert r[9].items_sha256 == hashlib.sha256(b"").hexdigest()
    assert (r[3].n_words, r[3].contaminated) == (0, False)
    assert max(x.n_hit for x in out if x.doc_id is None) == 2
    assert decontam.benchmark_hits(nothing, b).count() == 0
    none = decontam.benchmark_hits(frame, bench(spark)).collect()
    assert len(none) == len(out) and not any(x.n_hit for x in none)
    kept = decontam.keep_clean(frame, b)
    assert kept.columns == frame.columns
    assert {6, 7, 9, 10}.isdisjoint({x.doc_id for x in kept.collect()})


def test_pages(spark):
    page = "<html><body><nav>x</nav><article><h1>T&eacute;</h1><p>a <b>b</b>c\n d<br>e</p>" \
           "</article><footer>f</footer></body></html>"
    rows = [(1, "http://a.example/1", page, "x"), (1, "http://a.example/1", page, "x"),
            (2, None, None, "x"), (None, "::", "", "x"), (3, "http://a.example/2", "<p>one<p>two", "x"),
            (4, "http://A.example/3", "<div>" * 5000 + "deep", "x"),
            (5, "http://b.example", "<p>" + "w " * 200_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = html_extract.main_text(df).collect()
    assert sorted((r.page_id or 0) for r in out) == [0, 1, 1, 2, 3, 4, 5]
    r = {x.page_id: x for x in out}
    assert r[1].text == "Té a bc d e" and r[1].n_chars == 11
    assert r[2].text == "" == r[None].text and r[3].text == "one two" and r[4].text == "deep"
    assert r[5].n_chars == 399_999
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_extra_columns_of_pipeline_stages(frame):
    assert quality.keep_good(frame).columns == frame.columns
