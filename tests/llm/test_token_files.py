"""Token files: the library's ids, document order, offsets, an exact round trip."""
import glob
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartwise.llm import token_files
from cartwise.llm.queries import QUERIES
from cartwise.llm.token_count import tokenizer_path

SF = "/root/testdata/sf0.001"


def library(texts):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path(token_files.TOKENIZER))
    return [e.ids + [1] for e in tok.encode_batch([t or "" for t in texts],
                                                  add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_documents_against_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    docs = docs.sort_values("doc_id")
    want, start = [], 0
    for i, ids in zip(docs.doc_id, library(docs.text)):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    got = QUERIES["op11_token_binary"](spark, SF)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"),
                          ("ids_crc32", "bigint")]
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("text", [
    "", " \n\t ", "a b\u0085c\x1cd\x0be\x0cf", "e ́x é ̸= ≠",
    "<|startoftext|>a b<|endoftext|> <|end oftext|>", "ΣΑΣ İi ẞ it's THEY'RE 12345 !!??",
    "中文 字符, 한글 각 각", "😀😀 ‍ x", "a" * 5000, "word " * 300_000, " x y　z"])
def test_texts_against_the_library(text):
    enc = token_files.Encoder(token_files.TOKENIZER)
    assert enc.apart
    got = [int(x) for p in enc.parts(text.encode()) for x in p]
    assert got + [1] == library([text])[0]


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_files, "MEMO_BYTES", 200)
    monkeypatch.setattr(token_files, "PART_BYTES", 64)
    enc = token_files.Encoder(token_files.TOKENIZER)
    text = " ".join(f"word{i} x{i % 7}" for i in range(500))
    assert [int(x) for p in enc.parts(text.encode()) for x in p] + [1] == library([text])[0]
    assert enc.held < 2000


def test_files_of_odd_rows(spark, frame, tmp_path):
    """Nulls last, repeated ids next to each other, clashing columns, one file format."""
    path = str(tmp_path / "odd")
    manifest = token_files.write_token_files(frame, path, parts=3)
    got = token_files.read_token_files(spark, path, tokens=True).orderBy("start").collect()
    rows = {}
    for r in frame.select("doc_id", "text").collect():
        rows.setdefault(r.doc_id, []).append(library([r.text])[0])
    assert [r.doc_id for r in got] == [1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None, None]
    start = 0
    for r in got:
        assert list(r.ids) in rows[r.doc_id]
        rows[r.doc_id].remove(list(r.ids))
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), crc(r.ids))
        start += r.n_tokens
    # the files alone: flat integers, offsets, bases by prefix sums
    base = 0
    for m in manifest.orderBy("part").collect():
        ids = np.memmap(f"{path}/{m.name}.tok", "<u2", "r")
        off = np.memmap(f"{path}/{m.name}.off", "<i8", "r")
        assert (m.base, len(ids), len(off), m.width) == (base, m.n_tokens, m.n_docs + 1, 2)
        assert (ids[off[1:] - 1] == 1).all()
        base += m.n_tokens
    assert {os.path.basename(f).rpartition(".")[0] for f in glob.glob(f"{path}/part-*")} \
        == {m.name for m in manifest.collect()}


def test_a_hot_id_is_spread(spark, tmp_path):
    docs = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("a b").alias("text"))
    m = token_files.write_token_files(docs, str(tmp_path / "hot"), parts=6).collect()
    assert sum(r.n_docs for r in m) == 3000 and max(r.n_docs for r in m) < 1200
    assert token_files.read_token_files(spark, str(tmp_path / "hot")).count() == 3000


def test_empty_table_and_other_tokenizer(spark, nothing, frame, tmp_path):
    m = token_files.write_token_files(nothing, str(tmp_path / "none"))
    assert m.count() == 0
    assert token_files.read_token_files(spark, str(tmp_path / "none")).count() == 0
    one = frame.where("doc_id = 6")
    token_files.write_token_files(one, str(tmp_path / "b"), tokenizer="byte_bpe_50k.json")
    got = token_files.read_token_files(spark, str(tmp_path / "b"), tokens=True).first()
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert list(got.ids) == tok.encode(one.first().text, add_special_tokens=False).ids + [1]
