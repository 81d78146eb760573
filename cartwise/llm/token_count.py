"""Token counts by batch encoding inside Arrow functions.

Batches are balanced by bytes, not by rows; a long text is split where the
tokenizer can't merge across, and its parts' counts are added up.  Only
lengths leave the function.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_bound, ship_package, slices_by_bytes

TOKENIZER = "piece_bpe_32k.model"
LIMIT = 4096
BATCH_BYTES = 1 << 20
PART_CHARS = 1 << 16


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file; a path with a slash is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers
    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def load(name: str):
    """(function from texts to counts, function from a text to its parts)."""
    path = tokenizer_path(name)
    if path.endswith(".model"):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
        # a piece that goes on after a word's end would join what a cut parts
        apart = all("▁" not in p.lstrip("▁") for p in pieces)
        # and the prefix blank of a part must stand for the blank at the cut
        apart = apart and sp.encode("a b") == sp.encode("a") + sp.encode("b")

        def count(texts: list[str]) -> list[int]:
            return [len(x) for x in sp.encode(texts, num_threads=1)]

        return count, (split_at_blanks if apart else lambda t: [t])
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return (lambda texts: [len(x.ids) for x in tok.encode_batch(texts, add_special_tokens=False)],
            split_before_blanks)


_CUT = re.compile(r"(?<=[^ ▁]) (?=[^ ▁])")
_CUT_WORDS = re.compile(r"(?<=[a-z])(?= [a-z])")


def _parts(text: str, cut: re.Pattern) -> list[str]:
    out, start = [], 0
    while len(text) - start > PART_CHARS:
        m = cut.search(text, start + PART_CHARS)
        if not m:
            break
        out.append(text[start:m.start()])
        start = m.end()
    out.append(text[start:])
    return out


def split_at_blanks(text: str) -> list[str]:
    """Parts between single blanks; the blank at a cut is left out, as the
    encoder puts one in front of every text."""
    return _parts(text, _CUT)


def split_before_blanks(text: str) -> list[str]:
    """Parts cut between a word and the blank before the next one."""
    return _parts(text, _CUT_WORDS)


def count_texts(texts: list[str | None], name: str = TOKENIZER) -> list[int]:
    count, split = load(name)
    parts, owner = [], []
    for i, t in enumerate(texts):
        for p in split(t) if t else ():
            parts.append(p)
            owner.append(i)
    out = [0] * len(texts)
    start, held = 0, 0
    for k, p in enumerate(parts):          # calls of about the same size
        held += len(p)
        if held >= BATCH_BYTES or k == len(parts) - 1:
            for i, n in zip(owner[start:k + 1], count(parts[start:k + 1])):
                out[i] += n
            start, held = k + 1, 0
    return out


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 tokenizer: str = TOKENIZER, limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit
    (n_tokens > limit), as the tokenizer's own library counts the whole text,
    without begin, end or added tokens.

    A null text counts as empty: 0 bytes, 0 tokens.  Rows keep their null or
    repeated ids.  Other columns are not read; no shuffle.
    """
    ship_package(df.sparkSession)
    arrow_bound(df.sparkSession)
    narrow = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("n_tokens", T.LongType()),
                           T.StructField("over_limit", T.BooleanType())])

    def lengths(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in slices_by_bytes(batches, 1, BATCH_BYTES):
            n = count_texts(b.column(1).to_pylist(), tokenizer)
            size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), size, pa.array(n, pa.int64()),
                 pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return narrow.mapInArrow(lengths, schema)
