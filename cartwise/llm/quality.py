"""Quality classifier from weak labels.

Heuristic labellers vote good, junk or nothing on every document.  The counts
of all vote patterns of the corpus (at most 3 ** labellers) go through
expectation-maximisation, which estimates each labeller's accuracy without
any hand label.  The patterns' posteriors then label a bounded sample of
documents, and a hashed linear scorer learns from those.  Every whole
document gets its score from the scorer.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_bound, ship_package, slices_by_bytes
from .text_bytes import column_bytes, word_hashes, word_spans

SAMPLE_ROWS = 2000          # documents that the scorer is fitted on, at most
BINS = 4096
THRESHOLD = 0.5
SLICE_BYTES = 2 << 20
LABELLERS = ("symbols", "capitals", "repeats", "bars", "decorated", "sentences", "variety")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "%*&$#!|~^=+<>@\\_{}[]"]] = True
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def _share(part, whole):
    return part / np.maximum(whole, 1)


def measures(data: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Per row: the numbers that the labellers look at."""
    n = len(ends) - 1
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])[ends])
    # bytes that begin a character
    chars = sums((data & 0xC0) != 0x80)
    upper = (data >= 65) & (data <= 90)
    lower = (data >= 97) & (data <= 122)
    start, stop, row = word_spans(~_WHITE[data], ends)
    words = np.bincount(row, minlength=n)
    h = word_hashes(data, start, stop)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        tail, head, one = data[stop - 1], data[start], stop - start == 1
    else:
        tail = head = np.zeros(0, np.uint8)
        one = np.zeros(0, bool)
    per = lambda mask: np.bincount(row[mask], minlength=n)
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    return {"words": words, "symbols": _share(sums(_SYMBOL[data]), chars),
            "capitals": _share(sums(upper), sums(upper | lower)),
            "repeats": _share(per(same), words),
            "bars": _share(per(one & (head == ord("|"))), words),
            "decorated": _share(per(_SYMBOL[tail] & ~one), words),
            "sentences": _share(per((tail == ord(".")) | (tail == ord(","))), words),
            "variety": _share(np.bincount(row[order][new], minlength=n), words)}


def votes(m: dict[str, np.ndarray]) -> np.ndarray:
    """(rows, labellers): 1 good, -1 junk, 0 nothing."""
    def vote(good, junk):
        return np.where(junk, -1, np.where(good, 1, 0))

    many = m["words"] >= 20
    return np.stack([
        vote(m["symbols"] < 0.01, m["symbols"] > 0.04),
        vote(m["capitals"] < 0.12, m["capitals"] > 0.3),
        vote(m["repeats"] < 0.03, m["repeats"] > 0.12),
        vote(m["bars"] < 0.01, m["bars"] > 0.1),
        vote(m["decorated"] < 0.03, m["decorated"] > 0.15),
        vote(many & (m["sentences"] > 0.03) & (m["sentences"] < 0.35),
             many & (m["sentences"] < 0.015)),
        vote(m["variety"] > 0.35, many & (m["variety"] < 0.2)),
    ], axis=1).astype(np.int8)


def pattern_of(v: np.ndarray) -> np.ndarray:
    return ((v.astype(np.int64) + 1) * 3 ** np.arange(v.shape[1])).sum(axis=1)


def votes_of(pattern: np.ndarray, labellers: int = len(LABELLERS)) -> np.ndarray:
    return np.stack([(pattern // 3 ** j) % 3 for j in range(labellers)], axis=1) - 1


def fit_labellers(pattern: np.ndarray, count: np.ndarray, rounds: int = 100):
    """Expectation-maximisation over counted vote patterns.

    Returns (posterior of good for each pattern, table of P(vote | class) as
    (labellers, 2, 3), prior of good).  It starts at the majority's vote.
    """
    v = votes_of(pattern) + 1
    w = count.astype(float)
    post = np.clip(0.5 + 0.5 * np.sign((v - 1).sum(axis=1)) * 0.8
                   - 0.8 * (v == 0).any(axis=1) * ((v - 1).sum(axis=1) > 0) * 0.5, 0.05, 0.95)
    labellers = v.shape[1]
    for _ in range(rounds):
        tables = np.empty((labellers, 2, 3))
        for y, p in enumerate((1 - post, post)):
            for j in range(labellers):
                c = np.bincount(v[:, j], weights=w * p, minlength=3) + 1.0
                tables[j, y] = c / c.sum()
        prior = np.clip((w * post).sum() / max(w.sum(), 1), 0.01, 0.99)
        logs = np.log(tables)
        good = np.log(prior) + sum(logs[j, 1][v[:, j]] for j in range(labellers))
        junk = np.log(1 - prior) + sum(logs[j, 0][v[:, j]] for j in range(labellers))
        new = 1 / (1 + np.exp(np.clip(junk - good, -500, 500)))
        if np.abs(new - post).max(initial=0) < 1e-9:
            break
        post = new
    return post, tables, prior


_STEP = np.uint32(2654435761)


def hashed(data: np.ndarray, ends: np.ndarray, bins: int = BINS):
    """(bin, row, words) of hashed features: the byte triples of the text with
    letters and digits folded by case, and pairs of equal neighbour words."""
    with np.errstate(over="ignore"):
        d = data.astype(np.uint32)
        fold = np.where((d >= 97) & (d <= 122), np.uint32(97),
                        np.where((d >= 65) & (d <= 90), np.uint32(65),
                                 np.where((d >= 48) & (d <= 57), np.uint32(48), d)))
        code = (fold[:-2] << np.uint32(16)) | (fold[1:-1] << np.uint32(8)) | fold[2:]
        code = (code * _STEP) >> np.uint32(32 - (bins.bit_length() - 1))
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    ok = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
    start, stop, word_row = word_spans(~_WHITE[data], ends)
    h = word_hashes(data, start, stop)
    same = np.zeros(len(h), bool)
    if len(h):
        same[1:] = (h[1:] == h[:-1]) & (word_row[1:] == word_row[:-1])
    return code[ok], row[2:][ok], _share(np.bincount(word_row[same], minlength=len(ends) - 1),
                                         np.bincount(word_row, minlength=len(ends) - 1))


REPEAT_WEIGHT = 4.0         # the repeated-word feature's scale beside the triples' shares


def features(data: np.ndarray, ends: np.ndarray):
    """(bins, shares, ends, repeats): the bins of each row and the square roots
    of their shares of its triples, at most ``BINS`` a row, where each row's
    end, and its share of repeated words."""
    n = len(ends) - 1
    code, row, repeats = hashed(data, ends)
    at, k = np.unique(row * BINS + code, return_counts=True)
    r = at // BINS
    total = np.maximum(np.bincount(row, minlength=n), 1)
    return ((at % BINS).astype(np.uint16), np.sqrt(k / total[r]).astype(np.float32),
            np.searchsorted(r, np.arange(n + 1)), repeats)


def fit_scorer(rows: list[tuple[bytes, bytes, float]], labels: np.ndarray, rounds: int = 250,
               ridge: float = 1e-4):
    """Weights (bins + repeat + bias) of a logistic scorer on soft labels, from
    the bins, shares and repeats of ``features``."""
    x = np.zeros((len(rows), BINS + 2), np.float32)
    for i, (bins, shares, repeats) in enumerate(rows):
        x[i, np.frombuffer(bins, np.uint16)] = np.frombuffer(shares, np.float32)
        x[i, BINS] = REPEAT_WEIGHT * repeats
    x[:, -1] = 1
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    labels = labels.astype(np.float32)
    step = np.float32(4.0 * len(rows) / max(np.einsum("ij,ij->", x, x), 1)) if rows else 0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = (p - labels) @ x / max(1, len(rows)) + np.float32(ridge) * w
        speed = np.float32(0.9) * speed - step * g
        w += speed
    return w.astype(np.float64)


def score_rows(data: np.ndarray, ends: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Scores 0 to 1; a row without a word scores 0."""
    n = len(ends) - 1
    code, row, repeats = hashed(data, ends)
    out = np.zeros(n)
    # shares by (row, bin): the square root of a share, as in the fit
    at, k = np.unique(row * BINS + code, return_counts=True)
    r = at // BINS
    total = np.maximum(np.bincount(row, minlength=n), 1)
    out += np.bincount(r, weights=np.sqrt(k / total[r]) * w[at % BINS], minlength=n)
    out += REPEAT_WEIGHT * repeats * w[BINS] + w[-1]
    p = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
    some = np.concatenate([[0], np.cumsum(~_WHITE[data], dtype=np.int64)])[ends]
    return np.where(np.diff(some) > 0, p, 0.0)


def _patterns(narrow: DataFrame) -> DataFrame:
    def count(batches):
        import pyarrow as pa

        for b in slices_by_bytes(batches, 0, SLICE_BYTES):
            data, ends = column_bytes(b.column(0))
            p, k = np.unique(pattern_of(votes(measures(data, ends))), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int64()), pa.array(k, pa.int64())],
                                             names=["pattern", "n"])

    return narrow.select("text").mapInArrow(count, "pattern long, n long") \
        .groupBy("pattern").agg(F.sum("n").alias("n"))


def _sample(rows: DataFrame, sample_rows: int) -> list:
    """Pattern and features of the distinct texts of ``rows`` (h, text), at most
    ``sample_rows``.  A text is read in its task, whatever its length; what
    leaves the task has a fixed size at most."""
    def read(batches):
        import pyarrow as pa

        seen = set()                # copies of a text are read once a task
        for b in slices_by_bytes(batches, 1, SLICE_BYTES):
            new = []
            for i, h in enumerate(b.column(0).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    new.append(i)
            b = b.take(pa.array(new, pa.int64()))
            data, ends = column_bytes(b.column(1))
            bins, shares, cut, repeats = features(data, ends)
            parts = list(zip(cut[:-1], cut[1:]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(pattern_of(votes(measures(data, ends))), pa.int64()),
                 pa.array([bins[i:j].tobytes() for i, j in parts], pa.binary()),
                 pa.array([shares[i:j].tobytes() for i, j in parts], pa.binary()),
                 pa.array(repeats, pa.float64())],
                names=["h", "pattern", "bins", "shares", "repeats"])

    return (rows.mapInArrow(read, "h long, pattern long, bins binary, shares binary, "
                                  "repeats double")
            .groupBy("h").agg(F.first(F.struct("pattern", "bins", "shares", "repeats"))
                              .alias("f"))
            .orderBy(F.hash("h"), "h").limit(sample_rows).select("f.*").collect())


def fit(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS
        ) -> tuple[np.ndarray, dict]:
    """(scorer weights, {labeller: (accuracy on good, accuracy on junk)})."""
    ship_package(df.sparkSession)
    arrow_bound(df.sparkSession)
    narrow = df.select(df[text_col].alias("text")).filter("text IS NOT NULL")
    counts = _patterns(narrow).collect()          # at most 3 ** labellers rows
    if not counts:
        return np.zeros(BINS + 2), {}
    pattern = np.array([r["pattern"] for r in counts])
    n = np.array([r["n"] for r in counts])
    order = np.argsort(pattern)
    pattern, n = pattern[order], n[order]
    post, tables, _ = fit_labellers(pattern, n)
    accuracy = {name: (float(tables[j, 1, 2]), float(tables[j, 0, 0]))
                for j, name in enumerate(LABELLERS)}
    # a hash of the text picks the sample: about twice the rows, then exactly
    share = min(1.0, 2 * sample_rows / max(1, int(n.sum())))
    rows = narrow.select(F.xxhash64("text").alias("h"), "text")
    sample = _sample(rows.filter(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1),
                     sample_rows)
    if share < 1 and len(sample) < sample_rows // 2:
        # so many copies that the hash picked few texts or none
        picked = [r["h"] for r in rows.select("h").distinct().orderBy(F.hash("h"), "h")
                  .limit(sample_rows).collect()]
        sample = _sample(rows.filter(F.col("h").isin(picked)), sample_rows)
    mine = np.array([r["pattern"] for r in sample], np.int64)
    return fit_scorer([(r["bins"], r["shares"], r["repeats"]) for r in sample],
                      post[np.searchsorted(pattern, mine)]), accuracy


def quality_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = THRESHOLD, **limits) -> DataFrame:
    """One row per input row: doc_id, score (0 to 1), keep (score >= threshold).

    A null text, or one without a word, scores 0.  Equal texts score equally;
    rows keep their null or repeated ids.  Other columns are not read.  An
    empty table gives an empty result.
    """
    weights, _ = fit(df, text_col, **limits)
    narrow = df.select(df[id_col].alias("doc_id"), df[text_col].alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("score", T.DoubleType()),
                           T.StructField("keep", T.BooleanType())])

    def score(batches):
        import pyarrow as pa

        for b in slices_by_bytes(batches, 1, SLICE_BYTES):
            s = score_rows(*column_bytes(b.column(1)), weights)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s), pa.array(s >= threshold)],
                names=["doc_id", "score", "keep"])

    return narrow.mapInArrow(score, schema)


def keep_good(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` whose text passes, with all their columns."""
    weights, _ = fit(df, text_col)
    at = df.columns.index(text_col)

    def passing(batches):
        for b in slices_by_bytes(batches, at, SLICE_BYTES):
            import pyarrow as pa
            s = score_rows(*column_bytes(b.column(at)), weights)
            yield b.filter(pa.array(s >= threshold))

    return df.mapInArrow(passing, df.schema)
