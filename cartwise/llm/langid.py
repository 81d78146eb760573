"""Language identification with string kernels.

The kernel of two stretches of text is the number of byte n-grams (1 to 3)
that both have, over the geometric mean of their own numbers: a blended
presence spectrum.  Nystroem landmarks, drawn from every language, turn it
into a feature map, on which one ridge regression a language is fitted.  A
text is scored whole, in stretches of ``STRETCH`` bytes: the presence matrix
of a batch times the landmarks' presence gives the kernel block, and that
times the folded regression weights gives the scores.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.column import Column

from .common import arrow_bound, ship_package, slices_by_bytes, written
from .text_bytes import column_bytes

ROWS_PER_LANG = 500        # training rows a language, at most
ROWS = 6500                # of all languages, where one row each is fewer
LANDMARKS_PER_LANG = 48    # stretches
LANDMARKS = 400            # of all languages: their matrix is what a worker holds
BROADCAST_LANGS = 100_000  # with their counts, about 50 bytes each
STRETCHES_PER_ROW = 3      # of a training row, spread over its length
STRETCH = 4096
SLICE_BYTES = 1 << 20
RIDGE = 1e-2
SHARPNESS = 4.0            # of the soft maximum that turns regressions into scores

CLASSES = 64


@lru_cache(maxsize=1)
def byte_classes() -> np.ndarray:
    """Class of each byte: 0 what is no letter, 1-26 the letters a-z, the rest
    for the bytes of other characters (continuation bytes by their low bits)."""
    out = np.zeros(256, np.uint32)
    for i in range(26):
        out[97 + i] = out[65 + i] = 1 + i
    for b in range(0x80, 0xC0):                # 32 classes; capitals of U+00C0.. fold
        out[b] = 27 + (b & 0x1F)
    for b in range(0xC0, 0x100):               # 5 classes of lead bytes
        out[b] = 59 + (b - 0xC0) % 5
    return out


def stretches(ends: np.ndarray, size: int = STRETCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, row) of the stretches of each row; none for empty rows."""
    lengths = np.diff(ends)
    parts = -(-lengths // size)
    row = np.repeat(np.arange(len(lengths)), parts)
    k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    # even cuts: the last stretch is about as long as the others
    start = ends[row] + k * lengths[row] // parts[row]
    stop = ends[row] + (k + 1) * lengths[row] // parts[row]
    return start, stop, row


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Codes of the 1-, 2- and 3-grams that begin at each byte (the last bytes
    have none of the longer ones)."""
    c = byte_classes()[data]
    two = c[:-1] * CLASSES + c[1:]
    three = two[:-1] * CLASSES + c[2:] if len(two) else two
    return [c, CLASSES + two, CLASSES + CLASSES ** 2 + three]


ALL_GRAMS = CLASSES + CLASSES ** 2 + CLASSES ** 3


def presence(data: np.ndarray, start: np.ndarray, stop: np.ndarray,
             index: np.ndarray, size: int) -> np.ndarray:
    """(stretches, size) 0/1 matrix of the known n-grams in each stretch.
    ``index``: n-gram code to column, or ``size`` if unknown."""
    out = np.zeros((len(start), size + 1), np.float32)
    if len(start):
        lo = int(start[0])
        row = np.repeat(np.arange(len(start)), stop - start)
        for n, code in enumerate(grams(data[lo:int(stop[-1])]), 1):
            r = row[:len(code)]
            ok = r == row[n - 1:n - 1 + len(code)]      # not across stretches
            out[r[ok], index[code[ok]]] = 1
    return out[:, :size]


class KernelClassifier:
    """What is fitted: languages, n-gram index, landmarks, weights."""

    def __init__(self, langs: list[str], index: np.ndarray, landmarks: np.ndarray,
                 weights: np.ndarray):
        self.langs, self.index = langs, index
        self.landmarks, self.weights = landmarks, weights
        self.own = np.maximum(landmarks.sum(axis=1), 1)

    def kernel(self, x: np.ndarray) -> np.ndarray:
        return _kernel(x, self.landmarks, self.own)

    def scores(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the best language, score) of each row; empty rows get 0."""
        n = len(ends) - 1
        sums = np.zeros((n, len(self.langs)))
        start, stop, row = stretches(ends)
        for k in range(0, len(start), 256):
            part = slice(k, k + 256)
            x = presence(data, start[part], stop[part], self.index, self.landmarks.shape[1])
            s = self.kernel(x) @ self.weights
            np.add.at(sums, row[part], s * (stop - start)[part][:, None])
        means = sums / np.maximum(np.diff(ends), 1)[:, None]
        soft = np.exp(SHARPNESS * (means - means.max(axis=1, keepdims=True)))
        soft /= soft.sum(axis=1, keepdims=True)
        best = means.argmax(axis=1)
        return best, soft[np.arange(n), best]


def _kernel(x: np.ndarray, landmarks: np.ndarray, own: np.ndarray) -> np.ndarray:
    both = x @ landmarks.T
    mine = np.maximum(x.sum(axis=1), 1)
    return both / np.sqrt(mine[:, None] * own[None, :])


def landmark_places(y: np.ndarray, n_langs: int) -> np.ndarray:
    """Which stretches (``y``: the number of their language) become landmarks: as
    many of each language, spread over its stretches, LANDMARKS in all; with more
    languages than that, one of every so many languages."""
    most = max(1, min(LANDMARKS_PER_LANG, LANDMARKS // n_langs))
    own = [np.flatnonzero(y == k) for k in np.unique(np.linspace(
        0, n_langs - 1, min(n_langs, LANDMARKS)).astype(int))]
    return np.concatenate([x[np.unique(np.linspace(0, len(x) - 1, min(len(x), most)).astype(int))]
                           for x in own if len(x)])


def train(pieces: list[list[bytes]], langs: list[str]) -> KernelClassifier | None:
    """Fit on the rows given, each by its stretches; None without any."""
    names = sorted(set(langs))
    flat = [p for own in pieces for p in own]
    if not flat:
        return None
    data = np.frombuffer(b"".join(flat), np.uint8)
    ends = np.concatenate([[0], np.cumsum([len(p) for p in flat])])
    start, stop = ends[:-1], ends[1:]
    row = np.repeat(np.arange(len(pieces)), [len(own) for own in pieces])
    number = {v: k for k, v in enumerate(names)}
    y = np.array([number[v] for v in langs])[row]
    marks = landmark_places(y, len(names))
    # the vocabulary: the n-grams of the landmarks
    index = np.full(ALL_GRAMS, -1, np.int64)
    for a, b in zip(start[marks], stop[marks]):
        for code in grams(data[a:b]):
            index[code] = 0
    known = np.flatnonzero(index == 0)
    index[:] = len(known)
    index[known] = np.arange(len(known))
    marks = np.sort(marks)
    landmarks = np.concatenate([presence(data, start[k:k + 1], stop[k:k + 1], index, len(known))
                                for k in marks])
    own = np.maximum(landmarks.sum(axis=1), 1)
    block = np.concatenate([
        _kernel(presence(data, start[k:k + 256], stop[k:k + 256], index, len(known)),
                landmarks, own) for k in range(0, len(flat), 256)]).astype(np.float64)
    values, vectors = np.linalg.eigh(_kernel(landmarks, landmarks, own).astype(np.float64))
    ok = values > 1e-8 * values.max()
    root = vectors[:, ok] / np.sqrt(values[ok])          # K_mm ** -1/2
    phi = block @ root
    # the targets are 1 for the stretch's own language and -1 for the others
    sums = np.zeros((len(names), phi.shape[1]))
    np.add.at(sums, y, phi)
    gram = phi.T @ phi + RIDGE * len(phi) * np.eye(phi.shape[1]) / 10
    weights = root @ np.linalg.solve(gram, (2 * sums - phi.sum(axis=0)).T)
    return KernelClassifier(names, index, landmarks, weights.astype(np.float32))


def trained_on(text: Column) -> Column:
    """array<binary>: the stretches of a text that are trained on, cut as
    ``stretches`` does, at most ``STRETCHES_PER_ROW`` spread over its length."""
    size = F.octet_length(text).cast("long")
    parts = F.ceil(size / STRETCH)
    spread = F.array(*[F.floor((parts - 1) * F.lit(k) / (STRETCHES_PER_ROW - 1))
                       for k in range(STRETCHES_PER_ROW)])
    at = lambda k: F.floor(k * size / parts).cast("int")
    return F.transform(F.array_distinct(spread), lambda k: F.substring(
        text.cast("binary"), at(k) + 1, at(k + 1) - at(k)))


def training_rows(df: DataFrame, text_col: str, lang_col: str, id_col: str,
                  per_lang: int) -> tuple[list[list[bytes]], list[str]]:
    """Stretches and language of at most ``per_lang`` rows a language and ROWS in
    all (one a language at least), picked by a hash of the id after a count a
    language, so that a frequent one sends no more than a rare one.  Rows of every
    length are drawn; a row is drawn and cut in its task, and only the stretches
    that are trained on leave it."""
    rows = (df.select(df[id_col].alias("i"), df[text_col].alias("text"),
                      df[lang_col].alias("lang"))
            .filter("lang IS NOT NULL AND text IS NOT NULL")
            .filter((F.octet_length("text") > 0) & F.col("text").rlike(r"\p{L}")))
    n = written(df.sparkSession, rows.groupBy("lang").count(), "languages")
    n_langs = n.count()
    per_lang = max(1, min(per_lang, ROWS // max(1, n_langs)))
    counted = F.broadcast(n) if n_langs <= BROADCAST_LANGS else n
    draw = F.pmod(F.xxhash64("i", "text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    # a language of few rows sends them all; of others about twice the rows are
    # cut, 20 at least, so that none is left without a row
    some = (rows.join(counted, "lang").withColumn("u", draw)
            .filter(F.col("u") < max(2.0 * per_lang, 20.0) / F.col("count"))
            .select("lang", "u", trained_on(F.col("text")).alias("pieces")))
    first = Window.partitionBy("lang").orderBy("u", "pieces")
    got = (some.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= per_lang)
           .orderBy("lang", "r").select("pieces", "lang").collect())
    return [[bytes(p) for p in g["pieces"]] for g in got], [g["lang"] for g in got]


def held_out(id_col: str) -> Column:
    """Rows that are never learnt from: crc32 of the id as text, mod 4, is 2."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 4 == 2


def identify(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             lang_col: str = "lang", per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (0 to 1).

    ``und`` with score 0 if the text is null or has no letter, or if there was
    nothing to learn from.  Only the text is an input of a prediction; equal
    texts get equal ones.  Rows keep their null or repeated ids; a null id
    counts as the empty text.  Columns beyond the three are not read.
    """
    spark = df.sparkSession
    ship_package(spark)
    arrow_bound(spark)
    model = train(*training_rows(df.filter(~held_out(id_col)), text_col, lang_col, id_col,
                                 per_lang))
    narrow = df.select(df[id_col].alias("doc_id"), held_out(id_col).alias("held_out"),
                       df[text_col].alias("text"),
                       F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("some"))
    schema = T.StructType([narrow.schema["doc_id"], T.StructField("held_out", T.BooleanType()),
                           T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    fitted = spark.sparkContext.broadcast(model)      # bounded by the landmarks

    def predict(batches):
        import pyarrow as pa

        m = fitted.value
        for b in slices_by_bytes(batches, 2, SLICE_BYTES):
            some = np.asarray(b.column(3))
            if m is None:
                best, score, some = np.zeros(len(some), int), np.zeros(len(some)), some & False
            else:
                best, score = m.scores(*column_bytes(b.column(2)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1),
                 pa.array([m.langs[k] if ok else "und" for k, ok in zip(best, some)], pa.string()),
                 pa.array(np.where(some, score, 0.0))],
                names=["doc_id", "held_out", "lang_pred", "score"])

    return narrow.mapInArrow(predict, schema)
