"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of word shingles.  Rows with one and the same set form a
class and are compared once.  Classes that share a MinHash band are candidate
neighbours; candidates hang together in components, and a component's classes
are compared in blocks of bounded size, block against block.  There the
MinHash values of a pair are compared a few at a time: with n compared and m
equal, the posterior of the similarity under a uniform prior is
Beta(m + 1, n - m + 1), and the pair is dropped once the probability of
reaching the threshold falls below the tolerance.  What is left is verified
exactly on the shingle sets.

A task returns counts and a spanning forest of its links, never the links: a
group of n similar texts costs rows in proportion to n for each block.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bound, discard, ship_package, slices_by_bytes, small_enough, written
from .components import components
from .text_bytes import column_bytes, mix, word_hashes, word_spans

SHINGLE = 5
THRESHOLD = 0.8
TOLERANCE = 1e-9        # a pair is dropped below this probability
HASHES = 128
BAND = 4                # 32 bands of 4: a pair at 0.8 meets in one with 1 - 5e-8
STEP = 16               # MinHash values compared at a time
BLOCK_ROWS = 768
BLOCK_SHINGLES = 1_000_000
BROADCAST_ROWS = 100_000     # of ids and numbers only, 200 bytes a row: 20 MB
SLICE_BYTES = 1 << 20

_WORD = np.zeros(256, bool)
_WORD[ord("0"):ord("9") + 1] = _WORD[ord("a"):ord("z") + 1] = _WORD[128:] = True


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row.  Words are runs of letters,
    digits and bytes beyond ASCII, A-Z folded; fewer words than ``size`` are
    one shingle, no words none."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    start, stop, row = word_spans(_WORD[data], ends)
    h = word_hashes(data, start, stop)
    at = np.searchsorted(row, np.arange(len(ends)))
    with np.errstate(over="ignore"):
        if len(h) >= size:
            x = h[:len(h) - size + 1].copy()
            for j in range(1, size):
                x = mix(x) + h[j:len(h) - size + 1 + j]
            x = mix(x)
        else:
            x = h[:0]
        out = []
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= size:
                out.append(np.unique(x[a:b - size + 1]))
            elif b > a:
                short = np.uint64(b - a)
                for w in h[a:b]:
                    short = mix(np.array([short], np.uint64))[0] + w
                out.append(mix(np.array([short], np.uint64)))
            else:
                out.append(h[:0])
    return out


@lru_cache(maxsize=1)
def _multipliers() -> np.ndarray:
    return mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)


def minhash(s: np.ndarray) -> np.ndarray:
    """HASHES values of a set that isn't empty."""
    a, out = _multipliers()[:, None], None
    with np.errstate(over="ignore"):
        for k in range(0, len(s), 2048):
            v = ((s[None, k:k + 2048] * a) >> np.uint64(32)).min(axis=1)
            out = v if out is None else np.minimum(out, v)
    return out.astype(np.uint32)


@lru_cache(maxsize=8)
def least_equal(threshold: float, tolerance: float) -> dict[int, int]:
    """After n compared values: the least number of equal ones with which the
    posterior probability of the threshold is still at the tolerance."""
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
            p = sum(comb(n + 1, k) * threshold ** k * (1 - threshold) ** (n + 1 - k)
                    for k in range(m + 1))
            if p >= tolerance:
                out[n] = m
                break
    return out


def surviving_pairs(sig: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool,
                    threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of left, row of right) whose MinHash values keep them alive;
    ``same``: left and right are one block, and i < j."""
    need = least_equal(threshold, tolerance)
    x, y = sig[left], sig[right]
    a_out, b_out = [], []
    for k in range(0, len(left), 64):                 # bounded memory
        part = np.zeros((len(x[k:k + 64]), len(y)), np.int16)
        for c in range(STEP):
            part += x[k:k + 64, c, None] == y[None, :, c]
        a, b = np.nonzero(part >= need[STEP])
        equal = part[a, b]
        a = a + k
        if same:
            a, b, equal = a[a < b], b[a < b], equal[a < b]
        for n in range(STEP, HASHES, STEP):
            if not len(a):
                break
            equal = equal + (x[a, n:n + STEP] == y[b, n:n + STEP]).sum(axis=1)
            ok = equal >= need[n + STEP]
            a, b, equal = a[ok], b[ok], equal[ok]
        a_out.append(left[a])
        b_out.append(right[b])
    return np.concatenate(a_out), np.concatenate(b_out)


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs, exactly."""
    if not len(a):
        return np.zeros(0, np.int64)
    rows = np.unique(np.concatenate([a, b]))
    sizes = np.array([len(sets[i]) for i in rows])
    values, col, df = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True,
                                return_counts=True)
    place = np.searchsorted(rows, np.arange(len(sets)))
    shared = int((df > 1).sum())
    by_pairs = len(a) * 2.0 * sizes.mean() * 40
    by_product = float(len(rows)) ** 2 * shared / 8 + 40.0 * len(col)
    if by_pairs <= by_product:
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                         for i, j in zip(a, b)])
    # products of 0/1 matrices over the shared values, some columns at a time
    number = np.cumsum(df > 1) - 1
    r = np.repeat(np.arange(len(rows)), sizes)
    keep = df[col] > 1
    r, c = r[keep], number[col[keep]]
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    both = np.zeros((len(rows), len(rows)), np.float32)
    for k in range(0, shared, 2048):
        lo, hi = np.searchsorted(c, [k, k + 2048])
        m = np.zeros((len(rows), 2048), np.float32)
        m[r[lo:hi], c[lo:hi] - k] = 1
        both += m @ m.T
    return both[place[a], place[b]].astype(np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component under the links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def compare_block(cid, copies, block, sig, sets, first: int, second: int,
                  threshold: float, tolerance: float):
    """Links between blocks ``first`` and ``second`` of a component (or inside
    one): (linked documents of each row, smallest linked-together row)."""
    n = len(cid)
    left, right = np.flatnonzero(block == first), np.flatnonzero(block == second)
    if not len(left) or not len(right):
        return np.zeros(n, np.int64), np.arange(n)
    a, b = surviving_pairs(sig, left, right, first == second, threshold, tolerance)
    size = np.array([len(s) for s in sets])
    # no link if the sizes alone forbid it
    ok = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
    a, b = a[ok], b[ok]
    both = intersections(sets, a, b)
    linked = both >= threshold * (size[a] + size[b] - both) - 1e-9
    a, b = a[linked], b[linked]
    links = np.bincount(a, weights=copies[b], minlength=n) \
        + np.bincount(b, weights=copies[a], minlength=n)
    return links.astype(np.int64), forest(n, a, b)


def _signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, th, cls, n_sh, sig): cls is a digest of the set, null without words."""
    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, th long, cls binary, n_sh long, sig binary"

    def sign(batches):
        import pyarrow as pa

        for b in slices_by_bytes(batches, 2, SLICE_BYTES):
            sets = shingle_sets(*column_bytes(b.column(2)), shingle)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1),
                 pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s)
                           else None for s in sets], pa.binary()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([minhash(s).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "th", "cls", "n_sh", "sig"])

    return docs.mapInArrow(sign, schema)


def near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: float = THRESHOLD, shingle: int = SHINGLE,
                tolerance: float = TOLERANCE) -> DataFrame:
    """One row per input row: doc_id, class_id, set_id, n_links.

    n_links is the number of other rows whose shingle sets have a Jaccard
    similarity of ``threshold`` or more; set_id the smallest id among the rows
    with the same set; class_id the smallest among the rows that chains of
    links connect.  A row without words (null and empty texts among them)
    links to none and is its own class.  Repeated rows are rows of one set.
    Other columns are not read.  ``kept`` is true for one row of each class:
    the smallest id (null first, then a hash of the text, then any one row).
    """
    spark = df.sparkSession
    ship_package(spark)
    arrow_bound(spark)
    docs = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("th"),
                     F.col(text_col).alias("text"))
    # the row's number is written with it: rows that repeat id and text are told apart
    rows = written(spark, _signatures(docs, shingle)
                   .withColumn("row", F.monotonically_increasing_id()), "signatures")
    repeats = not (rows.filter("cls IS NOT NULL").groupBy("doc_id", "th").count()
                   .filter("count > 1").isEmpty())
    sets = (rows.filter("cls IS NOT NULL").groupBy("cls")
            .agg(F.min(F.struct("doc_id", "th", "row")).alias("rep"), F.count(F.lit(1)).alias("copies"),
                 F.first("n_sh").alias("n_sh"), F.first("sig").alias("sig")))
    sets = written(spark, sets.withColumn("cid", F.monotonically_increasing_id()), "sets")

    bands = (sets.select("cid", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)),
        lambda k: F.xxhash64(k, F.substring(F.col("sig"), k * (4 * BAND) + 1, F.lit(4 * BAND)))))
        .alias("key")))
    buckets = written(spark, bands.groupBy("key").agg(
        F.min("cid").alias("low"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("key", "low"), "buckets")
    near = components(bands.join(buckets, "key").select("cid", "low"), "cid", "low")

    member = near.join(sets, near["node"] == sets["cid"]).select(
        "cid", F.col("label").alias("comp"), "rep", "copies", "n_sh")
    member = written(spark, member, "members")
    discard(spark, buckets, near)
    blocks = (member.groupBy("comp")
              .agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS),
                              F.ceil(F.sum("n_sh") / BLOCK_SHINGLES)).cast("int").alias("nb")))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    dealt = (member.join(blocks, "comp")
             .withColumn("block", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
             .select("cid", "comp", "rep", "copies", "nb", "block"))
    fit = F.broadcast if small_enough(member, BROADCAST_ROWS) else (lambda d: d)
    texts = (docs.join(fit(dealt), docs["doc_id"].eqNullSafe(dealt["rep.doc_id"])
                       & (docs["th"] == dealt["rep.th"]))
             .select("cid", "comp", "copies", "block", "nb", "text"))
    if repeats:
        # one of a representative's rows stands for them: their tasks send one each
        texts = texts.groupBy("cid").agg(*[F.first(c).alias(c) for c in texts.columns[1:]])
    texts = (texts.select("cid", "comp", "copies", "block", "text", other.alias("other"))
             .select("cid", "comp", "copies", "block", "text",
                     F.least("block", "other").alias("first"),
                     F.greatest("block", "other").alias("second")))

    def compare(key, table):
        import pyarrow as pa

        first, second = key[1].as_py(), key[2].as_py()
        cid = table.column("cid").to_numpy()
        _, one = np.unique(cid, return_index=True)        # a repeated row comes again
        t = table.take(pa.array(one)).combine_chunks()
        cid = cid[one]
        # sets and MinHash values again from the texts: less than what it would
        # take to carry them through the shuffle
        found = shingle_sets(*column_bytes(t.column("text").chunk(0)), shingle)
        sig = np.stack([minhash(s) for s in found])
        links, low = compare_block(cid, t.column("copies").to_numpy(),
                                   t.column("block").to_numpy(), sig, found, first, second,
                                   threshold, tolerance)
        some = np.flatnonzero(links)
        return pa.table({"cid": cid[some], "low": cid[low[some]], "links": links[some]})

    links = written(spark, texts.groupBy("comp", "first", "second")
                    .applyInArrow(compare, "cid long, low long, links long"), "links")
    discard(spark, member)
    linked = components(links, "cid", "low")
    per_set = (sets.select("cls", "cid", "copies", "rep")
               .join(links.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
               .join(linked.withColumnRenamed("node", "cid"), "cid", "left")
               .withColumn("label", F.coalesce("label", "cid")))
    # written first, so that a hot class's rows can be split in the join
    best = written(spark, per_set.groupBy("label").agg(F.min("rep").alias("best")), "best")
    per_set = written(spark, per_set.join(best, "label").select(
        "cls", "rep", "best", (F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
        .alias("n_links")), "classes")
    discard(spark, links, linked, sets, best)
    return (rows.select("doc_id", "th", "cls", "row").join(per_set, "cls", "left")
            .select("doc_id", F.when(F.col("cls").isNull(), F.col("doc_id"))
                    .otherwise(F.col("best.doc_id")).alias("class_id"),
                    F.when(F.col("cls").isNull(), F.col("doc_id"))
                    .otherwise(F.col("rep.doc_id")).alias("set_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    (F.col("cls").isNull() | (F.col("row") == F.col("best.row"))).alias("kept"),
                    "th", F.col("cls").isNull().alias("alone")))


def join_classes(df: DataFrame, **options) -> DataFrame:
    """``near_copies`` without its text hash."""
    return near_copies(df, **options).drop("th", "alone")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             **options) -> DataFrame:
    """The rows of ``df`` that stay, one of each class, with all their columns (of
    rows that repeat id and text any one; rows without words all stay)."""
    found = written(df.sparkSession, near_copies(df, id_col, text_col, **options)
                    .select("doc_id", "th", "alone", "kept"), "near-copies")
    kept = found.filter("kept").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    same = df[id_col].eqNullSafe(kept["__id"]) & (F.xxhash64(df[text_col]) == kept["__th"])
    stay = df.join(kept, same, "left_semi")
    twice = found.filter("NOT alone").groupBy("doc_id", "th").agg(
        F.count_if("kept").alias("k"), F.count("*").alias("n")).filter("k > 0 AND n > 1")
    if twice.isEmpty():
        return stay
    # rows whose id and text repeat: one stays
    more = twice.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
    same = df[id_col].eqNullSafe(more["__id"]) & (F.xxhash64(df[text_col]) == more["__th"])
    return (stay.join(more, same, "left_anti").unionByName(
        stay.join(more, same, "left_semi").dropDuplicates([id_col, text_col])))
