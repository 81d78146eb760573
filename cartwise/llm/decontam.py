"""Benchmark decontamination by a prefix-filtered set join.

A window is 13 consecutive words of a benchmark item (a shorter item is one
window).  Each window is the sequence of its word shingles.  All shingles of
the documents are counted, and the shingles of a window ordered by rarity.
As a window must occur whole, the shortest prefix of that order, its rarest
shingle, is enough: only documents that have it, at a place that leaves room
for the window, are candidates.  A candidate is verified word by word.

Both passes read the texts once and shuffle counts or hits only.  A benchmark of
up to BROADCAST_BYTES is broadcast.  A larger one is joined by shuffle: a bit set
of its shingles' hashes, of a fixed size at most, is broadcast instead and lets
through the document shingles that may be in it; those travel with the few words
around them, never with their text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from .common import once, words, written

WINDOW = 13
SHINGLE = 5
BROADCAST_BYTES = 64 << 20   # of windows and their shingles
BITS_A_ROW = 1 << 15         # of the bit set
MOST_BITS = 1 << 27          # 16 MB


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """The distinct windows (words) with the sorted distinct ids of their items,
    without null ones: an item that has none still has windows."""
    w = benchmark.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("ws")) \
        .filter("size(ws) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("ws") - F.lit(window - 1)))
    return (w.select("item_id", "ws", F.explode(starts).alias("at"))
            .select("item_id", F.slice("ws", F.col("at"), F.lit(window)).alias("win"))
            .groupBy("win").agg(F.sort_array(F.collect_set("item_id")).alias("items")))


def _word_hashes(ws: Column) -> Column:
    return F.transform(ws, lambda w: F.xxhash64(w))


def _hash_at(hs: Column, at: Column, k: int) -> Column:
    """Hash of the k words from ``at`` on, from the words' hashes (element
    access: slice() would copy the whole array each time)."""
    return F.xxhash64(*[F.get(hs, at + j) for j in range(k)])


def _doc_shingles(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, th, ws, pos, h): every shingle of the given lengths, and once a
    row pos -1, so that documents without a hit keep a row."""
    n = F.size("ws")
    none = F.array().cast("array<bigint>")

    def of_length(k: int) -> Column:
        shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), n - k)),
                               lambda i: _hash_at(F.col("hs"), i, k))
        return F.when(n >= k, shingles).otherwise(none)

    # the place in the joined array: 0 is the row itself, then each length's shingles
    first, pos = F.lit(1), F.lit(-1)
    for k in lengths:
        pos = F.when(F.col("at") >= first, F.col("at") - first).otherwise(pos)
        first = first + F.greatest(F.lit(0), n - (k - 1))
    hashed = once(docs.withColumn("hs", _word_hashes(F.col("ws"))))
    return (hashed.withColumn("sh", F.concat(F.array(F.lit(0).cast("long")),
                                             *[of_length(k) for k in lengths]))
            .select("doc_id", "th", "ws", F.posexplode_outer("sh").alias("at", "h"))
            .select("doc_id", "th", "ws", pos.alias("pos"), "h"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id",
                   item_text_col: str = "text", window: int = WINDOW,
                   shingle: int = SHINGLE) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items,
    items_sha256, contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    A null or empty text has no words and no hit; an empty benchmark hits
    nothing; items without words are left out.  Words in windows of an item with
    a null id are hit like others; ``n_items`` and ``items_sha256`` are of the
    distinct ids that aren't null.  Repeated rows give a row each.  Other columns
    of either table are not read.
    """
    return (_per_row(docs, benchmark, id_col, text_col, item_col, item_text_col, window, shingle)
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
            .drop("copies", "th", "__copy"))


def _per_row(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str,
             item_text_col: str, window: int, shingle: int) -> DataFrame:
    """The result with a row for each (doc_id, text hash) and its copies."""
    spark = docs.sparkSession
    wins = item_windows(benchmark, item_col, item_text_col, window)
    wins = written(spark, wins.select(F.xxhash64("win").alias("win_id"), "win", "items",
                                      F.size("win").alias("len"),
                                      F.least(F.lit(shingle), F.size("win")).alias("k")),
                   "windows")
    lengths = sorted(r[0] for r in wins.select("k").distinct().collect())   # at most `shingle`
    of_length = F.lit(None).cast("long")
    for k in lengths:
        of_length = F.when(F.col("k") == k, _hash_at(F.col("hs"), F.col("off"), k)) \
            .otherwise(of_length)
    parts = (wins.select("win_id", _word_hashes(F.col("win")).alias("hs"), "k",
                         F.explode(F.sequence(F.lit(0), F.col("len") - F.col("k"))).alias("off"))
             .select("win_id", "off", of_length.alias("h")))
    # a shingle's row; a window's words with their headers; the ids of its items
    size = wins.agg(F.sum((F.col("len") - F.col("k") + 1) * 24 + 24 * F.col("len")
                          + F.octet_length(F.concat_ws(" ", "win"))
                          + 16 * F.size("items"))).first()[0] or 0
    rows = once(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
                .select("doc_id", F.xxhash64("t").alias("th"), words(F.col("t")).alias("ws")))
    search = _found_by_broadcast if size <= BROADCAST_BYTES else _found_by_shuffle
    found = search(rows, wins, parts, lengths, window)
    merged = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["upto"]))).alias("n"),
            F.greatest(a["upto"], x["e"]).alias("upto")))["n"]
    per_doc = (found.groupBy("doc_id", "th")
               .agg(F.max("n_words").cast("long").alias("n_words"),
                    F.sum(F.when(F.col("pos") < 0, 1).otherwise(0)).alias("copies"),
                    F.collect_set("span").alias("spans"),
                    F.collect_set("items").alias("item_lists"))
               .withColumn("ids", F.array_sort(F.transform(
                   F.array_distinct(F.flatten("item_lists")), lambda x: x.cast("string"))))
               .select("doc_id", "th", "n_words", merged.cast("long").alias("n_hit"),
                       F.size("ids").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "ids"), 256).alias("items_sha256"), "copies"))
    return per_doc.withColumn("contaminated", (F.col("n_hit") > 0)
                              & (F.col("n_hit") * 20 >= F.col("n_words")))


def _counts(passed: DataFrame) -> DataFrame:
    """(h, n): how often the documents have each of the benchmark's shingles."""
    return written(passed.sparkSession, passed.groupBy("h").agg(F.count(F.lit(1)).alias("n")),
                   "shingle-counts")


def _prefixes(wins: DataFrame, parts: DataFrame, counts: DataFrame) -> DataFrame:
    """(h, off, win, items): each window by its rarest shingle, the prefix of length
    one.  A window one of whose shingles never occurs has no match."""
    return (parts.join(counts, "h", "left")
            .groupBy("win_id")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("h"),
                                F.col("off"))).alias("p"))
            .filter("p.n > 0")
            .join(wins, "win_id")
            .select(F.col("p.h").alias("h"), F.col("p.off").alias("off"), "win", "items"))


def _found_by_broadcast(rows: DataFrame, wins: DataFrame, parts: DataFrame,
                        lengths: list[int], window: int) -> DataFrame:
    """(doc_id, th, pos, n_words, span, items): a row with pos -1 for each document
    row, and one for each place where a window stands in it.  The windows and their
    shingles are broadcast."""
    spark = rows.sparkSession
    shingles = _doc_shingles(rows, lengths)
    counts = _counts(shingles.select("h", "pos").filter("pos >= 0")
                     .join(F.broadcast(parts.select("h").distinct()), "h"))
    prefix = _prefixes(wins, parts, counts)
    prefix = prefix.unionByName(spark.range(1).select(
        F.lit(0).cast("long").alias("h"), F.lit(-1).alias("off"),
        F.lit(None).cast("array<string>").alias("win"),
        F.lit(None).cast(dict(wins.dtypes)["items"]).alias("items")))
    # off -1 is the row that keeps documents without hits
    at = F.col("pos") - F.col("off")
    return (shingles.join(F.broadcast(prefix), "h")
            .filter(((F.col("pos") < 0) & (F.col("off") < 0)) | (
                (F.col("pos") >= 0) & (F.col("off") >= 0) & (at >= 0)
                & (at + F.size("win") <= F.size("ws"))
                & (F.slice("ws", F.greatest(at, F.lit(0)) + 1,
                           F.greatest(F.size("win"), F.lit(0))) == F.col("win"))))
            .select("doc_id", "th", "pos", F.size("ws").alias("n_words"),
                    F.when(F.col("off") >= 0, F.struct(
                        at.alias("s"), (at + F.size("win")).alias("e"))).alias("span"),
                    "items"))


def _bit_set(hashes: DataFrame) -> tuple[DataFrame, int]:
    """((bucket, bits as 512 long numbers), number of bits in all) of the column h:
    64 bits a hash or more, up to MOST_BITS."""
    n = hashes.count()
    bits = max(BITS_A_ROW, min(MOST_BITS, 1 << (64 * max(1, n) - 1).bit_length()))
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    per_word = (hashes.select(slot.alias("s"))
                .groupBy(F.shiftright("s", 15).cast("int").alias("bucket"),
                         F.shiftright("s", 6).bitwiseAND(F.lit(511)).cast("int").alias("w"))
                .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("x")))
    words_of = per_word.groupBy("bucket").agg(
        F.map_from_entries(F.collect_list(F.struct("w", "x"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(511)),
                        lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long")))
    return written(hashes.sparkSession, words_of.select("bucket", dense.alias("bits")),
                   "bit-set"), bits


def _maybe_in(rows: DataFrame, bit_set: tuple[DataFrame, int]) -> DataFrame:
    """The rows whose h may be in the set (all that are, and few others)."""
    table, bits = bit_set
    slot = F.col("h").bitwiseAND(F.lit(bits - 1))
    word = F.get("bits", F.shiftright(slot, 6).bitwiseAND(F.lit(511)).cast("int"))
    return (rows.withColumn("bucket", F.shiftright(slot, 15).cast("int"))
            .join(F.broadcast(table), "bucket")
            .where(F.getbit(word, slot.bitwiseAND(F.lit(63)).cast("int")) == 1)
            .drop("bucket", "bits"))


def _found_by_shuffle(rows: DataFrame, wins: DataFrame, parts: DataFrame,
                      lengths: list[int], window: int) -> DataFrame:
    """The rows of ``_found_by_broadcast`` for a benchmark of any size.  What is
    shuffled of the documents is a few numbers a row, and shingles that the bit set
    lets through, in the second pass with the words around them."""
    spark = rows.sparkSession
    shingles = _doc_shingles(rows, lengths).filter("pos >= 0")
    hashes = written(spark, parts.select("h").distinct(), "benchmark-shingles")
    counts = _counts(_maybe_in(shingles.select("h"), _bit_set(hashes))
                     .join(hashes.hint("shuffle_merge"), "h"))
    prefix = written(spark, _prefixes(wins, parts, counts), "prefixes")
    # a window reaches less than its length before and behind its shingle
    first = F.greatest(F.lit(0), F.col("pos") - window)
    near = _maybe_in(shingles, _bit_set(prefix.select("h").distinct())).select(
        "doc_id", "th", "pos", F.size("ws").alias("n_words"), "h", first.alias("first"),
        F.slice("ws", first + 1, F.lit(3 * window)).alias("around"))
    at = F.col("pos") - F.col("off")
    hits = (near.join(prefix.hint("shuffle_merge"), "h")
            .filter((at >= 0) & (at + F.size("win") <= F.col("n_words"))
                    & (F.slice("around", F.greatest(F.lit(0), at - F.col("first")) + 1,
                               F.size("win")) == F.col("win")))
            .select("doc_id", "th", "pos", "n_words",
                    F.struct(at.alias("s"), (at + F.size("win")).alias("e")).alias("span"),
                    "items"))
    own = rows.select("doc_id", "th", F.lit(-1).alias("pos"), F.size("ws").alias("n_words"),
                      F.lit(None).cast(dict(hits.dtypes)["span"]).alias("span"),
                      F.lit(None).cast(dict(wins.dtypes)["items"]).alias("items"))
    return own.unionByName(hits)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns.
    Rows that share an id are told apart by their texts."""
    bad = (_per_row(docs, benchmark, id_col, text_col, "item_id", "text", WINDOW, SHINGLE)
           .filter("contaminated")
           .select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")))
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__id"])
                     & (F.xxhash64(docs[text_col]) == bad["__th"]), "left_anti")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, list_slice(ws, p, p + 12) AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(2, len(ws) - 11))) AS p
        FROM bw WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(win) AS l FROM wins),
grams AS (
  SELECT doc_id, p, l, list_slice(ws, p, p + l - 1) AS win
  FROM (SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS p
        FROM dw, lens WHERE len(ws) >= l)),
hits AS (SELECT g.doc_id, g.p, g.l, w.item_id FROM grams g JOIN wins w ON g.win = w.win),
cover AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM (SELECT DISTINCT doc_id, p, l FROM hits))
  GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits WHERE item_id IS NOT NULL)
  GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
       coalesce(i.n_items, 0)::BIGINT AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.ws) AS contaminated
FROM dw d LEFT JOIN cover c ON c.doc_id = d.doc_id LEFT JOIN its i ON i.doc_id = d.doc_id
"""
