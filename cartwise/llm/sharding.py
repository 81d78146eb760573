"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of
prime size; the shards take turns, each claiming its next free slot, until
the table is full.  A document's hash picks a slot and the slot names the
shard.  A shard more or less changes few other slots.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 64
SLOTS = 6421          # prime, about 100 slots a shard


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n ** 0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """(first slot, step) of a shard's order over the slots."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % slots, 1 + int(digest[15:30], 16) % (slots - 1)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """Slot -> index of the shard.  ``slots`` must be prime and not less than
    the number of shards; the names must differ."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shard names must differ, and there must be one at least")
    if not _is_prime(slots) or slots < len(names):
        raise ValueError("slots must be a prime not less than the number of shards")
    prefs = [preference(n, slots) for n in names]
    at, table, left = [0] * len(names), [-1] * slots, slots
    while True:
        for i, (offset, step) in enumerate(prefs):
            slot = (offset + at[i] * step) % slots
            while table[slot] >= 0:
                at[i] += 1
                slot = (offset + at[i] * step) % slots
            table[slot] = i
            at[i] += 1
            left -= 1
            if not left:
                return table


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:05d}" for i in range(n)]


def assign_shards(df: DataFrame, key_col: str = "doc_id", names: list[str] | None = None,
                  slots: int = SLOTS) -> DataFrame:
    """One row per input row: doc_id, slot, shard (index into ``names``).

    The slot is md5 of the key as text, modulo the table size; a null key
    hashes as the empty text.  Equal keys share a shard.  The table has
    ``slots`` numbers whatever the input, so it is broadcast.  No shuffle of
    the documents; other columns are not read.
    """
    spark = df.sparkSession
    names = shard_names() if names is None else names
    placed = spark.createDataFrame(list(enumerate(lookup_table(names, slots))),
                                   "slot long, shard int")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots
    return (df.select(F.col(key_col).alias("doc_id")).withColumn("slot", slot)
            .join(F.broadcast(placed), "slot").select("doc_id", "slot", "shard"))


def write_shards(df: DataFrame, path: str, key_col: str = "doc_id",
                 names: list[str] | None = None, slots: int = SLOTS,
                 folder: str = "shard", writers: int | None = None) -> None:
    """Write ``df`` as Parquet below ``path``, a folder ``<folder>=i`` for each shard,
    with all its columns; one of them named like ``folder`` is an error, as the
    folder's name is a column of what is read back.  Rows are dealt by (shard, hash of
    the row), ``writers`` parts a shard (by default as many as give each of the
    session's shuffle partitions one)."""
    if folder in df.columns:
        raise ValueError(f"the table has a column {folder!r}: name the folders otherwise")
    spark = df.sparkSession
    names = shard_names() if names is None else names
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    writers = writers or max(1, -(-parts // len(names)))
    placed = spark.createDataFrame(list(enumerate(lookup_table(names, slots))),
                                   "slot long, shard int")
    key = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots
    rows = df.select(F.struct("*").alias("row"), slot.alias("slot"),
                     F.pmod(F.xxhash64(*df.columns), F.lit(writers)).alias("part"))
    (rows.join(F.broadcast(placed), "slot")
     .repartition(max(parts, len(names)), "shard", "part")
     .select("row.*", F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path))


# The fill as a recursive query: one row a turn, `taken` as a list of flags.
ORACLE = f"""
WITH RECURSIVE prefs AS (
  SELECT i, ('0x' || substr(m, 1, 15))::BIGINT % {SLOTS} AS o,
         1 + ('0x' || substr(m, 16, 15))::BIGINT % {SLOTS - 1} AS step
  FROM (SELECT i, md5('shard-' || lpad(i::VARCHAR, 5, '0')) AS m FROM range({SHARDS}) r(i))),
p AS (SELECT list(o ORDER BY i) AS o, list(step ORDER BY i) AS step FROM prefs),
fill AS (
  SELECT 0 AS turn, -1::BIGINT AS slot, list_transform(range({SLOTS}), lambda x: 0) AS taken
  UNION ALL
  SELECT turn + 1, s, list_transform(taken, lambda x, k: CASE WHEN k = s + 1 THEN 1 ELSE x END)
  FROM (SELECT turn, taken,
               (o[turn % {SHARDS} + 1] + step[turn % {SHARDS} + 1]
                * list_filter(range({SLOTS}), lambda j: taken[(o[turn % {SHARDS} + 1]
                    + j * step[turn % {SHARDS} + 1]) % {SLOTS} + 1] = 0)[1]) % {SLOTS} AS s
        FROM fill, p WHERE turn < {SLOTS}) q)
SELECT d.doc_id, d.slot, ((f.turn - 1) % {SHARDS})::INT AS shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT
             % {SLOTS} AS slot FROM documents) d
JOIN fill f ON f.slot = d.slot
"""
