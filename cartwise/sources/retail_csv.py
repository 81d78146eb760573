"""The nine retail tables from CSV files (A1).

A file's header names its columns; known columns get their type by name and
any other one stays text, so files with more columns load as they are.  Only
``order_reviews`` holds free text with line ends, and only that file is read
as one stream; the others are split over tasks.

The planner takes a compressed file's size for its rows' and would broadcast
millions of them, so the tables that join others say how they are joined.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartwise.functions.scalar import parse_timestamp
from cartwise.sources.files import write_csv

TABLES = ("customers", "geolocation", "order_items", "order_payments", "order_reviews",
          "orders", "products", "sellers", "product_translation")
MULTI_LINE = frozenset({"order_reviews"})
# Tables that grow with the orders are never broadcast, those of the parties are if small.
FACTS = ("orders", "order_items", "order_payments", "order_reviews")
DIMENSIONS = ("customers", "products", "sellers")
# The largest dimension that is broadcast, in bytes of its rows in a hash
# table, and the bytes there of a row and of a column; those of texts come on top.
BROADCAST_BYTES = 4 * 1024 * 1024
ROW_BYTES, COLUMN_BYTES = 32, 8

# The type of each known column; identifiers and names are text.
COLUMN_TYPES = {
    "customer_zip_code_prefix": "int", "seller_zip_code_prefix": "int",
    "geolocation_zip_code_prefix": "int", "geolocation_lat": "double",
    "geolocation_lng": "double", "order_item_id": "int", "price": "double",
    "freight_value": "double", "payment_sequential": "int", "review_score": "double",
    "order_purchase_timestamp": "timestamp_ntz",
    "order_delivered_customer_date": "timestamp_ntz",
}
# The words that stand for a missing value.
MISSING_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
                 "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_table(spark: SparkSession, path: str, multi_line: bool = False,
               types: dict[str, str] | None = None,
               missing: tuple[str, ...] = MISSING_WORDS) -> DataFrame:
    """One CSV file (or folder of part files) with typed columns.  A value that
    isn't of its column's type raises when it is read."""
    types = COLUMN_TYPES | (types or {})
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": multi_line,
               "mode": "FAILFAST", "inferSchema": False}
    raw = spark.read.options(**options).csv(path)         # reads the header only

    def typed(name: str):
        text = F.when(~F.col(f"`{name}`").isin(*missing), F.col(f"`{name}`"))
        kind = types.get(name, "string")
        if kind == "timestamp_ntz":
            return parse_timestamp(text).alias(name)
        return text.cast(kind).alias(name)

    return raw.select(*[typed(c) for c in raw.columns])


def bytes_in_memory(df: DataFrame) -> DataFrame:
    """The bytes of all rows of ``df`` in a hash table, as one row."""
    row = F.lit(ROW_BYTES + COLUMN_BYTES * len(df.columns)).cast("bigint")
    for c, kind in df.dtypes:
        if kind == "string":
            row = row + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    return df.agg(F.coalesce(F.sum(row), F.lit(0)).alias("n_bytes"))


def with_join_hints(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with the way they are joined: facts and large dimensions by
    shuffles, dimensions whose rows are few as broadcasts.  Dimensions are
    measured by one job, which reads them once."""
    sizes = [bytes_in_memory(tables[t]).select(F.lit(t).alias("name"), "n_bytes")
             for t in DIMENSIONS]
    small = {r["name"] for r in reduce(DataFrame.unionByName, sizes).collect()
             if r["n_bytes"] <= BROADCAST_BYTES}
    way = dict.fromkeys(FACTS, "merge") | {t: "broadcast" if t in small else "merge"
                                           for t in DIMENSIONS}
    return {t: df.hint(way[t]) if t in way else df for t, df in tables.items()}


def load_csv_tables(spark: SparkSession, folder: str, prefix: str = "", suffix: str = ".csv",
                    names: dict[str, str] | None = None,
                    types: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The nine tables of ``folder``: ``prefix`` + table + ``suffix`` each,
    unless ``names`` gives a file's name."""
    names = names or {}
    return with_join_hints({
        t: read_table(spark, f"{folder.rstrip('/')}/{names.get(t, prefix + t + suffix)}",
                      t in MULTI_LINE, types) for t in TABLES})


def write_csv_tables(tables: dict[str, DataFrame], folder: str, suffix: str = ".csv") -> None:
    """Write tables in the layout that ``load_csv_tables`` reads."""
    for name, df in tables.items():
        write_csv(df, f"{folder.rstrip('/')}/{name}{suffix}")
