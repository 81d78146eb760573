"""A whole table in order, with global positions (F1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartwise.session import stored


def sorted_positions(data: DataFrame, order_columns: Sequence[str], out: str = "position",
                     parts: int | None = None) -> DataFrame:
    """``row_number() OVER (ORDER BY order_columns)``, ascending with missing values
    last, without a task that sees the whole table.

    Rows are dealt by sampled ranges of the order, sorted in their part and written
    with the part's number and their place in it: both are data from then on, which
    a re-plan or a lost executor can't change.  A row's position is its place plus
    the rows of the parts before it, a table of one row a part.  Ties go by a hash of
    the whole row, so a value that very many rows share spreads over parts; only rows
    equal in every column stay together, and any order of those is the same."""
    parts = parts or int(data.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [*[F.col(c).asc_nulls_last() for c in order_columns],
             F.xxhash64(*data.columns).asc()]
    dealt = data.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the part's number in the upper bits, the place in the part in the lower 33
    written = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("__at", 33).alias("__part")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    base = (written.groupBy(part).agg(F.count(F.lit(1)).alias("_n"))
            .select("__part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")))
    place = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return (written.select("*", part).join(F.broadcast(base), "__part")
            .select(*data.columns, (F.col("_base") + place + 1).alias(out)))
