"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..session import scratch_path

_SHIPPED: set[str] = set()
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The copy cuts the lineage: it outlives lost executors, and its readers
    know its size.
    """
    path = scratch_path(spark, f"cartwise-llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    _MADE.append(path)
    return out


def discard(spark: SparkSession, *what: DataFrame | str | None) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for x in what:
        path = x if isinstance(x, str) else getattr(x, "_written_at", None)
        if path in _MADE:
            _MADE.remove(path)
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def made() -> list[str]:
    """Tables that ``written`` made and that still exist."""
    return list(_MADE)


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once a session.

    Workers then import the functions by name wherever they run.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="cartwise-src-"), "cartwise_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(target)
    _SHIPPED.add(sc.applicationId)


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows (reads no more than that)."""
    return df.limit(most_rows + 1).count() <= most_rows


def once(df: DataFrame) -> DataFrame:
    """``df`` with its expressions computed once a row: the optimizer doesn't
    merge a later projection, or a lambda in it, with what stands below a
    generator."""
    return df.select(F.explode(F.array(F.struct(*[F.col(c) for c in df.columns])))
                     .alias("r")).select("r.*")


def ascii_lower(c: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)) \
        .otherwise(F.translate(c, upper, upper.lower()))


# what stands between words; a word is digits, letters a-z and all beyond ASCII
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(c: Column) -> Column:
    """The words of a text in order; null has none."""
    parts = F.split(ascii_lower(F.coalesce(c, F.lit(""))), BETWEEN)
    return F.array_remove(parts, "")


def arrow_bound(spark: SparkSession, rows: int = 256, size: str = "8m") -> None:
    """Keep the Arrow batches sent to Python small, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def slices_by_bytes(batches, column: int, limit: int):
    """Cut Arrow batches into slices whose ``column`` holds about ``limit``
    bytes at most (one row at least)."""
    import pyarrow.compute as pc

    for b in batches:
        sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < b.num_rows:
            yield b.slice(start)
