"""Sources and sinks.

* A1 CSV with a header row, quoted fields that may hold newlines and
  doubled quotes, and an explicit schema (no inference pass over the data).
* A2 a folder of tables: every file becomes one lazily read table named by
  its file name without prefix and extension.  Listing uses the Hadoop file
  system of the session, so it works on HDFS/S3 as on a local disk.
* A3/A4 Parquet, the format between the engine's steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Words the source files use for a missing value.
MISSING_TEXT = ""
PART_ROWS = 1_000_000


def read_csv(spark: SparkSession, path: str, schema: StructType | str,
             null_value: str = MISSING_TEXT) -> DataFrame:
    """A1: header row, multi-line quoted fields, ``""`` as an escaped quote."""
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"')
            .option("nullValue", null_value)
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
            .option("mode", "FAILFAST")
            .csv(path))


def write_csv(df: DataFrame, path: str) -> None:
    """The CSV layout ``read_csv`` reads (timestamps as ``yyyy-MM-dd HH:mm:ss``), as
    compressed part files of PART_ROWS rows at most: such a file is read by one task."""
    (df.write.mode("overwrite").option("header", True)
     .option("compression", "gzip").option("maxRecordsPerFile", PART_ROWS)
     .option("quote", '"').option("escape", '"')
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
     .csv(path))


def write_parquet(df: DataFrame, path: str) -> None:
    """A3: persist a table."""
    df.write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """A4: read a persisted table back."""
    return spark.read.parquet(path)


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """File paths directly inside ``folder`` (Hadoop file system listing)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(conf)
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(p)
                  if not s.getPath().getName().startswith(("_", ".")))


def version(spark: SparkSession, paths: str) -> str:
    """Length and change time of comma-separated files or folders' members: a
    key that differs once a source has changed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for text in paths.split(","):
        p = jvm.org.apache.hadoop.fs.Path(text)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            out += [f"{s.getPath().getName()}:{s.getLen()}:{s.getModificationTime()}"
                    for s in fs.listStatus(p)]
    return ",".join(sorted(out))


def table_name(path: str, prefix: str = "", extension: str = "") -> str:
    """A2: file name with ``prefix`` cut from the front and ``extension``
    from the end."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if prefix and prefix in name:
        name = name.split(prefix)[-1]
    if extension and name.endswith(extension):
        name = name[: -len(extension)]
    return name


def load_folder(spark: SparkSession, folder: str, fmt: str = "parquet",
                prefix: str = "", extension: str = ".parquet") -> dict[str, DataFrame]:
    """A2: one lazily read DataFrame per file of the folder."""
    out = {}
    for path in list_files(spark, folder):
        if extension and not path.endswith(extension):
            continue
        out[table_name(path, prefix, extension)] = spark.read.format(fmt).load(path)
    return out


def table_sizes(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table as one frame (one Spark job, nothing collected)."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
             .select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in sorted(tables.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
