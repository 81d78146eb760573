"""Session helpers.

The library never creates a cluster session on its own: every public
function takes the caller's ``SparkSession``.  ``local_session`` is for
tests, the bench and the command line only.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings the plans rely on.  AQE re-plans joins at runtime (broadcast
# conversion by measured size, skew splitting, partition coalescing).
SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # coalesce shuffle partitions by size (advisory 64 MB), not to one per core
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

# Tables between the steps are written once and read a few times: size counts.
STORED_COMPRESSION = "zstd"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "cartwise") -> SparkSession:
    """A local session for tests and benchmarks (UI off, UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in SQL_DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder of the session.

    On a cluster ``spark.checkpoint.dir`` names a shared (HDFS/S3/...)
    folder and is used as is.  Only when it is unset -- local runs and
    tests -- a fresh folder under the system temp dir is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            # a temp folder would be local to the driver machine: executors
            # could neither write nor read it
            raise RuntimeError("set spark.checkpoint.dir to a shared folder "
                               "(HDFS/S3/...) for the prepared tables")
        conf = tempfile.mkdtemp(prefix="cartwise-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later uses scan
    the file, and a lost executor does too."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.option("compression", STORED_COMPRESSION).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path inside the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name
