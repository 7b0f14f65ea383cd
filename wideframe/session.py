"""Session set-up and the one place where intermediate tables are materialised."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


# Whole-stage code puts all expressions of a row into one method, and the JVM interprets methods that
# grow too long. Rows wider than this go through projections that are split into small methods (measured:
# running totals of the aligned series, 700,000 rows, 7.5 s in one method and 2.9 s split).
# A task holds what it reads as objects where a fit caches it (measured: about 600 bytes per row of five inputs, 20
# as Parquet), so scans are cut finer than Spark's 128 MB, and staged files end after ROWS_PER_FILE rows.
WIDE_ROW_SETTINGS = {"spark.sql.codegen.maxFields": "50", "spark.sql.files.maxPartitionBytes": "8m"}
ROWS_PER_FILE = 250_000


def prepare(spark: SparkSession) -> SparkSession:
    """Set what wide rows need on a session that others made; runtime settings only."""
    for key, value in WIDE_ROW_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "wideframe", cpus: str = "*", **conf) -> SparkSession:
    """A local session for tests and the benchmark; clusters bring their own session."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | WIDE_ROW_SETTINGS | conf
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for staged tables: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    made = tempfile.mkdtemp(prefix="wideframe-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir()


_STAGED: dict[str, list[str]] = {}


def staged_path(spark: SparkSession, label: str) -> str:
    """A folder of its own in the shared folder, remembered for ``release``."""
    path = os.path.join(shared_dir(spark), f"{label}-{uuid.uuid4().hex}")
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete what this application has staged so far, once its results are written; returns the number of folders.

    Results are lazy, so only the caller knows when no frame needs its staged inputs any more.
    """
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        folder = hadoop(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return len(paths)


def stage(df: DataFrame, label: str = "stage", partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back, in a folder per value of ``partition_by``.

    Cuts lineage so that a lost executor costs a re-read and not a recomputation, and pins values
    that a re-evaluation could change (range-partition ids, sketches). Parquet keeps later reads
    column-pruned. A file has at most ``ROWS_PER_FILE`` rows, so that tasks that read it get their share of rows and not of bytes.
    """
    path = staged_path(df.sparkSession, label)
    df.write.partitionBy(*partition_by).option("maxRecordsPerFile", ROWS_PER_FILE).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select([f"`{c}`" for c in df.columns])


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of a scan or staged table that comes in fewer splits than there are cores.

    For input in a few unsplittable files before work that is heavy per row. A table with enough
    splits, as any large one has, is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
