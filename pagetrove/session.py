"""Session settings and the shared folder that long jobs write through."""

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "pagetrove", cores: str = "*", **conf: str) -> SparkSession:
    """Local session for tests, the bench and trial runs."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PAGETROVE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        # Call-site capture costs a round trip per column expression.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    Only a local session without that setting falls back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="pagetrove-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def _run_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/pagetrove/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the part of the shared folder that belongs to this application."""
    return f"{_run_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder.

    For the end of a job: results that were not written elsewhere go with it.
    """
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(_run_folder(spark))
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts lineage, so a lost executor costs one stage and not the whole job, and
    keeps later reads columnar, pruned and sized for the optimizer.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``settle`` with the number of rows, counted while they are written."""
    rows = Observation()
    settled = settle(df.observe(rows, F.count(F.lit(1)).alias("rows")), name)
    return settled, rows.get["rows"]


def settle_bucketed(df: DataFrame, name: str, key: str, buckets: int) -> tuple[DataFrame, int]:
    """``settle`` in ``buckets`` buckets of ``key``, with the number of rows.

    Tables bucketed alike by their keys are joined without an exchange. Buckets are known to catalog tables
    only; this one's entry goes at once, what was read through it stays readable. Rows should come
    hash-partitioned by ``key`` into as many partitions, else every task writes a file per bucket.
    """
    spark, rows = df.sparkSession, Observation()
    table = f"pagetrove_{uuid.uuid4().hex}"
    counted = df.observe(rows, F.count(F.lit(1)).alias("rows"))
    try:
        counted.write.bucketBy(buckets, key).sortBy(key).option("path", scratch_path(spark, name)).saveAsTable(table)
        settled = spark.table(table)
        settled.schema  # resolved while the entry is there
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    return settled, rows.get["rows"]
