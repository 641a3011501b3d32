"""Ingest of feed objects as they arrive."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.ingest import ingest
from ..schemas import FEED_LINE
from ..sources.store import BATCH, RUN


def stream_feed(spark: SparkSession, path: str, objects_per_trigger: int | None = None) -> DataFrame:
    """New feed objects under ``path`` as a stream of lines with their file."""
    reader = (
        spark.readStream.schema(FEED_LINE)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    )
    if objects_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", objects_per_trigger)
    return reader.json(path).select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def ingest_stream(
    spark: SparkSession,
    feed_path: str,
    store_path: str,
    checkpoint: str,
    rejects_path: str | None = None,
    objects_per_trigger: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run ``ingest`` on every micro-batch; by default on what is there, then stop.

    A micro-batch is a store batch of the run that the checkpoint stands for, so one
    that is repeated after a failure replaces what it wrote before, and streams with checkpoints of
    their own do not touch each other's.
    """

    def run(lines: DataFrame, number: int) -> None:
        name = lines.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        result = ingest(
            lines.withColumn("_seq", F.monotonically_increasing_id()), store_path, number, run=name
        )
        if rejects_path is not None:
            result.rejects.write.mode("overwrite").parquet(f"{rejects_path}/{RUN}={name}/{BATCH}={number}")

    return (
        stream_feed(spark, feed_path, objects_per_trigger)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
