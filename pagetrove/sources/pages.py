"""Recorded responses: a snapshot of fetched pages stands in for the network."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def spread(df: DataFrame) -> DataFrame:
    """Use every core when a scan has fewer splits than the cluster has cores.

    Large inputs have more splits than that and are left alone: raw HTML is
    never shuffled at scale. Call it on a plain scan only.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def page_source(spark: SparkSession, path: str, has_status: bool = False) -> DataFrame:
    """Responses as (page_id, url, status, content) from a parquet snapshot.

    ``html`` becomes ``content``; ``status`` is 200 where none was recorded.
    """
    schema = "page_id long, url string, html string" + (", status int" if has_status else "")
    status = F.col("status") if has_status else F.lit(200).alias("status")
    return spread(spark.read.schema(schema).parquet(path)).select(
        "page_id", "url", status, F.col("html").alias("content")
    )


def to_raw_page(responses: DataFrame) -> DataFrame:
    """The crawl item: url and page text."""
    return responses.select("url", "content")


def filter_status(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split responses into those with status 200 and the refused rest.

    The refused side keeps no page text; a null status is refused.
    """
    fetched = F.coalesce(F.col("status") == 200, F.lit(False))
    return responses.where(fetched), responses.where(~fetched).drop("content")
