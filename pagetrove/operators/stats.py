"""Crawl counters."""

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.urls import url_host


def counters():
    """Responses, and how many of them were fetched and refused."""
    fetched = F.coalesce(F.col("status") == 200, F.lit(False))
    return (
        F.count("*").alias("responses"),
        F.count_if(fetched).alias("fetched"),
        F.count_if(~fetched).alias("refused"),
    )


def observe_crawl(responses: DataFrame) -> tuple[DataFrame, Observation]:
    """Count responses while another job reads them; ``.get`` after that job."""
    seen = Observation()
    return responses.observe(seen, *counters()), seen


def crawl_stats(responses: DataFrame) -> DataFrame:
    """Responses per host. Partial counts leave a hot host one row per task."""
    return responses.groupBy(url_host(F.col("url")).alias("host")).agg(*counters())
