"""One row per URL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_key


def unique_url(docs: DataFrame, order: list[str], key: str = "url") -> DataFrame:
    """Keep the earliest row per URL; rows without a URL stay, no two of them are copies.

    ``order`` must identify a row among those of its URL. The earliest place of each URL comes from an aggregate over
    narrow rows, combined per task before the shuffle; documents are only matched with the places of
    the copies that lose, which Spark broadcasts while they are few. ``docs`` is read several times
    and should be a written table.
    """
    places = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.struct(*order).alias("_at"))
    first = places.groupBy("_key").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    copied = first.where(F.col("_n") > 1).drop("_n")
    lost = places.join(copied, "_key").where(F.col("_at") != F.col("_first")).select(
        F.col("_key").alias(key), *[F.col("_at")[c].alias(c) for c in order]
    )
    return docs.join(lost, [key, *order], "left_anti").select(*docs.columns)


def frontier_dedup(urls: DataFrame, url: str = "url") -> DataFrame:
    """Distinct pages to fetch: (url_key, url), the smallest spelling of each."""
    return urls.groupBy(url_key(F.col(url)).alias("url_key")).agg(F.min(url).alias("url"))
