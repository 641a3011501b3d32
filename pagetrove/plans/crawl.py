"""A crawl replayed over recorded responses."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import url_key
from ..operators.links import expand_frontier, key_edges, link_edges, page_keys, undiscovered
from ..operators.seen import seen_within_ttl
from ..operators.stats import crawl_stats
from ..session import settle
from ..sources.pages import filter_status, to_raw_page


class Crawl(NamedTuple):
    reached: DataFrame
    items: DataFrame
    next_urls: DataFrame
    stats: DataFrame


def crawl(responses: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> Crawl:
    """Follow navigation links from the seeds through a snapshot.

    ``reached``: (url_key, depth). ``items``: raw pages reached, as they go into
    a feed. ``next_urls``: their links that the snapshot lacks. ``stats``:
    responses per host, refused ones included.
    """
    fetched, _ = filter_status(responses)
    edges = settle(link_edges(to_raw_page(fetched)), "links")
    seed_keys = seeds.select(url_key(F.col("url")).alias("url_key"))
    reached = expand_frontier(key_edges(edges), page_keys(fetched), seed_keys, max_depth)
    keys = reached.select("url_key")
    items = fetched.withColumn("url_key", url_key(F.col("url"))).join(keys, "url_key", "left_semi")
    followed = edges.withColumn("url_key", url_key(F.col("src_url"))).join(keys, "url_key", "left_semi")
    return Crawl(
        reached, to_raw_page(items), undiscovered(followed, fetched), crawl_stats(responses)
    )


def crawl_items(responses: DataFrame, ttl: int) -> DataFrame:
    """Responses that go into the feed: fetched, and not seen within the TTL.

    ``responses`` holds url, status, content, the fetch instant ``t`` and an ``id`` that tells
    fetches of one URL at one instant apart. Sightings are judged on narrow rows; pages are only
    matched with the url, instant and id of the suppressed few, which Spark broadcasts while
    they are small. A response without a URL has no key to be seen under; it is not suppressed.
    """
    fetched, _ = filter_status(responses)
    sightings = settle(fetched.select(F.col("url").alias("key"), "t", "id"), "sightings")
    emitted = seen_within_ttl(sightings, ttl).select("key", "t", "id")
    keyed = sightings.where(F.col("key").isNotNull())
    suppressed = settle(keyed.join(emitted, ["key", "t", "id"], "left_anti"), "suppressed")
    return fetched.join(suppressed.withColumnRenamed("key", "url"), ["url", "t", "id"], "left_anti").select(
        *fetched.columns
    )
