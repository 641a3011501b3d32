"""The link graph of a page snapshot and what can be reached in it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.html import nav_links, strip_invisible
from ..functions.urls import UrlParts, links_count, resolve_link, rewrite_link, url_key, url_parts
from ..session import settle, settle_bucketed


def _with_parts(df: DataFrame, url: str, prefix: str) -> tuple[DataFrame, UrlParts]:
    """Add the parts of a URL column as columns, so that each is worked out once."""
    parts = url_parts(F.col(url))
    names = [f"_{prefix}_{name}" for name in parts._fields]
    return df.select("*", *[c.alias(n) for c, n in zip(parts, names)]), UrlParts(*map(F.col, names))


def link_edges(pages: DataFrame) -> DataFrame:
    """One row (src_url, pos, href, dst_url) per followed navigation link.

    ``pos`` counts all links of a page. Narrow: no shuffle.
    """
    sources, source = _with_parts(pages.select("url", "content"), "url", "src")
    # Pages whose links do not count are dropped before their HTML is searched.
    html = sources.where(links_count(source)).withColumn("_html", strip_invisible(F.col("content")))
    hrefs = html.select("*", F.posexplode(nav_links(F.col("_html"))).alias("pos", "href"))
    links, link = _with_parts(hrefs.drop("_html", "content"), "href", "dst")
    target = resolve_link(rewrite_link(F.col("href"), link, source), source.scheme)
    return links.select(F.col("url").alias("src_url"), "pos", "href", target.alias("dst_url"))


def key_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src_key, dst_key) of an edge table."""
    return edges.select(
        url_key(F.col("src_url")).alias("src_key"), url_key(F.col("dst_url")).alias("dst_key")
    ).distinct()


def page_keys(pages: DataFrame) -> DataFrame:
    """Distinct ``url_key`` of a snapshot."""
    return pages.select(url_key(F.col("url")).alias("url_key")).distinct()


def undiscovered(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Linked pages that the snapshot lacks: (url_key, url, links), the next crawl list.

    Link targets and page keys meet in one aggregate instead of a join: both are
    combined per task before the only shuffle by key, so a target that many pages
    share is no hot key.
    """
    linked = edges.groupBy("dst_url").agg(F.count("*").alias("links"))
    targets = linked.select(
        url_key(F.col("dst_url")).alias("url_key"),
        F.col("dst_url").alias("url"),
        "links",
        F.lit(False).alias("there"),
    )
    there = pages.select(
        url_key(F.col("url")).alias("url_key"),
        F.lit(None).cast("string").alias("url"),
        F.lit(0).cast("long").alias("links"),
        F.lit(True).alias("there"),
    )
    met = targets.unionByName(there).groupBy("url_key").agg(
        F.min("url").alias("url"), F.sum("links").alias("links"), F.max("there").alias("there")
    )
    return met.where(~F.col("there")).drop("there")


# Keys of a frontier up to which the next links are looked up by name.
FEW_KEYS = 256


def _links_of(edges: DataFrame, newest: DataFrame, rows: int) -> DataFrame:
    """``url_key`` of what the newest pages link to.

    A few keys become a condition, by which only their buckets are read. More are joined, bucket by bucket.
    """
    if rows <= FEW_KEYS:
        found = edges.where(F.col("src_key").isin([row[0] for row in newest.collect()]))
    else:
        found = edges.join(newest, F.col("src_key") == F.col("url_key"), "left_semi")
    return found.select(F.col("dst_key").alias("url_key"))


def expand_frontier(
    edges: DataFrame,
    pages: DataFrame,
    seeds: DataFrame,
    max_depth: int | None = None,
    merge_every: int = 8,
) -> DataFrame:
    """Pages reached from the seeds: (url_key, depth).

    ``edges`` holds (src_key, dst_key), ``pages`` and ``seeds`` hold ``url_key``.
    Round by round: the links of the newest pages, distinct, not reached before,
    present in the snapshot (links to other pages are dropped once, before the rounds). Each round is written to the
    shared folder, so plans stay short and a lost executor costs one round. Ends when a round finds
    nothing, so cycles are harmless.

    Edges are bucketed by source and everything reached by key, in as many buckets as a shuffle has
    partitions: a round exchanges the links it found and nothing else. Page keys are distinct, so joins
    on them have no hot key.
    """
    buckets = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pages = settle(pages.select("url_key").distinct(), "pages")
    inside = edges.select("src_key", "dst_key").distinct().join(
        pages.withColumnRenamed("url_key", "dst_key"), "dst_key", "left_semi"
    ).select("src_key", "dst_key")
    edges, _ = settle_bucketed(inside.repartition(buckets, "src_key"), "edges", "src_key", buckets)
    first = pages.join(seeds.select("url_key"), "url_key", "left_semi").repartition(buckets, "url_key")
    newest, rows = settle_bucketed(first, "seeds", "url_key", buckets)
    reached, depth = [newest.withColumn("depth", F.lit(0))], 0
    while rows and (max_depth is None or depth < max_depth):
        depth += 1
        fresh = _links_of(edges, newest, rows).distinct()
        for level in reached:
            fresh = fresh.join(level.select("url_key"), "url_key", "left_anti")
        newest, rows = settle_bucketed(fresh, "frontier", "url_key", buckets)
        reached.append(newest.withColumn("depth", F.lit(depth)))
        if len(reached) > merge_every:
            merged = _union(reached).repartition(buckets, "url_key")
            reached = [settle_bucketed(merged, "reached", "url_key", buckets)[0]]
    return _union(reached)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
