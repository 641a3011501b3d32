"""Registered queries: each reads whole tables below ``sf_dir``.

``pages`` holds plain pages; fields and faults it lacks (meta tags, dates,
lower headings, over-long titles, copies) come from ``documents`` and
``conversations``, whose texts are wrapped into pages here.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.html import html_div_content, html_headings, nav_links, strip_invisible
from ..functions.patterns import array_to_text
from ..functions.text import clean_text
from ..functions.urls import url_key, url_parts
from ..operators.dedup import frontier_dedup, unique_url
from ..operators.links import expand_frontier, key_edges, link_edges, page_keys, undiscovered
from ..operators.numbering import assign_id
from ..operators.parse import is_valid, parse_pages, with_content_text
from ..operators.quarantine import judge, split_duplicates
from ..operators.search import display, result_json, search, search_anchored, search_many, search_sql
from ..operators.seen import micros, seen_lookup, seen_within_ttl
from ..operators.stats import crawl_stats
from ..operators.stored_search import search_stored as search_stored_files
from ..schemas import STORED_COLUMNS
from ..session import scratch_path, settle
from ..sources.feed import number_batches, read_feed, read_feed_array, write_feed
from ..sources.objects import write_feed_objects
from ..sources.pages import filter_status, page_source, spread, to_raw_page
from ..sources.seeds import seed_source
from ..sources.store import read_store, scan_store, to_stored_doc
from ..streaming.ingest import ingest_stream
from ..streaming.seen import ROCKSDB, drop_seen, seen_in_order, seen_stream
from ..streaming.stats import CrawlCounters, observed
from .crawl import crawl, crawl_items
from .ingest import ingest

HOUR = 3_600_000_000
SEARCH = "the"
WILDCARD_SEARCH = "t_on%the"
MANY = ["the", "TION", "er%on", "_ich", "é", "{", "a b", "no such words", " ", "", None]
INDEXED = ["the", "tion", "er%on", "en_pages", "no such words", "a b", "zz"]
SEEN_GLOB = "http*://*.example.[no]??/[a-e]?/*"
HEAVY_ROWS = 1_000
TURNS_TTL = 3
STREAM_SLICES = 4


# --- inputs -----------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_source(spark, f"{sf_dir}/pages.parquet")


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a status: 206 for a page that was cut off, 200 otherwise."""
    whole = F.col("content").endswith("</html>")
    return _pages(spark, sf_dir).withColumn("status", F.when(whole, 200).otherwise(206))


def _table(spark: SparkSession, sf_dir: str, name: str, schema: str) -> DataFrame:
    return spread(spark.read.schema(schema).parquet(f"{sf_dir}/{name}.parquet"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return _table(spark, sf_dir, "documents", schema)


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "conversations", "conv_id long, turn long, role string, text string")


def _events(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string"
    events = spark.read.schema(schema).parquet(f"{sf_dir}/events.parquet")
    return events.select(F.col(key).alias("key"), micros(F.col("ts")).alias("t"), F.col("event_id").alias("id"))


def _talk_url() -> Column:
    return F.concat(F.lit("https://talk.example/"), F.col("conv_id").cast("string"))


def _escaped(text: Column) -> Column:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(char), F.lit(name))
    return text


def _document_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a page with all fields; exact copies share their URL."""
    text = _escaped(F.col("text"))
    html = F.concat(
        F.lit("<html><head><title>"), text,
        F.lit('</title><meta name="description" content="'), text,
        F.lit("\"><META content='"), F.col("source"), F.lit("' name=author></head><body><time datetime="),
        F.col("n_chars").cast("string"),
        F.lit("></time><h3>"), text, F.lit("</h3><h1 id='>'>"), F.col("lang"), F.lit("<i>"), F.col("source"),
        F.lit("</i></h1><script>'<h2>none</h2>'</script></body></html>"),
    )
    url = F.concat(F.lit("https://docs.example/"), F.col("lang"), F.lit("/"), F.md5(F.col("text").cast("binary")))
    return _documents(spark, sf_dir).select("doc_id", url.alias("url"), html.alias("content"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_content_text(parse_pages(_pages(spark, sf_dir)))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored form of all valid pages, the page id as id."""
    valid = _parsed(spark, sf_dir).where(is_valid())
    return to_stored_doc(valid.withColumnRenamed("page_id", "id"))


# --- text -------------------------------------------------------------------


def clean_documents(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", clean_text(F.col("text")).alias("cleaned"))


def clean_conversations(spark, sf_dir):
    return _conversations(spark, sf_dir).select("conv_id", "turn", clean_text(F.col("text")).alias("cleaned"))


def clean_spoken(spark, sf_dir):
    """Turns of the system count as null."""
    said = F.when(F.col("role") != "system", F.col("text"))
    return _conversations(spark, sf_dir).select("conv_id", "turn", clean_text(said).alias("cleaned"))


def clean_benchmark(spark, sf_dir):
    items = _table(spark, sf_dir, "benchmark", "item_id long, text string")
    return items.select("item_id", clean_text(F.col("text")).alias("cleaned"))


# --- parsing and checks -----------------------------------------------------


def parsed_docs(spark, sf_dir):
    return _parsed(spark, sf_dir).select(
        "page_id", "url", "title", "description", "author", "published_date",
        F.array_join("content", "|").alias("content"),
    )


def parsed_documents(spark, sf_dir):
    return parse_pages(_document_pages(spark, sf_dir)).select(
        "doc_id", "url", "title", "description", "author", "published_date",
        F.array_join("content", "|").alias("content"),
    )


def content_text(spark, sf_dir):
    docs = parse_pages(_document_pages(spark, sf_dir), ["content"])
    return docs.select("doc_id", array_to_text(F.col("content")).alias("content_text"))


def valid_docs(spark, sf_dir):
    return _docs(spark, sf_dir).select("id", "title", "content", "url")


def rejected_docs(spark, sf_dir):
    judged = judge(_pages(spark, sf_dir))
    return judged.where(F.col("reject_reason").isNotNull()).select("page_id", "url", "reject_reason")


def document_quarantine(spark, sf_dir):
    judged = settle(judge(_document_pages(spark, sf_dir)), "judged")
    return split_duplicates(judged, ["doc_id"])[1]


def document_winners(spark, sf_dir):
    judged = settle(judge(_document_pages(spark, sf_dir)), "judged")
    return split_duplicates(judged, ["doc_id"])[0].select("doc_id", "url", "title", "content_text")


def _nested(spark: SparkSession, sf_dir: str, *html: str) -> DataFrame:
    """Documents as pages of one of several layouts; ``{}`` stands for the escaped text."""
    text = _escaped(F.col("text"))
    layouts = [F.concat(*sum([[F.lit(part), text] for part in layout.split("{}")], [])[:-1]) for layout in html]
    pick = F.element_at(F.array(*layouts), (F.col("doc_id") % len(html) + 1).cast("int"))
    return _documents(spark, sf_dir).select("doc_id", strip_invisible(pick).alias("h"))


BODY_LAYOUTS = (
    "<div class=\"main content\"><div>{}</div><p>tail</p></div><div>out</div>",
    "<div class='contents'>{}</div><div class='my-content CONTENT'>{}</div>",
    "</div><DIV id=x CLASS=content>head<div>{}<div>inner</div></div><p>rest",
    "<div><div title='content'>{}</div><div class='\tcontent\n'>{}</div>out</div><div class=content>late</div>",
)
HEADING_LAYOUTS = (
    "<h1>first<h2>{}</h2>last</h1>out<h3>third",
    "<h2>{}<h2>second</h2>third</h2></h2><h1>top</h1>",
    "<h2>open<h2>{}</h2>out<H1>top<h5>small</h5>end</H1>",
)
NAV_LAYOUTS = (
    "<nav><a href='/one'>{}</a><nav><a href='/two'></a></nav><a href='/three'></a></nav><a href='/out'></a>",
    "</nav><a href='/out'></a><nav><p></nav></nav><a href='/out'></a><NAV><a href='/late'>{}</a>",
)


def document_bodies(spark, sf_dir):
    """Content regions around, beside and inside other regions, closed and not."""
    return _nested(spark, sf_dir, *BODY_LAYOUTS).select("doc_id", html_div_content(F.col("h")).alias("body_text"))


def nested_headings(spark, sf_dir):
    pages = _nested(spark, sf_dir, *HEADING_LAYOUTS)
    return pages.select("doc_id", F.array_join(html_headings(F.col("h")), "|").alias("headings"))


def nested_nav_links(spark, sf_dir):
    pages = _nested(spark, sf_dir, *NAV_LAYOUTS)
    return pages.select("doc_id", F.posexplode(nav_links(F.col("h"))).alias("pos", "href"))


# --- responses and feeds ----------------------------------------------------


def fetched_pages(spark, sf_dir):
    return filter_status(_responses(spark, sf_dir))[0].select(
        "page_id", "url", F.md5(F.col("content").cast("binary")).alias("content_md5")
    )


def refused_pages(spark, sf_dir):
    return filter_status(_responses(spark, sf_dir))[1].select("page_id", "url", "status")


def crawl_stats_by_host(spark, sf_dir):
    return crawl_stats(_responses(spark, sf_dir))


def feed_batches(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return number_batches(pages.select("page_id", "url"), ["page_id"]).select(
        "page_id", "idx", "batch_id"
    )


def feed_objects(spark, sf_dir):
    """Numbered objects, written by the sink and read back: the number is the file's name."""
    path = scratch_path(spark, "objects")
    write_feed_objects(_pages(spark, sf_dir), path, ["page_id"])
    number = F.regexp_extract("_file", r"(\d+)\.json$", 1).cast("long")
    return read_feed(spark, f"{path}/*").select(
        "url", number.alias("batch_id"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


def feed_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "feed")
    write_feed(to_raw_page(_pages(spark, sf_dir)), path)
    return read_feed(spark, path).select("url", F.md5(F.col("content").cast("binary")).alias("content_md5"))


def store_ingest(spark, sf_dir):
    """Two batches: all documents, then all documents and all pages."""
    store = scratch_path(spark, "store")
    documents = _document_pages(spark, sf_dir).select(F.col("doc_id").alias("_seq"), "url", "content")
    pages = _pages(spark, sf_dir).select(F.col("page_id").alias("_seq"), "url", "content")
    first = documents.withColumns({"_file": F.lit("a"), "_block": F.lit(0).cast("long")})
    second = first.unionByName(pages.withColumns({"_file": F.lit("b"), "_block": F.lit(0).cast("long")}))
    ingest(first, store, 0)
    ingest(second, store, 1)
    return scan_store(spark, store)


def stream_ingest(spark, sf_dir):
    """Pages written as feed objects and read back by the streaming job."""
    feed, store = scratch_path(spark, "feed"), scratch_path(spark, "store")
    write_feed(to_raw_page(_pages(spark, sf_dir)), feed)
    ingest_stream(spark, feed, store, scratch_path(spark, "progress")).awaitTermination()
    return scan_store(spark, store).drop("id")


def assign_ids(spark, sf_dir):
    pages = _pages(spark, sf_dir).select("page_id", "url")
    return assign_id(pages, ["url", "page_id"], first=100).select("page_id", "url", "id")


def unique_urls(spark, sf_dir):
    """Conversations as pages of one URL each: the first turn wins."""
    turns = _conversations(spark, sf_dir).select(_talk_url().alias("url"), "turn", "role", "text")
    return unique_url(turns, ["turn"])


def unique_sources(spark, sf_dir):
    """A few hot keys: the first document of each source."""
    docs = _documents(spark, sf_dir).withColumnRenamed("source", "url")
    return unique_url(docs, ["doc_id"]).select("url", "doc_id", "lang", "text")


def _faulty_lines(spark, sf_dir):
    """Documents as feed lines, nine of ten with one fault each."""
    kind = F.col("doc_id") % 10
    fault = lambda n, bad, good: F.when(kind == n, bad).otherwise(good)
    long = F.repeat(F.lit("x"), F.lit(300))
    html = F.concat(
        F.lit("<title>"), fault(3, F.lit(""), fault(5, long, F.lit("It&apos;s a title"))),
        F.lit('</title><meta name="author" content="'), fault(6, long, F.col("source")),
        F.lit('"><time datetime="'), fault(7, F.repeat(F.lit("9"), F.lit(31)), F.col("lang")),
        F.lit('"></time><h1>'), fault(4, F.lit("42 the"), F.lit("Heading&hellip; of ")), F.lit("</h1>"),
    )
    url = F.concat(F.lit("https://feed.example/"), F.col("doc_id").cast("string"), fault(8, long, F.lit("")))
    line = F.to_json(F.struct(
        F.when(kind != 1, url).alias("url"), F.when(kind != 2, html).alias("content")
    ))
    return _documents(spark, sf_dir).select(fault(0, F.left(line, F.length(line) - 5), line).alias("value"))


def feed_faults(spark, sf_dir):
    """Records of a feed by what is wrong with them; null counts the good ones."""
    path = scratch_path(spark, "feed")
    _faulty_lines(spark, sf_dir).write.text(path)
    return judge(read_feed(spark, path)).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("records"))


def feed_fields(spark, sf_dir):
    """What is stored of the good records."""
    path = scratch_path(spark, "feed")
    _faulty_lines(spark, sf_dir).write.text(path)
    good = judge(read_feed(spark, path)).where(F.col("reject_reason").isNull())
    return good.select("url", "title", "author", "published_date", "content_text")


def feed_arrays(spark, sf_dir):
    """Documents as JSON arrays of a few hundred pages, read back by the splits of the files."""
    path, array = scratch_path(spark, "arrays"), F.floor(F.col("doc_id") / 400)
    pages = _document_pages(spark, sf_dir).select("doc_id", array.alias("array"), F.to_json(F.struct("url", "content")).alias("j"))
    own = Window.partitionBy("array").orderBy("doc_id")
    line = F.concat(
        F.when(F.row_number().over(own) == 1, F.lit("[")).otherwise(F.lit(",")), F.col("j"),
        F.when(F.lead("doc_id").over(own).isNull(), F.lit("]")).otherwise(F.lit("")))
    pages.select(line.alias("value"), "array").write.partitionBy("array").text(path)
    return read_feed_array(spark, path).select("url", F.md5(F.col("content").cast("binary")).alias("content_md5"))


# --- links ------------------------------------------------------------------


def page_nav_links(spark, sf_dir):
    html = strip_invisible(F.col("content"))
    return _pages(spark, sf_dir).select("page_id", html.alias("h")).select(
        "page_id", F.posexplode(nav_links(F.col("h"))).alias("pos", "href")
    )


def page_link_edges(spark, sf_dir):
    return link_edges(_pages(spark, sf_dir))


def document_links(spark, sf_dir):
    """Links of every kind from pages whose URL has a path, none, or parameters."""
    host = F.concat(F.lit("https://d"), F.col("doc_id").cast("string"), F.lit(".example"))
    kind = F.col("doc_id") % 5
    query = F.concat(F.lit("/"), F.col("lang"), F.lit("/x?n="), F.col("n_chars").cast("string"))
    url = F.concat(host, F.when(kind == 0, F.lit("")).when(kind == 1, F.lit("/a;p=1")).otherwise(query))
    html = F.concat(
        F.lit('<nav><a href="https://o.example/p#f">1</a><a href="//cdn.example/y">2</a><a href="foo/'),
        F.col("source"), F.lit('">3</a><a href="mailto:x@y.z">4</a><a href="/a;v=1?q=2#f">5</a>'),
        F.lit('<a name="no">6</a><a href="">7</a></nav>'),
    )
    return link_edges(_documents(spark, sf_dir).select(url.alias("url"), html.alias("content")))


def crawl_next(spark, sf_dir):
    """A whole crawl from the hosts and URLs of all pages: what it would fetch next."""
    pages = _responses(spark, sf_dir)
    return crawl(pages, pages.select(F.upper(F.substring_index("url", "/", 3)).alias("url")).unionByName(
        pages.select("url"))).next_urls


def page_url_parts(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    parts = url_parts(F.col("url"))
    return pages.select(
        "page_id",
        *[getattr(parts, name).alias(name) for name in parts._fields],
        url_key(F.col("url")).alias("url_key"),
    )


def undiscovered_links(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return undiscovered(link_edges(pages), pages)


def frontier_urls(spark, sf_dir):
    """Pages and all their links as one list of distinct fetches."""
    pages = _pages(spark, sf_dir)
    urls = pages.select("url").unionByName(link_edges(pages).select(F.col("dst_url").alias("url")))
    return frontier_dedup(urls)


def undiscovered_seeds(spark, sf_dir):
    """Start URLs of which the snapshot has no page."""
    seeds = seed_source(spark).withColumn("url_key", url_key(F.col("url")))
    # Only page keys that are seeds are counted; the fixed list of seeds is broadcast.
    keys = _pages(spark, sf_dir).select(url_key(F.col("url")).alias("url_key"))
    there = keys.join(F.broadcast(seeds.select("url_key")), "url_key", "left_semi").distinct()
    return seeds.join(there, "url_key", "left_anti").select("url")


def frontier_reach(spark, sf_dir):
    """From all cut-off pages, over links in both directions.

    No page of the snapshot links to another one, so every link target is taken
    as a page that links back to where it was found.
    """
    responses = _responses(spark, sf_dir)
    there = settle(key_edges(link_edges(responses)), "there")
    back = there.select(F.col("dst_key").alias("src_key"), F.col("src_key").alias("dst_key"))
    edges = there.unionByName(back)
    pages = page_keys(responses).unionByName(there.select(F.col("dst_key").alias("url_key")))
    _, refused = filter_status(responses)
    seeds = refused.select(url_key(F.col("url")).alias("url_key"))
    return expand_frontier(edges, pages, seeds)


def crawl_stats_stream(spark, sf_dir):
    """Totals of a stream of responses, counted by its micro-batches."""
    feed = scratch_path(spark, "responses")
    _responses(spark, sf_dir).select("url", "status").write.parquet(feed)
    counters = CrawlCounters()
    spark.streams.addListener(counters)
    try:
        stream = spark.readStream.schema("url string, status int").option("maxFilesPerTrigger", 2).parquet(feed)
        query = observed(stream).writeStream.format("noop").option(
            "checkpointLocation", scratch_path(spark, "progress")).trigger(availableNow=True).start()
        query.awaitTermination()
        counters.catch_up(query)
    finally:
        spark.streams.removeListener(counters)
    totals = counters.totals()
    return spark.range(1).select(*[F.lit(n).cast("long").alias(name) for name, n in totals.items()])


# --- sightings --------------------------------------------------------------


def seen_users(spark, sf_dir):
    return seen_within_ttl(_events(spark, sf_dir, "user_id"), 6 * HOUR)


def seen_event_types(spark, sf_dir):
    """Five hot keys, solved without collecting any of them."""
    return seen_within_ttl(_events(spark, sf_dir, "event_type"), HOUR // 6, HEAVY_ROWS)


def seen_whole_span(spark, sf_dir):
    """A TTL longer than all events: every key lies within one."""
    return seen_within_ttl(_events(spark, sf_dir, "event_type"), 100_000 * HOUR, HEAVY_ROWS)


def _streamed_events(spark, sf_dir, run):
    """Runs a stream once per time slice over the events that have arrived so far; returns what it wrote."""
    events = settle(_events(spark, sf_dir, "user_id"), "events")
    low, high = events.agg(F.min("t"), F.max("t")).first()
    feed, out, progress = (scratch_path(spark, name) for name in ("sightings", "emitted", "progress"))
    width = (high - low) // STREAM_SLICES + 1
    for i in range(STREAM_SLICES):
        arrived = events.where((F.col("t") >= low + i * width) & (F.col("t") < low + (i + 1) * width))
        arrived.write.mode("append").parquet(feed)
        stream = run(spark.readStream.schema(events.schema).parquet(feed))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(
            availableNow=True
        ).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(out).select("key", "t", "id")


def seen_users_stream(spark, sf_dir):
    """The streaming form over the same events, in several micro-batches."""
    return _streamed_events(spark, sf_dir, lambda stream: seen_stream(stream, 6 * HOUR))


def seen_users_in_order(spark, sf_dir):
    """Events that arrive up to an hour late, judged by timers in the order of their instants."""
    events = settle(_events(spark, sf_dir, "user_id").withColumn("late", F.col("t") + F.pmod(F.xxhash64("id"), F.lit(HOUR))), "events")
    low, high = events.agg(F.min("late"), F.max("late")).first()
    feed, out, progress = (scratch_path(spark, name) for name in ("sightings", "emitted", "progress"))
    width = (high - low) // STREAM_SLICES + 1
    # A row without a key, long after the others, lets go what still waits.
    end = spark.range(1).select(F.lit(None).cast("long").alias("key"), F.lit(high + 1000 * HOUR).alias("t"), "id")
    # Slices are taken up in the order of their files' times.
    for i in range(STREAM_SLICES):
        arrived = events.where(F.floor((F.col("late") - low) / width) == i).drop("late")
        arrived.repartition(1).write.mode("append").parquet(feed)
    end.write.mode("append").parquet(feed)
    before = spark.conf.get(ROCKSDB[0])
    spark.conf.set(*ROCKSDB)
    try:
        stream = spark.readStream.schema(end.schema).option("maxFilesPerTrigger", 1).parquet(feed)
        seen_in_order(stream, 6 * HOUR, HOUR).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(ROCKSDB[0], before)
    return spark.read.schema(end.schema).parquet(out).select("key", "t", "id")


def dropped_users_stream(spark, sf_dir):
    """Watermark de-duplication with a TTL longer than all events lets every key through once."""
    def run(stream):
        timed = stream.withColumn("ts", F.timestamp_micros("t"))
        return drop_seen(timed, "key", "ts", 100_000 * 3600).drop("ts")

    return _streamed_events(spark, sf_dir, run).groupBy("key").agg(F.count(F.lit(1)).alias("kept"))


def crawled_turns(spark, sf_dir):
    """Conversations as pages fetched again at every turn, kept once per TTL."""
    refused = F.col("role") == "system"
    responses = _conversations(spark, sf_dir).select(
        _talk_url().alias("url"),
        F.when(refused, 403).otherwise(200).alias("status"),
        F.col("text").alias("content"),
        F.col("turn").alias("t"),
        F.col("turn").alias("id"),
    )
    return crawl_items(responses, TURNS_TTL).select("url", F.col("t").alias("turn"), "content")


def seen_pages_lookup(spark, sf_dir):
    return seen_lookup(_pages(spark, sf_dir), SEEN_GLOB).select("page_id", "url")


# --- search -----------------------------------------------------------------


def search_top20(spark, sf_dir):
    return search(_docs(spark, sf_dir), SEARCH)


def search_stored(spark, sf_dir):
    """Over the stored table: pages are parsed when they come in, not when they are searched."""
    store = scratch_path(spark, "store")
    pages = _pages(spark, sf_dir).select(F.col("page_id").alias("_seq"), "url", "content")
    ingest(pages.withColumns({"_file": F.lit("a"), "_block": F.lit(0).cast("long")}), store, 0)
    return search(scan_store(spark, store), SEARCH)


def search_bound(spark, sf_dir):
    return search_sql(_docs(spark, sf_dir), SEARCH)


def search_wildcard(spark, sf_dir):
    return search(_docs(spark, sf_dir), WILDCARD_SEARCH)


def search_empty_query(spark, sf_dir):
    return search(_docs(spark, sf_dir), "")


def search_queries(spark, sf_dir):
    return search_many(_docs(spark, sf_dir), MANY).select("q", *STORED_COLUMNS)


def search_display(spark, sf_dir):
    return display(search(_docs(spark, sf_dir), SEARCH))


def search_response(spark, sf_dir):
    return result_json(search(_docs(spark, sf_dir), SEARCH), SEARCH)


def _store_lines(spark, sf_dir):
    """All documents, then all pages, as feed lines in arrival order."""
    documents = _document_pages(spark, sf_dir).select(F.col("doc_id").alias("_seq"), "url", "content")
    pages = _pages(spark, sf_dir).select(F.col("page_id").alias("_seq"), "url", "content")
    block = F.lit(0).cast("long")
    return documents.withColumns({"_file": F.lit("a"), "_block": block}).unionByName(
        pages.withColumns({"_file": F.lit("b"), "_block": block}))


def search_indexed(spark, sf_dir):
    """Common, rare, absent and short queries over a store of many files, each read as far as needed."""
    store = scratch_path(spark, "store")
    ingest(_store_lines(spark, sf_dir), store, 0, file_rows=100)
    found = [search_stored_files(spark, store, q).withColumn("q", F.lit(q)) for q in INDEXED]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select("q", *STORED_COLUMNS)


def search_thousands(spark, sf_dir):
    """A piece of every document as a query over all pages, some with wildcards, some of two characters."""
    kind, at = F.col("doc_id") % 10, (F.col("doc_id") % 23 + 1).cast("int")
    piece = lambda start, n: F.substring(F.replace(F.col("text"), F.lit("\\"), F.lit("/")), start, F.lit(n))
    q = F.when(kind == 0, F.concat(piece(at, 5), F.lit("%"), piece(at + 20, 3))).when(
        kind == 1, F.concat(piece(at, 3), F.lit("_"), piece(at + 4, 2))).when(
        F.col("doc_id") % 100 == 2, piece(at, 2)).otherwise(piece(at, 7))
    return search_anchored(settle(_docs(spark, sf_dir), "docs"), _documents(spark, sf_dir).select(q.alias("q")))


def stream_batches(spark, sf_dir):
    """Documents and pages as a feed of many objects, taken up in several micro-batches."""
    feed, store = scratch_path(spark, "feed"), scratch_path(spark, "store")
    write_feed(_store_lines(spark, sf_dir).select("url", "content"), feed, per_object=100)
    objects = spark.read.text(feed).select(F.input_file_name().alias("f")).distinct().count()
    ingest_stream(spark, feed, store, scratch_path(spark, "progress"), objects_per_trigger=-(-objects // 3)).awaitTermination()
    stored = settle(read_store(spark, store).select("ingest_batch", "id", "url", "content"), "stored")
    batches, ids, rows = stored.agg(F.count_distinct("ingest_batch"), F.count_distinct("id"), F.count("id")).first()
    return stored.select("url", "content", F.lit(batches > 1).alias("several"), F.lit(ids == rows).alias("distinct_ids"))


QUERIES = {
    f.__name__: f
    for f in (
        search_top20, search_bound, search_wildcard, search_empty_query, search_queries,
        search_display, search_response, parsed_docs, parsed_documents, content_text, valid_docs,
        rejected_docs, document_quarantine, document_winners, clean_documents,
        clean_conversations, clean_benchmark, page_nav_links, page_link_edges, page_url_parts,
        undiscovered_links, undiscovered_seeds, frontier_urls, frontier_reach, fetched_pages,
        refused_pages, crawl_stats_by_host, unique_urls, unique_sources, feed_batches, feed_objects,
        feed_roundtrip, store_ingest, stream_ingest, assign_ids, seen_users, seen_event_types,
        seen_users_stream, seen_pages_lookup, crawled_turns, seen_whole_span, dropped_users_stream,
        feed_faults, feed_fields, document_links, crawl_next, search_stored, clean_spoken,
        document_bodies, nested_headings, nested_nav_links, search_indexed, search_thousands, stream_batches,
        seen_users_in_order, feed_arrays, crawl_stats_stream,
    )
}
