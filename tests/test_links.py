import random

import pytest
from pyspark.sql import functions as F

from pagetrove.operators.dedup import frontier_dedup
from pagetrove.operators import links
from pagetrove.operators.links import expand_frontier, key_edges, link_edges, undiscovered
from pagetrove.operators.stats import crawl_stats, observe_crawl
from pagetrove.plans.crawl import crawl, crawl_items
from pagetrove.session import settle_bucketed
from pagetrove.sources.seeds import START_URLS, seed_source

H = "https://h.com/"
GRAPH = {"a": "bc", "b": "ad", "c": "c", "e": "a"}


@pytest.fixture(scope="module")
def responses(spark):
    def html(targets):
        return "<nav>" + "".join(f'<a href="/{t}">{t}</a>' for t in targets) + "</nav>"

    rows = [(H + s, 200, html(t)) for s, t in GRAPH.items()]
    rows += [(H + "f", 404, html("a")), ("https://other.com", 200, html("a"))]
    return spark.createDataFrame(rows, "url string, status int, content string")


def reach(spark, edges, pages, seeds, **kw):
    e = spark.createDataFrame(edges, "src_key string, dst_key string")
    p = spark.createDataFrame([(x,) for x in pages], "url_key string")
    s = spark.createDataFrame([(x,) for x in seeds], "url_key string")
    return {tuple(r) for r in expand_frontier(e, p, s, **kw).collect()}


def test_frontier_with_cycle(spark):
    edges = [(s, d) for s, t in GRAPH.items() for d in t]
    assert reach(spark, edges, GRAPH, "a") == {("a", 0), ("b", 1), ("c", 1)}
    assert reach(spark, edges, GRAPH, "ax", max_depth=0) == {("a", 0)}


def test_frontier_depth_and_merging(spark):
    chain = [(str(i), str(i + 1)) for i in range(6)]
    nodes = [str(i) for i in range(7)]
    assert reach(spark, chain, nodes, ["0"], merge_every=2) == {(str(i), i) for i in range(7)}
    assert reach(spark, chain, nodes, ["0"], max_depth=2) == {(str(i), i) for i in range(3)}


def test_crawl(spark, responses):
    seeds = spark.createDataFrame([(H + "a#top",), (H + "f",)], "url string")
    result = crawl(responses, seeds)
    assert {(r.url_key, r.depth) for r in result.reached.collect()} == {(H + "a", 0), (H + "b", 1), (H + "c", 1)}
    assert sorted(r.url for r in result.items.collect()) == [H + "a", H + "b", H + "c"]
    assert [tuple(r) for r in result.next_urls.collect()] == [(H + "d", H + "d", 1)]
    assert {r.host: (r.responses, r.fetched, r.refused) for r in result.stats.collect()} == {
        "h.com": (5, 4, 1),
        "other.com": (1, 1, 0),
    }


def test_edges(spark):
    html = '<nav><a href="/x">1</a><a>2</a><a href="//cdn/y">3</a><a href="#z">4</a></nav>'
    rows = [("https://h.com/p?q", html), ("https://h.com", html), ("https://h.com/a;b", html), (None, html), ("https://h.com/n", None)]
    edges = link_edges(spark.createDataFrame(rows, "url string, content string"))
    assert [tuple(r) for r in edges.orderBy("pos").collect()] == [
        ("https://h.com/p?q", 0, "/x", "https://h.com/x"),
        ("https://h.com/p?q", 1, "//cdn/y", "https://cdn/y"),
        ("https://h.com/p?q", 2, "#z", "https://h.com"),
    ]


def test_undiscovered_and_keys(spark, responses):
    edges = link_edges(responses)
    assert {(r.url, r.links) for r in undiscovered(edges, responses).collect()} == {(H + "d", 1)}
    assert key_edges(edges.unionByName(edges)).count() == 7


def test_next_crawl_list_needs_no_join(spark, responses):
    plan = undiscovered(link_edges(responses), responses)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "partial_count" in plan


def test_items_are_emitted_once_per_ttl(spark):
    rows = [("u", 200, f"c{t}", t, t) for t in (0, 300, 599, 600, 900, 1200)]
    rows += [("u", 500, "bad", 700, 70), (None, 200, "no url", 1, 71), (None, 200, "no url", 2, 72)]
    df = spark.createDataFrame(rows, "url string, status int, content string, t long, id long")
    assert sorted(r.id for r in crawl_items(df, 600).collect()) == [0, 71, 72, 600, 1200]


def test_frontier_dedup(spark):
    urls = spark.createDataFrame([("http://a/?y&x",), ("http://a/?x&y#f",), ("http://b/",)], "url string")
    assert {tuple(r) for r in frontier_dedup(urls).collect()} == {
        ("http://a/?x&y", "http://a/?x&y#f"),
        ("http://b/", "http://b/"),
    }


def test_observed_counts_equal_grouped_ones(spark, responses):
    watched, seen = observe_crawl(responses)
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"responses": 6, "fetched": 5, "refused": 1}
    assert crawl_stats(responses).agg(F.sum("responses")).first()[0] == 6


def test_seeds(spark, tmp_path):
    assert seed_source(spark).count() == len(START_URLS) == 28
    (tmp_path / "seeds.txt").write_text("https://a/\nhttps://b/\n")
    assert seed_source(spark, str(tmp_path / "seeds.txt")).count() == 2


def test_chains_longer_than_any_fixed_depth(spark):
    edges = spark.createDataFrame([(f"p{i}", f"p{i + 1}") for i in range(14)], "src_key string, dst_key string")
    pages = spark.createDataFrame([(f"p{i}",) for i in range(14)], "url_key string")
    seeds = spark.createDataFrame([("p0",)], "url_key string")
    got = {r.url_key: r.depth for r in expand_frontier(edges, pages, seeds).collect()}
    assert got == {f"p{i}": i for i in range(14)}


def test_a_bare_host_seed_reaches_its_page(spark):
    from pagetrove.plans.crawl import crawl

    pages = spark.createDataFrame(
        [("https://dev.to/", 200, '<nav><a href="/x">x</a></nav>')], "url string, status int, content string"
    )
    for seed in ("https://dev.to", "HTTPS://Dev.To/#top"):
        found = crawl(pages, spark.createDataFrame([(seed,)], "url string"))
        assert [tuple(r) for r in found.reached.collect()] == [("https://dev.to/", 0)]
        assert [r.url for r in found.next_urls.collect()] == ["https://dev.to/x"]


@pytest.mark.parametrize("few", [256, 0])
def test_any_graph_equals_a_walk(spark, monkeypatch, few):
    """Looked up by name, and joined bucket by bucket."""
    monkeypatch.setattr(links, "FEW_KEYS", few)
    chance = random.Random(6)
    pairs = {(f"p{chance.randrange(300)}", f"p{chance.randrange(330)}") for _ in range(420)}
    edges = spark.createDataFrame(sorted(pairs), "src_key string, dst_key string")
    pages = spark.createDataFrame([(f"p{i}",) for i in range(300)], "url_key string")
    seeds = spark.createDataFrame([("p0",), ("p1",), ("p1",), ("p320",)], "url_key string")
    want, newest, depth = {"p0": 0, "p1": 0}, {"p0", "p1"}, 0
    while newest:
        depth += 1
        newest = {b for a, b in pairs if a in newest and int(b[1:]) < 300} - set(want)
        want |= dict.fromkeys(newest, depth)
    assert {r.url_key: r.depth for r in expand_frontier(edges, pages, seeds, merge_every=3).collect()} == want
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("pagetrove_")]


def test_a_round_does_not_exchange_edges(spark, monkeypatch):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = spark.range(5_000).selectExpr("concat('p', id) AS src_key", "concat('p', id * 7 % 5000) AS dst_key")
        edges, n = settle_bucketed(edges.repartition(8, "src_key"), "edges", "src_key", 8)
        newest, _ = settle_bucketed(
            spark.range(900).selectExpr("concat('p', id) AS url_key").repartition(8, "url_key"), "newest", "url_key", 8)
        assert n == 5_000
        found = links._links_of(edges, newest, 900)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Join" in plan and "Exchange" not in plan
        assert found.count() == 900
        # Pruning is done in either case; only a scan that keeps its buckets shows it.
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        named = links._links_of(edges, newest.limit(1), 1)
        plan = named._jdf.queryExecution().executedPlan().toString()
        assert "SelectedBucketsCount: 1 out of 8" in plan and "Exchange" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
