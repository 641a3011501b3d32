from urllib.parse import urlparse, urlunparse

from pyspark.sql import functions as F

from pagetrove.functions import urls as U

SOURCE = "https://h.com/en/25?page=2#top"
GOLDEN = [
    ("/The", SOURCE, "https://h.com/The"),
    ("foo/bar", SOURCE, "https://h.com/foo/bar"),
    ("../x", SOURCE, "https://h.com/../x"),
    ("#top", SOURCE, "https://h.com"),
    ("", SOURCE, "https://h.com"),
    ("?q=1", SOURCE, "https://h.com?q=1"),
    ("/a;v=1?q=2#f", SOURCE, "https://h.com/a?q=2"),
    ("/p?", SOURCE, "https://h.com/p"),
    ("/a b", SOURCE, "https://h.com/a b"),
    ("mailto:x@y.z", SOURCE, "https://h.com/x@y.z"),
    ("javascript:void(0)", SOURCE, "https://h.com/void(0)"),
    ("tel:+1", SOURCE, "https://h.com/+1"),
    ("http:/x", SOURCE, "https://h.com/x"),
    ("//cdn.h/y", SOURCE, "//cdn.h/y"),
    ("https://o.com/p#frag", SOURCE, "https://o.com/p#frag"),
    ("/x", "https://h.com", None),
    ("https://o.com/p", "https://h.com", None),
    ("/x", "https://h.com/a;p", None),
    ("/x", "https://h.com/", "https://h.com/x"),
]

LINKS = [
    "", " ", "a", "/a", "//h", "//h/a?b#c", "a;b", "a;b/c", "/a;b;c", "/a;", "x:y", "1x:y", "a+b:c", ":a", "?", "#",
    "?a#b?c", "#a?b", "http:", "http://", "http:///a", "HTTP://O.com/A", "ftp:a;b", "mailto:a;b?c", " /lead", "\t/a\nb",
    "a/b/c;d?e#f", "é/ü", "//[::1]/x", "/a//b", "////a", "data:text/plain,hi", "/a?b=c;d", "tel:12;ext=3", "g;x=1/../y",
]
SOURCES = [
    SOURCE, "http://a", "http://a/", "HTTPS://a/b", "http://a/b;c", "http://a/b;", "a/b", "/a/b", "//a/b", "file:///a",
    "mailto:x", "news:a/b", "http://u:p@a:80/b?c",
]


def restated(link, source):
    """The rewriting rule over the standard library's splitter."""
    a, b = urlparse(link), urlparse(source)
    if b.path == "" or b.params != "":
        return None
    if a.netloc:
        return link
    return urlunparse((b.scheme, b.netloc, a.path, "", a.query, ""))


def rewritten(spark, pairs):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, h string, s string")
    link, source = U.url_parts(F.col("h")), U.url_parts(F.col("s"))
    out = df.select("i", U.rewrite_link(F.col("h"), link, source).alias("o"))
    return [r.o for r in sorted(out.collect())]


def test_golden(spark):
    assert rewritten(spark, [g[:2] for g in GOLDEN]) == [g[2] for g in GOLDEN]


def test_same_as_standard_library(spark):
    pairs = [(a, b) for a in LINKS for b in SOURCES]
    got = rewritten(spark, pairs)
    wrong = [(p, g, restated(*p)) for p, g in zip(pairs, got) if g != restated(*p)]
    assert wrong == []


def test_parts_same_as_standard_library(spark):
    urls = LINKS + SOURCES
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    rows = sorted(df.select("i", *U.url_parts(F.col("u"))).collect())
    assert [tuple(r)[1:] for r in rows] == [tuple(urlparse(u)) for u in urls]


def test_resolve(spark):
    df = spark.createDataFrame([("//cdn/y",), ("http://a/",)], "l string")
    out = df.select(U.resolve_link(F.col("l"), F.lit("https")))
    assert [r[0] for r in out.collect()] == ["https://cdn/y", "http://a/"]


def test_url_key(spark):
    cases = {
        "http://a/p#x": "http://a/p",
        "http://a/p?b=2&a=1#x": "http://a/p?a=1&b=2",
        "http://a/p?": "http://a/p",
        "http://a/p?x=?&a": "http://a/p?a&x=?",
        "http://a/p#x?b&a": "http://a/p",
    }
    df = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.k for r in df.select("u", U.url_key(F.col("u")).alias("k")).collect()} == cases
