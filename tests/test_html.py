import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagetrove.functions import html as H
from pagetrove.functions.nesting import running_depth
from pagetrove.operators.parse import is_valid, parse_pages

LONG = "x" * 200_000

# html, title, description, author, published_date, content, valid
GOLDEN = [
    (
        "<title>T 1</title><meta name=\"description\" content=\"D!\"><meta content=\"Ann\" NAME='author'>"
        '<time datetime="2024-01-02">x</time><h2>Two</h2><h1>One <b>big</b> thing</h1><h3>42</h3>',
        "T 1", "D!", "Ann", "2024-01-02", ["one big thing", "two"], True,
    ),
    ("<h1>No title</h1>", None, None, None, None, ["no title"], False),
    ("<title>x</title><p>no headings</p>", "x", None, None, None, None, False),
    (
        '<title>x</title><time>now</time><time datetime="d">y</time><h1>A&amp;B Corp</h1>',
        "x", None, None, None, ["ab corp"], True,
    ),
    ("<title></title><h1>Hi</h1>", None, None, None, None, ["hi"], False),
    (
        '<title>x</title><meta name="description"><meta name="description" content="late"><h1>Hi</h1>',
        "x", None, None, None, ["hi"], True,
    ),
    ("<title>x</title><h1><!-- c -->Real<script>bad()</script></h1>", "x", None, None, None, ["real"], True),
    ("<title>x</title><h1>The</h1><h2>Kept</h2>", "x", None, None, None, ["kept"], True),
    # Own cases from here on.
    ("<title> a < b </title><h1>x</h1>", " a < b ", None, None, None, ["x"], True),
    ("<title>a<b>c</b></title><h1>x</h1>", None, None, None, None, ["x"], False),
    ("<title>a</title><title>b</title><h1>x</h1>", "a", None, None, None, ["x"], True),
    ("<!--<title>no</title>--><title>yes</title><h1>x</h1>", "yes", None, None, None, ["x"], True),
    ("<script>'<h1>no</h1>'</script><title>t</title><h1>yes</h1>", "t", None, None, None, ["yes"], True),
    ('<script src="a"/><title>t</title><h1>yes</h1>', "t", None, None, None, ["yes"], True),
    ("<title>t</title><h1>yes</h1><script>never closed <h1>no</h1>", "t", None, None, None, ["yes"], True),
    ("<title>t</title><h1>foo<!-- x -->bar</h1>", "t", None, None, None, ["foo bar"], True),
    ('<title>t</title><h1 data-x="a>b">inner</h1>', "t", None, None, None, ["inner"], True),
    ("<title>t</title><h1>cut off", "t", None, None, None, ["cut off"], True),
    ("<title>t</title><h10>no</h10><header>no</header><H1\n>Yes</H1\n>", "t", None, None, None, ["yes"], True),
    (
        "<title>&lt;b&gt; &copy; &#65;&#x42; &nope; &am</title><h1>&lt;b&gt;x&lt;/b&gt;</h1>",
        "<b> © AB &nope; &am", None, None, None, ["bxb"], True,
    ),
    (
        '<title>t</title><meta name="Description" content="no"><meta name=description content=a/b><h1>x</h1>',
        "t", "a/b", None, None, ["x"], True,
    ),
    (
        "<title>t</title><meta property='x' name=author content=''><h1>x</h1>",
        "t", None, "", None, ["x"], True,
    ),
    (
        "<title>t</title><meta data-name='author' title=\"name='author'\" content='no'><h1>x</h1>",
        "t", None, None, None, ["x"], True,
    ),
    ("<title>t</title><h3>c</h3><h2>b</h2><h1>a1</h1><h1>b1</h1>", "t", None, None, None, ["b", "b", "c"], True),
    (f"<title>t</title><h1>{LONG}</h1><p a='{LONG}'>", "t", None, None, None, [LONG], True),
    ("", None, None, None, None, None, False),
    (None, None, None, None, None, None, False),
]


def test_fields(spark):
    rows = [(i, f"u{i}", g[0]) for i, g in enumerate(GOLDEN)]
    pages = spark.createDataFrame(rows, "i int, url string, content string")
    got = sorted(parse_pages(pages).withColumn("valid", is_valid()).collect(), key=lambda r: r.i)
    for row, want in zip(got, GOLDEN):
        seen = (row.title, row.description, row.author, row.published_date, row.content, row.valid)
        assert seen == want[1:], want[0] and want[0][:200]


@pytest.mark.parametrize(
    "html,links",
    [
        ('<nav><a href="/a">1</a><a>no</a><p><A HREF=/b>2</a></nav><a href="/out">', ["/a", "/b"]),
        ('<nav><a href="/a"></a><a href="/a"></a></nav><nav><a href=\'c d\'></nav>', ["/a", "/a", "c d"]),
        ('<nav><a data-href="no" href="yes"><abbr href="no"><a xhref="no">', ["yes"]),
        ('<nav><a title="href=no>" href="/x?a=1&amp;b=2"></nav>', ["/x?a=1&b=2"]),
        ('<nav><a href="one" href="two"><a href=""><a href></nav>', ["one", "", ""]),
        ("<nav><!-- <a href=no> --><a href=yes></nav>", ["yes"]),
        ("<navy><a href=no></navy>", []),
        ("<p>none</p>", []),
    ],
)
def test_nav_links(spark, html, links):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(H.nav_links(H.strip_invisible(F.col("h")))).first()[0] == links


def test_entities(spark):
    cases = {
        "&amp;lt;": "&lt;",
        "&#0;&#xD800;&#x110000;&#99999999999999999999;": "����",
        "&#x1F600;&#128512;": "😀😀",
        "&#146;&#150;&eacute;&Eacute;": "’–éÉ",
        "&copy&copyfoo; &": "©©foo; &",
        "Don&apos;t &nosuch; &NotEqualTilde; &hellip; &ampx &notit; &apos": "Don't &nosuch; ≂̸ … &x ¬it; &apos",
        "&#;&#x;&;": "&#;&#x;&;",
        "a & b": "a & b",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r.t: r.d for r in df.select("t", H.decode_entities(F.col("t")).alias("d")).collect()}
    assert got == cases


def test_first_or_last_of_repeated_attributes(spark):
    df = spark.createDataFrame([('<a x=1 x="2" y=3>',)], "t string")
    assert tuple(df.select(H.attribute(F.col("t"), "x"), H.attribute(F.col("t"), "x", last=True)).first()) == ("1", "2")


def test_unclosed_headings_stay_linear(spark):
    page = "<h2>word " * 40_000
    df = spark.createDataFrame([(page,)], "h string").select(F.size(H.html_headings(F.col("h"))).alias("n"))
    assert df.first().n == 40_000


@pytest.mark.parametrize("html, headings", [
    ("<h1>one<h2>two</h2>three</h1><h3>four", ["one two three", "two", "four"]),
    ("<h2>q<h2>b</h2>c</h2><h1>d", ["d", "q b c", "b"]),
    ("<h2>q<h2>b</h2><p>c", ["q", "b"]),  # the outer one is not closed
    ("</h1><h1>q</h1></h1>b<h1>c</h1>", ["q", "c"]),
    ("<h1>q<h4>b</h4>c</h1><h1>d<h4>e", ["q b c", "d"]),
    ("<H1 class='x'>q<h1>b<h1>c</H1>d</h1>e</h1>f", ["q b c d e", "b c d", "c"]),
])
def test_nested_headings(spark, html, headings):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(H.html_headings(F.col("h")).alias("x")).first().x == headings


@pytest.mark.parametrize("html, links", [
    ("<nav><a href=1><nav><a href=2></nav><a href=3></nav><a href=4>", ["1", "2", "3"]),
    ("</nav><a href=1><nav></nav></nav><a href=2><nav><a href=3>", ["3"]),
])
def test_nested_nav(spark, html, links):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(H.nav_links(F.col("h")).alias("x")).first().x == links


@pytest.mark.parametrize("html, text", [
    ('<div>no</div><div class="main content">One <div>two</div><p>three</p></div><div>out</div>', "one two three"),
    ("<div class=content>a1<div><div>b</div></div>c<p>d", "b c d"),
    ("<div class='contents'>x</div><div class='my-content'>x</div><div class=CONTENT>x</div><p class=content>x", None),
    ("</div></div><DIV CLASS='\tcontent\n'>first</DIV><div class=content>second</div>", "first"),
    ("<div class='x'>u<div class=content>v</div>w</div>", "v"),
    ("<div title='content' class=x>u</div>", None),
    ("<div class=content>42 the</div><div class=content>late</div>", None),
    ("<div class=content></div>", None),
    ("plain content", None),
    ("", None),
    (None, None),
])
def test_div_content(spark, html, text):
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(H.html_div_content(H.strip_invisible(F.col("h"))).alias("x")).first().x == text


class Walk(HTMLParser):
    """Headings, navigation links and the content region, by counting open elements per name."""

    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.headings, self.links, self.open, self.navs = [], [], [], 0
        self.body, self.depth, self.found = [], 0, False
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        if re.fullmatch("h[1-6]", tag):
            for h in self.open:
                h.setdefault("next", len(h["text"]))
            self.headings.append({"tag": tag, "text": [], "closed": False})
            self.open.append(self.headings[-1])
        self.navs += tag == "nav"
        if tag == "a" and self.navs and dict(attrs).get("href") is not None:
            self.links.append(dict(attrs)["href"])
        if tag == "div":
            self.depth += self.depth > 0
            if not self.found and "content" in (dict(attrs).get("class") or "").split():
                self.found, self.depth = True, 1
        self.handle_data(" ")

    def handle_endtag(self, tag):
        self.handle_data(" ")
        for h in reversed(self.open):
            if h["tag"] == tag:
                h["closed"] = True
                self.open.remove(h)
                break
        self.navs -= tag == "nav" and self.navs > 0
        self.depth -= tag == "div" and self.depth > 0

    def handle_data(self, data):
        for h in self.open:
            h["text"].append(data)
        if self.depth:
            self.body.append(data)

    def heading_texts(self):
        return ["".join(h["text"] if h["closed"] else h["text"][: h.get("next")]).split()
                for n in "123" for h in self.headings if h["tag"] == f"h{n}"]


def test_against_a_walk(spark):
    chance = random.Random(12)
    bits = [f"<{end}{t}>" for t in ("h1", "h2", "h3", "h4", "nav", "div", "p") for end in ("", "/")]
    bits += ["<div class='content'>", "<div class='a content b'>", "<div class=x>", "<a href=/{}>", "</a>", "<a>"] + ["w{} "] * 6
    pages = ["".join(chance.choice(bits).format(chr(97 + chance.randrange(26)) * 4) for _ in range(chance.randrange(1, 60)))
             for _ in range(600)]
    pages.append("".join(chance.choice(bits).format("word") for _ in range(6_000)))
    df = spark.createDataFrame(list(enumerate(pages)), "i int, h string").repartition(4)
    got = df.select("i", H.html_headings(F.col("h")).alias("headings"), H.nav_links(F.col("h")).alias("links"),
                    H.html_div_content(F.col("h")).alias("body")).collect()
    for row in got:
        walk = Walk(pages[row.i])
        want = [" ".join(t) for t in walk.heading_texts() if t] or None
        assert row.headings == want, pages[row.i]
        assert row.links == walk.links, pages[row.i]
        assert row.body == (" ".join("".join(walk.body).split()) or None), pages[row.i]


def test_long_pages_stay_linear(spark):
    page = "<nav><a href=x>" * 30_000 + "</nav>" * 30_000 + "<div class=content>" + "<div>w" * 30_000 + "</div>" * 30_000
    df = spark.createDataFrame([(page,)], "h string")
    links, body = df.select(F.size(H.nav_links(F.col("h"))), H.html_div_content(F.col("h"))).first()
    assert links == 30_000 and len(body) == 59_999


def test_running_depth(spark):
    chance = random.Random(2)
    rows = [[chance.choice([1, -1, 0]) for _ in range(n)] for n in (0, 1, 127, 128, 129, 1_000)]
    df = spark.createDataFrame([(r,) for r in rows], "d array<int>")

    def depths(deltas):
        out, depth = [], 0
        for d in deltas:
            depth = max(0, depth + d)
            out.append(depth)
        return out

    assert [r[0] for r in df.select(running_depth(F.col("d"))).collect()] == [depths(r) for r in rows]
