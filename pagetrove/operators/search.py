"""Substring search over stored documents."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import ilike_any, make_pattern
from ..session import settle, settle_counted

# Fixed value: rows per answer.
RESULT_LIMIT = 20
SEARCHED = ("title", "description", "content")

# Queries answered in one pass over the documents; more take further passes.
QUERIES_PER_PASS = 64

# Bytes of queries and their windows that one pass of anchored queries broadcasts, and how many queries without a
# trigram there may be.
QUERY_BYTES = 32_000_000
SHORT_QUERIES = 4_096

# Documents of the first round of anchored queries, and how much larger each round is than the one before.
FIRST_DOCS, GROWTH = 2_048, 4

# Characters of a window without a hole, and on the left and right of a hole.
WINDOW, BEFORE, AFTER = 8, 4, 3

# In a marked pattern: where a window ends, one character that may be any, and stand-ins while pairs are resolved.
_CUT, _HOLE, _PAIRS = "\u0002", "\u0001", "\u0003\u0004\u0005"

# What searched columns are joined with; no window holds it, and a hole takes only half of it.
_JOIN = "\u0000\u0000"


def matches(query: str) -> Column:
    """Case-insensitive match in any searched column."""
    return ilike_any(make_pattern(query), *SEARCHED)


def search(
    docs: DataFrame, query: str | None, limit: int = RESULT_LIMIT, ordered: bool = True
) -> DataFrame:
    """First ``limit`` matching rows by id. No query, no rows; a blank is a query.

    ``ordered=False`` takes any matching rows and stops reading early.
    """
    if not query:
        return docs.limit(0)
    found = docs.where(matches(query))
    return (found.orderBy("id") if ordered else found).limit(limit)


def search_sql(docs: DataFrame, query: str | None, limit: int = RESULT_LIMIT) -> DataFrame:
    """``search`` as SQL text with bound parameters; values never enter the text."""
    if not query:
        return docs.limit(0)
    return docs.sparkSession.sql(
        """
        SELECT * FROM {docs}
        WHERE title ILIKE :pattern OR description ILIKE :pattern OR content ILIKE :pattern
        ORDER BY id LIMIT :rows
        """,
        args={"pattern": make_pattern(query), "rows": limit},
        docs=docs,
    )


def search_many(
    docs: DataFrame, queries: Sequence[str | None], limit: int = RESULT_LIMIT
) -> DataFrame:
    """``search`` for many queries: the first rows of each, with a column ``q``.

    The patterns are constants of the plan, so each document is tested where it
    is read and only matches are emitted. Every task keeps ``limit`` rows per
    query before the shuffle, so a query that matches everything moves no more
    than others do.
    """
    asked = list(dict.fromkeys(q for q in queries if q))
    passes = [
        _search_pass(docs, asked[i : i + QUERIES_PER_PASS], limit)
        for i in range(0, len(asked), QUERIES_PER_PASS)
    ]
    if not passes:
        return docs.limit(0).withColumn("q", F.lit(""))
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def _search_pass(docs: DataFrame, queries: list[str], limit: int) -> DataFrame:
    hits = F.array_compact(F.array(*[F.when(matches(q), F.lit(q)) for q in queries]))
    return _first_per_query(docs.withColumn("q", F.explode(hits)), limit)


def search_anchored(docs: DataFrame, queries: DataFrame, limit: int = RESULT_LIMIT) -> DataFrame:
    """``search_many`` for a table of queries (column ``q``), hundreds of thousands of them.

    A query is anchored at a window of up to WINDOW characters that its matches must hold, or at one with a hole where
    the query has ``_``; of several, at the one that fewest documents hold. A document meets only queries whose window it has.
    Documents are taken in the order of ids, in rounds that grow by GROWTH, and a query with ``limit`` rows leaves: what
    still waits is rare among the documents seen, so a round yields some ``limit`` times GROWTH rows a query however many
    documents it has. Queries are broadcast QUERY_BYTES at a time, so documents are not shuffled with their texts, and tasks
    keep ``limit`` rows per query. Queries of wildcards alone meet every document, QUERIES_PER_PASS at a time.
    ``docs`` is read once and should have distinct ids.
    """
    pattern = _pattern(F.col("q"))
    asked = settle(queries.where(F.col("q") != "").select("q").distinct().select(
        "q", pattern.alias("pattern"), _marked(F.lower(pattern)).alias("_marked")), "queries")
    whole = F.concat(F.lit(_CUT), F.get("windows", F.lit(0)), F.lit(_CUT))
    clear = ~F.col("q").rlike("[\\x00-\\x05]")
    asked = settle(asked.withColumn("windows", _query_windows(F.col("_marked"))).select(
        "q", "pattern", "windows",
        # Such a query is its window: what holds it needs no further test.
        (clear & (F.size("windows") == 1) & (F.col("_marked") == whole)).alias("exact"),
        F.when(clear & ~F.contains("_marked", F.lit(_HOLE)), F.array_remove(F.split("_marked", _CUT), "")).alias("pieces"),
        F.col("_marked").rlike(f"[^{_CUT}{_HOLE}]{{3}}").alias("_trigram")), "query-windows")
    if asked.where(~F.col("_trigram")).count() > SHORT_QUERIES:
        raise ValueError(f"more than {SHORT_QUERIES} queries without three literal characters in a row")
    text = F.concat_ws(_JOIN, *[F.lower(c) for c in SEARCHED])
    # Dealt out, so that every round has work for all tasks.
    dealt = docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, docs.rdd.getNumPartitions()))
    placed, rows = settle_counted(dealt.select(
        F.struct(*docs.columns).alias("_d"), F.col("id").alias("_id"), text.alias("_text"),
        F.monotonically_increasing_id().alias("_place")), "searched")
    waiting, found = asked.where(F.size("windows") > 0), []
    rounds = _rounds(placed, rows)
    for n, here in enumerate(rounds):
        hits = _anchored_hits(placed.where(here), waiting, limit)
        found.append(hits if n == len(rounds) - 1 else settle(hits, "hits"))
        if n < len(rounds) - 1:
            full = _union(found).groupBy("q").count().where(F.col("count") >= limit)
            waiting = settle(waiting.join(full, "q", "left_anti"), "waiting")
    # The documents go along as structs, so that no column of theirs meets one of ours.
    first = _first_per_query(_union(found), limit, "_id", "_place")
    out = first.select("q", "_place").join(placed.select("_place", "_d"), "_place").select("q", "_d.*")
    # Wildcards alone; collected only as the constants of a pass.
    short = [r["q"] for r in asked.where(F.size("windows") == 0).orderBy("q").collect()]
    if short:
        out = out.unionByName(search_many(docs, short, limit).select("q", *docs.columns))
    return out


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def _rounds(placed: DataFrame, rows: int) -> list[Column]:
    """Conditions on ``_id`` that split the documents into rounds; about where they end is enough."""
    ends, size, end = [], FIRST_DOCS, FIRST_DOCS
    while end < rows:
        ends.append(end / rows)
        size *= GROWTH
        end += size
    if not ends:
        return [F.lit(True)]
    cuts = placed.agg(F.percentile_approx("_id", ends)).first()[0]
    cuts = sorted(set(cuts or []))
    if not cuts:
        return [F.lit(True)]
    at = F.col("_id")
    # Rows without an id come first.
    between = [(at > a) & (at <= b) for a, b in zip(cuts, cuts[1:])]
    return [at.isNull() | (at <= cuts[0]), *between, at > cuts[-1]]


def _anchored_hits(part: DataFrame, waiting: DataFrame, limit: int) -> DataFrame:
    """(q, _id, _place): the first documents of ``part`` for each query."""
    octets = F.octet_length("q") * (2 + F.size("windows")) + 64
    total, several = waiting.agg(F.sum(octets), F.count_if(F.size("windows") > 1)).first()
    meeting, found = _meeting(part, waiting), []
    passes = max(1, -(-(total or 0) // QUERY_BYTES))
    for n in range(passes):
        own = waiting.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == n)
        anchored = own.where(F.size("windows") == 1).select("q", "pattern", "exact", "pieces", F.get("windows", F.lit(0)).alias("window"))
        if several:
            open_ = own.where(F.size("windows") > 1).select(
                "q", "pattern", "exact", "pieces", F.size("windows").alias("size"), F.explode("windows").alias("window"))
            often = _meeting(part, open_.select(F.array("window").alias("windows"))).join(F.broadcast(open_.select("window").distinct()), "window").groupBy("window").agg(
                F.count(F.lit(1)).alias("n"))
            # Windows that no document holds are left out: such a query has no match.
            rarest = open_.join(often, "window").groupBy("q", "pattern", "exact", "pieces", "size").agg(
                F.min(F.struct("n", "window")).alias("anchor"), F.count(F.lit(1)).alias("there"))
            anchored = anchored.unionByName(rarest.where(F.col("there") == F.col("size")).select(
                "q", "pattern", "exact", "pieces", F.col("anchor.window").alias("window")))
        met = meeting.join(F.broadcast(settle(anchored, "anchors")), "window")
        hit = F.col("exact")
        for column in SEARCHED:
            one = F.col(f"_d.{column}")
            held = F.when(F.col("pieces").isNotNull(), _in_order(F.col("pieces"), F.lower(one))).otherwise(
                F.call_function("ilike", one, F.col("pattern")))
            hit = hit | F.coalesce(held, F.lit(False))
        found.append(_first_per_query(met.where(hit).select("q", "_id", "_place"), limit, "_id", "_place"))
    return _union(found)


def _meeting(part: DataFrame, queries: DataFrame) -> DataFrame:
    """(_d, _id, _place, window): documents by their windows in the shapes of the queries'."""
    shape = F.regexp_replace(F.col("window"), f"[^{_HOLE}]", "x")
    shapes = [r[0] for r in queries.select(F.explode("windows").alias("window")).select(shape).distinct().collect()]
    # An inner explode would have its array made twice, once for a filter on its size.
    return part.select("_d", "_id", "_place", F.explode_outer(_text_windows(F.col("_text"), shapes)).alias("window"))


def _in_order(pieces: Column, text: Column) -> Column:
    """Whether a lower-case text holds the pieces one after the other: a pattern without ``_``, without its regular expression."""
    def after(at: Column, piece: Column) -> Column:
        found = F.position(piece, text, at)
        return F.when((at > 0) & (found > 0), found + F.char_length(piece)).otherwise(0)

    return F.aggregate(pieces, F.lit(1), after) > 0


def _marked(pattern: Column) -> Column:
    """A pattern of ``_pattern`` with _CUT for ``%``, _HOLE for ``_`` and its pairs resolved.

    A character of the pattern that is a mark itself counts as a hole, which only makes the window weaker.
    """
    marked = F.translate(pattern, _JOIN[0] + _CUT + _PAIRS, _HOLE * 5)
    pairs = dict(zip(("\\\\", "\\%", "\\_"), _PAIRS))
    for old, new in pairs.items():
        marked = F.replace(marked, F.lit(old), F.lit(new))
    return F.translate(marked, "%_" + _PAIRS, _CUT + _HOLE + "\\%_")


def _query_windows(marked: Column) -> Column:
    """Windows that every match holds; of all, those with the most literal characters."""
    one = f"[^{_CUT}{_HOLE}]"
    runs = F.regexp_extract_all(marked, F.lit(f"{one}+"), F.lit(0))
    plain = F.flatten(F.transform(runs, lambda run: F.when(F.char_length(run) <= WINDOW, F.array(run)).otherwise(
        F.regexp_extract_all(run, F.lit(f"(?s)(?=(.{{{WINDOW}}}))."), F.lit(1)))))
    holed = F.regexp_extract_all(marked, F.lit(f"{one}{{1,{BEFORE}}}{_HOLE}{one}{{1,{AFTER}}}"), F.lit(0))

    def literal(window: Column) -> Column:
        return F.char_length(window) - F.contains(window, F.lit(_HOLE)).cast("int")

    every = F.array_distinct(F.concat(plain, holed))
    most = F.array_max(F.transform(every, literal))
    return F.filter(every, lambda window: literal(window) == most)


def _text_windows(text: Column, shapes: list[str]) -> Column:
    """Distinct windows of a lower-case text in the given shapes, such as ``xxx`` or ``xx\u0001x``."""
    if not shapes:
        return F.array().cast("array<string>")
    kinds = []
    for shape in sorted(shapes):
        before, hole, after = shape.partition(_HOLE)
        kinds.append(F.struct(
            F.lit(len(shape)).alias("size"), F.lit(len(before)).alias("before"), F.lit(hole).alias("hole"), F.lit(len(after)).alias("after")))

    def cut(longest: Column) -> Column:
        return F.transform(F.array(*kinds), lambda kind: F.when(F.char_length(longest) >= kind["size"], F.concat(
            F.substring(longest, F.lit(1), kind["before"]), kind["hole"],
            F.substring(longest, kind["before"] + 2, kind["after"]))))

    # One pass finds the longest window at every place; all shapes are cut from it, in little code.
    longest = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{WINDOW}}}))."), F.lit(1))
    return F.array_compact(F.array_distinct(F.flatten(F.transform(longest, cut))))


def _pattern(query: Column) -> Column:
    """``make_pattern`` of a column."""
    # A backslash before any other character goes; pairs are passed over whole.
    return F.regexp_replace(F.concat(F.lit("%"), query, F.lit("%")), r"(?s)(\\[\\%_])|\\", "$1")


def _first_per_query(hits: DataFrame, limit: int, *order: str) -> DataFrame:
    first = Window.partitionBy("q").orderBy(*order or ["id"])
    return hits.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= limit).drop("_rank")


def display(results: DataFrame) -> DataFrame:
    """What a result page shows, numbered from 0. For the rows of one answer."""
    place = Window.orderBy("id")
    return results.select(
        (F.row_number().over(place) - 1).alias("position"), "url", "title", "description"
    )


def result_json(results: DataFrame, query: str | None) -> DataFrame:
    """One row with the answer as JSON text. For the rows of one answer."""
    if not query:
        return results.sparkSession.range(1).select(F.lit('{"results":[]}').alias("json"))
    columns = ["id"] + [c for c in results.columns if c != "id"]
    sites = F.sort_array(F.collect_list(F.struct(*columns)))
    answer = F.struct(F.struct(sites.alias("sites"), F.lit(query).alias("defaultQuery")).alias("results"))
    return results.agg(F.to_json(answer, {"ignoreNullFields": "false"}).alias("json"))
