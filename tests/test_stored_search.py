import random

import pytest
from pyspark.sql import functions as F

from pagetrove.functions.grams import grams, literal_parts
from pagetrove.functions.patterns import make_pattern
from pagetrove.operators import search as S
from pagetrove.operators import stored_search
from pagetrove.schemas import STORED_DOC
from pagetrove.sources.store import append_store, create_store, scan_store


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Three batches of 400 rows in files of 50; each file has a word of its own, and some rows are odd."""
    path = str(tmp_path_factory.mktemp("store") / "store")
    create_store(spark, path)
    chance = random.Random(4)
    odd = ["100% _sure_ \\\\ İstanbul", "ÉTÉ été ß", "ab", "", "x\x00y日本語テキスト", "Σίσυφος ΟΔΟΣ"]
    for batch in range(3):
        rows = []
        for i in range(batch * 400 + 1, batch * 400 + 401):
            words = [f"file{(i - 1) // 50:03d}x"] + [chance.choice(["the", "Tion", "er on", "zebra%"]) for _ in range(4)]
            rows.append((i, None, "{" + chance.choice(odd) + "}", chance.choice([None, " ".join(words)]), None,
                         f"Title {i} " + words[0], f"u{i}"))
        rows = spark.createDataFrame(rows, STORED_DOC)
        append_store(rows.repartition(3), path, "r", batch, batch * 400 + 400, file_rows=50)
    return path


QUERIES = ["the", "TION", "er on", "file017x", "file01%x", "title 1200", "no such words", "_sure_", "100\\%", "%", "_", "ab", " ", "été",
           "istanbul", "日本語", "語テ", "\\\\\\\\", "zebra\\%", "ß", "x\x00y", "the%Tion", "οδος", "f_le", "\\f\\i\\l\\e"]


def rows_of(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("sizes", [(4, 4), (1, 1)])
def test_equals_a_scan(spark, store, monkeypatch, sizes):
    monkeypatch.setattr(stored_search, "FIRST_FILES", sizes[0])
    monkeypatch.setattr(stored_search, "GROWTH", sizes[1])
    docs = scan_store(spark, store)
    for query in QUERIES if sizes[0] == 4 else QUERIES[:4]:
        assert rows_of(stored_search.search_stored(spark, store, query)) == rows_of(S.search(docs, query)), query
    for query in ("", None):
        assert stored_search.search_stored(spark, store, query).count() == 0


def test_few_files_are_read(spark, store, monkeypatch):
    read = []

    def first_rows(spark, path, files, query, limit, keep=stored_search._first_rows):
        read.extend(f["file"] for f in files)
        return keep(spark, path, files, query, limit)

    monkeypatch.setattr(stored_search, "_first_rows", first_rows)

    def files(query):
        read.clear()
        stored_search.search_stored(spark, store, query)
        return len(read)

    assert files("title") == 4  # the first round is enough
    assert files("file017x") == 1
    assert files("file011") == 1
    assert files("no such words") == 0
    assert files("%") == 4 and files("qq") == 24  # short queries rule nothing out


def test_files_hold_ascending_ids(spark, store):
    from pagetrove.sources.store import read_side

    files = sorted((r.first, r.last, r.rows) for r in read_side(spark, store, "_files").collect())
    assert len(files) == 24 and all(a[1] < b[0] for a, b in zip(files, files[1:])) and sum(f[2] for f in files) == 1200


@pytest.mark.parametrize("bound", [S.QUERY_BYTES, 2_000])
def test_anchored_equals_one_by_one(spark, store, monkeypatch, bound):
    monkeypatch.setattr(S, "QUERY_BYTES", bound)
    docs = scan_store(spark, store)
    asked = spark.createDataFrame([(q,) for q in QUERIES + ["", None, "the"]], "q string")
    got = {}
    for r in S.search_anchored(docs, asked).collect():
        got.setdefault(r.q, []).append(tuple(r)[1:])
    want = {q: rows_of(S.search(docs, q)) for q in QUERIES}
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}


@pytest.mark.parametrize("first", [7, 100])
def test_anchored_in_rounds_equals_one_by_one(spark, store, monkeypatch, first):
    monkeypatch.setattr(S, "FIRST_DOCS", first)
    docs = scan_store(spark, store)
    more = ["zebra_ er", "file0_7x", "the%zebra%on", "file003x tion the", "x\x01y", "title 1_ file", "o\\_n", "\x00", "\x00\x00", "\x02", "\x03"]
    queries = QUERIES + more
    got = {}
    for r in S.search_anchored(docs, spark.createDataFrame([(q,) for q in queries], "q string")).collect():
        got.setdefault(r.q, []).append(tuple(r)[1:])
    want = {q: rows_of(S.search(docs, q)) for q in queries}
    assert {q: sorted(v) for q, v in got.items()} == {q: v for q, v in want.items() if v}


def test_anchored_queries_meet_as_few_rows_as_match(spark, store):
    """Each trigram of a query is frequent, all of it is rare; a query with 20 rows takes no further documents."""
    asked = spark.createDataFrame([("on%r on",), ("file01_x",), ("er on t",), ("a longer query than a window",)], "q string")
    marked = asked.select("q", S._marked(F.lower(S._pattern(F.col("q")))).alias("m"))
    windows = {r.q: sorted(r.w) for r in marked.select("q", S._query_windows(F.col("m")).alias("w")).collect()}
    assert windows["on%r on"] == ["r on"] and windows["file01_x"] == ["file01"] and windows["er on t"] == ["er on t"]
    assert len(windows["a longer query than a window"]) == 21
    docs = scan_store(spark, store).select(F.struct("*").alias("_d"), F.col("id").alias("_id"), F.lit("ab1cd").alias("_text"), "id")
    rounds = S._rounds(docs, 10_000)
    assert len(rounds) > 1
    counts = [docs.where(r).count() for r in rounds]
    assert sum(counts) == 1200 and all(0 < a < b for a, b in zip(counts, counts[1:-1]))


def test_anchored_meets_only_rows_with_the_rarest_gram(spark, store):
    asked = spark.createDataFrame([("the file017x",), ("e file017x er",)], "q string")
    frame = S.search_anchored(scan_store(spark, store), asked)
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert S.search_anchored(scan_store(spark, store), spark.createDataFrame([], "q string")).count() == 0


def test_too_many_short_queries_are_refused(spark, store, monkeypatch):
    monkeypatch.setattr(S, "SHORT_QUERIES", 1)
    with pytest.raises(ValueError, match="short|three"):
        S.search_anchored(scan_store(spark, store), spark.createDataFrame([("a",), ("b",)], "q string"))


def test_literal_parts():
    assert literal_parts(make_pattern("a%bc_d")) == ["a", "bc", "d"]
    assert literal_parts(make_pattern("100\\% \\_x\\\\y\\z")) == ["100% _x\\yz"]
    assert literal_parts("%") == []


def test_grams(spark):
    df = spark.createDataFrame([("ABcab cAB",), ("é日本",), ("ab",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(grams(F.col("t"))).collect()]
    assert got == [["abc", "bca", "cab", "ab ", "b c", " ca"], ["é日本"], [], [], None]
